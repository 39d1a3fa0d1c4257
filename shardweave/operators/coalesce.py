"""Bursts of signals merged into one: a fixed window opened by the first signal.

The next window of a key starts at its first signal after the last window closed, so
windows depend on all earlier ones.  Time is cut into buckets; for every bucket a small
table says when the last window closes for each signal that could open the first one.
These tables are chained per key, after which all buckets run independently.  A task
never holds more than one bucket of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardweave.operators.scan import BUCKET, bucket_of, even_width

NAME = "__name"
PART = "__part"
NEVER = np.iinfo(np.int64).min // 4


class _Timeline:
    """The signals of several keys in one bucket, laid out one key after the other."""

    def __init__(self, keys: pd.Series, at: np.ndarray, base: int, span: int, width: int) -> None:
        codes, self.names = pd.factorize(keys)
        order = np.lexsort((at, codes))
        self.code, self.at = codes[order], at[order]
        self.size, self.width = len(order), width
        # Keys are so far apart that a search never finds a signal of the wrong key by time alone.
        self.offset = np.arange(len(self.names), dtype=np.int64) * 4 * (span + width) - base
        self.place = self.at + self.offset[self.code]
        self.hop = np.append(self._first(self.place + width, self.code), self.size)

    def _first(self, place: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Index of the first signal of its key at or after each place; ``size`` when there is none."""
        found = np.searchsorted(self.place, place, side="left")
        padded = np.append(self.code, -1)
        return np.where(padded[found] == code, found, self.size)

    def first_after(self, code: np.ndarray, time: np.ndarray) -> np.ndarray:
        start = np.searchsorted(self.code, code, side="left")
        late = self._first(time + self.offset[code], code)
        return np.where(time <= self.at[start], start, late)

    def last_end(self, opener: np.ndarray) -> np.ndarray:
        """End of the last window when each opener opens the first one."""
        at = opener
        while True:
            ahead = self.hop[at]
            if (ahead == self.size).all():
                return self.at[at] + self.width
            at = np.where(ahead < self.size, ahead, at)


def coalesce_signals(df: DataFrame, key: str, at: str, width: int, rows_per_group: int = 500_000) -> DataFrame:
    """One row (key, start, emit_at) per window of ``width`` LONG time units.

    A window holds the signals in ``[start, start + width)``.  Buckets are made short enough
    that the fullest has about ``rows_per_group`` signals.  A bucket is never shorter than a
    window; where that makes buckets too full, their keys are spread over several groups.
    """
    even = even_width(df, at, rows_per_group, longest=1000 * width)
    span, parts = max(width, even), -(-max(width, even) // even)
    signals = df.select(
        # Keys travel as text, marked so that NULL is a key like any other.
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias(NAME),
        F.col(at).alias("at"),
        bucket_of(at, span).alias(BUCKET),
        F.pmod(F.xxhash64(key), F.lit(parts)).alias(PART),
    )

    def timeline(rows: pd.DataFrame) -> _Timeline:
        base = int(rows[BUCKET].iloc[0]) * span
        return _Timeline(rows[NAME], rows["at"].to_numpy(), base, span, width)

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        line, base = timeline(rows), int(rows[BUCKET].iloc[0]) * span
        early = line.at < base + width
        # Besides the signals of the first window length, the first one after it can open.
        follows = np.append(True, early[:-1] | (line.code[1:] != line.code[:-1]))
        opener = np.flatnonzero(early | follows)
        end, code = line.last_end(opener), line.code[opener]
        # Neighbouring openers that lead to the same end need one entry.
        last = np.append((end[1:] != end[:-1]) | (code[1:] != code[:-1]), True)
        return pd.DataFrame(
            {
                NAME: line.names.take(code[last]),
                BUCKET: rows[BUCKET].iloc[0],
                PART: rows[PART].iloc[0],
                "upto": line.at[opener][last],
                "end": end[last],
            }
        )

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Walk the tables in order of (key, bucket, upto); a bucket may span several batches."""
        name, bucket, busy, after = None, None, NEVER, None
        for rows in batches:
            keys, buckets = rows[NAME].to_numpy(dtype=object), rows[BUCKET].to_numpy()
            upto, end = rows["upto"].to_numpy(), rows["end"].to_numpy()
            cut = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (buckets[1:] != buckets[:-1])))
            opened, entries = [], []
            for a, b in zip(cut, np.append(cut[1:], len(keys))):
                if a > 0 or (keys[a], buckets[a]) != (name, bucket):
                    if keys[a] != name:
                        busy = NEVER
                    elif after is not None:
                        busy = after
                    name, bucket, after = keys[a], buckets[a], None
                    opened.append(a)
                    entries.append(busy)
                if after is None:
                    hit = a + int(np.searchsorted(upto[a:b], busy, side="left"))
                    after = int(end[hit]) if hit < b else None
            first = rows.iloc[opened]
            yield pd.DataFrame({NAME: first[NAME], BUCKET: first[BUCKET], PART: first[PART], "busy": entries})

    def windows(rows: pd.DataFrame) -> pd.DataFrame:
        line = timeline(rows)
        busy = rows.groupby(NAME, sort=False)["busy"].first().reindex(line.names).to_numpy()
        at = line.first_after(np.arange(len(line.names)), busy)
        found = []
        while (at < line.size).any():
            at = at[at < line.size]
            found.append(at)
            at = line.hop[at]
        opened = np.concatenate(found) if found else np.empty(0, np.int64)
        start = line.at[opened]
        return pd.DataFrame({NAME: line.names.take(line.code[opened]), "start": start, "emit_at": start + width})

    named = f"`{NAME}` string, `{BUCKET}` long, `{PART}` long"
    tables = signals.groupBy(PART, BUCKET).applyInPandas(summarise, f"{named}, upto long, end long")
    # Whole keys per task, walked in order batch by batch: no key has to fit into memory.
    walked = tables.repartition(NAME).sortWithinPartitions(NAME, BUCKET, "upto")
    entries = walked.mapInPandas(chain, f"{named}, busy long")
    joined = signals.join(entries, [NAME, BUCKET, PART])
    opened = joined.groupBy(PART, BUCKET).applyInPandas(windows, f"`{NAME}` string, start long, emit_at long")
    value = F.when(F.col(NAME) != "", F.expr(f"substr({NAME}, 2)")).cast(df.schema[key].dataType)
    return opened.select(value.alias(key), "start", "emit_at")
