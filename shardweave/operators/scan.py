"""Running values over an order, safe for keys that hold a large part of all rows.

A plain window by key puts all rows of a key into one task.  Here rows are windowed by
(key, bucket), where buckets cut the order into consecutive pieces, and each bucket gets
the carry of the earlier buckets of its key from a table with one row per (key, bucket).
Results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "__key"
BUCKET = "__bucket"

MICROS = 1_000_000
MINUTE = 60 * MICROS
HOUR = 60 * MINUTE
DAY = 24 * HOUR
_STRETCHES = 4096
MAX_HOT = 10_000
#: Rows of a key, and of a key within one window's length, up to which a plain range frame sums them.
HOT_ROWS, FRAME_ROWS = 1_000_000, 1000


def micros(ts: Column | str) -> Column:
    """LONG microseconds since the epoch of a timestamp with or without zone."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def bucket_of(order: Column | str, width: int) -> Column:
    """Number of the bucket of ``width`` consecutive LONG order values, rounded down."""
    col = F.col(order) if isinstance(order, str) else order
    size = F.lit(width).cast("long")
    return F.call_function("div", col - F.pmod(col, size), size)


def even_width(df: DataFrame, order: str, rows_per_bucket: int = 1_000_000, longest: int = DAY) -> int:
    """Bucket width that keeps about ``rows_per_bucket`` rows in the fullest stretch of the order.

    Two small aggregates over the order column: its span, then the fullest of some thousand
    equal stretches.  A key can never have more rows in a bucket than all keys together.
    """
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None or lo == hi:
        return longest
    stretch = max((hi - lo) // _STRETCHES, 1)
    counts = df.filter(F.col(order).isNotNull()).groupBy(bucket_of(order, stretch).alias("stretch")).count()
    fullest = counts.agg(F.max("count")).first()[0]
    return max(1, min(longest, stretch * rows_per_bucket // fullest))


def _is_one_of(counts: DataFrame, keys: Sequence[str]) -> Column:
    """Whether a row's key is one of the keys of ``counts``; always true beyond ``MAX_HOT`` of them."""
    hot = [r[0] for r in counts.select(F.xxhash64(*keys)).limit(MAX_HOT + 1).collect()]
    if len(hot) > MAX_HOT:
        return F.lit(True)
    return F.xxhash64(*keys).isin(hot) if hot else F.lit(False)


def dense_keys(df: DataFrame, keys: Sequence[str], at: str, window: int) -> Column:
    """Whether a row's key has more than ``HOT_ROWS`` rows, or more than ``FRAME_ROWS`` within one window's length.

    A frame of ``window`` covers at most two stretches of that length, so other keys have small frames.
    """
    stretches = df.groupBy(*keys, bucket_of(at, max(window, 1)).alias("__stretch")).agg(F.count(F.lit(1)).alias("__n"))
    counts = stretches.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.max("__n").alias("__most"))
    return _is_one_of(counts.filter((F.col("__n") > HOT_ROWS) | (F.col("__most") > FRAME_ROWS)), keys)


def split_hot(df: DataFrame, keys: Sequence[str], bucket: Column, hot_rows: int = HOT_ROWS) -> Column:
    """``bucket`` for keys with more than ``hot_rows`` rows, one bucket for every other key.

    Runs one count per key, combined before its shuffle.  Only hashes of hot keys come to the
    driver, at most ``MAX_HOT`` of them; with more hot keys than that all keys are bucketed.
    A key that shares its hash with a hot one is bucketed too, which changes no result.
    """
    hot = _is_one_of(df.groupBy(*keys).count().filter(F.col("count") > hot_rows), keys)
    return F.when(hot, bucket).otherwise(F.lit(0).cast("long"))


def scan_ready(df: DataFrame, keys: Sequence[str], bucket: Column) -> DataFrame:
    """Append the scan columns: the keys as one struct, and the bucket.

    Keys are compared as a struct because two structs with the same NULLs are equal, so the
    join to the carries needs no NULL-safe form and keeps the partitioning of the window.
    """
    key = F.struct(*keys) if keys else F.lit(0)
    return df.withColumns({KEY: key, BUCKET: bucket})


def scan_step(
    rows: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """One scan over rows with scan columns.  Steps in a row share one shuffle of the rows."""
    sums, maxes, previous = dict(sums or {}), dict(maxes or {}), dict(previous or {})
    kept = rows.columns
    rows = rows.withColumns({f"__in_{out}": col for out, col in {**sums, **maxes, **previous}.items()})

    def given(out: str) -> Column:
        return F.col(f"__in_{out}")

    # The last row of a bucket, as one struct, is all that ``previous`` needs.
    aggs = [F.sum(given(o)).alias(f"__sum_{o}") for o in sums]
    aggs += [F.max(given(o)).alias(f"__max_{o}") for o in maxes]
    if previous:
        row = F.struct(*[given(o).alias(o) for o in previous])
        aggs.append(F.max_by(row, F.struct(*order)).alias("__row"))
    by_bucket = Window.partitionBy(KEY).orderBy(BUCKET)
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy(KEY, BUCKET).agg(*aggs).select(
        F.col(KEY).alias("__carry_key"),
        F.col(BUCKET).alias("__carry_bucket"),
        *[F.sum(f"__sum_{o}").over(earlier).alias(f"__carry_{o}") for o in sums],
        *[F.max(f"__max_{o}").over(earlier).alias(f"__carry_{o}") for o in maxes],
        *([F.lag("__row").over(by_bucket).alias("__carry_row")] if previous else []),
    )

    inside = Window.partitionBy(KEY, BUCKET).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    local = rows.withColumns(
        {
            **{f"__local_{o}": F.sum(given(o)).over(upto) for o in sums},
            **{f"__local_{o}": F.max(given(o)).over(upto) for o in maxes},
            **{f"__local_{o}": F.lag(given(o)).over(inside) for o in previous},
            **({"__nth": F.row_number().over(inside)} if previous else {}),
        }
    )
    same = (F.col(KEY) == F.col("__carry_key")) & (F.col(BUCKET) == F.col("__carry_bucket"))
    joined = local.join(carry, same, "left")
    return joined.select(
        *kept,
        *[
            F.when(
                F.col(f"__local_{o}").isNotNull() | F.col(f"__carry_{o}").isNotNull(),
                F.coalesce(f"__local_{o}", F.lit(0)) + F.coalesce(f"__carry_{o}", F.lit(0)),
            ).alias(o)
            for o in sums
        ],
        *[F.greatest(f"__local_{o}", f"__carry_{o}").alias(o) for o in maxes],
        *[
            F.when(F.col("__nth") == 1, F.col("__carry_row")[o]).otherwise(F.col(f"__local_{o}")).alias(o)
            for o in previous
        ],
    )


def scan_done(rows: DataFrame) -> DataFrame:
    return rows.drop(KEY, BUCKET)


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Append running sums, running maxima and previous-row values per key.

    ``bucket`` must not decrease along ``order``, and ``order`` must be unique per key.
    Running values include the current row unless ``exclusive``; a previous value is NULL
    on the first row of its key.
    """
    return scan_done(scan_step(scan_ready(df, keys, bucket), order, sums, maxes, previous, exclusive))


def trailing_sum(
    df: DataFrame, keys: Sequence[str], at: str, window: int, value: Column, out: str, width: int | None = None, dense: Column | None = None
) -> DataFrame:
    """Append the sum of ``value`` over the rows of the key in ``[at - window, at]``; NULL adds nothing.

    Keys with few rows in a window are summed by a range frame.  Those that ``dense`` names (``dense_keys`` of
    ``df`` by default) go through one ordered scan however many rows a window holds: a value enters a running
    sum at its time and leaves it after ``window``, and a window may be longer than a bucket.
    Floating values are summed as DECIMAL, because what enters must leave without a trace.
    """
    if dense is None:
        dense = dense_keys(df, keys, at, window)
    valued = df.withColumn("__value", value)
    kind = valued.schema["__value"].dataType
    floating = isinstance(kind, (T.FloatType, T.DoubleType))
    added = F.col("__value").cast("decimal(38,10)") if floating else F.col("__value")

    def summed(total: Column) -> Column:
        whole = F.coalesce(total, F.lit(0))
        return (whole.cast(kind) if floating else whole).alias(out)

    frame = Window.partitionBy(*keys).orderBy(at).rangeBetween(-window, 0)
    sparse = valued.filter(~dense).select(*df.columns, summed(F.sum(added).over(frame)))

    valued = valued.filter(dense)
    own = F.struct(*df.columns)
    none = F.lit(None).cast(df.select(own.alias("r")).schema["r"].dataType)

    def events(time: Column, side: int, amount: Column, row: Column) -> DataFrame:
        number = F.monotonically_increasing_id().alias("__id")
        return valued.select(*keys, time.alias("__at"), F.lit(side).alias("__side"), number, amount.alias("__add"), row.alias("__row"))

    # at one time: what enters, then the rows that ask, then what leaves
    rows = events(F.col(at), 0, added, none).unionByName(events(F.col(at), 1, added - added, own))
    rows = rows.unionByName(events(F.col(at) + F.lit(window), 2, -added, none))
    scanned = ordered_scan(rows, keys, ["__at", "__side", "__id"], bucket_of("__at", width or 8 * window), sums={out: F.col("__add")})
    return sparse.unionByName(scanned.filter("__side = 1").select("__row.*", summed(F.col(out))))


def as_of_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, right_at: str, tie: str, values: Sequence[str], width: int
) -> DataFrame:
    """Left join of every row to the last ``right`` row of its key at or before ``at``.

    ``tie`` orders right rows of the same time.  Both sides run through one ordered scan, so
    neither side of a hot key is gathered or multiplied.
    """
    payload = F.struct(F.col(right_at).alias("at"), F.col(tie).alias("tie"), *values)
    lookups = left.select(
        *keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), F.monotonically_increasing_id().alias("__id"),
        F.lit(None).cast(right.select(payload.alias("r")).schema["r"].dataType).alias("__right"),
        F.struct(*left.columns).alias("__left"),
    )
    events = right.select(
        *keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.monotonically_increasing_id().alias("__id"),
        payload.alias("__right"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType).alias("__left"),
    )
    scanned = ordered_scan(
        lookups.unionByName(events), keys, ["__at", "__side", "__id"], bucket_of("__at", width),
        maxes={"__last": F.col("__right")},
    )
    return scanned.filter("__side = 1").select("__left.*", *[F.col(f"__last.{v}").alias(v) for v in values])
