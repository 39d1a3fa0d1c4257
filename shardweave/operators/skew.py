"""Joins whose keys may be very uneven: find the heavy keys by a mergeable sketch, deal only their rows to more tasks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items a sketch tracks; a count is too large by at most 3.5 / TRACKED of all rows.
TRACKED = 2048


def heavy_sketches(df: DataFrame, key: str, by: Sequence[str] = (), tracked: int = TRACKED) -> DataFrame:
    """A sketch of the most frequent keys for each group, as a table that can be stored, and its number of rows."""
    keyed = df.filter(F.col(key).isNotNull())
    return keyed.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(`{key}`, {tracked})").alias("sketch"), F.count(F.lit(1)).alias("n_rows"))


def heavy_keys(sketches: DataFrame, share: float = 0.01, tracked: int = TRACKED) -> dict[object, int]:
    """Keys that may hold ``share`` of all rows, with an upper bound of their rows, merged from stored sketches.

    Counts of a sketch are never too small, so no such key is missed.  There are at most ``1 / (share - 3.5 / tracked)``.
    """
    spare = share - 3.5 / tracked
    if spare <= 0:
        raise ValueError(f"a sketch of {tracked} items does not tell keys of a share of {share}")
    most = min(int(1 / spare) + 1, tracked)
    merged = sketches.agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("s"), F.sum("n_rows").alias("n"))
    found = merged.filter("n > 0").select("n", F.explode(F.expr(f"approx_top_k_estimate(s, {most})")).alias("e")).select("n", "e.item", "e.count")
    return {r["item"]: r["count"] for r in found.collect() if r["count"] >= share * r["n"]}


def _one_of(column: Column, keys: Sequence[object]) -> Column:
    return F.coalesce(column.isin(list(keys)), F.lit(False))


def spread_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, heavy: Mapping[object, int],
    rows: int = 1_000_000, how: str = "inner", deal: Column | None = None,
) -> DataFrame:
    """Equi-join that gives a heavy key of the left side one task for every ``rows`` of its rows.

    Rows of other keys are joined as they lie: bucketed tables keep their buckets.  Left rows of a heavy key are
    dealt by ``deal`` (a whole number that is the same whenever a row is computed again; unless given, a hash
    of the row), right rows of it are repeated for every part.  ``how``: inner or left.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a spread join is inner or left, not {how}")
    if not heavy:
        return left.join(right, left[left_key] == right[right_key], how)
    keys = list(heavy)
    rest = left.filter(~_one_of(left[left_key], keys)).join(
        right.filter(~_one_of(right[right_key], keys)), F.col(left_key) == F.col(right_key), how
    )
    parts = F.create_map(*[F.lit(v) for k, n in heavy.items() for v in (k, max(1, -(-n // rows)))])
    number = F.xxhash64(*left.columns) if deal is None else deal
    dealt = left.filter(_one_of(left[left_key], keys)).withColumn("__part", F.pmod(number, parts[F.col(left_key)]).cast("long"))
    spread = F.explode(F.sequence(F.lit(0).cast("long"), (parts[F.col(right_key)] - 1).cast("long")))
    copies = right.filter(_one_of(right[right_key], keys)).withColumn("__copy", spread)
    hot = dealt.join(copies, (F.col(left_key) == F.col(right_key)) & (F.col("__part") == F.col("__copy")), how).drop("__part", "__copy")
    return reduce(DataFrame.unionByName, [rest, hot])
