"""Joining values to the interval that contains them, without a nested loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BIN_BITS = 20


def first_match(intervals: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Disjoint intervals equivalent to "the first listed interval that contains the value"."""
    edges = sorted({lo for lo, _, _ in intervals} | {hi + 1 for _, hi, _ in intervals})
    out: list[tuple[int, int, str]] = []
    for lo, after in zip(edges, edges[1:]):
        owner = next((s for a, b, s in intervals if a <= lo <= b), None)
        if owner is None:
            continue
        if out and out[-1][2] == owner and out[-1][1] + 1 == lo:
            out[-1] = (out[-1][0], after - 1, owner)
        else:
            out.append((lo, after - 1, owner))
    return out


def interval_case(value: Column, intervals: list[tuple[int, int, str]]) -> Column:
    """CASE over a short list of intervals; NULL when none contains the value."""
    branches = [(value.between(lo, hi), F.lit(shard)) for lo, hi, shard in intervals]
    head, *rest = branches
    return reduce(lambda case, b: case.when(*b), rest, F.when(*head))


def interval_join(
    df: DataFrame,
    value: str,
    intervals: DataFrame,
    lo: str,
    hi: str,
    on: tuple[str, ...] = (),
    bin_bits: int = HASH_BIN_BITS,
    small: bool = False,
) -> DataFrame:
    """Left join of ``df`` to the intervals with ``lo <= value <= hi`` and equal ``on`` columns.

    Intervals are repeated once per bin of ``2**bin_bits`` values they touch, so the join is
    an equi-join on the bin with a residual range check.  ``small`` is the caller's promise
    that the interval list is bounded; otherwise Spark decides by size whether to broadcast.
    """
    bins = F.sequence(F.shiftright(F.col(lo), bin_bits), F.shiftright(F.col(hi), bin_bits))
    binned = intervals.withColumn("__bin", F.explode(bins))
    if small:
        binned = F.broadcast(binned)
    left, right = df.withColumn("__bin", F.shiftright(F.col(value), bin_bits)).alias("v"), binned.alias("i")
    same = reduce(
        lambda a, b: a & b,
        [F.col(f"v.{c}") == F.col(f"i.{c}") for c in (*on, "__bin")],
        F.col(f"v.{value}").between(F.col(f"i.{lo}"), F.col(f"i.{hi}")),
    )
    extra = [F.col(f"i.{c}") for c in intervals.columns if c not in on]
    return left.join(right, same, "left").select(*[F.col(f"v.{c}") for c in df.columns], *extra)


def dyadic_cells(intervals: DataFrame, lo: str, hi: str, bits: int = 62, step: int = 2) -> DataFrame:
    """The intervals cut into aligned cells of ``2**(step * level)`` values: columns of the intervals, ``__level``, ``__cell``.

    A value of an interval lies in exactly one of its cells.  A level adds at most ``2**step - 1`` cells at either
    end, whatever the width; an interval without values (``lo > hi`` or a null bound) has none.  Bounds lie within
    ``bits`` bits.
    """

    def cells(level: int) -> str:
        k, up = step * level, step * (level + 1)
        # the whole cells of this level, and where those of the next level begin and end
        a, b = f"shiftright({lo} + {(1 << k) - 1}, {k})", f"shiftright({hi} + 1, {k})"
        span = lambda x, y: f"if({x} < {y}, sequence({x}, {y} - 1), array())"
        if up > bits:
            return f"transform({span(a, b)}, c -> struct({level} AS __level, c AS __cell))"
        c, d = f"shiftright({lo} + {(1 << up) - 1}, {up})", f"shiftright({hi} + 1, {up})"
        own = f"if({c} < {d}, concat({span(a, f'{c} * {1 << step}')}, {span(f'{d} * {1 << step}', b)}), {span(a, b)})"
        return f"transform({own}, c -> struct({level} AS __level, c AS __cell))"

    levels = ", ".join(cells(k) for k in range(-(-bits // step)))
    found = f"if({lo} <= {hi}, concat({levels}), array())"
    return intervals.selectExpr("*", f"inline({found})")


def dyadic_join(
    df: DataFrame,
    value: str,
    intervals: DataFrame,
    lo: str,
    hi: str,
    on: tuple[str, ...] = (),
    how: str = "inner",
    bits: int = 62,
    step: int = 2,
    small: bool = False,
    sums: dict[str, Column] | None = None,
) -> DataFrame:
    """Join of ``df`` to all intervals with ``lo <= value <= hi`` and equal ``on`` columns, whatever their widths.

    An equi-join on level and cell: a row asks once for each level that some interval uses, which are at most
    ``bits / step``.  Intervals may overlap and lie in each other.  ``how`` is ``inner`` or ``left``; ``small`` is
    the caller's promise that the interval list is bounded, otherwise Spark decides by size whether to broadcast.

    With ``sums``, whole-number expressions of an interval by name, a row comes once with their sums over all its
    intervals instead of once for each interval.  Intervals are added up inside their cells before the join, so no
    pair of a value and an interval is made, however many intervals a value has.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    cells = dyadic_cells(intervals, lo, hi, bits, step)
    used = sorted(r[0] for r in cells.select("__level").distinct().collect())
    keys = (*on, "__level", "__cell")
    same = reduce(lambda a, b: a & b, [F.col(f"v.{c}") == F.col(f"i.{c}") for c in keys])

    def ask(values: DataFrame) -> DataFrame:
        levels = values.withColumn("__level", F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>")))
        return levels.withColumn("__cell", F.expr(f"shiftright({value}, __level * {step})")).alias("v")

    def lookup(right: DataFrame) -> DataFrame:
        return (F.broadcast(right) if small else right).alias("i")

    if sums is not None:
        added = lookup(cells.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()]))
        found = ask(df.select(*on, value).distinct()).join(added, same)
        total = found.groupBy(*[F.col(f"v.{c}").alias(c) for c in (*on, value)]).agg(*[F.sum(f"i.{name}").alias(name) for name in sums])
        whole = reduce(lambda a, b: a & b, [F.col(f"d.{c}") == F.col(f"t.{c}") for c in (*on, value)])
        return df.alias("d").join(total.alias("t"), whole, how).select("d.*", *[F.col(f"t.{name}") for name in sums])
    extra = [c for c in intervals.columns if c not in on]
    found = ask(df).join(lookup(cells), same).select(*[F.col(f"v.{c}") for c in df.columns], *[F.col(f"i.{c}") for c in extra])
    if how == "inner":
        return found
    held = ask(df.select(*on, value).distinct()).join(lookup(cells.select(*keys).distinct()), same, "left_semi").select(*on, value).distinct()
    alone = df.join(held, [*on, value], "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)
