"""Alert rules and dashboard queries over metric samples.

A series is given by its key columns; ``at`` is LONG microseconds and (at, tie) is unique
within a series.  Rates are not extrapolated to the edges of their window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardweave.operators.held import alert_state, with_held_since
from shardweave.operators.scan import MICROS, MINUTE, bucket_of, dense_keys, ordered_scan, trailing_sum

LOOK_BACK = 5 * MINUTE
EVERY = 30 * MICROS


def label_matches(label: Column, pattern: str) -> Column:
    """Whole-text regular expression match; an absent label is the empty text."""
    return F.coalesce(label, F.lit("")).rlike(f"^(?:{pattern})$")


# --- counters -------------------------------------------------------------------------


def with_growth(samples: DataFrame, series: Sequence[str], at: str, tie: str, value: str, bucket: Column) -> DataFrame:
    """Append ``growth`` since the previous sample; a drop is a reset and counts from 0."""
    chained = ordered_scan(samples, series, [at, tie], bucket, previous={"__before": F.col(value)})
    return chained.withColumn("growth", _growth(F.col("__before"), value)).drop("__before")


def _growth(before: Column, value: str) -> Column:
    return F.when(before.isNull(), 0).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)


def counter_rate(
    samples: DataFrame, series: Sequence[str], at: str, tie: str, value: str, width: int, window: int = LOOK_BACK
) -> DataFrame:
    """Append ``rate``: growth per second over the trailing window.

    Series with few samples in a window need one shuffle; dense ones are scanned in buckets.
    """
    dense = dense_keys(samples, series, at, window)
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(at, tie))
    sparse = samples.filter(~dense).withColumn("growth", _growth(before, value))
    chained = with_growth(samples.filter(dense), series, at, tie, value, bucket_of(at, width))
    summed = trailing_sum(sparse, series, at, window, F.col("growth"), "__sum", width, F.lit(False)).unionByName(
        trailing_sum(chained, series, at, window, F.col("growth"), "__sum", width, F.lit(True))
    )
    return summed.withColumn("rate", F.col("__sum") / F.lit(window / MICROS)).drop("__sum", "growth")


def counter_increase(
    samples: DataFrame, series: Sequence[str], at: str, tie: str, value: str, by: Sequence[str], width: int, step: int = LOOK_BACK
) -> DataFrame:
    """Growth per label group and step of time."""
    grown = with_growth(samples, series, at, tie, value, bucket_of(at, width))
    return grown.groupBy(*by, bucket_of(at, step).alias("step")).agg(F.sum("growth").alias("increase"))


def histogram_quantile(counts: DataFrame, by: Sequence[str], le: str, count: str, q: float) -> DataFrame:
    """Quantile per group from cumulative bucket counts, linear inside a bucket.

    ``le`` is DOUBLE with infinity as the last bound; a group has one row per bound.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(count).cast("double").alias("n"))))
    groups = counts.groupBy(*by).agg(listed.alias("b")).withColumn("total", F.element_at("b", -1)["n"])
    rank = F.col("total") * F.lit(q)
    groups = groups.withColumn("i", F.array_position(F.transform("b", lambda x: x["n"] >= rank), True).cast("int"))
    here = F.element_at("b", F.col("i"))
    before = F.get("b", F.col("i") - 2)
    lower = F.coalesce(before["le"], F.lit(0.0))
    lower_n = F.coalesce(before["n"], F.lit(0.0))
    inside = lower + (here["le"] - lower) * (rank - lower_n) / (here["n"] - lower_n)
    value = F.when(F.col("total") > 0, F.when(here["le"] == float("inf"), before["le"]).otherwise(inside))
    return groups.select(*by, value.alias("quantile"))


# --- gauges ---------------------------------------------------------------------------


def series_ratio(above: DataFrame, below: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Samples with equal labels and time divided by each other; no match gives no row."""
    left = above.select(*on, F.col(value).alias("__above"))
    right = below.select(*on, F.col(value).alias("__below")).filter("__below <> 0")
    return left.join(right, list(on)).withColumn("ratio", F.col("__above") / F.col("__below")).drop("__above", "__below")


def alert_states(
    samples: DataFrame, series: Sequence[str], at: str, tie: str, condition: Column, hold: int, bucket: Column
) -> DataFrame:
    """Append ``state``: inactive, pending, or firing once the condition held for ``hold``."""
    since = with_held_since(samples, series, at, tie, condition, bucket, out="__since")
    return since.withColumn("state", alert_state(F.col(at), F.col("__since"), hold)).drop("__since")


def latest_samples(samples: DataFrame, series: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The last value of every series."""
    return samples.groupBy(*series).agg(F.max_by(value, F.struct(*order)).alias(value))


def one_hot(rows: DataFrame, phase: str, phases: Sequence[str]) -> DataFrame:
    """One 0/1 row per possible phase of every row."""
    every = F.explode(F.array(*[F.lit(p) for p in phases]))
    spread = rows.withColumn("gauge_phase", every)
    return spread.withColumn("value", F.coalesce(F.col(phase) == F.col("gauge_phase"), F.lit(False)).cast("int"))


def running_gauge(changes: DataFrame, keys: Sequence[str], order: Sequence[str], delta: Column, bucket: Column, out: str) -> DataFrame:
    """Append the gauge after every +1 or -1 change."""
    return ordered_scan(changes, keys, order, bucket, sums={out: delta})


def evaluation_grid(
    samples: DataFrame, series: Sequence[str], at: str, tie: str, value: str, step: int = EVERY, look_back: int = LOOK_BACK
) -> DataFrame:
    """Value of every series at every evaluation time: its last sample within the look-back.

    Samples are first reduced to the last one per step, then offered to the following
    evaluation times; series without a recent sample have no row.
    """
    if look_back % step:
        raise ValueError("look_back must be a multiple of step")
    first = F.ceil(F.col(at) / F.lit(step)).cast("long")
    row = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value"))
    last = samples.groupBy(*series, first.alias("__step")).agg(F.max(row).alias("__row"))
    steps = F.sequence(F.col("__step"), F.col("__step") + F.lit(look_back // step))
    offered = last.withColumn("__eval", F.explode(steps)).withColumn("eval_at", F.col("__eval") * F.lit(step))
    recent = offered.filter(F.col("__row.at") > F.col("eval_at") - F.lit(look_back))
    return recent.groupBy(*series, "eval_at").agg(F.max("__row").alias("__row")).select(*series, "eval_at", F.col("__row.value").alias(value))


def sliding_average(samples: DataFrame, by: Sequence[str], at: str, value: str, window: int, step: int) -> DataFrame:
    """Average per group over windows of ``window`` that start every ``step``.

    Samples are summed per step before they are offered to the windows that contain it.
    """
    if window % step:
        raise ValueError("window must be a multiple of step")
    panes = samples.groupBy(*by, bucket_of(at, step).alias("__pane")).agg(
        F.sum(value).alias("__sum"), F.count(value).alias("__n")
    )
    starts = F.sequence(F.col("__pane") - F.lit(window // step - 1), F.col("__pane"))
    offered = panes.withColumn("__first", F.explode(starts)).withColumn("start", F.col("__first") * F.lit(step))
    return offered.groupBy(*by, "start").agg((F.sum("__sum").cast("double") / F.sum("__n")).alias("mean"))


def apply_thresholds(samples: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per sample and rule whose condition is true."""
    fired = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))
    return samples.withColumn("rule", F.explode(fired))
