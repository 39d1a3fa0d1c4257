"""P queries: alert rules and dashboard queries over events as metric samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardweave.operators import alerts as R
from shardweave.operators.scan import DAY, HOUR, bucket_of, micros, ordered_scan
from shardweave.plans.registry import event_bucket, event_width, query, table

SERIES = ["kind", "zone"]


def samples(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), micros("ts").alias("at_us"), F.col("event_type").alias("kind"),
        (F.col("user_id") % 3).alias("zone"), "value",
    )


def counters(spark, sf_dir):
    """A counter per series that starts again from 0 whenever it passes 5000."""
    grown = ordered_scan(
        samples(spark, sf_dir), SERIES, ["at_us", "seq"], event_bucket(spark, sf_dir, "at_us"), sums={"total": F.floor("value").cast("long")}
    )
    return grown.withColumn("count", F.col("total") % 5000).drop("total", "value")


SAMPLES_SQL = "s AS (SELECT event_id AS seq, epoch_us(ts) AS at_us, event_type AS kind, user_id % 3 AS zone, value FROM events)"
GROWTH_SQL = f"""{SAMPLES_SQL},
  c AS (SELECT *, (sum(floor(value)::BIGINT) OVER (PARTITION BY kind, zone ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) % 5000)::BIGINT AS count FROM s),
  p AS (SELECT *, lag(count) OVER (PARTITION BY kind, zone ORDER BY at_us, seq) AS before FROM c),
  g AS (SELECT *, CASE WHEN before IS NULL THEN 0 WHEN count < before THEN count ELSE count - before END AS growth FROM p)"""


@query(
    "p01_counter_rate",
    f"WITH {GROWTH_SQL}, r AS (SELECT *, sum(growth) OVER (PARTITION BY kind, zone ORDER BY at_us RANGE BETWEEN {2 * HOUR} PRECEDING AND CURRENT ROW) / 7200.0 AS rate FROM g) "
    "SELECT kind, zone, seq, count, round(rate::DOUBLE, 6) AS rate FROM r WHERE rate > 0.01",
)
def p01(spark, sf_dir):
    rated = R.counter_rate(counters(spark, sf_dir), SERIES, "at_us", "seq", "count", event_width(spark, sf_dir), 2 * HOUR)
    return rated.filter("rate > 0.01").withColumn("rate", F.round("rate", 6)).drop("at_us")


@query(
    "p02_counter_increase",
    f"WITH {GROWTH_SQL} SELECT kind, at_us // {HOUR} AS step, sum(growth)::BIGINT AS increase FROM g GROUP BY ALL",
)
def p02(spark, sf_dir):
    return R.counter_increase(counters(spark, sf_dir), SERIES, "at_us", "seq", "count", ["kind"], event_width(spark, sf_dir), HOUR)


@query(
    "p03_gauge_threshold",
    f"WITH {SAMPLES_SQL} SELECT *, 'high' AS rule FROM s WHERE value > 100 UNION ALL SELECT *, 'slow view' FROM s WHERE value > 50 AND kind = 'view' "
    "UNION ALL SELECT *, 'quiet' FROM s WHERE floor(value) = 0",
)
def p03(spark, sf_dir):
    value = F.col("value")
    rules = {"high": value > 100, "slow view": (value > 50) & (F.col("kind") == "view"), "quiet": F.floor(value) == 0}
    return R.apply_thresholds(samples(spark, sf_dir), rules)


@query(
    "p04_series_ratio",
    f"WITH {SAMPLES_SQL}, t AS (SELECT kind, zone, at_us // {12 * HOUR} AS step, sum(value::DECIMAL(18, 2)) AS total FROM s GROUP BY ALL) "
    "SELECT zone, step, round(a.total::DOUBLE / b.total::DOUBLE, 6) AS ratio FROM t a JOIN t b USING (zone, step) "
    "WHERE a.kind = 'click' AND b.kind = 'view' AND b.total <> 0 AND a.total::DOUBLE / b.total::DOUBLE > 0.8",
)
def p04(spark, sf_dir):
    totals = samples(spark, sf_dir).groupBy("kind", "zone", bucket_of("at_us", 12 * HOUR).alias("step")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total")
    )
    ratio = R.series_ratio(totals.filter("kind = 'click'"), totals.filter("kind = 'view'"), ["zone", "step"], "total")
    return ratio.filter("ratio > 0.8").withColumn("ratio", F.round("ratio", 6))


@query(
    "p05_hold_time",
    f"WITH {SAMPLES_SQL}, i AS (SELECT *, sum((value <= 20)::INT) OVER (PARTITION BY kind ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) AS run FROM s), "
    "j AS (SELECT *, min(at_us) FILTER (value > 20) OVER (PARTITION BY kind, run) AS since FROM i) "
    f"SELECT kind, seq, CASE WHEN value <= 20 THEN 'inactive' WHEN at_us - since >= {2 * HOUR} THEN 'firing' ELSE 'pending' END AS state FROM j",
)
def p05(spark, sf_dir):
    states = R.alert_states(
        samples(spark, sf_dir), ["kind"], "at_us", "seq", F.col("value") > 20, 2 * HOUR, event_bucket(spark, sf_dir, "at_us")
    )
    return states.select("kind", "seq", "state")


BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0)


@query(
    "p06_histogram_quantile",
    f"WITH {SAMPLES_SQL}, b(i, le) AS (VALUES {', '.join(f'({i}, {b}::DOUBLE)' for i, b in enumerate(BOUNDS))}, (6, 'infinity'::DOUBLE)), "
    f"h AS (SELECT kind, at_us // {DAY} AS day, i, le, count(*) FILTER (value <= le)::DOUBLE AS n, count(*)::DOUBLE AS total FROM s, b GROUP BY ALL), "
    "w AS (SELECT *, lag(le, 1, 0::DOUBLE) OVER k AS lower, lag(n, 1, 0::DOUBLE) OVER k AS lower_n FROM h WINDOW k AS (PARTITION BY kind, day ORDER BY i)) "
    "SELECT kind, day, round(CASE WHEN i = 6 THEN lower ELSE lower + (le - lower) * (0.95::DOUBLE * total - lower_n) / (n - lower_n) END, 6) AS quantile "
    "FROM w WHERE n >= 0.95::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY kind, day ORDER BY i) = 1",
)
def p06(spark, sf_dir):
    bounds = [*BOUNDS, float("inf")]
    hits = [F.count_if(F.col("value") <= b).alias(f"n{i}") for i, b in enumerate(bounds)]
    counted = samples(spark, sf_dir).groupBy("kind", bucket_of("at_us", DAY).alias("day")).agg(*hits)
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"n{i}").alias("n")) for i, b in enumerate(bounds)]))
    counts = counted.select("kind", "day", rows.alias("r")).select("kind", "day", "r.le", "r.n")
    return R.histogram_quantile(counts, ["kind", "day"], "le", "n", 0.95).withColumn("quantile", F.round("quantile", 6))


@query(
    "p07_sum_by_max_by",
    "WITH l AS (SELECT user_id, event_type AS kind, arg_max(value, event_id)::DECIMAL(18, 2) AS value FROM events GROUP BY ALL) "
    "SELECT kind, count(*) AS n_series, sum(value) AS total, max(value) AS peak FROM l GROUP BY kind",
)
def p07(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("kind"), "ts", "event_id", F.col("value").cast("decimal(18,2)").alias("value")
    )
    latest = R.latest_samples(rows, ["user_id", "kind"], ["ts", "event_id"], "value")
    return latest.groupBy("kind").agg(F.count(F.lit(1)).alias("n_series"), F.sum("value").alias("total"), F.max("value").alias("peak"))


PHASES = ("Pending", "Running", "Succeeded", "Failed")


@query(
    "p08_one_hot_phase",
    "SELECT o_orderkey, gauge_phase, (CASE o_orderkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Running' WHEN 2 THEN 'Succeeded' WHEN 3 THEN 'Failed' ELSE '' END = gauge_phase)::INT AS value "
    "FROM orders, (VALUES ('Pending'), ('Running'), ('Succeeded'), ('Failed')) t(gauge_phase)",
)
def p08(spark, sf_dir):
    pick = F.col("o_orderkey") % 5
    phase = F.when(pick == 0, PHASES[0]).when(pick == 1, PHASES[1]).when(pick == 2, PHASES[2]).when(pick == 3, PHASES[3])
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", phase.otherwise("").alias("phase"))
    return R.one_hot(jobs, "phase", PHASES).drop("phase")


@query(
    "p09_active_connections",
    "SELECT event_id, sum(CASE event_type WHEN 'error' THEN -1 WHEN 'purchase' THEN -1 ELSE 1 END) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS active FROM events",
)
def p09(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select("event_id", micros("ts").alias("at_us"), "event_type")
    delta = F.when(F.col("event_type").isin("error", "purchase"), -1).otherwise(1).cast("long")
    return R.running_gauge(changes, [], ["at_us", "event_id"], delta, event_bucket(spark, sf_dir, "at_us"), "active").select("event_id", "active")


@query(
    "p10_label_regex",
    "SELECT event_id FROM events WHERE regexp_full_match(event_type, 'cl.*|sign.p') UNION ALL SELECT event_id FROM events WHERE regexp_full_match(event_type, 'urch.*')",
)
def p10(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    kind = F.col("event_type")
    some = events.filter(R.label_matches(kind, "cl.*|sign.p")).select("event_id")
    return some.unionByName(events.filter(R.label_matches(kind, "urch.*")).select("event_id"))


@query(
    "p11_evaluation_grid",
    f"WITH {SAMPLES_SQL}, g AS (SELECT unnest(range((SELECT min(at_us) FROM s) // {HOUR} * {HOUR}, (SELECT max(at_us) FROM s) + {8 * HOUR}, {HOUR})) AS eval_at) "
    f"SELECT kind, zone, eval_at, arg_max(value, at_us) AS value FROM s JOIN g ON at_us <= eval_at AND at_us > eval_at - {6 * HOUR} GROUP BY kind, zone, eval_at",
)
def p11(spark, sf_dir):
    return R.evaluation_grid(samples(spark, sf_dir), SERIES, "at_us", "seq", "value", HOUR, 6 * HOUR)


@query(
    "p12_sliding_average",
    f"WITH {SAMPLES_SQL}, w AS (SELECT kind, value, unnest([at_us // {HOUR} * {HOUR} - i * {HOUR} for i in range(4)]) AS start FROM s) "
    "SELECT kind, start, round(sum(value::DECIMAL(18, 2))::DOUBLE / count(*), 6) AS mean FROM w GROUP BY kind, start",
)
def p12(spark, sf_dir):
    exact = samples(spark, sf_dir).withColumn("value", F.col("value").cast("decimal(18,2)"))
    return R.sliding_average(exact, ["kind"], "at_us", "value", 4 * HOUR, HOUR).withColumn("mean", F.round("mean", 6))
