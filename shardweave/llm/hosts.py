"""Verdicts on urls: rules for hosts and paths, and trust and distrust that links carry to hosts without one.

A host is a trusted or a blocked seed by the share of its pages that rules allow or block; a host that was never
crawled by the share of the links to it.  Trust is a personalised PageRank from the trusted seeds along the links,
distrust one from the blocked seeds against them: who links to blocked hosts is distrusted.  A host is blocked if
its distrust is above its trust and reaches the threshold.

Only SQL functions are used.  Scores are whole numbers (``SCALE`` is one blocked host) and shares of a link are
rounded down, so the result does not depend on the order in which rows are added.  A host with many links is split
by the other end of its links into parts of ``SPLIT``; each round ends in a stored table.

A null url, one without ``://`` and one without a host have an empty host, which has no seeds and no links: rules do
not fit it and it is allowed.  Null or empty html has no links; relative links stay on their host and carry nothing.
Repeated pages count as often as they are there.  Comments and scripts hold no links.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.llm.shared import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SCALE = 1_000_000_000
ROUNDS = 20
#: Percent of a host's score that goes on along its links.
DAMPING = 85
#: Distrust that blocks a host: half of its pages blocked, or as much from the hosts it links to.
THRESHOLD = SCALE // 2
#: Links of one part of a host.
SPLIT = 100_000
#: Hosts with more than one of so many pages are joined apart from the others; there are at most so many.
HEAVY = 1_000

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
NO_LINKS = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)"
LINK = r"""(?i)<a[\t\n\x0B\f\r ][^<>]*?href[\t\n\x0B\f\r ]*=[\t\n\x0B\f\r ]*["']?[\t\n\x0B\f\r ]*((?:[a-z][a-z0-9+.-]*:)?//[^"'\t\n\x0B\f\r <>]+)"""

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Iterable[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule whose host is the url's or above it and whose path begins the url's;
    of rules as long, the first in order of their text.  Null if no rule fits."""
    text = verdict = F.lit(None).cast("string")
    # the last WHEN that is put around the others is the first that is tried
    for kind, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        text, verdict = F.when(fits, name + start).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def _links(html: Column) -> Column:
    """Urls of the absolute links of a page."""
    found = F.regexp_extract_all(F.regexp_replace(html, NO_LINKS, ""), F.lit(LINK), F.lit(1))
    return F.transform(found, lambda u: F.when(u.startswith("//"), F.concat(F.lit("http:"), u)).otherwise(u))


def host_graph(pages: DataFrame, rules: Iterable[Rule]) -> tuple[DataFrame, DataFrame]:
    """(hosts, edges): each host with its pages and its seeds, and the number of pages of one host that link to another."""
    rules = list(rules)
    verdict = lambda host, path: fitting_rule(host, path, rules)[1]
    linked = lambda u: F.struct(host_of(u).alias("host"), verdict(host_of(u), path_of(u)).alias("verdict"))
    url = F.col("url")
    scanned = stored(
        pages.select(
            host_of(url).alias("host"), path_of(url).alias("path"), F.array_distinct(F.transform(_links(F.col("html")), linked)).alias("links")
        ).select("host", verdict(F.col("host"), F.col("path")).alias("verdict"), "links").where("host <> ''"),
        "page-hosts",
    )
    each = scanned.select(F.col("host").alias("from"), F.inline("links")).where("host <> '' AND host <> `from`")

    def seeded(rows: DataFrame, crawled: bool) -> DataFrame:
        share = lambda kind: F.count(F.when(F.col("verdict") == kind, 1))
        return rows.groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked"), F.count(F.lit(1)).alias("n")).withColumn("crawled", F.lit(crawled))

    # the row of a host's own pages stands for it where there is one
    both = seeded(scanned, True).unionByName(seeded(each, False))
    own = F.max_by(F.struct("allowed", "blocked", "n", "crawled"), "crawled").alias("own")
    hosts = both.groupBy("host").agg(own).select("host", "own.*").select(
        "host", F.when(F.col("crawled"), F.col("n")).otherwise(0).alias("pages"),
        F.expr(f"allowed * {SCALE} div n").alias("trust"), F.expr(f"blocked * {SCALE} div n").alias("distrust"),
    )
    edges = each.select("from", F.col("host").alias("to")).groupBy("from", "to").agg(F.count(F.lit(1)).alias("weight"))
    return stored(hosts, "hosts"), stored(edges, "host-edges")


def propagated(hosts: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after so many rounds along the edges; the seeds themselves if there are none."""
    seeds = hosts.select("host", "trust", "distrust")
    if edges.isEmpty():
        return seeds
    ahead = edges.select(F.col("from").alias("host"), "to", "weight", F.lit(True).alias("forward"))
    back = edges.select(F.col("to").alias("host"), F.col("from").alias("to"), "weight", F.lit(False).alias("forward"))
    ways = ahead.unionByName(back)
    sums = ways.groupBy("host", "forward").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("degree"))
    parts = sums.groupBy("host").agg(F.expr(f"1 + max(degree) div {SPLIT}").alias("parts"))
    ways = ways.join(sums.select("host", "forward", "total"), ["host", "forward"]).join(parts, "host")
    ways = stored(ways.withColumn("part", F.pmod(F.xxhash64("to"), "parts")).drop("parts"), "host-ways")
    seeds = stored(seeds.join(parts, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long"))), "host-seeds")
    scores = seeds
    moved = lambda kind: F.expr(
        f"cast({kind} as decimal(19,0)) * cast(weight as decimal(12,0)) * {DAMPING} div (cast(total as decimal(14,0)) * 100)"
    )
    none = F.lit(0).cast("long")
    for _ in range(rounds):
        sent = ways.join(scores.withColumn("part", F.explode(F.sequence(none, F.col("parts") - 1))), ["host", "part"]).select(
            F.col("to").alias("host"), F.when(F.col("forward"), moved("trust")).otherwise(none).alias("trust"),
            F.when(F.col("forward"), none).otherwise(moved("distrust")).alias("distrust"), none.alias("parts"),
        )
        both = sent.unionByName(seeds).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust")], F.max("parts").alias("parts"))
        scores = stored(both, "host-scores")
    return scores.drop("parts")


def judged(pages: DataFrame, rules: Iterable[Rule], default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule and verdict of every page."""
    rules = list(rules)
    hosts, edges = host_graph(pages, rules)
    scores = propagated(hosts, edges)
    blocked = scores.where(f"distrust > trust AND distrust >= {THRESHOLD}").select("host")
    blocked = stored(hosts.select("host", "pages").join(blocked.withColumn("bad", F.lit(True)), "host", "left"), "host-verdicts")
    total = blocked.agg(F.sum("pages")).first()[0] or 0
    # fewer than HEAVY hosts can have that many pages, so this table may be broadcast
    heavy = blocked.where(F.col("pages") * HEAVY > total).select(F.col("host").alias("heavy"), F.coalesce("bad", F.lit(False)).alias("heavy_bad"))
    light = blocked.where((F.col("pages") * HEAVY <= total) & F.col("bad")).select(F.col("host").alias("probe"), "bad")
    url = F.col("url")
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "said": verdict}).join(F.broadcast(heavy), F.col("host") == F.col("heavy"), "left")
    # a row that needs no host's verdict any more gets a key of its own, which no host has: "/" ends a host
    alone = F.col("said").isNotNull() | F.col("heavy").isNotNull() | (F.col("host") == "")
    key = F.when(alone, F.concat(F.lit("/"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("host"))
    rows = rows.withColumn("probe", key).join(light, "probe", "left")
    bad = F.coalesce("heavy_bad", "bad", F.lit(False))
    return rows.select("page_id", "url", "host", "path", "rule", F.coalesce("said", F.when(bad, "block").otherwise(default)).alias("verdict"))
