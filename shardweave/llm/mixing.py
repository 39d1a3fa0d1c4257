"""Mixing sources to target weights by hierarchical budgets.

A token budget flows down the tree domain - language - source.  At each node it is shared among the children
by weight; a child that cannot use its share (its tokens times ``epochs`` are fewer) leaves the shortage to
its siblings by their weights, and only when all siblings are full does a shortage remain at their parent,
whose own siblings take it up.  The tree has one row per source, so the budgets are worked out on the driver
from one aggregate.  Each leaf then takes its documents in seeded epochs: every epoch is the whole leaf in a
fresh seeded order, and the budget cuts off a prefix of the tokens of the last one.

Null domain, language or source is a value of its own.  Texts without words have no tokens: they use up
nothing and come where the seeded order puts them.  Equal rows follow each other in that order and are dealt
one by one.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardweave.llm.shared import stored, text_of

LEVELS = ("domain", "lang", "source")
#: Rows of a leaf in one cell of its seeded order; a window holds one cell.
ROWS_PER_CELL = 500


def word_count(text: str = "text") -> Column:
    """Tokens of a text: its words between white space."""
    return F.regexp_count(text_of(text), F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def shared_out(budget: int, caps: list[int], weights: list[float]) -> list[int]:
    """``budget`` by weight with no share above its cap; what a full child leaves goes to the others.

    Whole tokens; what rounding leaves goes to the first children that have room.
    """
    budget = min(budget, sum(caps))
    shares, open_ = [0] * len(caps), [i for i, c in enumerate(caps) if c > 0 and weights[i] > 0]
    left = budget
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * left >= caps[i] * total]
        if not full:
            for i in open_:
                shares[i] = int(left * weights[i] / total)
            break
        for i in full:
            shares[i] = caps[i]
            left -= caps[i]
        open_ = [i for i in open_ if i not in full]
    rest = min(budget, sum(c for c, w in zip(caps, weights, strict=True) if w > 0)) - sum(shares)
    for i, cap in enumerate(caps):
        if rest > 0 and weights[i] > 0:
            more = min(cap - shares[i], rest)
            shares[i] += more
            rest -= more
    return shares


def leaf_budgets(tokens: Mapping[tuple, int], budget: int, epochs: int, weights: Mapping[tuple, float]) -> dict[tuple, int]:
    """Budget of every leaf.  ``weights`` maps paths, whole or partial, to weights; 1 where a path is absent."""

    def divide(path: tuple, leaves: list[tuple], amount: int) -> dict[tuple, int]:
        if len(path) == len(LEVELS):
            return {path: amount}
        children: dict[tuple, list[tuple]] = {}
        for leaf in leaves:
            children.setdefault(leaf[: len(path) + 1], []).append(leaf)
        names = sorted(children, key=lambda p: [(x is not None, x or "") for x in p])
        caps = [epochs * sum(tokens[x] for x in children[n]) for n in names]
        out: dict[tuple, int] = {}
        for name, share in zip(names, shared_out(amount, caps, [weights.get(n, 1.0) for n in names]), strict=True):
            out |= divide(name, children[name], share)
        return out

    return divide((), list(tokens), budget)


def mix(
    docs: DataFrame,
    domain: Column,
    weights: Mapping[tuple, float],
    share: float = 0.9,
    epochs: int = 2,
    seed: int = 7,
) -> DataFrame:
    """The chosen rows of ``docs`` with ``mix__``: domain, tokens, epoch and the budget of the leaf.

    The budget is ``share`` of all tokens; no document is taken more than ``epochs`` times.
    """
    spark: SparkSession = docs.sparkSession
    draw = F.xxhash64("doc_id", "text")
    facts = docs.select(domain.cast("string").alias("domain"), F.col("lang").cast("string"), F.col("source").cast("string"), word_count().alias("tokens"), draw.alias("draw"))
    facts = stored(facts, "mix-tokens")
    # one row per leaf and epoch from here on: the size of the tree, not of the corpus
    leaves = facts.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    tokens = {tuple(r[c] for c in LEVELS): r["tokens"] for r in leaves}
    budgets = leaf_budgets(tokens, int(share * sum(tokens.values())), epochs, weights) if leaves else {}
    plan = []
    for k, r in enumerate(leaves):
        leaf = tuple(r[c] for c in LEVELS)
        whole, rest = divmod(budgets[leaf], tokens[leaf]) if tokens[leaf] else (1, 0)
        cells = max(1, r["n"] // ROWS_PER_CELL)
        plan += [(*leaf, k, e, budgets[leaf], tokens[leaf] if e < whole else rest, cells) for e in range(whole + (rest > 0))]
    kinds = "p_domain string, p_lang string, p_source string, leaf int, epoch int, budget long, take long, cells int"

    def planned(rows: DataFrame, columns: dict[str, Column], plan: list[tuple], kinds: str) -> DataFrame:
        table = spark.createDataFrame(plan, kinds)
        match = [columns[c].eqNullSafe(table[f"p_{c}"]) for c in LEVELS]
        return rows.join(F.broadcast(table), match[0] & match[1] & match[2])

    # a leaf's seeded order is cut into cells; cells before the cut are taken whole, one is cut inside
    order = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("draw"))
    cell = F.pmod(order, F.col("cells")).cast("int")
    sums = planned(facts, {c: facts[c] for c in LEVELS}, plan, kinds).groupBy("leaf", "epoch", "take", cell.alias("cell")).agg(F.sum("tokens").alias("here"))
    running = Window.partitionBy("leaf", "epoch").orderBy("cell")
    upto = F.sum("here").over(running.rowsBetween(Window.unboundedPreceding, 0))
    cuts = sums.withColumn("upto", upto).where("upto > take").groupBy("leaf", "epoch").agg(
        F.min(F.struct("cell", (F.col("upto") - F.col("here")).alias("before"))).alias("cut")
    )
    at = {(r["leaf"], r["epoch"]): tuple(r["cut"]) for r in cuts.collect()}
    plan = [(*p, *at.get((p[3], p[4]), (p[7], 0))) for p in plan]
    kinds += ", cut int, before long"

    own = docs.select(*[F.col(f"`{c}`").alias(f"d_{i}") for i, c in enumerate(docs.columns)], domain.cast("string").alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), draw.alias("draw"), word_count().alias("tokens"))
    rows = planned(own, {c: own[c] for c in LEVELS}, plan, kinds).withColumns({"order": order, "cell": cell})
    inside = Window.partitionBy("leaf", "epoch").orderBy("order", "draw").rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where("cell = cut").withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).where("upto <= take").drop("upto")
    report = F.struct("domain", "tokens", "epoch", "budget").alias("mix__")
    return rows.where("cell < cut").unionByName(edge).select(*[F.col(f"d_{i}").alias(c) for i, c in enumerate(docs.columns)], report)
