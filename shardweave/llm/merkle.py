"""A Merkle manifest of a dataset: trees of arity eight, one for each group, and one tree over their roots.

A block holds 512 consecutive nodes of a group.  Each of its levels is kept as one string of hex digests, 64
characters a node, so a parent is the digest of a substring of 512 characters and the siblings of a node are the
substrings on both sides of it.  Block roots are the nodes of the next round, as long as a group has more than one
node; the group roots are the nodes of a last tree.  Going down again, every block hands the sibling segments
above its root to its members.  A block is bounded, whatever the size of its group.

Rows with equal content are leaves of their own; their order does not matter because their digests are equal.  A
null is ``-`` in a leaf, distinct from empty text ``0:``.  Rows with a null group form a group; rows with a null
order come first.  An empty table gives no rows.  Only the named fields are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardweave.llm.positions import with_positions
from shardweave.llm.shared import stored

ARITY = 8
#: Levels of a block; it holds ARITY ** HEIGHT nodes.
HEIGHT = 3
BLOCK = ARITY**HEIGHT
DIGEST = 64
RUN = ARITY * DIGEST

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SEGMENT = "struct<before:string,after:string>"


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, each ``-`` if null, else its UTF-8 length in bytes, ``:`` and its value."""

    def shown(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[shown(f) for f in fields]), 256)


def proof_digest(proof: str) -> Column:
    """H of all siblings of a proof, level by level, left to right."""
    return F.expr(f"sha2(array_join(transform({proof}, s -> concat(s.before, s.after)), ''), 256)")


def folded(leaf: str, proof: str) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.expr(f"aggregate({proof}, {leaf}, (node, s) -> sha2(concat(s.before, node, s.after), 256))")


def _runs(level: str) -> str:
    """The strings of at most eight digests that a level consists of."""
    return f"transform(sequence(0, cast((length({level}) - 1) div {RUN} as int)), i -> substring({level}, i * {RUN} + 1, {RUN}))"


def _parents(runs: str) -> str:
    return f"array_join(transform({runs}, run -> sha2(run, 256)), '')"


def _blocks(nodes: DataFrame, carried: list[str], label: str) -> DataFrame:
    """Nodes (tree, pos, size, node, carried…) as blocks with their runs of each level and their root."""
    member = F.struct((F.col("pos") % BLOCK).cast("int").alias("slot"), "node", *carried)
    grouped = nodes.groupBy("tree", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.array_sort(F.collect_list(member)).alias("members"), F.first("size").alias("size")
    )
    # the string of a level is a column of its own, so that it is built once and not for each of its runs
    levels = grouped.selectExpr("*", "array_join(members.node, '') AS level0")
    for h in range(HEIGHT):
        levels = levels.selectExpr("*", f"{_runs(f'level{h}')} AS runs{h}").selectExpr("*", f"{_parents(f'runs{h}')} AS level{h + 1}")
    # all levels of a block, unless it is the only one of its tree: then as many as lead to one node
    height = "CASE " + " ".join(f"WHEN size <= {ARITY**h} THEN {h}" for h in range(HEIGHT)) + f" ELSE {HEIGHT} END"
    tops = ", ".join(f"level{h}" for h in range(HEIGHT + 1))
    runs = [f"runs{h}" for h in range(HEIGHT)]
    return stored(levels.selectExpr("tree", "block", "size", "members", *runs, f"{height} AS height", f"elt(1 + {height}, {tops}) AS root"), label)


def _members(blocks: DataFrame, above: DataFrame, carried: list[str], passed: list[str]) -> DataFrame:
    """The nodes of the blocks again: tree, pos, node, carried…, passed… and ``proof``, the segments of all levels above.

    ``above`` has the nodes that are the roots of these blocks; its ``passed`` columns go down to their members.
    """
    upper = above.selectExpr("tree AS __tree", "pos AS __pos", "proof AS __proof", *[f"{c} AS __{c}" for c in passed])
    blocks = blocks.join(upper, (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__pos")))

    def segment(h: int) -> str:
        run = f"runs{h}[cast(m.slot div {ARITY ** (h + 1)} as int)]"
        at = f"cast(m.slot div {ARITY**h} % {ARITY} as int) * {DIGEST}"
        return f"struct(substring({run}, 1, {at}) AS before, substring({run}, {at} + {DIGEST + 1}, {RUN}) AS after)"

    own = f"slice(array({', '.join(segment(h) for h in range(HEIGHT))}), 1, height)"
    row = ", ".join([f"block * {BLOCK} + m.slot AS pos", "m.node AS node", *[f"m.{c} AS {c}" for c in carried], f"concat({own}, __proof) AS proof"])
    return blocks.selectExpr("tree", *[f"__{c} AS {c}" for c in passed], f"inline(transform(members, m -> struct({row})))")


def _climb(nodes: DataFrame, carried: list[str], label: str) -> list[DataFrame]:
    """Blocks of every round, from the nodes up to one block for each tree."""
    rounds = [_blocks(nodes, carried, label)]
    while (rounds[-1].agg(F.max("size")).first()[0] or 0) > BLOCK:
        size = F.ceil(F.col("size") / BLOCK).cast("long")
        up = rounds[-1].select("tree", F.col("block").alias("pos"), size.alias("size"), F.col("root").alias("node"))
        rounds.append(_blocks(up, [], label))
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame, carried: list[str], passed: list[str]) -> DataFrame:
    """Members of the lowest round; ``above`` has one row for each tree."""
    for blocks in reversed(rounds[1:]):
        above = _members(blocks, above, [], passed)
    return _members(rounds[0], above, carried, passed)


def manifest(leaves: DataFrame, group: str, order: str, leaf: str, carried: list[str]) -> DataFrame:
    """One row for each leaf: the carried columns, leaf, subroot, root and ``proof``.

    ``leaves`` has the digest of each row in ``leaf``.  ``proof`` holds the siblings before and after the node on
    every level, from the leaf through the root of its group to the root of all.  Trees of groups are ordered by
    the bytes of the group's text, a null first.
    """
    # '' for the null group and '+' before every other one keep the bytewise order and tell '' from null
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    rows = leaves.select(tree.alias("tree"), F.col(order).alias("__order"), F.col(leaf).alias("node"), *[F.col(c).alias(f"_{c}") for c in carried])
    placed = with_positions(rows, "tree", [F.col("__order").asc_nulls_first(), F.col("node").asc()], "merkle-leaves").drop("__order")
    carried = [f"_{c}" for c in carried]
    inner = _climb(placed, carried, "merkle-blocks")
    subroots = inner[-1].select(F.lit("").alias("tree"), F.col("tree").alias("_group"), F.col("root").alias("node"))
    outer = _climb(with_positions(subroots, "tree", [F.col("_group").asc()], "merkle-subroots"), ["_group"], "merkle-top")
    start = outer[-1].select("tree", F.lit(0).alias("pos"), F.expr(f"cast(array() as array<{_SEGMENT}>)").alias("proof"), "root")
    groups = _descend(outer, start, ["_group"], ["root"])
    tops = groups.select(F.col("_group").alias("tree"), F.lit(0).alias("pos"), "proof", F.col("node").alias("subroot"), "root")
    found = _descend(inner, tops, carried, ["subroot", "root"])
    return found.select(*[F.col(c).alias(c[1:]) for c in carried], F.col("node").alias("leaf"), "subroot", "root", "proof")
