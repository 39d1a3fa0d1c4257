"""How a log of SQL statements would land on a topology.

A statement is cut into tokens once; everything else is read from the list of tokens, so the inside of
quoted text and of comments is never mistaken for SQL.  A feature that cannot be read is NULL.  The log has
columns stmt_id (unique) and sql.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardweave.operators.placement import shards_of
from shardweave.operators.scan import DAY, bucket_of, ordered_scan
from shardweave.sources.topology import Topology

# Quoted text, quoted name, comments, word, number, any other sign: one alternative per kind of token.
_TOKEN = r"""'(?:''|[^'])*'|"(?:""|[^"])*"|--[^\n]*|/\*(?s:.)*?\*/|\p{L}[\p{L}\p{N}_$]*|_[\p{L}\p{N}_$]*|\p{N}+(?:\.\p{N}+)?|\S"""
# In the plain form of a statement tokens are separated by one blank and quoted text is 'its number.
_VALUE = r"'\d+|(?:- )?[0-9]+(?:\.[0-9]+)?"
_NESTED = r"(?:[^()]|\((?:[^()]|\([^()]*\))*\))*"


def _tokens(sql: Column) -> Column:
    """The tokens of a statement without its comments."""
    found = F.regexp_extract_all(sql, F.lit(_TOKEN), 0)
    return F.filter(found, lambda t: ~(t.startswith("--") | t.startswith("/*")))


def _plain(tokens: Column) -> Column:
    """Lower-case tokens in one line; quoted text is replaced by its place in the list, quoted names are bare."""

    def shown(token: Column, at: Column) -> Column:
        return (
            F.when(token.startswith("'"), F.concat(F.lit("'"), at.cast("string")))
            .when(token.startswith('"'), F.regexp_replace(F.lower(F.substring(token, F.lit(2), F.length(token) - 2)), r"[^\p{L}\p{N}_$]", "_"))
            .otherwise(F.lower(token))
        )

    return F.array_join(F.transform(tokens, shown), " ")


def _value(shown: Column, tokens: Column) -> Column:
    """The literal behind a value of the plain form; NULL if it is none, or empty text."""
    quoted = F.get(tokens, F.substring(shown, F.lit(2), F.length(shown)).try_cast("int"))
    inner = F.replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit("''"), F.lit("'"))
    number = F.when(shown.rlike(rf"^(?:{_VALUE})$"), F.replace(shown, F.lit(" "), F.lit("")))
    return F.when(shown.rlike(r"^'\d+$"), F.nullif(inner, F.lit(""))).otherwise(number)


def _compared(plain: Column, tokens: Column, column: str) -> Column:
    """Literals compared with ``column``, in order."""
    found = F.regexp_extract_all(plain, F.lit(rf"(?<![^ ]){re.escape(column.lower())} = ({_VALUE})(?![^ ])"), 1)
    return F.filter(F.transform(found, lambda v: _value(v, tokens)), lambda v: v.isNotNull())


def key_by_column(sql: Column, column: str) -> Column:
    """First ``column = literal``."""
    tokens = _tokens(sql)
    return F.get(_compared(_plain(tokens), tokens, column), 0)


def first_literal(sql: Column) -> Column:
    """First quoted literal that opens a list of values or is compared first in a WHERE."""
    tokens = _tokens(sql)
    return _value(F.regexp_extract(_plain(tokens), r"(?<![^ ])(?:values \(|where [^ ]+ =) ('\d+)(?![^ ])", 1), tokens)


def column_literals(sql: Column, column: str) -> Column:
    """Distinct literals compared with the shard column."""
    tokens = _tokens(sql)
    return F.array_distinct(_compared(_plain(tokens), tokens, column))


def unambiguous_key(sql: Column, column: str) -> Column:
    """The one literal compared with the shard column; NULL when there are several."""
    literals = column_literals(sql, column)
    return F.when(F.size(literals) == 1, F.get(literals, 0))


def _insert(plain: Column) -> tuple[Column, Column]:
    """Column names and tuples of an INSERT with a column list; both empty for anything else."""
    shape = r"^insert into [^(]+\( ([^()]*) \) values (.*)$"
    names = F.split(F.regexp_extract(plain, shape, 1), " , ")
    rows = F.regexp_replace(F.regexp_extract(plain, shape, 2), r" (?:on conflict|returning|;)(?: .*)?$", "")
    tuples = F.regexp_extract_all(rows, F.lit(rf"\( ({_NESTED}) \)"), 1)
    # anything beside the tuples means that they were not all understood
    whole = F.regexp_replace(rows, rf"\( {_NESTED} \)", "").rlike(r"^[ ,]*$")
    return names, F.when(whole, tuples).otherwise(F.array().cast("array<string>"))


def _items(values: Column) -> Column:
    """The items of a tuple: split at the commas outside parentheses."""
    return F.transform(F.regexp_extract_all(values, F.lit(r"(?:[^,()]|\((?:[^()]|\([^()]*\))*\))+"), 0), lambda x: F.trim(x))


def _all_keys(names: Column, tuples: Column, tokens: Column, column: str) -> Column:
    at = F.array_position(names, F.lit(column.lower())).cast("int")
    # two steps, so that a tuple is split once and not for each part of the value's expression
    keys = F.transform(F.transform(tuples, lambda t: F.get(_items(t), at - 1)), lambda v: _value(v, tokens))
    return F.when((at > 0) & (F.size(tuples) > 0) & ~F.exists(keys, lambda k: k.isNull()), keys)


def _first_key(names: Column, tuples: Column, tokens: Column, column: str) -> Column:
    at = F.array_position(names, F.lit(column.lower())).cast("int")
    first = F.transform(F.slice(tuples, 1, 1), lambda t: _items(t))
    fitting = F.filter(first, lambda items: (at > 0) & (F.size(items) == F.size(names)))
    return F.get(F.transform(F.transform(fitting, lambda items: F.get(items, at - 1)), lambda v: _value(v, tokens)), 0)


def insert_keys(sql: Column, column: str) -> Column:
    """Shard keys of all tuples of an INSERT, in order; NULL if any of them cannot be read."""
    tokens = _tokens(sql)
    return _all_keys(*_insert(_plain(tokens)), tokens, column)


def insert_key(sql: Column, column: str) -> Column:
    """Shard key of the first tuple of an INSERT whose column and value lists have equal length."""
    tokens = _tokens(sql)
    return _first_key(*_insert(_plain(tokens)), tokens, column)


def _reads(plain: Column) -> Column:
    return plain.rlike(r"^(?:select|show|values|table)(?: |$)") & ~plain.rlike(r"(?: |^)for(?: |$)")


def _names(plain: Column) -> Column:
    name = r"[\p{L}_][\p{L}\p{N}_$]*"
    found = F.regexp_extract_all(plain, F.lit(rf"(?<![^ ])(?:from|join|into|update) (?:{name} \. )?({name})(?![^ ])"), 1)
    return F.array_distinct(found)


def is_read_only(sql: Column) -> Column:
    """Surely a read: select, show, values or table, and no locking FOR clause."""
    return _reads(_plain(_tokens(sql)))


def tables_touched(sql: Column) -> Column:
    """Distinct lower-case table names in order of first appearance, schemas removed."""
    return _names(_plain(_tokens(sql)))


def only_known(tables: str, known: Column) -> Column:
    """At least one table, and all of them in ``known``."""
    return (F.size(tables) > 0) & (F.size(F.array_except(tables, known)) == 0)


# --- decisions ------------------------------------------------------------------------


def _read(log: DataFrame) -> DataFrame:
    """Append the tokens and the plain form, each worked out once."""
    return log.withColumn("__tokens", _tokens(F.col("sql"))).withColumn("__plain", _plain(F.col("__tokens")))


def _with_keys(read: DataFrame, column: str) -> DataFrame:
    tokens, plain = F.col("__tokens"), F.col("__plain")
    names, tuples = _insert(plain)
    parts = read.withColumns({"__names": names, "__tuples": tuples, "__found": F.array_distinct(_compared(plain, tokens, column))})
    names, tuples = F.col("__names"), F.col("__tuples")
    parts = parts.withColumns(
        {"__many": _all_keys(names, tuples, tokens, column), "__first": _first_key(names, tuples, tokens, column)}
    )
    one = F.when(F.size("__found") == 1, F.get("__found", F.lit(0))).otherwise(F.col("__first"))
    single = F.when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))
    keys = F.when(F.size("__many") > 1, F.array_distinct("__many")).otherwise(single)
    return parts.withColumn("keys", keys).drop("__names", "__tuples", "__found", "__many", "__first")


def statement_keys(log: DataFrame, column: str) -> DataFrame:
    """Append ``keys``: the shard keys a statement names; empty when it names none."""
    return _with_keys(_read(log), column).drop("__tokens", "__plain")


def _with_shards(log: DataFrame, topology: Topology) -> DataFrame:
    """Append ``keys`` and ``shards``, the shard of each key.  A statement needs no other row."""
    return _with_keys(_read(log), topology.column).withColumn("shards", shards_of(F.col("keys"), topology))


def placed_keys(log: DataFrame, topology: Topology) -> DataFrame:
    """One row (stmt_id, …, key, shard) per distinct shard key of every statement."""
    both = _with_shards(log, topology).withColumn("__key", F.explode(F.arrays_zip("keys", "shards")))
    own = [c for c in log.columns if c != "sql"]
    return both.select(*own, F.col("__key.keys").alias("key"), F.col("__key.shards").alias("shard"))


def route(log: DataFrame, topology: Topology) -> DataFrame:
    """Decision and shard of every statement.

    In order: blocked write, reference-only read, insert over several shards, one shard,
    read of all shards, write without a key.  One pass over the log, without a shuffle.
    """
    known = F.array(*[F.lit(t.lower()) for t in topology.reference_tables]).cast("array<string>")
    placed = _with_shards(log.select("stmt_id", "sql"), topology)
    features = placed.select(
        "stmt_id",
        _reads(F.col("__plain")).alias("read"),
        _names(F.col("__plain")).alias("tables"),
        F.exists("shards", lambda s: s.isNull()).alias("unplaced"),
        F.array_distinct(F.filter("shards", lambda s: s.isNotNull())).alias("shards"),
    )
    decision = (
        F.when(~F.col("read") & F.lit(topology.write_blocked), "reject: write blocked")
        .when(F.col("read") & only_known("tables", known), "any shard")
        .when(F.col("unplaced"), "reject: no range")
        .when(F.size("shards") > 1, "reject: several shards")
        .when(F.size("shards") == 1, "single")
        .when(F.col("read"), "scatter")
        .otherwise("reject: write without key")
    )
    routed = features.select("stmt_id", "read", "shards", decision.alias("decision"))
    shard = F.when(F.col("decision") == "single", F.get("shards", F.lit(0))).when(
        F.col("decision") == "any shard", F.lit(topology.ranges[0].shard)
    )
    return routed.select("stmt_id", "read", "decision", shard.alias("shard"))


def cross_shard_inserts(log: DataFrame, topology: Topology) -> DataFrame:
    """Statements whose tuples land on more than one shard."""
    found = F.array_distinct(F.filter("shards", lambda s: s.isNotNull()))
    return _with_shards(log, topology).select("stmt_id", F.size(found).cast("long").alias("n_shards")).filter("n_shards > 1")


def workload_report(routed: DataFrame) -> DataFrame:
    """Statements per decision and shard, with their share of all statements."""
    counts = routed.groupBy("decision", "shard").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def hot_keys(log: DataFrame, topology: Topology, n: int) -> DataFrame:
    """The ``n`` keys named by most statements."""
    counts = placed_keys(log, topology).groupBy("key", "shard").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "key").limit(n)


def transaction_span(log: DataFrame, topology: Topology) -> DataFrame:
    """Shards touched per transaction: empty, local or distributed."""
    shards = _with_shards(log.select("tx_id", "sql"), topology).select("tx_id", F.explode_outer("shards").alias("shard"))
    counted = shards.groupBy("tx_id").agg(F.count_distinct("shard").alias("n_shards"))
    kind = F.when(F.col("n_shards") == 0, "empty").when(F.col("n_shards") == 1, "local").otherwise("distributed")
    return counted.withColumn("span", kind)


def accepted_statements(log: DataFrame, blocks: DataFrame, width: int = DAY) -> DataFrame:
    """The log without writes inside a block interval of their keyspace; reads pass.

    ``log`` has stmt_id, keyspace and at, ``blocks`` has keyspace, from_at and to_at
    (exclusive).  A time is blocked when some block that began by then has not ended, so one
    ordered scan over both tables finds the blocked writes without pairing them up.
    """
    known = log.withColumn("__write", ~is_read_only(F.col("sql")))
    none = F.lit(None).cast("long")
    writes = known.filter("__write").select("keyspace", "at", F.lit(1).alias("__side"), F.col("stmt_id").alias("__id"), none.alias("to_at"))
    starts = blocks.select("keyspace", F.col("from_at").alias("at"), F.lit(0).alias("__side"), F.col("to_at").alias("__id"), "to_at")
    scanned = ordered_scan(
        writes.unionByName(starts.distinct()), ["keyspace"], ["at", "__side", "__id"], bucket_of("at", width),
        maxes={"__until": F.col("to_at")},
    )
    blocked = scanned.filter((F.col("__side") == 1) & (F.col("__until") > F.col("at"))).select(F.col("__id").alias("stmt_id"))
    return known.join(blocked, "stmt_id", "left_anti").drop("__write")
