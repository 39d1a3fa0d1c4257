"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardweave.llm import conversations, hosts, language, merkle, mixing, neighbours, overlap, packing, quality, quantise, toxic, transform, wrapper
from shardweave.llm.shared import table
from shardweave.plans.oracle import crc32_sql

#: Target weights by path in the tree domain, language, source; 1 where nothing is said.
WEIGHTS = {
    ("bulk",): 0.35, ("curated",): 0.65,
    ("bulk", "en"): 0.6, ("bulk", "de"): 0.15, ("bulk", "fr"): 0.15, ("bulk", "es"): 0.1,
    ("curated", "en"): 0.55, ("curated", "de"): 0.17, ("curated", "fr"): 0.17, ("curated", "es"): 0.11,
}

#: Rules of the url filter: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Fields of a leaf of the manifest, in order.
LEAF = ("doc_id", "source", "lang", "n_chars", "text")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


ORACLE["op3_product_quantisation"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.a, r.c FROM l JOIN reach r ON l.b = r.a),
comp AS (SELECT a AS vec_id, min(c) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN comp USING (vec_id)"""

ORACLE["op4_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 2], ' ') FOR i IN range(1, len(ws) - 1)]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT e.a, r.c FROM e JOIN reach r ON e.b = r.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(c) AS component_id FROM reach GROUP BY a) USING (doc_id)"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in (*LEAF[:-1], text)
    ) + ")"


def _levels_sql(name: str, nodes: str) -> str:
    """All levels of trees of arity eight over ``nodes`` (k, pos, n, h)."""
    return (
        f"{name} AS (SELECT k, 0 AS lev, pos, n, h FROM {nodes} UNION ALL "
        f"SELECT k, lev + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY ALL)"
    )


def _walk_sql(name: str, nodes: str, levels: str) -> str:
    """Every node of ``nodes`` (id, k, pos, n, sib, f) led up its tree: siblings appended, ``f`` folded."""
    return (
        f"{name} AS (SELECT id, k, 0 AS lev, pos, n, sib, f FROM {nodes} UNION ALL "
        f"SELECT w.id, w.k, w.lev + 1, w.pos // 8, (w.n + 7) // 8, w.sib || coalesce(string_agg(CASE WHEN t.pos <> w.pos THEN t.h END, '' ORDER BY t.pos), ''), "
        f"sha256(string_agg(CASE WHEN t.pos = w.pos THEN w.f ELSE t.h END, '' ORDER BY t.pos)) "
        f"FROM {name} w JOIN {levels} t ON t.k = w.k AND t.lev = w.lev AND t.pos // 8 = w.pos // 8 WHERE w.n > 1 "
        f"GROUP BY w.id, w.k, w.lev, w.pos, w.n, w.sib, w.f)"
    )


ORACLE["op12_merkle"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS k, {_leaf_sql("text")} AS h,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS t
  FROM documents),
l AS (
  SELECT row_number() OVER () AS id, doc_id, k, h, coalesce(t, h) AS f, '' AS sib,
    row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM d),
{_levels_sql("low", "l")},
sub AS (SELECT '' AS k, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n, h, k AS lang FROM low WHERE n = 1),
{_levels_sql("high", "sub")},
{_walk_sql("up", "l", "low")},
ends AS (SELECT up.id, s.k, s.pos, s.n, up.sib, up.f FROM up JOIN sub s ON s.lang = up.k WHERE up.n = 1),
{_walk_sql("top", "ends", "high")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(top.sib) AS proof_sha256, top.f AS folded_root, top.f = r.h AS verified
FROM l JOIN sub s ON s.lang = l.k JOIN top ON top.id = l.id AND top.n = 1 JOIN high r ON r.n = 1"""

_BODY = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_NAME = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

# A shortest path by rows: the best way to every grammar state after each row; before a row at most two turns go in.
ORACLE["op13_conversation_repair"] = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql(_NAME)} % 20 AS k FROM conversations),
d AS (
  SELECT conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (
  SELECT *, {_BODY} AS body, left(role, 1) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o),
f AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS dup, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS short,
    lag(x) OVER (PARTITION BY conv_id ORDER BY i) || x NOT IN ('su', 'ua', 'au') AS bad FROM g),
m AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (dup) AS duplicate, count(*) FILTER (short) AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES
  (0, 0, '', [], 0), (1, 0, '', [], 1), (2, 0, '', [], 2), (3, 0, '', [], 3),
  (0, 3, 'I', ['user:'], 2), (1, 3, 'I', ['user:'], 2), (3, 3, 'I', ['user:'], 2), (2, 3, 'I', ['assistant:'], 3),
  (0, 6, 'II', ['user:', 'assistant:'], 3), (1, 6, 'II', ['user:', 'assistant:'], 3), (3, 6, 'II', ['user:', 'assistant:'], 3),
  (2, 6, 'II', ['assistant:', 'user:'], 2)) t(q, c, a, o, r)),
p AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, {{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]}} AS w FROM conversations
  UNION ALL
  SELECT conv_id, i, q, min(w) FROM (
    SELECT f.conv_id, f.i, CASE e WHEN 'D' THEN ins.r WHEN 'R' THEN CASE WHEN ins.r = 2 THEN 3 ELSE 2 END
        ELSE CASE f.x WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END AS q,
      {{'c': p.w.c + ins.c + CASE e WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e <> 'D' AND f.short THEN 3 ELSE 0 END,
        'a': p.w.a || ins.a || e,
        'o': p.w.o || ins.o || CASE e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text]
          ELSE [CASE WHEN ins.r = 2 THEN 'assistant:' ELSE 'user:' END || f.text] END}} AS w
    FROM p JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN ins ON ins.q = p.q,
      (VALUES ('D'), ('K'), ('R')) v(e)
    WHERE e = 'D' OR NOT f.blank AND NOT f.dup AND (e = 'R'
      OR f.x = 's' AND ins.r = 0 OR f.x = 'u' AND ins.r <> 2 OR f.x = 'a' AND ins.r = 2)) GROUP BY conv_id, i, q),
z AS (
  SELECT p.conv_id, min({{'c': p.w.c + ins.c, 'a': p.w.a || ins.a, 'o': p.w.o || ins.o}}) AS w FROM p JOIN ins ON ins.q = p.q
  LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.i = coalesce(m.n, 0) AND ins.r IN (0, 3) GROUP BY p.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, z.w.c AS cost, z.w.a AS audit, sha256(array_to_string(z.w.o, chr(10))) AS repaired_sha256
FROM z LEFT JOIN m ON m.conv_id IS NOT DISTINCT FROM z.conv_id"""


def _host_sql(url: str) -> str:
    return f"translate(coalesce(regexp_extract({url}, '{hosts.URL}', 1), ''), '{hosts.UPPER}', '{hosts.UPPER.lower()}')"


def _rule_sql(host: str, url: str, of: int) -> str:
    """Text (1, 2) or verdict (0) of the longest rule that fits."""
    path, found = f"coalesce(regexp_extract({url}, '{hosts.URL}', 2), '')", []
    for rule in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        name, start = rule[1:]
        found.append(f"WHEN ({host} = '{name}' OR ends_with({host}, '.{name}')) AND starts_with({path}, '{start}') THEN '{rule[0] if of == 0 else name + start}'")
    return f"CASE {' '.join(found)} END"


_LINK = hosts.LINK.replace("'", "''")

ORACLE["op11_url_filter"] = f"""
WITH RECURSIVE u AS (SELECT page_id, url, {_host_sql("url")} AS host, html FROM pages),
j AS (SELECT *, coalesce(regexp_extract(url, '{hosts.URL}', 2), '') AS path, {_rule_sql("host", "url", 1)} AS rule, {_rule_sql("host", "url", 0)} AS said FROM u),
x AS (
  SELECT row_number() OVER () AS id, host, list_transform(regexp_extract_all(regexp_replace(html, '{hosts.NO_LINKS}', '', 'g'), '{_LINK}', 1),
    lambda l: CASE WHEN starts_with(l, '//') THEN 'http:' || l ELSE l END) AS links FROM j WHERE host <> ''),
t AS (SELECT id, host, unnest(links) AS link FROM x),
l AS (SELECT DISTINCT id, host, {_host_sql("link")} AS target, {_rule_sql(_host_sql("link"), "link", 0)} AS said FROM t),
e AS (SELECT host, target, count(*) AS w FROM l WHERE target <> '' AND target <> host GROUP BY ALL),
n AS (
  SELECT host AS node, said, true AS own FROM j WHERE host <> ''
  UNION ALL SELECT target, said, false FROM l WHERE target <> '' AND target <> host AND target NOT IN (SELECT host FROM j)),
seeds AS (
  SELECT node, ((count(*) FILTER (said = 'allow')) * {hosts.SCALE} // count(*))::HUGEINT AS t, ((count(*) FILTER (said = 'block')) * {hosts.SCALE} // count(*))::HUGEINT AS d
  FROM n GROUP BY node),
m AS (
  SELECT host AS node, target AS go, true AS forward, w, sum(w) OVER (PARTITION BY host) AS total FROM e
  UNION ALL SELECT target, host, false, w, sum(w) OVER (PARTITION BY target) FROM e),
r AS (
  SELECT 0 AS k, node, t, d FROM seeds
  UNION ALL
  SELECT k + 1, node, sum(t)::HUGEINT, sum(d)::HUGEINT FROM (
    SELECT r.k, m.go AS node, CASE WHEN forward THEN r.t * w * {hosts.DAMPING} // (total * 100) ELSE 0 END AS t,
      CASE WHEN forward THEN 0 ELSE r.d * w * {hosts.DAMPING} // (total * 100) END AS d FROM r JOIN m USING (node)
    UNION ALL SELECT r.k, node, seeds.t, seeds.d FROM r JOIN seeds USING (node)) WHERE k < {hosts.ROUNDS} GROUP BY k, node)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (
  SELECT node FROM r WHERE k = {hosts.ROUNDS} AND d > t AND d >= {hosts.THRESHOLD}) THEN 'block' ELSE 'allow' END) AS verdict FROM j"""


def domain() -> Column:
    """The bulk source is a domain of its own beside the curated ones."""
    return F.when(F.col("source") == "src0", "bulk").otherwise("curated")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages")).withColumn("page_id", F.col("page_id").cast("long"))


@query
def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return rows.select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score")


@query
def op3_product_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantise.near_copies(table(spark, sf_dir, "embeddings"), least=0.98)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("vec_id", "component_id")})


@query
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = overlap.jaccard_components(docs, width=3, percent=90)
    return rows.select(F.col("doc_id").cast("long"), "n_shingles", F.col("component_id").cast("long"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


@query
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transform.removal_report(table(spark, sf_dir, "documents"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"), domain(), WEIGHTS)
    return rows.select(F.col("doc_id").cast("long"), "lang", "source", "mix__.*")


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic.toxicity(docs, toxic.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.languages(docs, language.fit(docs))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = F.translate("text", merkle.UPPER, merkle.UPPER.lower())
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = docs.select(
        "doc_id", "lang", merkle.leaf_digest([F.col(c) for c in LEAF]).alias("leaf"),
        F.when(tampers, merkle.leaf_digest([lowered if c == "text" else F.col(c) for c in LEAF])).alias("tampered"),
    )
    rows = merkle.manifest(leaves, "lang", "doc_id", "leaf", ["doc_id", "tampered"])
    found = rows.select(
        F.col("doc_id").cast("long"), "leaf", "subroot", "root", merkle.proof_digest("proof").alias("proof_sha256"),
        merkle.folded("coalesce(tampered, leaf)", "proof").alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, space = table(spark, sf_dir, "conversations"), F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    damage = F.crc32(name.cast("binary")) % 20
    text = F.coalesce("text", space)
    damaged = rows.select(
        "conv_id", "turn", (damage != 0).alias("alive"),
        F.when(damage == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(damage == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    reports, parts = conversations.repair(damaged, "conv_id", "turn", "role", "text", F.col("alive"))
    columns = [F.col("conv").cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    digests = conversations.text_digests(parts).withColumnRenamed("conv", "__conv")
    whole = reports.where("repaired IS NOT NULL").select(*columns, F.sha2("repaired", 256).alias("repaired_sha256"))
    cut = reports.where("repaired IS NULL").join(digests, F.col("conv").eqNullSafe(F.col("__conv")))
    return whole.unionByName(cut.select(*columns, F.col("sha256").alias("repaired_sha256")))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hosts.judged(table(spark, sf_dir, "pages"), RULES)
    return rows.select(F.col("page_id").cast("long"), "host", "path", "rule", "verdict")
