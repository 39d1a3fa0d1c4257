import random
import tracemalloc
from collections import Counter

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shardweave.llm import language, quality, toxic
from shardweave.llm.shared import Batch, crc_mod

import pyarrow as pa  # noqa: I001
import zlib

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet"), spark.read.parquet(f"{SF_DIR}/labels.parquet")


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int, y string")


def test_fold_is_the_crc_of_the_id(spark):
    got = {r[0]: r[1] for r in spark.range(50).select("id", crc_mod("id", 5)).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 for i in range(50)}


def test_isotonic_is_the_nearest_rising_sequence():
    draw = np.random.default_rng(4)
    value, weight = draw.random(40), draw.integers(1, 5, 40).astype(float)
    got = quality.isotonic(value, weight)
    assert (np.diff(got) >= 0).all()
    # brute force: max over starts of min over ends of the weighted means
    want = [
        max(min(np.average(value[a : b + 1], weights=weight[a : b + 1]) for b in range(k, 40)) for a in range(k + 1))
        for k in range(40)
    ]
    assert np.allclose(got, want)


def test_normal_equations_equal_ridge_in_one_place(spark, tables):
    docs, labels = tables
    rows = quality.training_rows(quality.with_statistics(docs), labels)
    model = quality.fit(rows)
    local = rows.collect()
    z = model.lifted(np.array([r.stats for r in local], float))
    y = np.array([r.y for r in local])
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(z.shape[1]) / quality.FEATURES, z.T @ y)
    assert np.allclose(model.weights, want, atol=1e-6)


def test_statistics_do_not_depend_on_the_batch():
    texts = [r[1] for r in odd.rows()]
    whole = quality.statistics(Batch(pa.array(texts)))
    one = np.vstack([quality.statistics(Batch(pa.array([t], pa.string()))) for t in texts])
    assert np.allclose(whole, one)


def test_quality_held_out(spark, tables):
    docs, labels = tables
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_odd_rows(spark, tables):
    data = odd.rows()
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(60)] + [(1, None, None, "x"), (None, 1, 0, "x"), (2, 1, 0, "x")], "doc_id long, quality int, toxic int, y string")
    rows = quality.quality_scores(odd.docs(spark), labels).collect()
    assert len(rows) == len(data) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.quality_scores(odd.docs(spark), no_labels(spark)).collect()} == {0.5}
    assert quality.quality_scores(odd.docs(spark, []), labels).collect() == []
    kept = quality.keep_good(odd.docs(spark), no_labels(spark))
    assert kept.columns == odd.docs(spark).columns and kept.count() == len(data)


def insults(spark, seed=1):
    draw = random.Random(seed)
    data, labels = [], []
    for i in range(400):
        toxic_one = draw.random() < 0.3
        sentences = [odd.sentence(draw, 8) for _ in range(draw.randrange(1, 15))]
        if toxic_one:
            k = draw.randrange(len(sentences))
            sentences[k] += " zqwert" + odd.sentence(draw, 1)
        data.append((i, ". ".join(sentences) + ".", "en", "s", 0, *[None] * 10))
        labels.append((i, 1, int(toxic_one), "x"))
    return odd.docs(spark, data), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, y string"), data


def test_toxicity_is_learned_and_located(spark):
    docs, labels, data = insults(spark)
    texts = {r[0]: r[1] for r in data}
    model = toxic.fit(docs, labels)
    rows = toxic.toxicity(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert all(r.predicted == r.toxic for r in rows)
    for r in rows:
        marked = [texts[r.doc_id][s.begin : s.end] for s in r.sentences]
        assert all("zqwert" in m for m in marked) and bool(marked) == bool(r.toxic)
        # the document is the noisy-or of its sentences
        clean = np.prod([1 - s.score for s in r.sentences])
        assert abs(1 - clean - r.score) < 0.05


def test_toxicity_odd_rows(spark):
    _, labels, _ = insults(spark)
    model = toxic.fit(*insults(spark)[:2])
    rows = toxic.toxicity(odd.docs(spark), model).collect()
    assert len(rows) == len(odd.rows())
    texts = {r[0]: r[1] for r in odd.rows()}
    known = [r for r in rows if r.doc_id is not None]
    assert all(r.score == 0 for r in known if not texts[r.doc_id])
    assert all(r.score < 0.01 for r in known if not (texts[r.doc_id] or "").strip())
    assert {r.score for r in toxic.toxicity(odd.docs(spark), toxic.fit(odd.docs(spark), no_labels(spark))).collect()} == {0.0}
    assert toxic.toxicity(odd.docs(spark, []), toxic.fit(odd.docs(spark, []), labels)).collect() == []


def test_language_held_out(spark, tables):
    docs, _ = tables
    rows = language.languages(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95


def test_bloom_filters_return_every_language_of_a_gram():
    draw = np.random.default_rng(2)
    members = [draw.integers(0, 1 << 62, 3000).astype(np.uint64) for _ in range(70)]
    members[69] = members[0]
    model = language.Model.of([f"l{i:02}" for i in range(70)], members)
    hits = model.hits(members[0], np.zeros(3000, np.int64), 1)[0]
    assert hits[0] == hits[69] == pytest.approx(3000)
    assert np.delete(hits, [0, 69]).max() < 60


def plain_grams(text):
    """Every 3- and 5-gram of the lower-cased bytes whose inner bytes are letters; other ASCII counts as a space."""
    data = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in text.lower().encode())
    for size in (3, 5):
        for k in range(len(data) - size + 1):
            if 32 not in data[k + 1 : k + size - 1]:
                yield data[k : k + size]


def test_predictions_equal_plain_sets_of_grams(spark, tables, monkeypatch):
    monkeypatch.setattr(language, "GRAMS", 10**9)
    docs = tables[0].where("doc_id < 400")  # a small fixture for plain Python
    data = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    counts = {}
    for i, text, lang in data:
        if text and lang and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    counts = {lang: {g: n for g, n in c.items() if n > 1} for lang, c in counts.items()}
    rates = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    peak = {}
    for r in rates.values():
        for g, x in r.items():
            peak[g] = max(peak.get(g, 0), x)
    sets = {lang: {g for g, x in r.items() if x >= language.SHARE * peak[g]} for lang, r in rates.items()}
    got = {r.doc_id: r for r in language.languages(docs, language.fit(docs)).collect()}
    compared = 0
    for i, text, _ in data:
        if not any(c.isalpha() for c in text or ""):
            assert got[i].lang_pred == "und"
            continue
        own = list(plain_grams(text))
        hits = sorted(((sum(g in s for g in own), lang) for lang, s in sets.items()), reverse=True)
        best, second = hits[0][0], hits[1][0]
        assert abs(got[i].score - best / max(best + second, 1)) < 0.02
        # the filter's false hits can only turn what is nearly even
        if best > 1.1 * second:
            compared += 1
            assert got[i].lang_pred == hits[0][1]
    assert compared > 0.9 * len(data)


def test_language_odd_rows(spark, tables):
    docs, _ = tables
    model = language.fit(docs)
    rows = language.languages(odd.docs(spark), model).collect()
    texts = {r[0]: r[1] for r in odd.rows() if r[0] is not None}
    assert len(rows) == len(odd.rows())
    for r in rows:
        if r.doc_id is not None:
            letters = any(c.isalpha() for c in texts[r.doc_id] or "")
            assert (r.lang_pred == "und") == (not letters)
            assert 0 <= r.score <= 1
    none = language.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language.languages(odd.docs(spark), none).collect()} == {"und"}
    assert language.languages(odd.docs(spark, []), model).collect() == []


def test_noisy_or_fit_is_a_local_optimum():
    draw = random.Random(3)
    bags = []
    for i in range(80):
        label, known = i % 2, [[draw.randrange(1, 4)] for _ in range(draw.randrange(3))]
        bags.append((label, len(known) + 2, known + ([[0, draw.randrange(1, 4)]] if label and draw.random() < 0.8 else [])))
    bags = [(y, max(n, len(k)), k) for y, n, k in bags]

    def loss(w, bias):
        total = toxic.PENALTY * sum(x * x for x in w) / 2
        for y, n, known in bags:
            clean = np.prod([1 - 1 / (1 + np.exp(-bias - sum(w[f] for f in fs))) for fs in known] + [1 - 1 / (1 + np.exp(-bias))] * (n - len(known)))
            total -= np.log(1 - clean) if y else np.log(clean)
        return total

    w, bias = toxic._fit(bags, 4)
    best = loss(w, bias)
    for k in range(5):
        for step in (-0.3, 0.3):
            moved = np.append(w, bias)
            moved[k] += step
            assert loss(moved[:4], moved[4]) > best


def test_scores_are_the_noisy_or_of_sentences():
    model = toxic.Model({"idiot": 6.0, "idio|": 1.0, "fine": -1.0}, -5.0)
    for text in ("You IDIOT. fine day. nothing here!", "İ You IDIOT. fine day. nothing here!", "aİb idiots.\nIDIOT", "", "..."):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        clean = 1.0
        for a, b in toxic.sentences(low):
            words = set(toxic._WORD.findall(low[a:b]))
            z = -5.0 + sum(model.weights.get(f, 0.0) for f in words | {w[:n] + "|" for w in words for n in (4, 5, 6) if len(w) > n})
            clean *= 1 - 1 / (1 + np.exp(-z))
        assert abs(-np.expm1(-model.hazards(text)[0]) - (1 - clean)) < 1e-9


def test_few_labels_and_equal_texts_of_both_labels(spark):
    texts = ["you moron here", "a nice day", "a nice day"] * 8 + ["torn text"] * 3
    rows = [(i, f"{t} {i}" if i < 24 else t, "en", "s", 0, *[None] * 10) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, 1, int("moron" in t or i in (24, 25)), "x") for i, t in enumerate(texts)], "doc_id long, quality int, toxic int, y string")
    model = toxic.fit(odd.docs(spark, rows), labels, folds=5, held_out=7)
    assert model.hazards("such a moron")[0] > model.hazards("such a nice day")[0]
    assert model.weights == toxic.fit(odd.docs(spark, rows).repartition(7), labels, folds=5, held_out=7).weights


def test_statistics_hold_little_memory_whatever_the_batch():
    class Rows:
        """Keeps the function of a mapInArrow."""

        schema = {"doc_id": type("Field", (), {"dataType": LongType()})}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    texts = [f"some words of text {i} " * 500 for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    run = quality.with_statistics(Rows()).run
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 400
    assert peak < 40e6, peak
