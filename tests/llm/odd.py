"""Small tables with everything that may go wrong in a row."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names the operators use inside
        *[T.StructField(n, T.StringType()) for n in ("cls", "rk", "key", "n", "score", "spans", "mix", "domain", "cell", "epoch")],
    ]
)


def sentence(draw, words=12):
    return " ".join("".join(draw.choice("abcdefghijklmno") for _ in range(draw.randrange(2, 8))) for _ in range(words))


def rows(seed=1, n=60):
    draw = random.Random(seed)
    texts = [" ".join(sentence(draw, 9) + "." for _ in range(draw.randrange(1, 12))) for _ in range(n)]
    passage = sentence(draw, 90)
    texts[3] = texts[2]
    texts[5] = texts[4] + " extra"
    texts[7] = texts[6].upper()
    for i in (8, 9, 10, 11):
        texts[i] = texts[i] + " " + passage + " " + texts[i + 20]
    texts[12] = passage + passage
    long = " ".join(sentence(draw, 10) for _ in range(2500))
    near = long.split()
    for k in range(0, len(near), 97):
        near[k] = "other"
    special = [None, None, "", " \t\n ", "one", "one", "two words", "a b c", "éè 日本語 \U0001f600", "!!! 123", "x" * 3000, "y" * 3000 + "x" * 500, long, long, " ".join(near)]
    texts += special
    out = [(i, t, ("en", "de", None)[i % 3], ("src0", "src1", None)[i % 2 if i % 7 else 2], len(t or ""), *["?"] * 10) for i, t in enumerate(texts)]
    out += [out[2], out[2], (None, texts[4], None, None, None, *[None] * 10), (None, None, None, None, None, *[None] * 10)]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
