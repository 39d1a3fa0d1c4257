"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardweave.llm import mixing, overlap, packing, quality, transform
from shardweave.llm.queries import WEIGHTS, domain, tokenizer_file
from shardweave.llm.shared import stored, table

#: Bytes of a repeated string: 50 words of three letters and a space, so that hardly a passage of 50 words is shorter.
REPEAT = 200


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word shingles, similarity 0.8 or more)."""
    return overlap.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without byte strings of ``REPEAT`` bytes that occur more than once."""
    return transform.without_repeats(docs, REPEAT)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mixture takes a document: documents of short sources come twice."""
    return mixing.mix(docs, domain(), WEIGHTS).drop("mix__")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixture with their place in the training sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality", good_documents),
    ("near-duplicates", one_of_each_group),
    ("repeats", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: A learned classifier and hash-seeded mixing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
