"""The corpus pipeline: five stages over the documents, each written as Parquet and read again as the next one's input.

Every stage works on all that its predecessor kept. Near duplicates are told by row, whatever the doc_id: rows that repeat
doc_id and text are one, rows that share only a doc_id are not, and a null doc_id joins groups like any other. Leaks are told
by row in the same way: a leaking row goes whatever its doc_id, and a clean row that shares the doc_id stays.

The first stage sets `lang` to the language that it predicts from the text; the label of the input is only learned from. All later
stages hand it on, and the last one gives it beside the digests of each document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import byte_bpe, decontaminate, language_id, set_join, suffix_dedup
from evidentia.llm.common import saved
from evidentia.llm.queries import RANKS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts whose closeness to every landmark is less are rejected, as are texts without letters.
MIN_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised, and states it as their lang."""
    return language_id.recognised(docs.select(*COLUMNS), language_id.train(docs, ~language_id.held_out_rows()), MIN_SCORE)


def row_key() -> Column:
    """A number, 0 or more, of doc_id and text; rows that agree in both have the same one."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"), 1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: that with the smallest doc_id, null last."""
    keyed = docs.select(*COLUMNS, row_key().alias("key"))  # rows of one key are one node of the join
    groups = set_join.ngram_jaccard_join(keyed.select(F.col("key").alias("doc_id"), "text")).select(
        F.col("doc_id").alias("key"),
        F.col("component_id").alias("component"),
    )
    keys = saved(keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("copies")), "keys")
    grouped = groups.where("component <> key").distinct()
    linked = grouped.unionByName(grouped.select(F.col("component").alias("key"), "component").distinct()).join(keys, "key")
    best = linked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best")).select("component", "best.key")
    gone = saved(linked.select("key", "component").join(best, ["key", "component"], "left_anti").select("key"), "gone")
    several = saved(keys.where("copies > 1").select("key"), "several")
    once = keyed.join(gone.union(several).distinct(), "key", "left_anti")
    if not several.isEmpty():
        kept = several.join(gone, "key", "left_anti")
        others = F.min(F.struct("lang", "source", "n_chars")).alias("o")
        repeats = keyed.join(kept, "key").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), others)
        once = once.select(*COLUMNS).unionByName(repeats.select("doc_id", "text", "o.*"))
    return once.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every repeated 200-byte string out of the texts; a character that is cut in part goes whole."""
    return suffix_dedup.texts_left(docs, carry=("lang", "source")).select(*COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows that hold a benchmark passage."""
    keyed = docs.select(*COLUMNS, row_key().alias("key"))
    found = decontaminate.leaks(keyed.select(F.col("key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select(*COLUMNS)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, and the language that the first stage found."""
    return byte_bpe.bpe_digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, carry=("lang",))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("byte_bpe", byte_pairs),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
