"""Corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Every stage takes all that its predecessor kept and returns the columns of ``documents``,
the last one tokens. A null text has no words and no language. Ids may be null or repeat:
stages decide row by row, and of copies the one with the smallest id stays, null ids last.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm import bpe
from guardlake.llm.common import few_tasks, saved, small_batches, table
from guardlake.llm.decontaminate import remove_contamination
from guardlake.llm.langid import identify
from guardlake.llm.simhash import simhash_components
from guardlake.llm.substring import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and the column that tells their rows apart, in the order of ids: ``doc_id`` if it can, else a key written out."""
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1):
        return docs, "doc_id"
    order = [F.asc_nulls_last("doc_id"), F.xxhash64("text"), F.xxhash64("lang", "source")]  # many null ids lie in several ranges
    return saved(docs.orderBy(*order).withColumn("row", F.monotonically_increasing_id())), "row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no identified language go; the others' ``lang`` is the one identified."""
    small_batches(spark)
    docs, key = _keyed(docs.select(*COLUMNS))
    found = identify(docs, key).select(key, "language", "accepted")
    changed = saved(found.join(docs.select(key, "lang"), key).where("not accepted or lang is null or lang <> language").select(key, "language", "accepted"))
    named = docs.join(changed, key, "left").where("accepted is null or accepted")
    return named.withColumn("lang", F.coalesce("language", "lang")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the smallest id."""
    small_batches(spark)
    docs, key = _keyed(docs.select(*COLUMNS))
    gone = saved(simhash_components(docs, key, tasks=few_tasks(docs)).where(F.col(key) != F.col("component_id")).select(key))
    return docs.join(gone, key, "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages seen earlier are cut; a document of which nothing is left goes."""
    small_batches(spark)
    docs, key = _keyed(docs.select(*COLUMNS))
    cut = saved(remove_repeats(docs, key, tasks=few_tasks(docs)).where("n_removed > 0").select(key, "kept_text"))
    text = F.coalesce("kept_text", "text")
    return _measured(docs.join(cut, key, "left").where("kept_text is null or kept_text <> ''").withColumn("text", text))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; a document that is mostly such passages goes."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    return _measured(remove_contamination(docs, table(spark, sf_dir, "benchmark"))).coalesce(few_tasks(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with a digest of what they decode to."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)

    def row(tok: bpe.Tokenizer, ids: bytes) -> tuple:
        return len(ids) // 4, ids, hashlib.sha256(tok.decode(ids).encode()).hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType()), T.StructField("decoded_sha256", T.StringType())]
    return bpe.mapped(docs.select("doc_id", "lang", "source", "text"), bpe.default_path(), row, fields, "text", ("text",)).coalesce(few_tasks(docs))


STAGES = [
    ("language id", language),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeats),
    ("benchmark decontamination", decontaminated),
    ("bpe tokens", tokens),
]
#: Simhash components, winnowed repeats and merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
