"""Null and repeated ids in the pipeline's stages: rows are decided on one by one."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(seed, n=120):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA).withColumn("n_chars", F.length("text").cast("long"))


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates_keep_null_and_repeated_ids(spark, sf):
    a, b, c, d, e, f = map(prose, range(6))
    # two null ids beside a repeated id; one id with two texts, of which one is a copy; an exact repeat; a copy with a null id
    given = frame(spark, [(None, a), (None, b), (1, c), (2, c), (2, d), (3, e), (3, e), (4, f), (None, f)])
    assert rows(corpus_pipeline.near_duplicates(spark, given, sf)) == rows(frame(spark, [(None, a), (None, b), (1, c), (2, d), (3, e), (4, f)]))


def test_repeats_cut_in_rows_of_null_id(spark, sf):
    shared, own, other = prose(10, 80), prose(11), prose(12)
    given = frame(spark, [(1, shared), (None, f"{own} {shared}"), (2, other), (2, f"{own[:20]} {shared}")])
    assert rows(corpus_pipeline.repeats(spark, given, sf)) == rows(frame(spark, [(1, shared), (None, own), (2, other), (2, own[:20].strip())]))


@pytest.mark.parametrize("last", [1, None])
def test_language_decides_by_row(spark, sf, last):
    given = frame(spark, [(1, prose(20)), (1, "1 2 3"), (last, "4 5 6"), (None, prose(21))])
    assert rows(corpus_pipeline.language(spark, given, sf)) == rows(frame(spark, [(1, prose(20)), (None, prose(21))]))
