"""Queries of this subpackage and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from guardlake.llm import bpe, curriculum, decontaminate, hnsw, langid, mixing, negatives, quality, simhash, substring, urls, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hnsw": hnsw.op1_hnsw,
    "op2_urls": urls.op2_urls,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_langid": langid.op6_langid,
    "op7_substring": substring.op7_substring,
    "op8_bpe": bpe.op8_bpe,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_simhash": simhash.op10_simhash,
    "op11_whitening": whitening.op11_whitening,
    "op12_curriculum": curriculum.op12_curriculum,
    "op13_negatives": negatives.op13_negatives,
    "langid_pages": langid.langid_pages,
}
ORACLE_SQL: dict[str, str] = {
    "op2_urls": urls.oracle(),
    "op5_warc": warc.ORACLE,
    "op12_curriculum": curriculum.oracle(),
    "op13_negatives": negatives.ORACLE,
}
