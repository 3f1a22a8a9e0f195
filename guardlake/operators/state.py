"""Keyed state over a log, as windows: counters, escalation, emit-once, unlocking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.decisions import ENFORCEMENT, is_in, severity_rank

KEY = ("session_id", "rule_id", "path", "attempt")


def escalated(findings: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Denials with their count so far: from the second on text is added, from the third on they block at HIGH or more."""
    hits = findings.where(is_in(F.col("decision"), ENFORCEMENT)).fillna({k: v for k, v in {"path": "__pathless__", "attempt": "__unknown_attempt__"}.items() if k in key} or {key[0]: ""})
    n = F.row_number().over(Window.partitionBy(*key).orderBy("seq")).cast("long")
    hits = hits.withColumn("repeat", n)
    third = F.col("repeat") >= 3
    high = severity_rank(F.col("severity")) < 30
    return hits.select(
        "seq", *key, "repeat", F.when(third, "block").otherwise(F.col("decision")).alias("decision"), F.when(third & high, "HIGH").otherwise(F.col("severity")).alias("severity"), (F.col("repeat") >= 2).alias("noted"),
    )


def once(rows: DataFrame, *key: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy("seq")
    return rows.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")


def unlocked_reads(reads: DataFrame) -> DataFrame:
    """Partial reads, and whether the same session had read the whole file before."""
    w = Window.partitionBy("session_id", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(F.col("full").cast("int")).over(w), F.lit(0)) == 1
    return reads.withColumn("allowed", seen).where(~F.col("full")).select("seq", "session_id", "path", "allowed")


def recent_failures(findings: DataFrame, least: int = 2, k: int = 4) -> DataFrame:
    """A session's most repeated denials."""
    c = findings.where(is_in(F.col("decision"), ENFORCEMENT)).groupBy("session_id", "rule_id").agg(F.count("*").alias("n"), F.max("seq").alias("last_seq")).where(F.col("n") >= least)
    w = Window.partitionBy("session_id").orderBy(F.desc("n"), F.desc("last_seq"))
    return c.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def pruned_counters(counters: DataFrame, keep: int = 512) -> DataFrame:
    """The ``keep`` largest by value, then key: a top-k, not a sort of all."""
    return counters.orderBy(F.desc("value"), F.desc("key")).limit(keep)


def runs(rows: DataFrame, flag: str, *key: str) -> DataFrame:
    """Longest run of consecutive flagged rows per key (gaps and islands)."""
    a = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    b = F.row_number().over(Window.partitionBy(*key, flag).orderBy("seq"))
    island = rows.withColumn("_i", a - b).where(F.col(flag)).groupBy(*key, "_i").agg(F.count("*").alias("n"))
    return island.groupBy(*key).agg(F.max("n").alias("longest"))


def attempt_fingerprint(*parts):
    """SHA-256 of the parts as JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)
