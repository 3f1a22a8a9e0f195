"""Post-processing of findings before a decision: dedupe, reminders, compaction, enrichment, decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.decisions import ENGINE_RANK, ranked, severity_rank


def deduplicated(findings: DataFrame, event: str = "event_id") -> DataFrame:
    """Equal (rule, decision, message, context) of one event: the first stays."""
    w = Window.partitionBy(event, "rule_id", "decision", "message", "additional_context").orderBy("seq")
    return findings.withColumn("_p", F.row_number().over(w)).where("_p = 1").drop("_p")


def reminded_once(findings: DataFrame, rule_id: str) -> DataFrame:
    """Of a reminder rule's findings, one per session."""
    w = Window.partitionBy("session_id").orderBy("seq")
    reminder = F.coalesce(F.col("rule_id") == rule_id, F.lit(False))
    place = F.row_number().over(w)
    return findings.where(~reminder).union(findings.where(reminder).withColumn("_p", place).where("_p = 1").drop("_p"))


def decided(findings: DataFrame, event: str = "event_id") -> DataFrame:
    """One decision per event: the highest engine rank, ties by severity, then the first."""
    key = F.struct(ranked(F.col("decision"), ENGINE_RANK, 0).alias("a"), severity_rank(F.col("severity")).alias("b"), (-F.col("seq")).alias("c"))
    return findings.groupBy(event).agg(F.max_by("decision", key).alias("decision"), F.max_by("rule_id", key).alias("rule_id"), F.count("*").alias("n_findings"))


def enriched(findings: DataFrame, context: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Findings with a context table's text appended to their own; a finding without context keeps its own."""
    one = context.groupBy(*keys).agg(F.min(value).alias("_v"))
    joined = findings.join(one, keys, "left")
    return joined.withColumn("additional_context", F.when(F.concat_ws("", "additional_context", "_v") != "", F.concat_ws("\n", "additional_context", "_v"))).drop("_v")
