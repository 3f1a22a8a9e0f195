"""Path roll-up, heat map and project partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.paths import prefixes


def rollup(events: DataFrame, findings: DataFrame) -> DataFrame:
    """Distinct events, findings and blocks below every prefix of a path.

    A row carries its id at most once per prefix, so each side is one aggregation; an
    event with several paths below a prefix counts once.
    """
    below = lambda df, path: df.withColumn("_x", F.explode(prefixes(path))).select("*", "_x.prefix", "_x.depth")
    e = below(events.select("seq", F.explode("candidate_paths").alias("p")), F.col("p")).groupBy("prefix", "depth").agg(F.count_distinct("seq").alias("n_events"))
    f = below(findings.where("path is not null").select("seq", "path", "decision"), F.col("path")).groupBy("prefix").agg(F.count("*").alias("n_findings"), F.sum(F.when(F.col("decision").isin("block", "deny"), 1).otherwise(0)).cast("long").alias("n_blocks"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return e.join(f, "prefix", "left").select("prefix", F.col("depth").cast("long").alias("depth"), "n_events", zero("n_findings"), zero("n_blocks"))


def heatmap(events: DataFrame, least: int = 4, most: int = 12, width: int = 3_600_000_000) -> DataFrame:
    """Counts by path and equal time span; as many spans as hours, from ``least`` to ``most``."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    ends = ends.withColumn("parts", F.least(F.greatest(F.ceil((F.col("t1") - F.col("t0")) / width), F.lit(least)), F.lit(most)))
    span = F.greatest((F.col("t1") - F.col("t0")) / F.col("parts"), F.lit(1.0))
    placed = events.crossJoin(F.broadcast(ends)).select("path", F.least(F.floor((t - F.col("t0")) / span), F.col("parts") - 1).cast("long").alias("bucket"))
    return placed.groupBy("path", "bucket").agg(F.count("*").alias("n"))


def projects(events: DataFrame, root: str, mode: str) -> DataFrame:
    """First non-null root and mode of each session, then sessions by root."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = events.select("session_id", F.first(root, ignorenulls=True).over(w).alias("root"), F.first(mode, ignorenulls=True).over(w).alias("mode")).distinct()
    return first.groupBy("root").agg(F.count("*").alias("sessions"), F.count_distinct("mode").alias("modes"))
