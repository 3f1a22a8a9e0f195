"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.storage import drop_saved, saved, shared_dir

__all__ = ["connected_components", "drop_saved", "few_tasks", "saved", "shared_dir", "small_batches", "table"]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts take 1000 rows unless the session says otherwise: two workers
    of an executor hold a batch each, in and out, beside the JVM's copies."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_tasks(scan: DataFrame, splits: int = 3) -> int:
    """How many tasks read a table's scan with ``splits`` input splits each, two tasks a core at least:
    fewer and larger files where each split leaves little."""
    return max(2 * scan.sparkSession.sparkContext.defaultParallelism, -(-scan.rdd.getNumPartitions() // splits))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 40) -> DataFrame:
    """Smallest node reachable, for every node of an undirected edge list.

    Alternates large-star and small-star steps (Kiveris et al., 2014), which end in
    O(log^2 n) rounds whatever the diameter. Returns ``(node, component)`` for the
    nodes that have an edge to another node; self loops and nulls are ignored. A hub
    is an ordinary skewed join key: both join sides are plain shuffles, so adaptive
    execution can split it.
    """
    both_sides = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = saved(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        # large star: every neighbour above u is hung under the smallest of u's neighbourhood
        both = both_sides(e)
        low = saved(both.groupBy("u").agg(F.min("v").alias("m")).where("m < u"))
        large = (
            both.where("v > u").join(low, "u", "left")
            .select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()
        )
        large = saved(large)
        # small star: the neighbours below u, and u itself, are hung under the smallest one
        low2 = saved(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low2.select("u", F.col("m").alias("v"))).distinct()
        )
        small = saved(small)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_saved(e, low, large, low2)
        e = small
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
