"""Joins of results, findings and events by nearness in time.

Every join is an equi-join on its keys and a time bucket as wide as the tolerance: the
right side stands in its own bucket and its neighbours, so a key with a third of all rows
is spread over time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.operators.claims import claim

__all__ = ["claim", "micros", "nearest", "unmatched", "within"]


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def within(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, before: bool = True, after: bool = True) -> DataFrame:
    """Pairs of equal keys at most ``tolerance`` microseconds apart; right columns get ``r_``; ``dt`` is right less left."""
    r = right.select(*(F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns))
    r = r.withColumn("_rt", micros("r_ts"))
    steps = [0] + [1] * before + [-1] * after
    r = r.withColumn("_b", F.explode(F.array(*(F.floor(F.col("_rt") / tolerance) + s for s in steps))))
    l = left.withColumn("_lt", micros("ts")).withColumn("_b", F.floor(F.col("_lt") / tolerance))  # noqa: E741
    dt = F.col("_rt") - F.col("_lt")
    ok = F.abs(dt) <= tolerance
    if not before:
        ok = ok & (dt >= 0)
    if not after:
        ok = ok & (dt <= 0)
    return l.join(r, [*keys, "_b"]).withColumn("dt", dt).where(ok).drop("_b", "_rt", "_lt")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, id_col: str = "seq", **side) -> DataFrame:
    """Each left row with its nearest right row, if any; ties to the smaller right id."""
    pairs = within(left, right, keys, tolerance, **side)
    best = pairs.groupBy(id_col).agg(F.min(F.struct(F.abs("dt").alias("d"), F.col(f"r_{id_col}").alias("r"))).alias("m"))
    return left.join(best.select(id_col, F.col("m.r").alias(f"near_{id_col}"), F.col("m.d").alias("distance")), id_col, "left")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, id_col: str = "seq") -> DataFrame:
    """Left rows without a right row within the tolerance."""
    hit = within(left.select(id_col, "ts", *keys), right.select(f"{id_col}", "ts", *keys), keys, tolerance).select(id_col).distinct()
    return left.join(hit, id_col, "left_anti")
