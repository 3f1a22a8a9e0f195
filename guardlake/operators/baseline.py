"""Set algebra of violation ids against a stored baseline. Frames have ``rule`` and ``stable_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(rule: Column, path: Column, identifier: Column, detail: Column) -> Column:
    return F.concat_ws("|", rule, path, identifier, F.when(detail != "", detail))


def new(current: DataFrame, stored: DataFrame) -> DataFrame:
    return current.join(stored, ["rule", "stable_id"], "left_anti").select("rule", "stable_id").distinct()


def fixed(current: DataFrame, stored: DataFrame) -> DataFrame:
    return new(stored, current)


def pruned(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(current, ["rule", "stable_id"], "left_semi").select("rule", "stable_id").distinct()


def effective(stored: DataFrame, inherited: DataFrame) -> DataFrame:
    return stored.select("rule", "stable_id").union(inherited.select("rule", "stable_id")).distinct()


def same(a: DataFrame, b: DataFrame) -> bool:
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


def inflated(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules with more ids than before; a swap of ids is allowed."""
    b, a = (x.groupBy("rule").agg(F.count("*").alias(name)) for x, name in ((before, "n_before"), (after, "n_after")))
    joined = a.join(b, "rule", "left").select("rule", F.coalesce("n_before", F.lit(0)).cast("long").alias("n_before"), "n_after")
    return joined.where("n_after > n_before")


def tally(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Per rule: all current, new, fixed and known ids, in one join and one aggregation."""
    both = current.select("rule", "stable_id", F.lit(1).alias("c")).join(stored.select("rule", "stable_id", F.lit(1).alias("b")), ["rule", "stable_id"], "full")
    count = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    c, b = F.col("c").isNotNull(), F.col("b").isNotNull()
    return both.groupBy("rule").agg(count(c).alias("total"), count(c & ~b).alias("new"), count(~c & b).alias("fixed"), count(c & b).alias("known"))


def frozen(current: DataFrame, stored: DataFrame) -> DataFrame:
    """The current ids become the baseline only if there is none yet."""
    return stored if stored.take(1) else current.select("rule", "stable_id").distinct()
