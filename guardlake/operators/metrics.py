"""Counts, rates and top lists over hook events, findings, results and subprocess runs.

Inputs are frames with the columns of the trace tables (``session_id, seq, ts, event_name,
platform, tool_name``; findings add ``rule_id, severity, decision, message, path``). Every
ordering ends in a total key, so ties are stable; counts combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.decisions import ADVISORY, ENFORCEMENT, is_in

PATHLESS = "__pathless__"


def n(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def top_k(df: DataFrame, key: str, k: int, seq: str | None = None) -> DataFrame:
    """Most frequent keys; ties by first appearance (``seq``) or by the key itself."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(seq or key).alias("_first"))
    return counted.orderBy(F.desc("n"), "_first", key).limit(k).drop("_first")


def top_rules_enforced(findings: DataFrame, k: int = 20) -> DataFrame:
    return top_k(findings.where(is_in(F.col("decision"), ENFORCEMENT)), "rule_id", k, "seq")


def decision_volume(findings: DataFrame) -> DataFrame:
    """Per finding, with an absent decision counted as allow."""
    return counts_by(findings.select(F.coalesce("decision", F.lit("allow")).alias("decision")), "decision")


def enforcement_split(findings: DataFrame) -> DataFrame:
    d = F.col("decision")
    return findings.agg(n(is_in(d, ENFORCEMENT)).alias("enforced"), n(is_in(d, ADVISORY)).alias("advisory"), n(d.isNull() | (d == "allow")).alias("allowed"))


def daily_volume(events: DataFrame) -> DataFrame:
    return counts_by(events.select(F.date_format("ts", "yyyy-MM-dd").alias("day")), "day")


def denies(findings: DataFrame) -> DataFrame:
    return findings.where(is_in(F.col("decision"), ENFORCEMENT)).withColumn("path", F.coalesce("path", F.lit(PATHLESS)))


def retry_patterns(findings: DataFrame, least: int = 2) -> DataFrame:
    return counts_by(findings.where(is_in(F.col("decision"), ENFORCEMENT)), "session_id", "rule_id").where(F.col("n") >= least)


def churn(findings: DataFrame) -> DataFrame:
    """Hits of each (session, rule, path) that was denied at all."""
    return counts_by(denies(findings), "session_id", "rule_id", "path")


def churn_by_rule(findings: DataFrame) -> DataFrame:
    return churn(findings).groupBy("rule_id").agg(n(F.col("n") == 1).alias("first_time"), n(F.col("n") > 1).alias("repeated"), F.sum("n").cast("long").alias("hits"))


def resolution_rate(findings: DataFrame) -> DataFrame:
    """Share of denied keys that were denied once, to 4 places; 0 without denials."""
    c = churn(findings).agg(F.count("*").alias("keys"), F.coalesce(n(F.col("n") == 1), F.lit(0)).alias("once"))
    return c.select("keys", "once", F.when(F.col("keys") > 0, F.round(F.col("once") / F.col("keys"), 4)).otherwise(0.0).alias("rate"))


def median_retries(findings: DataFrame) -> DataFrame:
    """Exact median of repeats over the keys denied more than once; 0 without any."""
    return churn(findings).where("n > 1").agg(F.coalesce(F.median(F.col("n") - 1).cast("double"), F.lit(0.0)).alias("median_retries"))


def looping_files(findings: DataFrame) -> DataFrame:
    c = churn(findings).where((F.col("n") > 1) & (F.col("path") != PATHLESS))
    return c.groupBy("path").agg(F.sum("n").cast("long").alias("hits"), F.count("*").alias("loops"))


def rule_examples(findings: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("rule_id").orderBy("seq")
    return findings.where("message is not null").withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k).select("rule_id", "place", "message")


def posture(results: DataFrame) -> DataFrame:
    d = F.col("decision")
    share = lambda x: F.when(F.col("total") > 0, F.floor(100.0 * F.col(x) / F.col("total") + 0.5)).otherwise(0).cast("long")
    c = results.agg(F.count("*").alias("total"), *(n(d == x).alias(x) for x in ("block", "deny", "ask")), n(F.col("skipped")).alias("skipped"), n(F.col("n_errors") > 0).alias("errored"))
    return c.select("total", "block", "deny", "ask", share("block").alias("block_pct"), share("deny").alias("deny_pct"), share("ask").alias("ask_pct"), "skipped", "errored")


def pivot_counts(df: DataFrame, row: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts with a column for each value; declared values need no extra pass."""
    return df.groupBy(row).agg(*(n(F.col(column) == v).alias(v) for v in values), F.count("*").alias("total"))


def top_rules(findings: DataFrame, k: int = 20) -> DataFrame:
    """Rules with enforcement first, then by blocks, denials, count and first appearance; the first severity is shown."""
    d = F.col("decision")
    c = findings.groupBy("rule_id").agg(
        F.count("*").alias("n"), n(d == "block").alias("blocks"), n(d == "deny").alias("denies"), n(is_in(d, ADVISORY)).alias("advisories"),
        F.min_by("severity", "seq").alias("severity"), F.min("seq").alias("first_seen"),
    )
    c = c.withColumn("enforced", F.col("blocks") + F.col("denies"))
    return c.orderBy(F.desc("enforced"), F.desc("blocks"), F.desc("denies"), F.desc("n"), "first_seen").limit(k)


def counts_zero_filled(df: DataFrame, key: str, families: list[str]) -> DataFrame:
    known = df.sparkSession.createDataFrame([(x,) for x in families], f"{key} string")
    return known.join(counts_by(df, key), key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def commands(runs: DataFrame, k: int = 3) -> DataFrame:
    """Per command: runs, failures, median duration and the first ``k`` error texts of failures."""
    failed = F.col("returncode") != 0
    w = Window.partitionBy("command", failed).orderBy("seq")
    seen = runs.withColumn("failed", failed).withColumn("place", F.row_number().over(w))
    kept = F.array_sort(F.collect_list(F.when(F.col("failed") & (F.col("place") <= k), F.struct("place", "stderr"))))
    return seen.groupBy("command").agg(
        F.count("*").alias("runs"), n(~F.col("failed")).alias("passed"), n(F.col("failed")).alias("failures"), F.median(F.coalesce("duration_ms", F.lit(0.0))).alias("median_ms"), F.array_join(F.transform(kept, lambda x: x["stderr"]), "|").alias("errors"),
    )


def noisy_commands(runs: DataFrame, k: int = 5) -> DataFrame:
    c = runs.groupBy("command").agg(F.count("*").alias("runs"), n(F.col("returncode") != 0).alias("failures"))
    return c.withColumn("fail_rate", F.col("failures") / F.col("runs")).orderBy(F.desc("fail_rate"), F.desc("runs"), "command").limit(k)


def blocked_resolution(results: DataFrame) -> DataFrame:
    """Sessions with a block or denial, and those with a passing result after the first one."""
    d = F.col("decision")
    first = F.min(F.when(is_in(d, ENFORCEMENT), F.col("seq"))).over(Window.partitionBy("session_id"))
    later = n(is_in(d, ("allow", "context", "warn", "info")) & (F.col("seq") > F.col("first_block")))
    s = results.withColumn("first_block", first).where("first_block is not null").groupBy("session_id").agg(later.alias("later"))
    return s.agg(F.count("*").alias("blocked"), F.coalesce(n(F.col("later") > 0), F.lit(0)).alias("resolved"))


def repeated_denials(findings: DataFrame, k: int = 5) -> DataFrame:
    c = counts_by(findings.where(is_in(F.col("decision"), ENFORCEMENT)).select(F.concat(F.col("session_id").substr(1, 8), F.lit(" · "), "rule_id").alias("label")), "label")
    return c.where("n > 1").orderBy(F.desc("n"), "label").limit(k)


def pathless_results(results: DataFrame, paths: DataFrame) -> DataFrame:
    return results.join(paths.select("session_id", "day").distinct(), ["session_id", "day"], "left_anti").agg(F.count("*").alias("n"))


def pareto(counts: DataFrame, label: str, value: str, k: int = 12) -> DataFrame:
    """The ``k`` largest, one row for the rest, and the running share in percent.

    The rest is summed by an aggregation; only ``k + 1`` rows meet in the ordered window.
    """
    top = counts.orderBy(F.desc(value), label).limit(k).select(F.col(label).alias("label"), F.col(value).cast("long").alias("n"), F.lit(0).alias("tail"))
    rest = counts.join(top.select("label"), counts[label] == F.col("label"), "left_anti").agg(F.count("*").alias("c"), F.sum(value).cast("long").alias("n")).where("c > 0")
    rows = top.union(rest.select(F.concat(F.lit("+"), F.col("c").cast("string"), F.lit(" more")), "n", F.lit(1)))
    w = Window.orderBy("tail", F.desc("n"), "label")
    whole = counts.agg(F.sum(value).cast("long").alias("whole"))
    run = rows.withColumn("running", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return run.crossJoin(F.broadcast(whole)).select("label", "n", F.floor(100.0 * F.col("running") / F.col("whole") + 0.5).cast("long").alias("cumulative_pct"))


def top_per_group(df: DataFrame, group: str, key: str, k: int) -> DataFrame:
    c = counts_by(df, group, key)
    w = Window.partitionBy(group).orderBy(F.desc("n"), key)
    return c.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


def history(findings: DataFrame, least: int) -> DataFrame:
    """Rule and path pairs seen ``least`` times or more, with their decisions as ``decision=count``."""
    c = counts_by(findings.where("path is not null").select("rule_id", "path", F.coalesce("decision", F.lit("none")).alias("decision")), "rule_id", "path", "decision")
    g = c.groupBy("rule_id", "path").agg(F.sum("n").cast("long").alias("n"), F.array_sort(F.collect_list(F.concat_ws("=", "decision", F.col("n").cast("string")))).alias("d"))
    return g.where(F.col("n") >= least).select("rule_id", "path", "n", F.array_join("d", ",").alias("decisions"))


def buckets(df: DataFrame, width: str) -> DataFrame:
    """Counts in tumbling buckets aligned to the epoch: ``hour`` or ``day``."""
    return counts_by(df.select(F.date_format(F.date_trunc(width, "ts"), "yyyy-MM-dd HH:mm").alias("bucket")), "bucket")


def sparkline(df: DataFrame, asof: Column, hours: int, parts: int = 12) -> DataFrame:
    """Counts in ``parts`` equal spans that end at ``asof``; rows outside are left out."""
    age = F.unix_micros(asof.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    width = hours * 3_600_000_000 // parts
    place = (F.lit(parts - 1) - F.floor(age / width)).cast("long")
    return counts_by(df.where((age >= 0) & (age < width * parts)).select(F.least(F.greatest(place, F.lit(0)), F.lit(parts - 1)).cast("long").alias("bucket")), "bucket")


def bounds(df: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return df.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("n"))
