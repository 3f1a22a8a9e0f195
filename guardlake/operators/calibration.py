"""Calibration signals per rule: advisory pressure, runtime repetition, persistence, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.functions.decisions import ENFORCEMENT, is_in, round_half_up

#: Decisions that only warn, and those that stop a session.
WARNING, STOPPING = ("warn", "context", "ask", "info"), ("block", "deny", "ask")


def asymptote(v: Column, scale: float) -> Column:
    return 1 - F.exp(-v / scale)


def session_decisions(results: DataFrame) -> DataFrame:
    """The last block or denial of a session, else its first decision."""
    d = F.col("decision")
    hard = F.max(F.when(is_in(d, ENFORCEMENT), F.struct("seq", "decision")))
    return results.groupBy("session_id").agg(F.coalesce(hard["decision"], F.min_by("decision", "seq")).alias("final"))


def advisory(findings: DataFrame, results: DataFrame) -> DataFrame:
    """How often a warning is followed by a session that passes, weighed by volume."""
    warned = F.coalesce(F.col("decision"), F.lit("context")).isin(*WARNING)
    per = findings.groupBy("rule_id", "session_id").agg(F.count("*").alias("n"), F.sum(F.when(warned, 1).otherwise(0)).alias("w"))
    per = per.join(session_decisions(results), "session_id", "left")
    passed = (F.col("w") > 0) & ~F.coalesce(F.col("final").isin(*STOPPING), F.lit(False))
    g = per.groupBy("rule_id").agg(F.count("*").alias("sessions"), F.sum("n").cast("long").alias("total"), F.sum("w").cast("long").alias("warnings"), F.sum(F.when(passed, 1).otherwise(0)).cast("long").alias("allow_after_warn"))
    score = (F.col("allow_after_warn") / F.col("sessions") * 60 + F.col("warnings") / F.col("total") * 40) * F.least(F.col("sessions") / 5, F.lit(1.0))
    level = F.when((F.col("sessions") >= 8) & (F.col("total") >= 10), "high").when((F.col("sessions") >= 3) & (F.col("total") >= 4), "medium").otherwise("low")
    return g.withColumn("advisory_pressure", F.least(round_half_up(score).cast("long"), F.lit(100).cast("long"))).withColumn("confidence", level)


def repetition(findings: DataFrame) -> DataFrame:
    """Share of a rule's sessions in which it fires at more than one time, raised by volume."""
    per = findings.groupBy("rule_id", "session_id").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("times"))
    g = per.groupBy("rule_id").agg(F.count("*").alias("sessions"), F.sum(F.when(F.col("times") > 1, 1).otherwise(0)).cast("long").alias("repeating"), F.avg("n").alias("mean"))
    rate = F.col("repeating") / F.col("sessions")
    score = rate * (45 + 35 * asymptote(F.col("mean"), 20.0) + 20 * asymptote(F.col("sessions"), 20.0))
    return g.select("rule_id", "sessions", "repeating", round_half_up(score).cast("long").alias("repeat_score"))


def persistence(findings: DataFrame, scope: list[str]) -> DataFrame:
    """Findings of a rule in the last result of a scope against those in the first, capped at 1."""
    per = findings.groupBy("rule_id", *scope, "ts").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    w = Window.partitionBy("rule_id", *scope).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = per.select("rule_id", *scope, F.first("n").over(w).alias("first"), F.last("n").over(w).alias("last"), F.count("*").over(w).alias("k")).distinct().where("k > 1")
    g = ends.groupBy("rule_id").agg(F.sum("first").cast("long").alias("first"), F.sum("last").cast("long").alias("last"))
    return g.withColumn("persistence", round_half_up(F.least(F.col("last") / F.col("first"), F.lit(1.0)) * 100).cast("long"))


#: Beginnings of rule ids in upper case; base, weight and scale of the error score.
RULE_PREFIXES = ("PY", "BUILTIN", "STOP", "GLOBAL", "LG", "TS", "FE", "RS", "GIT", "SHELL", "QA", "WARN", "CONFIG", "STYLE", "REMIND")
ERROR_BASE, ERROR_WEIGHT, ERROR_SCALE = 30, 70, 5.0


def canonical(json: Column) -> Column:
    """JSON with the keys of all objects in order, without blanks; what is no JSON stays null."""
    return F.to_json(F.try_parse_json(json))


def scope_key(event: Column, tool: Column, command: Column, tool_input: Column) -> Column:
    """What makes two results comparable: event, tool, command, and the input whatever the order of its keys."""
    return F.to_json(F.struct(event.alias("event_name"), tool.alias("tool_name"), command.alias("command"), canonical(tool_input).alias("tool_input")), {"ignoreNullFields": "false"})


def rule_errors(results: DataFrame, rules: DataFrame) -> DataFrame:
    """``(rule_id, message)`` of the errors of ``results(errors)`` that name a rule before a colon.

    A known rule of ``rules(rule_id)`` is met whatever its case, of several spellings the smallest; an unknown one counts if it
    looks like an id, in upper case behind a known beginning, else in lower case. Other errors belong to no rule.
    """
    each = results.select(F.explode("errors").alias("error")).where("error is not null")
    pattern = r"(?s)^([A-Za-z0-9_-]+):\s*(.*)"
    named = each.where(F.col("error").rlike(pattern)).select(F.upper(F.regexp_extract("error", pattern, 1)).alias("upper"), F.regexp_extract("error", pattern, 2).alias("message"))
    known = rules.where("rule_id is not null").groupBy(F.upper("rule_id").alias("upper")).agg(F.min("rule_id").alias("known"))
    likely = F.when(F.col("upper").rlike("^(" + "|".join(RULE_PREFIXES) + ")-"), F.col("upper")).otherwise(F.lower("upper"))
    looks = F.when(F.col("upper").rlike("^[A-Z0-9]+-[A-Z0-9_-]+$"), likely)
    return named.join(known, "upper", "left").select(F.coalesce("known", looks).alias("rule_id"), "message").where("rule_id is not null")


def error_pressure(results: DataFrame, findings: DataFrame) -> DataFrame:
    """``(rule_id, errors, error_score, repeat_score, pressure)``: of every rule with errors or findings, how much it errs and repeats."""
    errors = rule_errors(results, findings.select("rule_id").distinct()).groupBy("rule_id").agg(F.count("*").alias("errors"))
    both = errors.join(repetition(findings).select("rule_id", "repeat_score"), "rule_id", "full")
    n = F.coalesce("errors", F.lit(0).cast("long"))
    score = F.when(n > 0, F.least(F.lit(100).cast("long"), ERROR_BASE + round_half_up(asymptote(n, ERROR_SCALE) * ERROR_WEIGHT).cast("long"))).otherwise(0)
    repeat = F.coalesce("repeat_score", F.lit(0).cast("long"))
    return both.select("rule_id", n.alias("errors"), score.alias("error_score"), repeat.alias("repeat_score"), F.greatest(score, repeat).alias("pressure"))
