"""Trace-shaped views of the supplied synthetic tables, the same in Spark and in DuckDB.

The supplied tables hold no traces. These views give every operator rows of the right
shape; they are stand-ins, and nothing is claimed about real traces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the stand-ins.
EVENT_NAMES = {"signup": "SessionStart", "view": "PreToolUse", "click": "PostToolUse", "purchase": "PermissionRequest", "error": "PostToolUseFailure"}
PLATFORMS = ("claude", "codex", "opencode", "cursor", "pi")
TOOLS = ("Bash", "Edit", "Write", "Read", "Grep", "Glob", "Task")
DECISIONS = ("deny", "block", "ask", "warn", "context", "info", "allow", None)
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.create_map(*(F.lit(x) for kv in EVENT_NAMES.items() for x in kv))[F.col("event_type")]
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    s = lambda m: (F.col("k") % m).cast("string")
    path = F.concat(F.lit("/home/u/repos/repo"), s(4), F.lit("/dir"), s(9), F.lit("/f"), F.col("k").cast("string"), F.lit(".py"))
    shared = F.concat(F.lit("/home/u/repos/repo"), s(4), F.lit("/shared.py"))
    return e.select(
        F.col("event_id").alias("seq"), "ts", F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), name.alias("event_name"),
        _pick(PLATFORMS, F.col("user_id") % 5).alias("platform"), _pick(TOOLS, F.col("k") % 7).alias("tool_name"), path.alias("path"),
        F.when(F.col("k") % 3 == 0, F.array(path, shared)).otherwise(F.array(path)).alias("candidate_paths"), "k", "value",
    )


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = hook_events(spark, sf_dir)
    return e.select(
        "seq", "ts", "session_id", "event_name", "platform", "tool_name", F.concat(F.lit("R-"), (F.col("k") % 20).cast("string")).alias("rule_id"),
        _pick(SEVERITIES, F.col("k") % 4).alias("severity"), _pick(DECISIONS, F.floor("value") % 8).alias("decision"),
        F.concat(F.lit("m"), (F.col("k") % 6).cast("string")).alias("message"), F.when(F.col("k") % 11 != 0, F.col("path")).alias("path"), "k",
    )


def hook_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result per session and day; its decision is that of its findings by the dashboard's order."""
    from guardlake.functions.decisions import RESULT_ORDER, first_of

    f = rule_findings(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    g = f.groupBy("session_id", "day").agg(
        F.min("seq").alias("seq"), F.min("ts").alias("ts"), F.min_by("event_name", "seq").alias("event_name"), F.min_by("platform", "seq").alias("platform"),
        F.min_by("tool_name", "seq").alias("tool_name"), F.collect_set("decision").alias("decisions"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"), F.count("*").alias("n_findings"),
    )
    return g.select("session_id", "day", "seq", "ts", "event_name", "platform", "tool_name", first_of(F.col("decisions"), RESULT_ORDER).alias("decision"), "rule_ids", "n_findings", (F.col("seq") % 17 == 0).alias("skipped"), F.when(F.col("seq") % 13 == 0, 1).otherwise(0).cast("long").alias("n_errors"))


def subprocess_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("command"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("long").alias("returncode"), F.col("o_totalprice").alias("duration_ms"), F.concat(F.lit("err"), F.col("o_custkey").cast("string")).alias("stderr"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current violations: a row per line item, with the reference's id format."""
    i = table(spark, sf_dir, "lineitem")
    stable = F.concat_ws("|", F.concat(F.lit("rule"), (F.col("l_linenumber")).cast("string")), F.concat(F.lit("file"), (F.col("l_partkey") % 500).cast("string")), F.concat(F.lit("id"), (F.col("l_suppkey")).cast("string")))
    return i.where(F.col("l_quantity") <= 45).select(F.concat(F.lit("rule"), F.col("l_linenumber").cast("string")).alias("rule"), stable.alias("stable_id")).distinct()


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    stable = F.concat_ws("|", F.concat(F.lit("rule"), (F.col("l_linenumber")).cast("string")), F.concat(F.lit("file"), (F.col("l_partkey") % 500).cast("string")), F.concat(F.lit("id"), (F.col("l_suppkey")).cast("string")))
    return i.where(F.col("l_quantity") >= 10).select(F.concat(F.lit("rule"), F.col("l_linenumber").cast("string")).alias("rule"), stable.alias("stable_id")).distinct()


def _case(column: str, values, sql: bool = True) -> str:
    return "case " + column + " " + " ".join(f"when {i} then " + ("null" if v is None else f"'{v}'") for i, v in enumerate(values)) + " end"


HE = f"""he as (select event_id as seq, ts, 's' || user_id as session_id, case event_type {' '.join(f"when '{a}' then '{b}'" for a, b in EVENT_NAMES.items())} end as event_name,
 {_case('user_id % 5', PLATFORMS)} as platform, {_case('k % 7', TOOLS)} as tool_name, '/home/u/repos/repo' || (k % 4) || '/dir' || (k % 9) || '/f' || k || '.py' as path,
 case when k % 3 = 0 then ['/home/u/repos/repo' || (k % 4) || '/dir' || (k % 9) || '/f' || k || '.py', '/home/u/repos/repo' || (k % 4) || '/shared.py'] else ['/home/u/repos/repo' || (k % 4) || '/dir' || (k % 9) || '/f' || k || '.py'] end as candidate_paths, k, value
 from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))"""
RF = HE + f""", rf as (select seq, ts, session_id, event_name, platform, tool_name, 'R-' || (k % 20) as rule_id, {_case('k % 4', SEVERITIES)} as severity,
 {_case('cast(floor(value) as bigint) % 8', DECISIONS)} as decision, 'm' || (k % 6) as message, case when k % 11 <> 0 then path end as path, k from he)"""
HR = RF + """, hr as (select session_id, day, min(seq) as seq, min(ts) as ts, arg_min(event_name, seq) as event_name, arg_min(platform, seq) as platform, arg_min(tool_name, seq) as tool_name,
 coalesce(case max(case decision when 'block' then 7 when 'deny' then 6 when 'ask' then 5 when 'warn' then 4 when 'context' then 3 when 'info' then 2 when 'allow' then 1 end)
  when 7 then 'block' when 6 then 'deny' when 5 then 'ask' when 4 then 'warn' when 3 then 'context' when 2 then 'info' end, 'allow') as decision,
 list_sort(list_distinct(list(rule_id))) as rule_ids, count(*) as n_findings, min(seq) % 17 = 0 as skipped, case when min(seq) % 13 = 0 then 1 else 0 end as n_errors
 from (select *, strftime(ts, '%Y-%m-%d') as day from rf) group by session_id, day)"""
SR = """sr as (select o_orderkey as seq, o_orderpriority as command, case when o_orderstatus = 'F' then 1 else 0 end as returncode, o_totalprice as duration_ms, 'err' || o_custkey as stderr from orders)"""
_ID = "'rule' || l_linenumber || '|file' || (l_partkey % 500) || '|id' || l_suppkey"
VB = f"""cur as (select distinct 'rule' || l_linenumber as rule, {_ID} as stable_id from lineitem where l_quantity <= 45),
 base as (select distinct 'rule' || l_linenumber as rule, {_ID} as stable_id from lineitem where l_quantity >= 10)"""
