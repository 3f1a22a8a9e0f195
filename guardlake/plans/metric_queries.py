"""Metric queries on the stand-in traces, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.functions import paths as P
from guardlake.operators import metrics as M
from guardlake.plans import proxies as X
from guardlake.plans.proxies import HE, HR, RF, SR

ASOF = "2024-01-31 00:00:00"
FAMILIES = ["R-0", "R-3", "R-7", "R-19", "R-99"]
ENF = "decision in ('deny', 'block')"

QUERIES = {
    "top_rules_enforced": (
        lambda s, d: M.top_rules_enforced(X.rule_findings(s, d)),
        f"with {RF} select rule_id, count(*) as n from rf where {ENF} group by 1 order by n desc, min(seq), 1 limit 20",
    ),
    "counts_by_event": (lambda s, d: M.counts_by(X.hook_events(s, d), "event_name"), f"with {HE} select event_name, count(*) as n from he group by 1"),
    "counts_by_tool_severity": (lambda s, d: M.counts_by(X.rule_findings(s, d), "tool_name", "severity"), f"with {RF} select tool_name, severity, count(*) as n from rf group by 1, 2"),
    "counts_by_decision_finding": (lambda s, d: M.decision_volume(X.rule_findings(s, d)), f"with {RF} select coalesce(decision, 'allow') as decision, count(*) as n from rf group by 1"),
    "counts_by_decision_result": (lambda s, d: M.counts_by(X.hook_results(s, d), "decision"), f"with {HR} select decision, count(*) as n from hr group by 1"),
    "enforcement_split": (
        lambda s, d: M.enforcement_split(X.rule_findings(s, d)),
        f"with {RF} select count(*) filter ({ENF}) as enforced, count(*) filter (decision in ('ask','warn','context','info')) as advisory, count(*) filter (decision is null or decision = 'allow') as allowed from rf",
    ),
    "daily_volume": (lambda s, d: M.daily_volume(X.hook_events(s, d)), f"with {HE} select strftime(ts, '%Y-%m-%d') as day, count(*) as n from he group by 1"),
    "day_bounds": (lambda s, d: M.bounds(X.hook_events(s, d)), f"with {HE} select min(strftime(ts, '%Y-%m-%d')) as first_day, max(strftime(ts, '%Y-%m-%d')) as last_day, count(*) as n from he"),
    "distinct_sessions": (lambda s, d: X.hook_events(s, d).agg(F.count_distinct("session_id").alias("n")), f"with {HE} select count(distinct session_id) as n from he"),
    "retry_patterns": (lambda s, d: M.retry_patterns(X.rule_findings(s, d)), f"with {RF} select session_id, rule_id, count(*) as n from rf where {ENF} group by 1, 2 having count(*) >= 2"),
    "churn_by_rule": (
        lambda s, d: M.churn_by_rule(X.rule_findings(s, d)),
        f"with {RF}, c as (select rule_id, count(*) as n from rf where {ENF} group by session_id, rule_id, coalesce(path, '__pathless__')) select rule_id, count(*) filter (n = 1) as first_time, count(*) filter (n > 1) as repeated, cast(sum(n) as bigint) as hits from c group by 1",
    ),
    "resolution_rate": (
        lambda s, d: M.resolution_rate(X.rule_findings(s, d)),
        f"with {RF}, c as (select count(*) as n from rf where {ENF} group by session_id, rule_id, coalesce(path, '__pathless__')) select count(*) as keys, count(*) filter (n = 1) as once, case when count(*) > 0 then round(cast(count(*) filter (n = 1) as double) / count(*), 4) else 0.0::double end as rate from c",
    ),
    "median_retries": (
        lambda s, d: M.median_retries(X.rule_findings(s, d)),
        f"with {RF}, c as (select count(*) as n from rf where {ENF} group by session_id, rule_id, coalesce(path, '__pathless__')) select coalesce(cast(median(n - 1) filter (n > 1) as double), 0.0::double) as median_retries from c",
    ),
    "looping_files": (
        lambda s, d: M.looping_files(X.rule_findings(s, d)),
        f"with {RF}, c as (select path, count(*) as n from rf where {ENF} and path is not null group by session_id, rule_id, path) select path, cast(sum(n) as bigint) as hits, count(*) as loops from c where n > 1 group by 1",
    ),
    "denies_by_file": (
        lambda s, d: M.counts_by(M.denies(X.rule_findings(s, d)), "path"),
        f"with {RF} select coalesce(path, '__pathless__') as path, count(*) as n from rf where {ENF} group by 1",
    ),
    "rule_examples": (
        lambda s, d: M.rule_examples(X.rule_findings(s, d)),
        f"with {RF} select rule_id, place, message from (select *, row_number() over (partition by rule_id order by seq) as place from rf where message is not null) where place <= 3",
    ),
    "kpi_posture": (
        lambda s, d: M.posture(X.hook_results(s, d)),
        f"""with {HR}, c as (select count(*) as total, count(*) filter (decision = 'block') as block, count(*) filter (decision = 'deny') as deny, count(*) filter (decision = 'ask') as ask, count(*) filter (skipped) as skipped, count(*) filter (n_errors > 0) as errored from hr)
select total, block, deny, ask, cast(floor(100.0::double * block / total + 0.5) as bigint) as block_pct, cast(floor(100.0::double * deny / total + 0.5) as bigint) as deny_pct, cast(floor(100.0::double * ask / total + 0.5) as bigint) as ask_pct, skipped, errored from c""",
    ),
    "event_platform_pivot": (
        lambda s, d: M.pivot_counts(X.hook_events(s, d), "event_name", "platform", X.PLATFORMS),
        f"with {HE} select event_name, {', '.join(f'''count(*) filter (platform = '{p}') as {p}''' for p in X.PLATFORMS)}, count(*) as total from he group by 1",
    ),
    "top_rules_pivot": (
        lambda s, d: M.top_rules(X.rule_findings(s, d)),
        f"""with {RF} select rule_id, count(*) as n, count(*) filter (decision = 'block') as blocks, count(*) filter (decision = 'deny') as denies, count(*) filter (decision in ('ask','warn','context','info')) as advisories,
arg_min(severity, seq) as severity, min(seq) as first_seen, count(*) filter ({ENF}) as enforced from rf group by 1 order by enforced desc, blocks desc, denies desc, n desc, first_seen limit 20""",
    ),
    "dup_zero_fill": (
        lambda s, d: M.counts_zero_filled(X.rule_findings(s, d), "rule_id", FAMILIES),
        f"with {RF} select k.rule_id, count(rf.seq) as n from (values {', '.join(f'''('{x}')''' for x in FAMILIES)}) k(rule_id) left join rf on rf.rule_id = k.rule_id group by 1",
    ),
    "subprocess_by_command": (
        lambda s, d: M.commands(X.subprocess_runs(s, d)),
        f"""with {SR}, p as (select *, row_number() over (partition by command, returncode <> 0 order by seq) as place from sr)
select command, count(*) as runs, count(*) filter (returncode = 0) as passed, count(*) filter (returncode <> 0) as failures, cast(median(duration_ms) as double) as median_ms, coalesce(string_agg(stderr, '|' order by place) filter (returncode <> 0 and place <= 3), '') as errors from p group by 1""",
    ),
    "noisy_commands": (
        lambda s, d: M.noisy_commands(X.subprocess_runs(s, d)),
        f"with {SR} select command, count(*) as runs, count(*) filter (returncode <> 0) as failures, cast(count(*) filter (returncode <> 0) as double) / count(*) as fail_rate from sr group by 1 order by fail_rate desc, runs desc, command limit 5",
    ),
    "slowest_commands": (
        lambda s, d: X.subprocess_runs(s, d).groupBy("command").agg(F.max("duration_ms").alias("slowest_ms"), F.count("*").alias("runs")).orderBy(F.desc("slowest_ms"), "command").limit(8),
        f"with {SR} select command, max(duration_ms) as slowest_ms, count(*) as runs from sr group by 1 order by slowest_ms desc, command limit 8",
    ),
    "ops_top_counts": (
        lambda s, d: M.top_k(X.hook_results(s, d).select("seq", F.coalesce("platform", F.lit("unknown")).alias("platform")), "platform", 10, "seq"),
        f"with {HR} select coalesce(platform, 'unknown') as platform, count(*) as n from hr group by 1 order by n desc, min(seq), 1 limit 10",
    ),
    "blocked_resolution": (
        lambda s, d: M.blocked_resolution(X.hook_results(s, d)),
        f"""with {HR}, b as (select *, min(case when {ENF} then seq end) over (partition by session_id) as fb from hr),
g as (select session_id, count(*) filter (decision in ('allow','context','warn','info') and seq > fb) as later from b where fb is not null group by 1) select count(*) as blocked, count(*) filter (later > 0) as resolved from g""",
    ),
    "repeated_denials": (
        lambda s, d: M.repeated_denials(X.rule_findings(s, d)),
        f"with {RF} select substr(session_id, 1, 8) || ' · ' || rule_id as label, count(*) as n from rf where {ENF} group by 1 having count(*) > 1 order by n desc, label limit 5",
    ),
    "pathless_results": (
        lambda s, d: M.pathless_results(X.hook_results(s, d), X.rule_findings(s, d).where("path is not null").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))),
        f"with {HR} select count(*) as n from hr where not exists (select 1 from rf where rf.path is not null and rf.session_id = hr.session_id and strftime(rf.ts, '%Y-%m-%d') = hr.day)",
    ),
    "hottest_repos": (
        lambda s, d: M.top_k(X.hook_events(s, d).select("seq", F.explode("candidate_paths").alias("p")).select("seq", P.repo_label(F.col("p")).alias("repo")), "repo", 10),
        f"with {HE} select regexp_extract(p, '(?:^|/)repos/([^/]+)', 1) as repo, count(*) as n from (select unnest(candidate_paths) as p from he) group by 1 order by n desc, repo limit 10",
    ),
    "pareto": (
        lambda s, d: M.pareto(M.counts_by(X.rule_findings(s, d), "rule_id"), "rule_id", "n"),
        f"""with {RF}, c as (select rule_id, count(*) as n from rf group by 1), r as (select *, row_number() over (order by n desc, rule_id) as i from c),
t as (select case when i <= 12 then rule_id end as label, n, i from r), g as (select label, n, i from t where i <= 12 union all select '+' || count(*) || ' more', sum(n), 99 from t where i > 12 having count(*) > 0)
select label, cast(n as bigint) as n, cast(floor(100.0::double * sum(n) over (order by i) / (select sum(n) from c) + 0.5) as bigint) as cumulative_pct from g""",
    ),
    "severity_top3": (
        lambda s, d: M.top_per_group(X.rule_findings(s, d), "severity", "rule_id", 3),
        f"with {RF}, c as (select severity, rule_id, count(*) as n from rf group by 1, 2) select * from (select *, row_number() over (partition by severity order by n desc, rule_id) as place from c) where place <= 3",
    ),
    "history_threshold": (
        lambda s, d: M.history(X.rule_findings(s, d), 30),
        f"""with {RF}, c as (select rule_id, path, coalesce(decision, 'none') as decision, count(*) as n from rf where path is not null group by 1, 2, 3)
select rule_id, path, cast(sum(n) as bigint) as n, array_to_string(list_sort(list(decision || '=' || n)), ',') as decisions from c group by 1, 2 having sum(n) >= 30""",
    ),
    "time_series_hour": (lambda s, d: M.buckets(X.hook_events(s, d), "hour"), f"with {HE} select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as bucket, count(*) as n from he group by 1"),
    "time_series_day": (lambda s, d: M.buckets(X.hook_events(s, d), "day"), f"with {HE} select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') as bucket, count(*) as n from he group by 1"),
    "sparkline_12": (
        lambda s, d: M.sparkline(X.hook_events(s, d), F.lit(ASOF), 168),
        f"""with {HE}, a as (select epoch_us(timestamp '{ASOF}') - epoch_us(ts) as age from he) select cast(11 - age // 50400000000 as bigint) as bucket, count(*) as n from a where age >= 0 and age < 604800000000 group by 1""",
    ),
    "funnel_matrix": (
        lambda s, d: M.pivot_counts(X.hook_results(s, d), "decision", "platform", X.PLATFORMS),
        f"with {HR} select decision, {', '.join(f'''count(*) filter (platform = '{p}') as {p}''' for p in X.PLATFORMS)}, count(*) as total from hr group by 1",
    ),
}
