"""Further queries on the stand-ins, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.operators import more as O
from guardlake.operators import sessions as S
from guardlake.plans import corpus_queries as Q
from guardlake.plans import proxies as X
from guardlake.plans.proxies import HE, HR, RF, SR, VB
from guardlake.plans.session_queries import SUMMARY

ENF = "decision in ('deny', 'block')"
ASOF = "2024-01-31 00:00:00"


def _summary(s, d):
    return S.summary(X.hook_events(s, d), X.hook_results(s, d))


def _imports(s, d):
    p = X.table(s, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("pkg"), (F.col("p_partkey") % 11).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit(".m"), (F.col("p_size") % 11).cast("string")))).alias("module"))


def _modules(s, d):
    return X.table(s, d, "supplier").select(F.concat(F.lit("pkg"), (F.col("s_suppkey") % 9).cast("string"), F.lit(".m"), (F.col("s_suppkey") % 7).cast("string")).alias("module"))


QUERIES = {
    "session_group_merge": (
        lambda s, d: O.group_merge(_summary(s, d), _summary(s, d).where("session_id < 's5'").select("session_id", F.concat(F.lit("s"), F.floor(F.substring("session_id", 2, 9).cast("long") / 4).cast("string")).alias("root"))),
        f"""with {HR}, {SUMMARY}, j as (select session_id, n_events, duration_ms, coalesce(outcome, 'allow') as outcome, case when session_id < 's5' then 's' || (cast(substr(session_id, 2) as bigint) // 4) else session_id end as root from ss left join so using (session_id))
select root, count(*) as members, cast(sum(n_events) as bigint) as n_events, max(duration_ms) as longest_ms, case when bool_or(outcome = 'block') then 'block' when bool_or(outcome = 'deny') then 'deny' when bool_or(outcome = 'ask') then 'ask' else 'allow' end as outcome, min(session_id) as first_member from j group by 1""",
    ),
    "snapshot_summary": (
        lambda s, d: O.snapshot_summary(X.hook_events(s, d), X.rule_findings(s, d), X.subprocess_runs(s, d)),
        f"with {RF}, {SR} select 'platform' as section, platform as key, count(*) as n from he group by 2 union all select 'decision', coalesce(decision, 'allow'), count(*) from rf group by 2 union all select 'failure', command, count(*) from sr where returncode <> 0 group by 2",
    ),
    "baseline_summary": (lambda s, d: O.baseline_summary(X.violations(s, d)), f"with {VB} select rule, split_part(stable_id, '|', 2) as file, count(*) as n from cur group by 1, 2"),
    "advisory_visible": (
        lambda s, d: O.visible_advisories(X.hook_events(s, d), "path", "value"),
        f"with {HE} select path, arg_max(seq, (value, -seq)) as seq, count(*) - 1 as suppressed from he group by 1",
    ),
    "changed_rows": (
        lambda s, d: O.changed_rows(X.hook_events(s, d), "session_id", F.concat_ws("|", "event_name", "tool_name")).select("seq", "session_id"),
        f"with {HE} select seq, session_id from (select *, event_name || '|' || tool_name as sg, lag(event_name || '|' || tool_name) over (partition by session_id order by seq) as b from he) where b <> sg",
    ),
    "page_of_session": (
        lambda s, d: O.page_of(S.latest(X.hook_events(s, d)), [F.desc("seq")]).select("session_id", "page"),
        f"with {HE} select session_id, (row_number() over (order by max(seq) desc) - 1) // 15 as page from he group by 1",
    ),
    "retry_locks": (
        lambda s, d: O.locked(X.hook_results(s, d).select("seq", "session_id", "rule_ids"), X.rule_findings(s, d).where("decision = 'block' and k % 4 = 0").groupBy("session_id").agg(F.collect_set("rule_id").alias("locked_ids"))),
        f"""with {HR}, l as (select distinct session_id, rule_id from rf where decision = 'block' and k % 4 = 0), x as (select seq, session_id, unnest(rule_ids) as rule_id from hr)
select x.seq as seq, x.session_id as session_id, string_agg(x.rule_id, ',' order by x.rule_id) as broken from x join l on l.session_id = x.session_id and l.rule_id = x.rule_id group by 1, 2""",
    ),
    "repair_plans": (
        lambda s, d: X.table(s, d, "conversations").select("conv_id", "turn", O.repair_signal(F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, " Repair plan: the RULE, then re-read").otherwise(" plan"))).alias("signal")).where("signal"),
        "select conv_id, turn, true as signal from conversations where turn % 2 = 0",
    ),
    "counters_cleared": (
        lambda s, d: O.cleared(X.rule_findings(s, d).where("decision in ('deny', 'block') and path is not null"), X.hook_events(s, d).where("tool_name in ('Edit', 'Write')")),
        f"""with {RF}, h as (select session_id, path, max(seq) as last_hit, count(*) as hits from rf where {ENF} and path is not null group by 1, 2), t as (select session_id, path, max(seq) as last_touch from he where tool_name in ('Edit', 'Write') group by 1, 2)
select * from h join t using (session_id, path) where last_touch > last_hit""",
    ),
    "obsolete_imports": (
        lambda s, d: O.obsolete_imports(_imports(s, d), _modules(s, d)).select("id", "module"),
        """with m as (select distinct 'pkg' || (s_suppkey % 9) || '.m' || (s_suppkey % 7) as module from supplier), k as (select module from m union select split_part(module, '.', 1) from m),
i as (select p_partkey as id, 'pkg' || (p_partkey % 11) || case when p_partkey % 3 = 0 then '' else '.m' || (p_size % 11) end as module from part) select id, module from i where module not in (select module from k)""",
    ),
    "literal_constants": (
        lambda s, d: O.constant_for(X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("value")), X.table(s, d, "part").select(F.col("p_size").cast("long").alias("value"), F.col("p_type").alias("path"), (F.col("p_partkey") % 90).alias("line"), F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("name"))).groupBy("value", "constant", "constant_path").agg(F.count("*").alias("n")),
        """with c as (select cast(p_size as bigint) as value, p_type as path, p_partkey % 90 as line, 'C' || p_partkey as name from part), f as (select value, arg_min(name, (path, line, name)) as constant, arg_min(path, (path, line, name)) as constant_path from c group by 1)
select l.value as value, constant, constant_path, count(*) as n from (select cast(l_quantity as bigint) as value from lineitem) l left join f using (value) group by 1, 2, 3""",
    ),
    "rule_counterparts": (
        lambda s, d: O.counterparts(X.rule_findings(s, d).groupBy("rule_id").agg(F.collect_set("tool_name").alias("collectors"))),
        f"with {RF} select tool_name as collector, string_agg(distinct rule_id, ',' order by rule_id) as rules from rf group by 1",
    ),
    "error_rule_ids": (
        lambda s, d: O.error_rules(X.table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("failed in py-code-"), (F.col("s_suppkey") % 30).cast("string"), F.lit(": x")).alias("text")), X.table(s, d, "supplier").where("s_suppkey < 20").select(F.concat(F.lit("PY-CODE-"), F.col("s_suppkey").cast("string")).alias("rule_id"))).select("s_suppkey", "rule_id"),
        "select s_suppkey, case when s_suppkey % 30 < 20 then 'PY-CODE-' || (s_suppkey % 30) else 'PY-CODE-0' end as rule_id from supplier",
    ),
    "long_lines": (
        lambda s, d: O.long_lines(X.table(s, d, "documents"), "doc_id", "text", 1000),
        r"""with l as (select doc_id, unnest(range(1, len(p) + 1)) as line, rtrim(unnest(p), ' ') as raw from (select doc_id, string_split(text, chr(10)) as p from documents))
select doc_id, line, length(raw) as length from l where length(raw) > 1000 and not starts_with(ltrim(raw, ' '), '#') and not regexp_matches(ltrim(raw, ' '), '^(import|from)\s') and not regexp_matches(raw, 'https?://')""",
    ),
    "feature_envy": (
        lambda s, d: O.feature_envy(X.table(s, d, "lineitem").select((F.col("l_orderkey") % 3000).alias("fn"), F.concat("l_returnflag", "l_linestatus").alias("root")), share=0.3),
        """with p as (select l_orderkey % 3000 as fn, l_returnflag || l_linestatus as root, count(*) as n from lineitem group by 1, 2), t as (select fn, arg_max(root, (n, root)) as root, max(n) as n, cast(sum(n) as bigint) as total from p group by 1)
select * from t where n >= 6 and cast(n as double) / total > 0.3""",
    ),
    "coverage_gaps": (
        lambda s, d: O.coverage_gaps(Q._symbols(s, d), Q._references(s, d).select(F.regexp_replace(F.lower("token"), r"^mod\.", "").alias("name")), 60.0),
        f"""with {Q.SYM}, h as (select path, count(*) as symbols, count(*) filter (name in (select replace(lower(token), 'mod.', '') from ref)) as named from sym group by 1)
select path, symbols, named, cast(floor(100.0::double * named / symbols + 0.5) as bigint) as percent from h where 100.0::double * named / symbols < 60""",
    ),
    "stale_sources": (
        lambda s, d: O.stale(X.hook_events(s, d), F.lit(ASOF)),
        f"""with {HE}, a as (select platform, cast((epoch_us(timestamp '{ASOF}') - max(epoch_us(ts))) // 60000000 as bigint) as age_minutes from he group by 1)
select *, case when age_minutes <= 60 then 'fresh' when age_minutes <= 360 then 'aging' when age_minutes <= 1440 then 'stale' else 'dead' end as level from a""",
    ),
    "path_attribution": (
        lambda s, d: O.near_events(X.rule_findings(s, d), X.hook_events(s, d).where("event_name = 'PreToolUse'")),
        f"with {RF}, e as (select session_id, ts, seq, path from he where event_name = 'PreToolUse') select rf.seq as seq, rf.session_id as session_id, (select arg_max(e.path, (e.ts, e.seq)) from e where e.session_id = rf.session_id and e.ts <= rf.ts) as near_path from rf where {ENF}",
    ),
    "integration_seams": (
        lambda s, d: Q._symbols(s, d).join(Q._references(s, d).where("test_path rlike '_[0-9]\\\\.py$'").select(F.regexp_replace(F.lower("token"), r"^mod\.", "").alias("name")), "name", "left_anti").select("name", "path"),
        "with ref as (select replace(lower(case when (l_suppkey * 20 + l_linenumber) % 2 = 0 then 'SYM' else 'mod.Sym' end || (l_suppkey * 20 + l_linenumber)), 'mod.', '') as name from lineitem where l_suppkey % 40 < 10) select 'sym' || p_partkey as name, 'f' || (p_partkey % 50) || '.py' as path from part where 'sym' || p_partkey not in (select name from ref)",
    ),
}
