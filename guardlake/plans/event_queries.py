"""Filter, adapter and finding queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.functions import adapters as A
from guardlake.functions import filters as W
from guardlake.operators import findings as G
from guardlake.operators import metrics as M
from guardlake.plans import proxies as X
from guardlake.plans.proxies import HE, RF

ASOF = "2024-01-31 00:00:00"
RAW = ("before-shell", "pre-tool-use", "POSTTOOLUSE", "beforeShellExecution", "tool_call", "tool.execute.after", "odd")


def _findings(s, d):
    f = X.rule_findings(s, d)
    return f.withColumn("event_id", F.concat_ws("/", "session_id", F.date_format("ts", "yyyy-MM-dd"))).withColumn("additional_context", F.when(F.col("k") % 3 == 0, F.concat(F.lit("c"), (F.col("k") % 2).cast("string"))))


FE = RF + ", fe as (select *, session_id || '/' || strftime(ts, '%Y-%m-%d') as event_id, case when k % 3 = 0 then 'c' || (k % 2) end as additional_context from rf)"

QUERIES = {
    "time_window": (
        lambda s, d: M.counts_by(X.hook_events(s, d).where(W.in_window(F.col("ts"), F.lit(ASOF), "7d") & W.on_platforms(F.col("platform"), ("claude", "pi"))), "platform"),
        f"with {HE} select platform, count(*) as n from he where ts >= timestamp '{ASOF}' - interval 7 day and platform in ('claude', 'pi') group by 1",
    ),
    "synthetic_sessions": (
        lambda s, d: X.hook_events(s, d).select(F.concat(F.when(F.col("k") % 4 == 0, "test-").when(F.col("k") % 4 == 1, "self-test-").otherwise(""), "session_id").alias("x")).agg(F.sum(W.real_session(F.col("x")).cast("long")).alias("cli"), F.sum(W.real_session(F.col("x"), W.DASHBOARD_SYNTHETIC).cast("long")).alias("dashboard")),
        f"with {HE} select count(*) filter (k % 4 <> 0) as cli, count(*) filter (k % 4 <> 1) as dashboard from he",
    ),
    "valid_paths": (
        lambda s, d: M.counts_by(X.hook_events(s, d).select(F.when(F.col("k") % 5 == 0, F.concat(F.lit("Foo"), F.col("k").cast("string"))).when(F.col("k") % 5 == 1, F.col("k").cast("string")).when(F.col("k") % 5 == 2, "Makefile").when(F.col("k") % 5 == 3, "a b.py").otherwise(F.col("path")).alias("p")).select(W.valid_path(F.col("p")).alias("valid")), "valid"),
        f"with {HE} select k % 5 in (2, 4) as valid, count(*) as n from he group by 1",
    ),
    "context_kinds": (
        lambda s, d: M.counts_by(X.hook_events(s, d).select(W.context_kind(F.when(F.col("k") % 3 == 0, "https://x.y/z").when(F.col("k") % 3 == 1, "run (all)").otherwise(F.col("path"))).alias("kind")), "kind"),
        f"with {HE} select case k % 3 when 0 then 'url' when 1 then 'tool' else 'file' end as kind, count(*) as n from he group by 1",
    ),
    "adapter_events": (
        lambda s, d: M.counts_by(X.hook_events(s, d).select("platform", A.canonical_event(F.col("platform"), F.element_at(F.array(*map(F.lit, RAW)), (F.col("k") % 7 + 1).cast("int"))).alias("event")), "platform", "event"),
        f"""with {HE}, r as (select platform, k % 7 as i from he) select platform, case i when 0 then 'before-shell' when 1 then 'PreToolUse' when 2 then 'PostToolUse' when 3 then case platform when 'cursor' then 'PreToolUse' else 'beforeShellExecution' end
when 4 then case platform when 'pi' then 'PreToolUse' else 'tool_call' end when 5 then case platform when 'opencode' then 'PostToolUse' else 'tool.execute.after' end else 'odd' end as event, count(*) as n from r group by 1, 2""",
    ),
    "adapter_tools": (
        lambda s, d: M.counts_by(X.hook_events(s, d).select(A.canonical_tool(F.element_at(F.array(*map(F.lit, ("shell", " Read-File ", "NEW", "file_edit"))), (F.col("k") % 4 + 1).cast("int"))).alias("tool")), "tool"),
        f"with {HE} select case k % 4 when 0 then 'Bash' when 1 then 'Read' when 2 then 'NEW' else 'Write' end as tool, count(*) as n from he group by 1",
    ),
    "findings_deduplicated": (
        lambda s, d: G.deduplicated(_findings(s, d)).select("seq", "event_id", "rule_id"),
        f"with {FE} select min(seq) as seq, event_id, rule_id from fe group by event_id, rule_id, decision, message, additional_context",
    ),
    "reminded_once": (
        lambda s, d: M.counts_by(G.reminded_once(_findings(s, d), "R-7"), "session_id", "rule_id"),
        f"with {RF} select session_id, rule_id, case when rule_id = 'R-7' then 1 else count(*) end as n from rf group by 1, 2",
    ),
    "event_decisions": (
        lambda s, d: G.decided(_findings(s, d)),
        f"""with {FE}, o as (select *, row_number() over (partition by event_id order by case when decision in ('deny', 'block') then 4 when decision = 'ask' then 3 when decision = 'allow' then 2 else 0 end desc,
case severity when 'CRITICAL' then 40 when 'HIGH' then 30 when 'MEDIUM' then 20 else 10 end desc, seq) as p, count(*) over (partition by event_id) as n_findings from fe) select event_id, decision, rule_id, n_findings from o where p = 1""",
    ),
    "findings_enriched": (
        lambda s, d: G.enriched(_findings(s, d).where("rule_id in ('R-3', 'R-4')"), _findings(s, d).where("k % 20 = 3").select("session_id", "rule_id", F.concat(F.lit("seen "), "tool_name").alias("hint")), ["session_id", "rule_id"], "hint").select("seq", "additional_context"),
        f"""with {FE}, h as (select session_id, rule_id, min('seen ' || tool_name) as v from fe where k % 20 = 3 group by 1, 2)
select seq, nullif(concat_ws(chr(10), additional_context, v), '') as additional_context from fe left join h using (session_id, rule_id) where rule_id in ('R-3', 'R-4')""",
    ),
}
