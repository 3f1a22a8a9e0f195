"""Session, correlation, path, baseline and state queries, each with its DuckDB SQL.

The stand-in events are sparse, so tolerances are minutes and hours here; they are parameters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.functions import paths as P
from guardlake.operators import baseline as B
from guardlake.operators import correlate as C
from guardlake.operators import explore as E
from guardlake.operators import sessions as S
from guardlake.operators import state as K
from guardlake.plans import proxies as X
from guardlake.plans.proxies import HE, HR, RF, VB

MIN, HOUR = 60_000_000, 3_600_000_000
ENF = "decision in ('deny', 'block')"
UNIT = ["session_id", "day"]
SUMMARY = """ss as (select session_id, arg_min(platform, seq) as platform, count(*) as n_events, count(distinct tool_name) as n_tools, cast((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 as bigint) as duration_ms from he group by 1),
 sp as (select session_id, count(distinct p) as n_paths from (select session_id, unnest(candidate_paths) as p from he) group by 1),
 so as (select session_id, case when bool_or(decision = 'block') then 'block' when bool_or(decision = 'deny') then 'deny' when bool_or(decision = 'ask') then 'ask' else 'allow' end as outcome from hr group by 1)"""
SPANS = """sx as (select session_id || '/' || strftime(ts, '%Y-%m-%d') as sid, min(epoch_us(ts)) as st, max(epoch_us(ts)) as en, list_distinct(list(path)) as paths from he group by 1)"""


#: Texts that sessions are searched by.
TEXTS = ("R-1", " Block ", "dir4/f1", "opencode", "CAT /home/u/repos/repo1", "work of s7", "grep", "nowhere", " ")


def _terms(s, d):
    e, r = X.hook_events(s, d), X.hook_results(s, d)
    own = S.summary(e, r).select("session_id", F.concat(F.lit("Work of "), "session_id").alias("title"), "outcome")
    shell = e.where("tool_name = 'Bash'").select("session_id", F.concat(F.lit("cat "), "path").alias("command"))
    own_fields = {"title": (own, "title"), "id": (e.withColumn("id", F.col("session_id")), "id"), "platform": (e, "platform"), "outcome": (own, "outcome"), "tool": (e, "tool_name")}
    return S.search_terms(own_fields | {"rule": (X.rule_findings(s, d), "rule_id"), "path": (e, "candidate_paths"), "command": (shell, "command")})


def _units(s, d):
    e = X.hook_events(s, d).withColumn("sid", F.concat("session_id", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")))
    return S.spans(e, ["sid"])


def _parents(s, d):
    """Parent edges of the stand-in: session n hangs below n // 3, but for a cycle of 100, 101 and 102."""
    ids = X.table(s, d, "events").select((F.col("user_id") % 150).alias("u")).distinct()
    up = F.when(F.col("u") == 100, 101).when(F.col("u") == 101, 102).when(F.col("u") == 102, 100).otherwise(F.floor(F.col("u") / 3)).cast("long")
    return ids.where("u > 0").select(F.col("u").cast("long").alias("child"), up.alias("parent"))


def _lineage(s, d):
    return S.roots(_parents(s, d))


def _claim_sql(ts, tolerance):
    """Results one by one, a step of the recursion each for every tool: the nearest event that is not in the list of those taken."""
    return f"""with recursive {HE}, r as materialized (select tool_name as key, seq, epoch_us({ts}) as t, row_number() over (partition by tool_name order by seq) as n from he where event_name = 'PostToolUse'),
e as materialized (select tool_name as key, seq, epoch_us({ts}) as t from he where event_name = 'PreToolUse'),
near as materialized (select r.key, r.n, e.seq as event_seq, abs(e.t - r.t) as d from r join e on e.key = r.key and abs(e.t - r.t) <= {tolerance}),
walk as (select key, 0::bigint as n, []::bigint[] as taken, null::bigint as event_seq, null::bigint as distance from r group by key
union all select key, n + 1, case when x is null then taken else list_append(taken, x.event_seq) end, x.event_seq, x.d
from (select w.key, w.n, any_value(w.taken) as taken, min(case when near.event_seq is not null and not list_contains(w.taken, near.event_seq) then {{'d': near.d, 'event_seq': near.event_seq}} end) as x
  from walk w join r on r.key = w.key and r.n = w.n + 1 left join near on near.key = w.key and near.n = w.n + 1 group by w.key, w.n))
select r.seq, walk.event_seq, walk.distance from r join walk using (key, n)"""


def _events(s, d, name):
    return X.hook_events(s, d).where(F.col("event_name") == name)


def _attempted(s, d):
    return X.rule_findings(s, d).withColumn("attempt", F.when(F.col("k") % 5 != 0, F.concat(F.lit("a"), (F.col("k") % 2).cast("string"))))


def _reads(s, d):
    return X.hook_events(s, d).select("seq", "session_id", "path", (F.col("k") % 3 == 0).alias("full"))


QUERIES = {
    "session_summary": (
        lambda s, d: S.summary(X.hook_events(s, d), X.hook_results(s, d)),
        f"with {HR}, {SUMMARY} select session_id, platform, n_events, n_tools, coalesce(n_paths, 0) as n_paths, duration_ms, coalesce(outcome, 'allow') as outcome from ss left join sp using (session_id) left join so using (session_id)",
    ),
    "session_activity": (lambda s, d: S.latest(X.hook_events(s, d)), f"with {HE} select session_id, arg_max(tool_name, (ts, seq)) as tool_name, max(seq) as seq from he group by 1"),
    "primary_cause": (
        lambda s, d: S.primary_cause(X.rule_findings(s, d)),
        f"""with {RF} select session_id, rule_id, decision, severity, seq from (select *, row_number() over (partition by session_id order by case decision when 'block' then 7 when 'deny' then 6 when 'ask' then 5 when 'warn' then 4 when 'context' then 3 when 'info' then 2 when 'allow' then 1 else 0 end desc,
case severity when 'CRITICAL' then 40 when 'HIGH' then 30 when 'MEDIUM' then 20 else 10 end desc, ts desc, seq desc) as p from rf) where p = 1""",
    ),
    "preferred_primary": (
        lambda s, d: S.preferred_primary(S.summary(X.hook_events(s, d), X.hook_results(s, d)).withColumn("native_id", F.concat(F.lit("n"), (F.substring("session_id", 2, 9).cast("long") % 40).cast("string"))), "native_id"),
        f"""with {HR}, {SUMMARY}, m as (select *, 'n' || (cast(substr(session_id, 2) as bigint) % 40) as native_id from ss)
select native_id, session_id as primary_session, members from (select *, row_number() over (partition by native_id order by n_events desc, n_tools desc, duration_ms desc, session_id) as p, count(*) over (partition by native_id) as members from m) where p = 1""",
    ),
    "mirror_sessions": (
        lambda s, d: S.mirrors(_units(s, d), "sid", 2 * HOUR, 2 * HOUR),
        f"with {HE}, {SPANS} select a.sid as a, b.sid as b from sx a join sx b on a.sid < b.sid and abs(a.st - b.st) <= {2 * HOUR} and abs(a.en - b.en) <= {2 * HOUR} and list_has_any(a.paths, b.paths)",
    ),
    "child_sessions": (
        lambda s, d: S.children(_units(s, d), "sid", 30 * MIN, 60 * MIN, 6 * HOUR),
        f"""with {HE}, {SPANS}, m as (select c.sid as child, p.sid as parent, p.en - p.st as len from sx c join sx p on c.sid <> p.sid and c.st >= p.st - {30 * MIN} and c.en <= p.en + {30 * MIN} and list_has_any(c.paths, p.paths)
and p.en - p.st >= greatest(3 * (c.en - c.st), c.en - c.st + {60 * MIN})) select child, arg_min(parent, (-len, parent)) as parent, count(distinct parent) as candidates from m group by 1""",
    ),
    "lineage_root": (
        _lineage,
        """with recursive e as (select distinct user_id % 150 as child from events where user_id % 150 > 0), p as (select child, case child when 100 then 101 when 101 then 102 when 102 then 100 else child // 3 end as parent from e),
up as (select child, parent as at, 1 as n from p union all select up.child, p.parent, n + 1 from up join p on p.child = up.at where n < 200 and up.at <> up.child)
select p.child as child, coalesce(min(up.at) filter (not exists (select 1 from p q where q.child = up.at)), p.child) as root from p left join up on up.child = p.child group by p.child""",
    ),
    "session_search": (
        lambda s, d: S.search(X.hook_events(s, d), "dir4/f1"),
        f"with {HE} select session_id, count(*) as hits from he where contains(lower(session_id), 'dir4/f1') or contains(platform, 'dir4/f1') or contains(lower(tool_name), 'dir4/f1') or len(list_filter(candidate_paths, lambda x: contains(lower(x), 'dir4/f1'))) > 0 group by 1",
    ),
    "session_search_fields": (
        lambda s, d: S.found_by(_terms(s, d), TEXTS).select("text", "session_id", F.array_join("fields", ",").alias("fields")),
        f"""with {HR}, {SUMMARY}, t as (select session_id, 'title' as field, 'Work of ' || session_id as term from ss union select session_id, 'id', session_id from he union select session_id, 'platform', platform from he
union select session_id, 'outcome', outcome from so union select session_id, 'tool', tool_name from he union select session_id, 'rule', rule_id from rf union select session_id, 'path', unnest(candidate_paths) from he
union select session_id, 'command', 'cat ' || path from he where tool_name = 'Bash'), q as (select unnest([{', '.join(f"'{t}'" for t in TEXTS)}]) as text)
select text, session_id, string_agg(distinct field, ',' order by field) as fields from t join q on contains(lower(term), lower(trim(text))) group by 1, 2""",
    ),
    "path_semi_filter": (
        lambda s, d: S.touched(X.rule_findings(s, d), X.hook_events(s, d), "/home/u/repos/repo1/dir3/f93.py").groupBy("session_id").agg(F.count("*").alias("n")),
        f"with {RF} select session_id, count(*) as n from rf where session_id in (select session_id from (select session_id, unnest(candidate_paths) as p from he) where p = '/home/u/repos/repo1/dir3/f93.py' or starts_with(p, '/home/u/repos/repo1/dir3/f93.py/')) group by 1",
    ),
    "result_event_nearest": (
        lambda s, d: C.nearest(_events(s, d, "PostToolUse").select("seq", "ts", "session_id"), _events(s, d, "PreToolUse").select("seq", "ts", "session_id"), ["session_id"], 6 * HOUR, after=False),
        f"""with {HE}, p as (select seq, ts, session_id from he where event_name = 'PostToolUse'), q as (select seq as rs, ts as rt, session_id from he where event_name = 'PreToolUse'),
m as (select seq, min((epoch_us(ts) - epoch_us(rt), rs)) as m from p join q using (session_id) where rt <= ts and epoch_us(ts) - epoch_us(rt) <= {6 * HOUR} group by seq)
select p.seq, p.ts, p.session_id, m.m[2] as near_seq, m.m[1] as distance from p left join m using (seq)""".replace("m.m[2]", "struct_extract(m.m, 2)").replace("m.m[1]", "struct_extract(m.m, 1)"),
    ),
    "finding_result_anti": (
        lambda s, d: C.unmatched(X.rule_findings(s, d).select("seq", "ts", "tool_name", "rule_id"), X.hook_results(s, d).select("seq", "ts", "tool_name", F.explode("rule_ids").alias("rule_id")), ["tool_name", "rule_id"], 30 * MIN).select("seq", "tool_name", "rule_id"),
        f"with {HR}, x as (select seq, ts, tool_name, unnest(rule_ids) as rule_id from hr) select seq, tool_name, rule_id from rf where not exists (select 1 from x where x.tool_name = rf.tool_name and x.rule_id = rf.rule_id and abs(epoch_us(x.ts) - epoch_us(rf.ts)) <= {30 * MIN})",
    ),
    "greedy_claim": (lambda s, d: C.claim(_events(s, d, "PostToolUse"), _events(s, d, "PreToolUse"), ["tool_name"], 5 * MIN), _claim_sql("ts", 5 * MIN)),
    "burst_claim": (
        lambda s, d: C.claim(*(_events(s, d, n).withColumn("ts", F.date_trunc("day", "ts")) for n in ("PostToolUse", "PreToolUse")), ["tool_name"], 48 * HOUR),
        _claim_sql("date_trunc('day', ts)", 48 * HOUR),
    ),
    "path_rollup": (
        lambda s, d: E.rollup(X.hook_events(s, d), X.rule_findings(s, d)),
        f"""with {RF}, pe as (select seq, list_filter(string_split(p, '/'), lambda x: x <> '') as parts from (select seq, unnest(candidate_paths) as p from he)),
e as (select array_to_string(parts[1:i], '/') as prefix, i as depth, seq from (select *, unnest(range(1, len(parts) + 1)) as i from pe)),
pf as (select seq, decision, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from rf where path is not null),
f as (select array_to_string(parts[1:i], '/') as prefix, decision from (select *, unnest(range(1, len(parts) + 1)) as i from pf)),
fg as (select prefix, count(*) as n_findings, count(*) filter ({ENF}) as n_blocks from f group by 1)
select prefix, depth, n_events, coalesce(n_findings, 0) as n_findings, coalesce(n_blocks, 0) as n_blocks from (select prefix, depth, count(distinct seq) as n_events from e group by 1, 2) left join fg using (prefix)""",
    ),
    "path_heatmap": (
        lambda s, d: E.heatmap(X.hook_events(s, d)),
        f"""with {HE}, b as (select min(epoch_us(ts)) as t0, max(epoch_us(ts)) as t1 from he), w as (select *, least(greatest(ceil((t1 - t0) / {HOUR}.0::double), 4), 12) as parts from b)
select path, cast(least(floor((epoch_us(ts) - t0) / greatest(cast(t1 - t0 as double) / parts, 1.0)), parts - 1) as bigint) as bucket, count(*) as n from he, w group by 1, 2""",
    ),
    "project_partitions": (
        lambda s, d: E.projects(X.hook_events(s, d).withColumn("root", F.when(F.col("k") % 3 == 0, P.repo_label(F.col("path")))).withColumn("mode", F.when(F.col("k") % 2 == 0, "strict")), "root", "mode"),
        f"""with {HE}, m as (select session_id, arg_min(regexp_extract(path, '(?:^|/)repos/([^/]+)', 1), seq) filter (k % 3 = 0) as root, arg_min('strict', seq) filter (k % 2 = 0) as mode from he group by 1)
select root, count(*) as sessions, count(distinct mode) as modes from m group by 1""",
    ),
    "baseline_new": (lambda s, d: B.new(X.violations(s, d), X.baseline(s, d)), f"with {VB} select * from cur except select * from base"),
    "baseline_fixed": (lambda s, d: B.fixed(X.violations(s, d), X.baseline(s, d)), f"with {VB} select * from base except select * from cur"),
    "baseline_pruned": (lambda s, d: B.pruned(X.violations(s, d), X.baseline(s, d)), f"with {VB} select * from base intersect select * from cur"),
    "baseline_union": (lambda s, d: B.effective(X.baseline(s, d), X.violations(s, d)), f"with {VB} select * from base union select * from cur"),
    "baseline_inflation": (
        lambda s, d: B.inflated(X.baseline(s, d), X.violations(s, d)),
        f"with {VB} select a.rule, coalesce(b.n, 0) as n_before, a.n as n_after from (select rule, count(*) as n from cur group by 1) a left join (select rule, count(*) as n from base group by 1) b using (rule) where a.n > coalesce(b.n, 0)",
    ),
    "lint_tally": (
        lambda s, d: B.tally(X.violations(s, d), X.baseline(s, d)),
        f"""with {VB}, j as (select coalesce(cur.rule, base.rule) as rule, cur.stable_id as c, base.stable_id as b from cur full join base on cur.rule = base.rule and cur.stable_id = base.stable_id)
select rule, count(c) as total, count(*) filter (b is null) as new, count(*) filter (c is null) as fixed, count(*) filter (b is not null and c is not null) as known from j group by 1""",
    ),
    "repeat_escalation": (
        lambda s, d: K.escalated(_attempted(s, d)),
        f"""with {RF}, h as (select seq, session_id, rule_id, coalesce(path, '__pathless__') as path, coalesce(case when k % 5 <> 0 then 'a' || (k % 2) end, '__unknown_attempt__') as attempt, decision, severity from rf where {ENF}),
r as (select *, row_number() over (partition by session_id, rule_id, path, attempt order by seq) as repeat from h)
select seq, session_id, rule_id, path, attempt, repeat, case when repeat >= 3 then 'block' else decision end as decision, case when repeat >= 3 and severity in ('LOW', 'MEDIUM') then 'HIGH' else severity end as severity, repeat >= 2 as noted from r""",
    ),
    "emit_once": (lambda s, d: K.once(X.rule_findings(s, d), "session_id", "rule_id").select("seq", "session_id", "rule_id"), f"with {RF} select min(seq) as seq, session_id, rule_id from rf group by 2, 3"),
    "full_read_unlock": (
        lambda s, d: K.unlocked_reads(_reads(s, d)),
        f"with {HE} select seq, session_id, path, allowed from (select seq, session_id, path, k % 3 = 0 as f, coalesce(bool_or(k % 3 = 0) over (partition by session_id, path order by seq rows between unbounded preceding and 1 preceding), false) as allowed from he) where not f",
    ),
    "recent_failures": (
        lambda s, d: K.recent_failures(X.rule_findings(s, d)),
        f"with {RF}, c as (select session_id, rule_id, count(*) as n, max(seq) as last_seq from rf where {ENF} group by 1, 2 having count(*) >= 2) select * from (select *, row_number() over (partition by session_id order by n desc, last_seq desc) as place from c) where place <= 4",
    ),
    "counter_prune": (
        lambda s, d: K.pruned_counters(X.rule_findings(s, d).groupBy(F.concat_ws("|", "session_id", "rule_id").alias("key")).agg(F.count("*").alias("value"))),
        f"with {RF} select session_id || '|' || rule_id as key, count(*) as value from rf group by 1 order by value desc, key desc limit 512",
    ),
    "bare_assert_runs": (
        lambda s, d: K.runs(X.hook_events(s, d).withColumn("flag", F.col("event_name") == "PreToolUse"), "flag", "session_id"),
        f"""with {HE}, i as (select session_id, event_name = 'PreToolUse' as flag, row_number() over (partition by session_id order by seq) - row_number() over (partition by session_id, event_name = 'PreToolUse' order by seq) as g from he)
select session_id, max(n) as longest from (select session_id, g, count(*) as n from i where flag group by 1, 2) group by 1""",
    ),
}
