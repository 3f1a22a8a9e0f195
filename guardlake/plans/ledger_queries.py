"""State, routing and order queries, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.operators import ledger as L
from guardlake.plans import proxies as X
from guardlake.plans.proxies import HE, RF, VB

COLLECTORS = ("dead-code", "long-method", "own-check", "import-alias", "high-complexity")
_SQL_COLLECTOR = "case k % 5 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(COLLECTORS)) + " end"


def _results(s, d):
    names = F.array(*map(F.lit, COLLECTORS))
    return X.hook_events(s, d).select("seq", F.get(names, (F.col("k") % 5).cast("int")).alias("collector"))


def _catalog(s):
    rows = [("dead-code", ["cli"], ["Stop"]), ("long-method", ["cli", "hook"], ["PostToolUse"]), ("import-alias", ["hook"], ["PreToolUse"]), ("high-complexity", ["hook"], ["PostToolUse"])]
    return s.createDataFrame(rows, "collector string, surfaces array<string>, events array<string>")


def _layer(s, d, step, source):
    e = X.hook_events(s, d).where(F.col("k") % step == 0)
    return e.groupBy(F.concat(F.lit("k"), (F.col("k") % 50).cast("string")).alias("key")).agg(F.when(F.min("k") % 4 == 0, None).otherwise(F.concat(F.lit(source), F.min("k").cast("string"))).alias("value"))


def _marks(s, d, name):
    return X.hook_events(s, d).where(F.col("event_name") == name)


def _live(s, d):
    e = X.hook_events(s, d)
    row = lambda version, value: e.select("session_id", (F.col("k") % 10).alias("slot"), "seq", version.alias("version"), value.alias("value"))
    return row(F.lit(3).cast("long"), F.lit("snapshot")).where("seq % 2 = 0"), row(F.col("k") % 6, F.lit("live")).where("seq % 2 = 1")


def _attempts(s, d):
    e = X.hook_events(s, d)
    none = F.lit("").cast("string")
    target = F.array(F.struct(F.when(F.col("k") % 3 > 0, F.col("path")).otherwise(none).alias("path"), F.lit("file").alias("source"), (F.col("k") % 2).cast("string").alias("content")))
    paths = F.when(F.col("k") % 4 == 0, F.array(none)).otherwise(F.reverse("candidate_paths"))
    return e.select("seq", L.fingerprint(F.col("tool_name"), paths, target, (F.col("k") % 2).cast("string")).alias("f"))


def _nodes(s, d):
    e = X.hook_events(s, d)
    return e.groupBy((F.col("k") % 4).alias("parent"), F.concat(F.lit("n"), F.col("k").cast("string")).alias("name"), (F.col("k") % 3 == 0).alias("is_dir")).agg(F.count("*").alias("findings"))


QUERIES = {
    "platform_capability": (
        lambda s, d: X.hook_events(s, d).groupBy(L.capability(F.concat(F.lit(" "), F.upper("platform"))).alias("capability")).agg(F.count("*").alias("n")),
        f"with {HE} select case platform when 'opencode' then 'degraded' when 'codex' then 'partial' when 'cursor' then 'partial' else 'full' end as capability, count(*) as n from he group by 1",
    ),
    "collectors_routed": (
        lambda s, d: L.routed(_results(s, d), _catalog(s), "hook", "PostToolUse").groupBy("collector").agg(F.count("*").alias("n")),
        f"with {HE} select {_SQL_COLLECTOR} as collector, count(*) as n from he where k % 5 in (1, 2, 4) group by 1",
    ),
    "collectors_enabled": (
        lambda s, d: L.enabled(_results(s, d), s.createDataFrame([("import-alias", True), ("high-complexity", False)], "collector string, on boolean")).groupBy("collector").agg(F.count("*").alias("n")),
        f"with {HE} select {_SQL_COLLECTOR} as collector, count(*) as n from he where k % 5 in (1, 2, 3) group by 1",
    ),
    "layered_settings": (
        lambda s, d: L.layered([_layer(s, d, 1, "base"), _layer(s, d, 2, "repo"), _layer(s, d, 3, "user")]),
        f"""with {HE}, l as (select 'k' || (k % 50) as key, case when min(k) % 4 <> 0 then 'base' || min(k) end as value, 0 as layer from he group by 1
union all select 'k' || (k % 50), case when min(k) % 4 <> 0 then 'repo' || min(k) end, 1 from he where k % 2 = 0 group by 1 union all select 'k' || (k % 50), case when min(k) % 4 <> 0 then 'user' || min(k) end, 2 from he where k % 3 = 0 group by 1)
select key, value, layer from l qualify row_number() over (partition by key order by layer desc) = 1""",
    ),
    "alive_reminders": (
        lambda s, d: L.alive(X.hook_events(s, d), "ts", 86_400, "session_id", "tool_name").groupBy("session_id").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs")),
        f"""with recursive {HE}, a as materialized (select session_id, tool_name, seq, epoch(date_trunc('second', ts))::bigint as tt, ts from he),
chain as (select session_id, tool_name, min(tt) as tt from a group by 1, 2
union all select c.session_id, c.tool_name, min(a.tt) from chain c join a on a.session_id = c.session_id and a.tool_name = c.tool_name and a.tt > c.tt + 86400 group by 1, 2, c.tt),
kept as (select session_id, arg_min(seq, (ts, seq)) as seq from a join chain using (session_id, tool_name, tt) group by session_id, tool_name, tt)
select session_id, count(*) as n, sum(seq)::bigint as seqs from kept group by 1""",
    ),
    "locks_held": (
        lambda s, d: L.locks_held(_marks(s, d, "PermissionRequest"), _marks(s, d, "PreToolUse"), _marks(s, d, "SessionStart"), 86_400 * 3),
        f"""with {HE}, m as (select session_id, seq, ts, case event_name when 'PreToolUse' then 'attempt' when 'PermissionRequest' then 'lock' else 'plan' end as kind from he where event_name in ('PreToolUse', 'PermissionRequest', 'SessionStart'))
select a.session_id, a.seq, coalesce((select l.kind = 'lock' and epoch(date_trunc('second', a.ts)) - epoch(date_trunc('second', l.ts)) <= 259200 from m l where l.session_id = a.session_id and l.seq < a.seq and l.kind <> 'attempt' order by l.seq desc limit 1), false) as locked
from m a where kind = 'attempt'""",
    ),
    "full_reads_needed": (
        lambda s, d: L.full_read_needed(X.hook_events(s, d).where("tool_name = 'Read'").select("seq", "session_id", F.when(F.col("k") % 5 == 0, F.lit("a.md")).otherwise(F.col("path")).alias("path"), (F.col("value") < 20).alias("full"), (F.col("k") * 1000).alias("bytes"))),
        f"""with {HE}, r as (select seq, session_id, case when k % 5 = 0 then 'a.md' else path end as path, value < 20 as full_read, k * 1000 as bytes from he where tool_name = 'Read')
select seq, session_id, path from r a where not full_read and path not like '%.md' and bytes <= 40000 and not exists (select 1 from r b where b.session_id = a.session_id and b.path = a.path and b.seq < a.seq and b.full_read)""",
    ),
    "attempt_fingerprints": (
        lambda s, d: _attempts(s, d).agg(F.count("f").alias("named"), F.count_distinct("f").alias("kinds")),
        f"""with {HE} select count(*) filter (k % 4 > 0 or k % 3 > 0) as named, count(distinct (tool_name, case when k % 4 > 0 then list_sort(candidate_paths) end, case when k % 3 > 0 then path end, k % 2)) filter (k % 4 > 0 or k % 3 > 0) as kinds from he""",
    ),
    "counters_pruned": (
        lambda s, d: (lambda c: L.pruned(c, c.where("n <= 2"), 12))(X.hook_events(s, d).groupBy(F.concat_ws("/", "session_id", "tool_name").alias("key")).agg(F.count("*").alias("n"))),
        f"""with {HE}, c as (select session_id || '/' || tool_name as key, count(*) as n from he group by 1),
ranked as (select *, row_number() over (order by n desc, key desc) as place from c where not n <= 2)
select key, n from c where n <= 2 union all select key, n from ranked where place <= greatest(12 - (select count(*) from c where n <= 2), 0)""",
    ),
    "counters_pruned_few": (
        lambda s, d: (lambda c: L.pruned(c, s.createDataFrame([("s1/Bash",), ("s2/Edit",), ("none/Read",)], "key string"), 12))(X.hook_events(s, d).groupBy(F.concat_ws("/", "session_id", "tool_name").alias("key")).agg(F.count("*").alias("n"))),
        f"""with {HE}, c as (select session_id || '/' || tool_name as key, count(*) as n from he group by 1), p as (select * from c where key in ('s1/Bash', 's2/Edit', 'none/Read')),
ranked as (select *, row_number() over (order by n desc, key desc) as place from c where key not in (select key from p))
select * from p union all select key, n from ranked where place <= 12 - (select count(*) from p)""",
    ),
    "baseline_stale": (
        lambda s, d: L.stale_entries(X.baseline(s, d), X.violations(s, d)),
        f"with {VB} select rule, count(*) filter (stable_id in (select stable_id from cur)) as kept, count(*) filter (stable_id not in (select stable_id from cur)) as stale from base group by 1",
    ),
    "ingest_counts": (
        lambda s, d: L.ingested(X.hook_events(s, d).withColumn("source", F.col("platform")), F.col("k") % 7 != 0, "session_id", "tool_name", "platform"),
        f"""with {HE}, v as (select *, k % 7 <> 0 as good from he),
r as (select platform as source, case when not good then 'rejected' when exists (select 1 from v b where b.good and b.seq < a.seq and b.session_id = a.session_id and b.tool_name = a.tool_name and b.platform = a.platform) then 'ignored' else 'accepted' end as kind from v a)
select source, kind, count(*) as n from r group by 1, 2""",
    ),
    "live_merge": (
        lambda s, d: L.merged_live(*_live(s, d), "session_id", "slot"),
        f"""with {HE}, u as (select session_id, k % 10 as slot, seq, 3 as version, 'snapshot' as value from he where seq % 2 = 0 union all select session_id, k % 10, seq, k % 6, 'live' from he where seq % 2 = 1)
select * from u qualify row_number() over (partition by session_id, slot order by version desc, seq desc) = 1""",
    ),
    "newest_rows": (
        lambda s, d: L.newest(X.hook_events(s, d).withColumn("ts", F.when(F.col("k") % 9 > 0, F.col("ts"))), 200).select("seq"),
        f"with {HE} select seq from he order by case when k % 9 > 0 then ts else timestamp '1970-01-01' end desc, seq desc limit 200",
    ),
    "tree_children": (
        lambda s, d: L.tree_children(_nodes(s, d)),
        f"with {HE}, n as (select k % 4 as parent, 'n' || k as name, k % 3 = 0 as is_dir, count(*) as findings from he group by k) select *, row_number() over (partition by parent order by is_dir desc, findings desc, name) as place from n",
    ),
    "attached_runs": (
        lambda s, d: L.attached(X.subprocess_runs(s, d).withColumn("session_id", F.concat(F.lit("s"), (F.col("seq") % 400).cast("string"))), X.hook_events(s, d)).groupBy("session_id").agg(F.count("*").alias("n")),
        f"with {HE} select 's' || (o_orderkey % 400) as session_id, count(*) as n from orders where 's' || (o_orderkey % 400) in (select session_id from he) group by 1",
    ),
    "findings_by_path": (
        lambda s, d: L.findings_by_path(X.rule_findings(s, d), X.hook_events(s, d)),
        f"with {RF}, p as (select distinct session_id, unnest(candidate_paths) as path from he), f as (select session_id, count(*) as n from rf group by 1) select path, sum(n)::bigint as findings, count(*) as sessions from p join f using (session_id) group by 1",
    ),
    "deprecated_references": (
        lambda s, d: L.deprecated_references(
            X.table(s, d, "part").select(F.concat(F.lit("Sym"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") > 40).alias("deprecated")),
            X.table(s, d, "lineitem").select(F.concat(F.lit("test"), (F.col("l_orderkey") % 100).cast("string")).alias("test"), F.concat(F.lit("sym"), F.col("l_partkey").cast("string")).alias("token")),
        ),
        "select distinct 'test' || (l_orderkey % 100) as test, 'sym' || l_partkey as token from lineitem join part on p_partkey = l_partkey where p_size > 40",
    ),
}
