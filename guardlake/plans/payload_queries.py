"""Platform payloads: raw hook JSON of every event normalised, and every decision in its platform's own JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.functions import payloads as P
from guardlake.functions.decisions import RESULT_ORDER, first_of
from guardlake.plans import proxies as X
from guardlake.plans.guard_queries import _pick, _values
from guardlake.plans.proxies import RF

#: Payload forms; ``@s`` is the event's session and ``@p`` its path. What each must give follows in ``EXPECTED``.
FORMS = (
    ("claude", '{"hookEventName":"pre-tool-use","sessionId":"@s","workspace_root":"/w","tool_name":"Bash","tool_input":{"command":"cat @p"}}'),
    ("cursor", '{"event":"beforeShellExecution","conversation_id":"@s","workspace_roots":[1," /w "],"cmd":"cat @p","args":{"timeout":3}}'),
    ("cursor", '{"hook_event_name":"afterFileEdit","session_id":"@s","cwd":" /w ","filePath":"@p","edits":[{"new":"x"}]}'),
    ("cursor", '{"hook_event_name":"postToolUse","session_id":"@s","tool":{"name":"read-file","args":{"path":"@p"}},"tool_output":"done"}'),
    ("codex", '{"hook_event_name":"posttooluse","session_id":"outer","params":{"thread":{"id":"@s","name":"T"}},"tool_response":{"ok":true}}'),
    ("codex", '{"hook_event_name":"SessionStart","method":"thread/name/set","params":{"threadId":"@s","name":" Named "}}'),
    ("opencode", '{"hook_event_name":"file.edited","directory":"/w","properties":{"info":{"id":"@s","title":"T"}},"tool_output":"@p"}'),
    ("opencode", '{"hook_event_name":"tool.execute.before","session_id":"@s","tool_name":" WebFetch ","tool_input":"@p"}'),
    ("pi", '{"hook_event_name":"user_bash","session_id":"@s","command":"cat @p","excludeFromContext":true}'),
    ("pi", '{"hook_event_name":"tool_result","session_id":"@s","toolName":"GREP","arguments":{"q":"@p"},"tool_result":[1,2]}'),
    ("pi", '["@s"]'),
    ("other", '{"hook_event_name":7,"session_id":"@s","cwd":""'),
)
COLUMNS = ("hook_event_name", "tool_name", "session_id", "cwd", "tool_input", "tool_result", "session_title", "native_id", "others")
#: Written by hand from the rule of each platform, not from the code.
EXPECTED = (
    ("PreToolUse", "Bash", "@s", "/w", '{"command":"cat @p"}', None, None, None, None),
    ("PreToolUse", "Bash", "@s", "/w", '{"command":"cat @p","timeout":3}', None, None, None, None),
    ("PostToolUse", "Write", "@s", "/w", '{"edits":[{"new":"x"}],"file_path":"@p"}', '{"file_path":"@p"}', None, None, None),
    ("PostToolUse", "Read", "@s", None, '{"path":"@p"}', '"done"', None, None, None),
    ("PostToolUse", None, "outer", None, None, '{"ok":true}', "T", "@s", '["outer"]'),
    ("SessionStart", None, "@s", None, None, None, "Named", "@s", None),
    ("PostToolUse", "Write", None, "/w", None, '"@p"', "T", "@s", None),
    ("PreToolUse", "WebFetch", "@s", None, '"@p"', None, None, None, None),
    ("PreToolUse", "Bash", "@s", None, '{"command":"cat @p","exclude_from_context":true}', None, None, None, None),
    ("PostToolUse", "Grep", "@s", None, '{"q":"@p"}', "[1,2]", None, None, None),
    (None,) * 9,
    (None,) * 9,
)


def _payloads(s, d):
    n = F.col("k") % len(FORMS)
    e = X.hook_events(s, d).select("seq", "session_id", "path", _pick(n, [p for p, _ in FORMS]).alias("platform"), _pick(n, [r for _, r in FORMS]).alias("raw"))
    return e.select("seq", "platform", F.replace(F.replace("raw", F.lit("@s"), "session_id"), F.lit("@p"), "path").alias("raw"))


def _normalised(s, d):
    native = F.coalesce("codex_session_id", "opencode_session_id").alias("native_id")
    return P.normalized(_payloads(s, d)).select("seq", *COLUMNS[:7], native, F.col("secondary_session_ids").alias("others"))


def decided(s, d):
    """Findings of a session and day as one event with its decision, a context for a third and an update for half of them."""
    f = X.rule_findings(s, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    found = F.transform(F.array_sort(F.collect_list(F.struct("seq", "rule_id", "severity", "decision", "message"))), lambda x: F.struct(x["rule_id"].alias("rule_id"), x["severity"].alias("severity"), x["decision"].alias("decision"), x["message"].alias("message")))
    g = f.groupBy("session_id", "day").agg(F.min("seq").alias("seq"), F.min_by("event_name", "seq").alias("event_name"), F.min_by("platform", "seq").alias("platform"), F.collect_set("decision").alias("all"), found.alias("findings"))
    return g.select(
        "seq", "event_name", "platform", first_of(F.col("all"), RESULT_ORDER).alias("decision"), "findings", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("note "), "seq")).alias("context"),
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit('{"command":"run '), "seq", F.lit('"}'))).alias("updated_input"),
    )


_PLACES = "replace(replace({0}, '@s', session_id), '@p', path) as {0}"
_EVENT = """'{"hookEventName":"' || event_name || '","additionalContext":' || c || '}'"""
RENDERED = (
    RF + """, g as (select session_id, strftime(ts, '%Y-%m-%d') as day, min(seq) as seq, arg_min(event_name, seq) as e, arg_min(platform, seq) as p,
 coalesce(case max(case decision when 'block' then 7 when 'deny' then 6 when 'ask' then 5 when 'warn' then 4 when 'context' then 3 when 'info' then 2 when 'allow' then 1 end)
  when 7 then 'block' when 6 then 'deny' when 5 then 'ask' when 4 then 'warn' when 3 then 'context' when 2 then 'info' end, 'allow') as d,
 list({'r': rule_id, 's': severity, 'd': decision, 'm': message} order by seq) as f from rf group by 1, 2),
 t as (select seq, e, p, d, d in ('block', 'deny', 'ask') as stop, list_filter(f, lambda x: x.d is not distinct from g.d) as own, f,
 list_filter(f, lambda x: x.d = 'block' and x.s = 'CRITICAL') as grave, case when seq % 3 = 0 then 'note ' || seq end as c, case when seq % 2 = 0 then '{"command":"run ' || seq || '"}' end as u from g),
 w as (select *, array_to_string(list_transform(own, lambda x: '[' || x.r || ' | ' || x.s || '] ' || x.m), chr(10)) as why, array_to_string(list_transform(grave, lambda x: '[' || x.r || ' | ' || x.s || '] ' || x.m), chr(10)) as crit,
 array_to_string(list_transform(case when len(own) > 0 then own else f end, lambda x: '[' || x.r || ' | ' || x.s || '] ' || x.m), chr(10)) as txt from t),
 q as (select *, to_json(why) as jr, to_json(crit) as jc, to_json(txt) as jt, to_json(c) as jn, to_json(case when c is null then txt else txt || chr(10) || chr(10) || c end) as jw from w),
 o as (select seq, p as platform, e as event_name, case p
 when 'cursor' then case
  when e in ('PreToolUse', 'PermissionRequest') then case when stop then '{"permission":"' || case d when 'ask' then 'ask' else 'deny' end || '","user_message":' || jt || ',"agent_message":' || jw || '}'
   when d = 'allow' or u is not null or c is not null then '{"permission":"allow"' || coalesce(',"updated_input":' || u, '') || coalesce(',"agent_message":' || jn, '') || '}' end
  when e = 'PostToolUse' or e = 'SessionStart' and c is not null then '{"additional_context":' || jw || '}' else '{"agent_message":' || jn || '}' end
 when 'pi' then (select case when b || n || a = '' and h = '' then null else '{' || substr(b || a || n || h, 2) || '}' end from (select case when e = 'PreToolUse' and stop then ',"block":true,"reason":' || jr else '' end as b,
   case when d = 'allow' and u is not null then ',"updated_input":' || u else '' end as a, coalesce(',"context":' || jn, '') as n,
   case when e = 'PostToolUse' and (c is not null or d = 'allow' and u is not null) then ',"tool_result_patch":{"details":{"guardlake":{"decision":"' || d || '"' || coalesce(',"context":' || jn, '') || '}}}' else '' end as h))
 when 'opencode' then case
  when e = 'PreToolUse' and stop then '{"action":"block","reason":' || jr || coalesce(',"context":' || jn, '') || '}'
  when e = 'PreToolUse' and d = 'allow' and u is not null then '{"action":"allow","updated_args":' || u || coalesce(',"context":' || jn, '') || '}'
  when e = 'PermissionRequest' then case when stop then '{"action":"block","reason":' || jr || '}' when d = 'allow' and u is not null then '{"action":"allow","updated_args":' || u || '}' end
  when e = 'PostToolUse' and d in ('block', 'deny') then '{"action":"block","reason":' || jr || coalesce(',"context":' || jn, '') || '}'
  when e <> 'PostToolUseFailure' then '{"action":"context","context":' || jn || '}' end
 else case
  when e = 'PreToolUse' then (select case when x <> '' then '{"hookSpecificOutput":{"hookEventName":"PreToolUse"' || x || '}}' end from (select
    case when stop then ',"permissionDecision":"' || case when p = 'codex' or d = 'block' then 'deny' else d end || '","permissionDecisionReason":' || jr
     when d = 'allow' then ',"permissionDecision":"allow"' || case when p = 'codex' then '' else ',"permissionDecisionReason":' || jr end else '' end
    || case when u is not null and (p <> 'codex' or d = 'allow') then ',"updatedInput":' || u else '' end || coalesce(',"additionalContext":' || jn, '') as x))
  when e = 'PermissionRequest' then case when stop or d = 'allow' then '{"hookSpecificOutput":{"hookEventName":"PermissionRequest","decision":{"behavior":"' || case when d in ('block', 'deny') then 'deny' else d end || '"'
    || case when d = 'allow' and u is not null and p <> 'codex' then ',"updatedInput":' || u else '' end || case when stop then ',"message":' || jr else '' end || '}}}' end
  when e = 'PostToolUse' then (select case when x || n <> '' then '{' || substr(x || n, 2) || '}' end from (select case when p = 'codex' and len(grave) > 0 then ',"continue":false,"stopReason":' || jc when stop then ',"decision":"block","reason":' || jr else '' end as x,
    coalesce(',"hookSpecificOutput":{"hookEventName":"PostToolUse","additionalContext":' || jn || '}', '') as n))
  when e = 'SessionStart' then '{"hookSpecificOutput":{"hookEventName":"SessionStart","additionalContext":' || jn || '}}'
  when p <> 'codex' then '{"systemMessage":' || jn || '}' end end as output from q)
 select seq, platform, event_name, output from o"""
)
_FORM = _values((i, *e) for i, e in enumerate(EXPECTED))

QUERIES = {
    "payloads_normalised": (
        _normalised,
        f"""with {X.HE} select he.seq, {', '.join(_PLACES.format('x' + c).replace(' as x', ' as ') for c in COLUMNS)}
from he join {_FORM} v(n, {', '.join('x' + c for c in COLUMNS)}) on he.k % {len(FORMS)} = v.n""",
    ),
    "payloads_readable": (
        lambda s, d: P.normalized(_payloads(s, d)).groupBy("platform", "readable").agg(F.count("*").alias("n"), F.count_distinct("canonical").alias("forms")),
        f"""with {X.HE}, r as (select k % {len(FORMS)} as i, session_id, path from he)
select case when i = 0 then 'claude' when i < 4 then 'cursor' when i < 6 then 'codex' when i < 8 then 'opencode' when i < 11 then 'pi' else 'other' end as platform, i < 10 as readable, count(*) as n,
count(distinct case when i >= 10 then 'empty' when i in (3, 5) then i || session_id || case i when 3 then path else '' end when i = 4 then i || session_id else i || session_id || path end) as forms from r group by 1, 2""",
    ),
    "decisions_rendered": (lambda s, d: P.rendered(decided(s, d)).select("seq", "platform", "event_name", "output"), "with " + RENDERED),
}
