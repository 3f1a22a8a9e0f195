"""Payloads of platforms and answers to them, by hand."""

import json

from pyspark.sql import functions as F

from guardlake.functions import payloads as P

FOUND = [("R-1", "HIGH", "block", "no"), ("R-2", "CRITICAL", "block", "never"), ("R-3", "LOW", "context", "hint"), ("R-4", "LOW", "block", "")]
WHY = "[R-1 | HIGH] no\n[R-2 | CRITICAL] never"
ANSWERS = [
    ("claude", "Stop", "block", "c", None, FOUND, {"decision": "block", "reason": WHY + "\n\nc"}),
    ("claude", "SubagentStop", "context", "c", None, FOUND, {"systemMessage": "c"}),
    ("claude", "Stop", "ask", "c", None, FOUND, {"decision": "block", "reason": "c"}),
    ("claude", "Stop", "ask", None, None, FOUND, {"decision": "block", "reason": ""}),
    ("claude", "TaskCompleted", "block", "c", None, FOUND, None),
    ("claude", "TaskCompleted", None, "c", None, FOUND, {"systemMessage": "c"}),
    ("claude", "SubagentStart", None, None, "{}", FOUND, None),
    ("claude", "PreToolUse", None, "", '{"a":1}', FOUND, {"hookSpecificOutput": {"hookEventName": "PreToolUse", "updatedInput": {"a": 1}}}),
    ("claude", "Unheard", "block", "c", None, FOUND, None),
    ("codex", "PostToolUse", "block", "c", None, FOUND, {"continue": False, "stopReason": "[R-2 | CRITICAL] never", "hookSpecificOutput": {"hookEventName": "PostToolUse", "additionalContext": "c"}}),
    ("codex", "Stop", "context", "c", None, FOUND, {"systemMessage": "c"}),
    ("codex", "SessionEnd", "block", "c", None, FOUND, None),
    ("codex", "PreCompact", "block", "c", None, FOUND, {"hookSpecificOutput": {"hookEventName": "PreCompact", "additionalContext": "c"}}),
    ("opencode", "Stop", "block", "c", None, FOUND, {"action": "continue", "reason": WHY}),
    ("opencode", "Stop", "warn", "c", None, FOUND, {"action": "context", "context": "c"}),
    ("opencode", "PostToolUse", "ask", "c", None, FOUND, {"action": "context", "context": "c"}),
    ("pi", "UserPromptSubmit", "block", None, None, FOUND, {"block": True, "reason": WHY}),
    ("pi", "Stop", "block", None, None, FOUND, None),
    ("cursor", "SubagentStart", "block", "c", None, FOUND, {"permission": "deny", "user_message": WHY}),
    ("cursor", "UserPromptSubmit", "deny", "c", None, FOUND, {"continue": False, "user_message": WHY + "".join(["\n[R-3 | LOW] hint"])}),
    ("cursor", "UserPromptSubmit", None, None, None, [], {"continue": True}),
    ("cursor", "PermissionRequest", None, "c", '{"a":1}', [], {"permission": "allow", "updated_input": {"a": 1}, "agent_message": "c"}),
    ("cursor", "Stop", "block", "c", None, FOUND, {"followup_message": WHY + "\n\nc"}),
    ("cursor", "Stop", "warn", None, None, FOUND, None),
    ("cursor", "Stop", "block", None, None, [], None),
    ("claude", "Stop", "block", "c", None, None, None),
]


def test_answers(spark):
    schema = "i int, platform string, event_name string, decision string, context string, updated_input string, findings array<struct<rule_id:string,severity:string,decision:string,message:string>>"
    rows = spark.createDataFrame([(i, *a[:6]) for i, a in enumerate(ANSWERS)], schema)
    got = {r.i: json.loads(r.output) if r.output else None for r in P.rendered(rows).collect()}
    assert got == {i: a[6] for i, a in enumerate(ANSWERS)}


def one(spark, platform, payload):
    return P.normalized(spark.createDataFrame([(platform, json.dumps(payload))], "platform string, raw string")).collect()[0]


def test_unreadable_is_empty(spark):
    rows = [(p, r) for p in ("cursor", "codex", None) for r in (None, "", "{", "[1]", "7", '{"a":1,"a":2}')]
    for r in P.normalized(spark.createDataFrame(rows, "platform string, raw string")).collect():
        assert not r.readable and r.session_id is None and r.tool_input is None


def test_untouched_fields_stay(spark):
    raw = {"hook_event_name": "Stop", "session_id": "s", "x": {"y": [1, None, "é"]}, "n": None, "tool_result": None}
    r = one(spark, "codex", raw)
    assert json.loads(r.canonical) == raw | {"tool_response": None}


def test_order_of_identity_sources(spark):
    r = one(spark, "codex", {"thread_id": " ", "params": {"threadId": 5, "conversation_id": " p "}, "data": {"codex_session_id": "d"}, "thread": {"id": "t"}})
    assert (r.session_id, r.codex_session_id, r.session_identity_source) == ("p", "p", "codex-thread")
    r = one(spark, "opencode", {"data": {"info": {"id": "inner", "title": "T"}}, "session_id": "own"})
    assert (r.session_id, r.opencode_session_id, r.session_title) == ("own", "inner", "T")
    r = one(spark, "codex", {"session_id": "own", "threadId": "t", "secondary_session_ids": ["a", 3, "own"]})
    assert (r.session_id, json.loads(r.secondary_session_ids)) == ("own", ["a", "own"])


def test_given_defaults_win(spark):
    r = one(spark, "cursor", {"event": "beforeShellExecution", "command": "outer", "tool_input": {"command": "inner"}, "tool_response": 1, "tool_output": 2})
    assert json.loads(r.tool_input) == {"command": "inner"} and (r.tool_response, r.tool_result) == ("1", "2")
    r = one(spark, "pi", {"hook_event_name": "user-bash", "command": "x", "tool_input": "text"})
    assert r.tool_input == '"text"'
    r = one(spark, "pi", {"hook_event_name": "user_bash", "command": "x", "excludeFromContext": "true", "tool_name": "odd"})
    assert (r.tool_name, json.loads(r.tool_input)) == ("odd", {"command": "x"})


def test_clashing_columns_are_replaced(spark):
    rows = spark.createDataFrame([("pi", '{"session_id":"s"}', "old", 1)], "platform string, raw string, session_id string, keep int")
    r = P.normalized(rows).select(F.col("session_id"), "keep").collect()[0]
    assert tuple(r) == ("s", 1)
