"""Platform payloads as VARIANT maps: normalising raw hook JSON, and rendering decisions in a platform's own shape.

Built-in expressions only: a payload is parsed once into ``map<string,variant>``, every canonical
field is a look-up in order over keys and source objects, and what was not touched stays as it came.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions.adapters import NATIVE_EVENTS, TOOLS, _lookup, canonical_event

OBJECT = "map<string,variant>"
#: Tool names that a platform's payloads are known to use.
PLATFORM_TOOLS = {
    "cursor": ("bash", "shell", "terminal", "read", "read_file", "edit", "write", "file_edit", "after_file_edit", "grep", "glob", "webfetch", "websearch"),
    "opencode": ("bash", "edit", "glob", "grep", "multiedit", "notebookedit", "read", "todowrite", "webfetch", "websearch", "write"),
    "pi": ("write", "edit", "bash", "read", "grep", "glob", "webfetch", "websearch"),
}
#: Cursor events whose tool follows from the event.
SHELL_EVENTS = ("beforeShellExecution", "afterShellExecution")
READ_EVENTS = ("beforeReadFile", "beforeTabFileRead")
EDIT_EVENTS = ("afterFileEdit", "afterTabFileEdit")
#: Keys that hold identities and titles, in order.
TITLE_KEYS = ("session_title", "sessionTitle", "thread_title", "threadTitle", "conversation_title", "conversationTitle")
THREAD_KEYS = ("codex_session_id", "codexSessionId", "codexSessionID", "threadId", "threadID", "thread_id", "conversationId", "conversationID", "conversation_id")
SESSION_KEYS = ("opencode_session_id", "opencodeSessionId", "opencodeSessionID", "sessionID", "sessionId", "aggregate_id", "aggregateId")
FILE_KEYS = ("file_path", "filePath", "path", "resolved_file_path", "original_file_path")
COMMAND_KEYS = ("command", "cmd", "script")
#: Canonical columns that hold text, and those that hold JSON.
TEXT_FIELDS = ("hook_event_name", "tool_name", "session_id", "cwd", "prompt", "session_title", "session_title_source", "session_identity_source", "codex_session_id", "opencode_session_id", "cursor_hook_event", "opencode_hook_event")
JSON_FIELDS = ("tool_input", "tool_result", "tool_response", "secondary_session_ids")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that stands in the plan once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _string(value: Column) -> Column:
    """The text of a JSON string; null for any other value."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _object(value: Column) -> Column:
    """The members of a JSON object; null for any other value."""
    return F.try_variant_get(value, "$", OBJECT)


def first_raw(source: Column, *keys: str) -> Column:
    """The first key of an object that holds a text that is not empty, as it stands."""
    return F.coalesce(*(F.nullif(_string(source[k]), F.lit("")) for k in keys))


def first_text(sources: list[Column], keys: tuple[str, ...]) -> Column:
    """The first text that is not blank, stripped: sources in order, and in each the keys in order."""
    names = F.array(*map(F.lit, keys))
    found = F.flatten(F.transform(F.array(*sources), lambda m: F.transform(names, lambda k: _strip(_string(m[k])))))
    return F.get(F.filter(found, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def _empty() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))


def _with(base: Column, key: str, value: Column) -> Column:
    """``base`` with ``key`` where it lacks it and there is a value."""
    added = lambda b, v: F.when(v.isNotNull() & ~F.map_contains_key(b, F.lit(key)), F.map_concat(b, F.create_map(F.lit(key), v))).otherwise(b)
    return _let(base, lambda b: _let(value, lambda v: added(b, v)))


def _tool(platform: str, name: Column, hyphens: bool = True) -> Column:
    folded = lambda n: F.regexp_replace(F.lower(_strip(n)), "-", "_") if hyphens else F.lower(_strip(n))
    return _let(name, lambda n: _let(folded(n), lambda f: _lookup(f, {t: TOOLS[t] for t in PLATFORM_TOOLS[platform]}, n)))


def _event(platform: str, name: Column) -> Column:
    return _let(name, lambda n: canonical_event(F.lit(platform), n))


def _identity(raw: Column, objects: tuple[str, ...], inner: str, direct: tuple[str, ...], titles: tuple[str, ...], inner_title: str) -> tuple[Column, Column]:
    """Id and title: the payload and its objects first, then the object ``inner`` of each of them."""
    outer = [raw, *(_object(raw[o]) for o in objects)]
    nested = [_object(m[inner]) for m in outer]
    return (
        F.coalesce(first_text(outer, direct), first_text(nested, (*direct, "id"))),
        F.coalesce(first_text(outer, titles), first_text(nested, (*titles, inner_title))),
    )


def _filled(value: Column) -> Column:
    return F.when(F.size(value) > 0, value)


def _cursor(raw: Column) -> dict[str, Column]:
    event = first_text([raw], ("hook_event_name", "hookEventName", "event_name", "event"))
    tool = _object(raw["tool"])
    given = F.coalesce(
        *(_let(_object(raw[k]), _filled) for k in ("tool_input", "toolInput", "tool_args", "args", "arguments", "input")),
        *(_let(_object(tool[k]), _filled) for k in ("input", "args", "arguments")), _empty(),
    )
    edits = F.when(~F.is_variant_null(raw["edits"]), raw["edits"])

    def completed(e: Column, g: Column) -> Column:
        file = _with(_with(g, "file_path", first_text([raw, g], FILE_KEYS).cast("variant")), "edits", edits)
        return F.when(e.isin(*SHELL_EVENTS), _with(g, "command", first_text([raw, g], COMMAND_KEYS).cast("variant"))).when(e.isin(*READ_EVENTS, *EDIT_EVENTS), file).otherwise(g)

    inputs = _let(event, lambda e: _let(given, lambda g: completed(e, g)))
    name = F.coalesce(first_text([raw], ("tool_name", "toolName", "tool")), first_text([tool], ("name",)))
    named = lambda e: F.when(e.isin(*SHELL_EVENTS), F.lit("Bash")).when(e.isin(*READ_EVENTS), F.lit("Read")).when(e.isin(*EDIT_EVENTS), F.lit("Write")).otherwise(_tool("cursor", name))
    roots = F.transform(F.try_variant_get(raw["workspace_roots"], "$", "array<variant>"), lambda x: _strip(_string(x)))
    file_of = lambda i: F.to_variant_object(F.create_map(F.lit("file_path"), F.coalesce(i["file_path"], F.lit("").cast("variant"))))
    edited = F.when(event.isin(*EDIT_EVENTS), _let(inputs, file_of))
    output = F.when(~F.is_variant_null(raw["tool_output"]), raw["tool_output"])
    return {
        "hook_event_name": F.coalesce(_event("cursor", event), F.lit("")),
        "cursor_hook_event": event,
        "session_id": first_raw(raw, "session_id", "sessionId", "conversation_id", "conversationId"),
        "cwd": F.coalesce(first_text([raw], ("cwd", "workspaceRoot", "workspace_root", "project_path")), F.get(F.filter(roots, lambda x: x.isNotNull() & (x != "")), F.lit(0))),
        "tool_name": _let(event, named),
        "tool_input": F.to_variant_object(_let(inputs, _filled)),
        "tool_response": F.coalesce(raw["tool_response"], edited, output, raw["tool_result"]),
        "tool_result": F.coalesce(raw["tool_result"], output, raw["tool_response"], edited),
        "prompt": first_text([raw], ("prompt", "user_prompt", "userPrompt")),
    }


def _results(raw: Column) -> dict[str, Column]:
    """Results under both names; an output alone is a result."""
    return {"tool_response": F.coalesce(raw["tool_response"], raw["tool_result"]), "tool_result": F.coalesce(raw["tool_result"], raw["tool_response"], raw["tool_output"])}


def _standard(raw: Column, *folders: str) -> dict[str, Column]:
    return {"session_id": first_raw(raw, "session_id", "sessionId"), "cwd": first_raw(raw, "cwd", "workspace_root", *folders)}


def _codex(raw: Column) -> dict[str, Column]:
    thread, title = _identity(raw, ("params", "data", "result"), "thread", THREAD_KEYS, (*TITLE_KEYS, "threadName", "thread_name"), "name")
    renamed = F.when(_string(raw["method"]) == "thread/name/set", first_text([_object(raw["params"])], ("name",)))
    title = F.coalesce(title, renamed)
    own = _standard(raw)
    known = own["session_id"]
    listed = F.filter(F.transform(F.try_variant_get(raw["secondary_session_ids"], "$", "array<variant>"), _string), lambda x: x.isNotNull())
    second = F.coalesce(listed, F.array().cast("array<string>"))
    second = F.when(F.array_contains(second, known), second).otherwise(F.array_append(second, known))
    return own | _results(raw) | {
        "hook_event_name": _event("codex", first_raw(raw, "hook_event_name", "hookEventName")),
        "session_id": F.coalesce(known, F.when(~F.map_contains_key(raw, F.lit("session_id")), thread)),
        "codex_session_id": _default(raw, "codex_session_id", thread),
        "session_identity_source": _default(raw, "session_identity_source", F.when(thread.isNotNull(), "codex-thread")),
        "secondary_session_ids": F.when(known != thread, F.to_variant_object(second)),
        "session_title": _default(raw, "session_title", title),
        "session_title_source": _default(raw, "session_title_source", F.when(title.isNotNull(), "codex-thread")),
    }


def _default(raw: Column, key: str, value: Column) -> Column:
    return F.when(~F.map_contains_key(raw, F.lit(key)), value)


def _opencode(raw: Column) -> dict[str, Column]:
    event = first_raw(raw, "hook_event_name")
    session, title = _identity(raw, ("properties", "data"), "info", SESSION_KEYS, TITLE_KEYS, "title")
    name = F.coalesce(first_raw(raw, "tool_name"), F.when(event == "file.edited", "Write"))
    return _standard(raw, "directory") | _results(raw) | {
        "hook_event_name": F.coalesce(_let(event, lambda e: _lookup(e, NATIVE_EVENTS["opencode"], e)), F.lit("")),
        "opencode_hook_event": event,
        "tool_name": _tool("opencode", name),
        "opencode_session_id": _default(raw, "opencode_session_id", session),
        "session_identity_source": _default(raw, "session_identity_source", F.when(session.isNotNull(), "opencode-event")),
        "session_title": _default(raw, "session_title", title),
        "session_title_source": _default(raw, "session_title_source", F.when(title.isNotNull(), "opencode-event")),
    }


def _pi(raw: Column) -> dict[str, Column]:
    event = first_raw(raw, "hook_event_name", "hookEventName")
    command = F.when(F.regexp_replace(F.lower(event), "-", "") == "user_bash", first_raw(raw, "command"))
    given = F.coalesce(*(_object(raw[k]) for k in ("tool_input", "input", "args", "arguments")))
    hidden = F.when(F.try_variant_get(raw["excludeFromContext"], "$", "boolean") & (F.schema_of_variant(raw["excludeFromContext"]) == "BOOLEAN"), F.lit(True).cast("variant"))
    typed = _with(_with(F.coalesce(given, _empty()), "command", command.cast("variant")), "exclude_from_context", hidden)
    named = _tool("pi", first_raw(raw, "tool_name", "toolName", "tool", "name"), hyphens=False)
    return _standard(raw) | _results(raw) | {
        "hook_event_name": _event("pi", event),
        "tool_name": F.coalesce(named, F.when(command.isNotNull() & ~F.map_contains_key(raw, F.lit("tool_name")), "Bash")),
        "tool_input": F.to_variant_object(F.when(command.isNotNull(), typed).otherwise(given)),
    }


def _claude(raw: Column) -> dict[str, Column]:
    return _standard(raw) | {"hook_event_name": _event("claude", first_raw(raw, "hook_event_name", "hookEventName"))}


PLATFORMS = {"cursor": _cursor, "codex": _codex, "opencode": _opencode, "pi": _pi}


def normalized(rows: DataFrame, platform: str = "platform", raw: str = "raw") -> DataFrame:
    """``rows`` with ``canonical`` (the payload with its canonical fields, as JSON), ``readable``, and each field as a column.

    Text that is null, no JSON, JSON with a repeated key or no object gives an empty payload and ``readable`` false.
    Platforms without a table of their own are read like the plainest one. A field is null where the payload has no
    fitting value; fields in ``JSON_FIELDS`` are JSON text. Columns of these names in ``rows`` are replaced.
    """
    given = [c for c in rows.columns if c not in {"canonical", "readable", "_raw", "_fields", *TEXT_FIELDS, *JSON_FIELDS}]
    parsed = rows.withColumn("_raw", F.try_variant_get(F.try_parse_json(F.col(raw)), "$", OBJECT)).withColumn("readable", F.col("_raw").isNotNull())
    parsed = parsed.withColumn("_raw", F.coalesce("_raw", _empty()))

    def overlay(fields: dict[str, Column]) -> Column:
        each = F.array(*(F.struct(F.lit(k).alias("key"), (v if k in JSON_FIELDS else v.cast("variant")).alias("value")) for k, v in fields.items()))
        return F.map_from_entries(F.filter(each, lambda e: e["value"].isNotNull()))

    chosen = overlay(_claude(F.col("_raw")))
    for name, fields in PLATFORMS.items():
        chosen = F.when(F.col(platform) == name, overlay(fields(F.col("_raw")))).otherwise(chosen)
    merged = parsed.withColumn("_fields", chosen).withColumn("_fields", F.map_concat(F.map_filter("_raw", lambda k, _: ~F.map_contains_key(F.col("_fields"), k)), "_fields"))
    texts = [_string(F.col("_fields")[k]).alias(k) for k in TEXT_FIELDS]
    jsons = [F.to_json(F.col("_fields")[k]).alias(k) for k in JSON_FIELDS]
    return merged.select(*given, "readable", F.to_json("_fields").alias("canonical"), *texts, *jsons)


# --- rendering -------------------------------------------------------------------------


def messages(findings: Column, decision: Column | None = None) -> Column:
    """``[rule | SEVERITY] message`` lines of the findings of a decision (of all without one); blank messages are left out."""
    fits = lambda f: F.coalesce(f["message"] != "", F.lit(False)) & (F.lit(True) if decision is None else f["decision"].eqNullSafe(decision))
    line = lambda f: F.concat(F.lit("["), f["rule_id"], F.lit(" | "), f["severity"], F.lit("] "), f["message"])
    return F.array_join(F.transform(F.filter(findings, fits), line), "\n")


def _json(*parts: tuple[str, Column]) -> Column:
    """JSON of the parts that are not null; null if none is left."""
    some = parts[0][1].isNotNull()
    for _, v in parts[1:]:
        some = some | v.isNotNull()
    return F.when(some, F.struct(*(v.alias(k) for k, v in parts)))


def _joined(text: Column, context: Column) -> Column:
    """Text and context with a blank line between; null if both are empty."""
    return F.nullif(F.concat_ws("\n\n", F.nullif(text, F.lit("")), context), F.lit(""))


def rendered(rows: DataFrame, owner: str = "guardlake") -> DataFrame:
    """``rows`` with ``output``: the JSON that the platform expects for a decided event, null where it expects none.

    ``rows`` has ``platform, event_name, decision, context, updated_input`` (JSON text) and ``findings``, an array of
    (rule_id, severity, decision, message). A null, blank or unreadable ``updated_input`` and an empty object are none;
    empty contexts are none. Without findings only cursor gets an answer. ``owner`` names the details of a patched result.
    """
    event, decision, platform = F.col("event_name"), F.col("decision"), F.col("platform")
    context = F.nullif(F.col("context"), F.lit(""))
    updated = F.try_variant_get(F.try_parse_json("updated_input"), "$", OBJECT)
    updated = F.when(F.size(updated) > 0, updated)
    findings = F.coalesce("findings", F.array().cast("array<struct<rule_id:string,severity:string,decision:string,message:string>>"))
    is_ = lambda *names: F.coalesce(decision.isin(*names), F.lit(False))
    stops, allows = is_("deny", "block", "ask"), is_("allow")
    reason = messages(findings, decision)
    stopped = F.when(stops, reason)
    note = lambda name: F.when(context.isNotNull(), F.struct(name.alias("hookEventName"), context.alias("additionalContext")))
    out = lambda *parts: F.to_json(_json(*parts))
    blocked = ("decision", F.when(stops, F.lit("block")))

    def permission(name: Column, verdict: Column, why: Column, update: Column, extra: Column) -> Column:
        some = verdict.isNotNull() | update.isNotNull() | extra.isNotNull()
        inner = F.struct(name.alias("hookEventName"), verdict.alias("permissionDecision"), why.alias("permissionDecisionReason"), update.alias("updatedInput"), extra.alias("additionalContext"))
        return out(("hookSpecificOutput", F.when(some, inner)))

    def request(update: Column) -> Column:
        behavior = F.when(is_("deny", "block"), "deny").when(is_("ask", "allow"), decision)
        inner = F.struct(behavior.alias("behavior"), F.when(allows, update).alias("updatedInput"), stopped.alias("message"))
        return out(("hookSpecificOutput", F.when(behavior.isNotNull(), F.struct(F.lit("PermissionRequest").alias("hookEventName"), inner.alias("decision")))))

    answer = out(blocked, ("reason", stopped), ("hookSpecificOutput", note(event)))
    stop_like = out(blocked, ("reason", F.when(stops, F.coalesce(_joined(reason, context), F.lit("")))), ("systemMessage", F.when(~stops, context)))
    only_note, only_message = out(("hookSpecificOutput", note(event))), out(("systemMessage", context))
    nothing = F.lit(None).cast("string")
    verdict = F.when(is_("block"), "deny").when(stops | allows, decision)
    claude = (
        F.when(event.isin("PreToolUse", "SubagentStart"), permission(event, verdict, F.when(stops | allows, reason), updated, context)).when(event == "PermissionRequest", request(updated)).when(event == "SessionStart", only_note)
        .when(event.isin("UserPromptSubmit", "PostToolUse"), answer).when(event.isin("Stop", "SubagentStop", "ConfigChange"), stop_like).when(event == "PostToolUseFailure", only_message)
        .when(event.isin("TaskCompleted", "TeammateIdle") & ~stops, only_message)
    )
    grave = F.filter(findings, lambda f: (f["decision"] == "block") & (F.upper(f["severity"]) == "CRITICAL"))
    halted = out(("continue", F.lit(False)), ("stopReason", messages(grave)), ("hookSpecificOutput", note(event)))
    codex = (
        F.when(event == "PreToolUse", permission(event, F.when(stops, "deny").when(allows, "allow"), stopped, F.when(allows, updated), context)).when(event == "PermissionRequest", request(F.lit(None).cast(OBJECT)))
        .when(event == "PostToolUse", F.when(F.size(grave) > 0, halted).otherwise(answer)).when(event.isin("PostCompact", "PreCompact", "SessionStart", "SubagentStart", "SubagentStop"), only_note)
        .when(event == "UserPromptSubmit", answer).when(event == "Stop", stop_like)
    )
    updates = allows & updated.isNotNull()
    acts = F.when(stops, "block").when(updates, "allow")
    said = ("context", context)
    about = out(("action", F.when(context.isNotNull(), "context")), said)
    changes = ("updated_args", F.when(updates, updated))
    hard = is_("deny", "block")
    opencode = (
        F.when(event == "PreToolUse", out(("action", F.coalesce(acts, F.when(context.isNotNull(), "context"))), ("reason", stopped), changes, said)).when(event == "PermissionRequest", out(("action", acts), ("reason", stopped), changes))
        .when(event == "PostToolUse", out(("action", F.when(hard, "block").when(context.isNotNull(), "context")), ("reason", F.when(hard, reason)), said)).when(event == "SessionStart", about)
        .when(event == "Stop", F.when(stops, out(("action", F.lit("continue")), ("reason", reason))).otherwise(about))
    )
    can_block = event.isin("PreToolUse", "UserPromptSubmit") & stops
    pi_parts = (("block", F.when(can_block, True)), ("reason", F.when(can_block, reason)), ("updated_input", F.when(allows, updated)), said)
    details = F.struct(F.struct(F.struct(decision.alias("decision"), context.alias("context"), F.when(can_block, reason).alias("reason")).alias(owner)).alias("details"))
    patched = F.when((event == "PostToolUse") & _json(*pi_parts).isNotNull(), details)
    pi = out(*pi_parts, ("tool_result_patch", patched))
    gated = event.isin("PreToolUse", "PermissionRequest", "SubagentStart")
    ours = F.size(F.filter(findings, lambda f: f["decision"].eqNullSafe(decision))) > 0
    text = F.when(ours, reason).otherwise(messages(findings))
    whole = _joined(text, context)
    asks = F.when(hard, "deny").when(is_("ask"), "ask")
    allow = out(("permission", F.lit("allow")), ("updated_input", updated), ("agent_message", context))
    gate = F.when(asks.isNotNull(), out(("permission", asks), ("user_message", text), ("agent_message", F.when((event != "SubagentStart") | (asks == "ask"), F.coalesce(whole, F.lit("")))))).when(allows | updated.isNotNull() | context.isNotNull(), allow)
    prompt = F.when(stops, out(("continue", F.lit(False)), ("user_message", text))).when(context.isNotNull(), out(("continue", F.lit(True)), ("user_message", context)))
    cursor = (
        F.when(gated, gate).when(event == "PostToolUse", out(("additional_context", whole))).when(event == "UserPromptSubmit", prompt)
        .when(event.isin("Stop", "SubagentStop"), F.when(stops | context.isNotNull(), out(("followup_message", whole)))).when(event == "PreCompact", out(("user_message", whole)))
        .when((event == "SessionStart") & context.isNotNull(), out(("additional_context", whole))).otherwise(out(("agent_message", context)))
    )
    silent = F.when(platform == "cursor", F.when(gated, allow).when(event == "UserPromptSubmit", out(("continue", F.lit(True)))))
    loud = F.when(platform == "codex", codex).when(platform == "opencode", opencode).when(platform == "pi", pi).when(platform == "cursor", cursor).otherwise(claude)
    return rows.withColumn("output", F.when(F.size(findings) == 0, silent).otherwise(F.coalesce(loud, nothing)))
