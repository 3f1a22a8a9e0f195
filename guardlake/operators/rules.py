"""Rules as data: applicability, regex rules over content targets, overrides, decisions.

Patterns are literals of the plan, so each compiles once; a rule set becomes a handful of
columns over one scan of the targets, without a cross join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions.paths import matches_glob
from guardlake.operators.guards import SHELLS, with_shell


@dataclass(frozen=True)
class Rule:
    """A regex rule. ``target`` is content, path, command or prompt; empty tuples do not restrict."""

    rule_id: str
    patterns: tuple[str, ...]
    action: str = "deny"
    severity: str = "MEDIUM"
    target: str = "content"
    events: tuple[str, ...] = ()
    tools: tuple[str, ...] = ()
    path_globs: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = ()
    case_sensitive: bool = True
    multiline: bool = True
    message: str = ""


def _any(conditions: list[Column], empty: bool) -> Column:
    out = F.lit(False) if conditions else F.lit(empty)
    for c in conditions:
        out = out | c
    return out


def fires(rule: Rule, columns: set[str]) -> Column:
    """Cheap tests first; the patterns last. Multiline also lets a dot match a line end."""
    flags = "(?" + ("" if rule.case_sensitive else "i") + ("ms" if rule.multiline else "") + ")"
    prefix = flags if flags != "(?)" else ""
    ok = F.lit(True)
    if rule.events and "event_name" in columns:
        ok = ok & F.col("event_name").isin(*rule.events)
    if rule.tools and "tool_name" in columns:
        ok = ok & F.col("tool_name").isin(*rule.tools)
    if rule.path_globs:
        ok = ok & _any([matches_glob(F.col("path"), g) for g in rule.path_globs], True)
    if rule.exclude_globs:
        ok = ok & ~_any([matches_glob(F.col("path"), g) for g in rule.exclude_globs], False)
    hit = _any([F.col(rule.target).rlike(prefix + p) for p in rule.patterns], False)
    return F.coalesce(F.when(ok, hit), F.lit(False))


def evaluate(targets: DataFrame, rules: tuple[Rule, ...], id_cols: tuple[str, ...]) -> DataFrame:
    """A finding for every target and rule that fires on it, in one pass over the targets."""
    columns = set(targets.columns)
    found = F.filter(F.array(*(F.when(fires(r, columns), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.action).alias("decision"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))) for r in rules)), lambda x: x.isNotNull())
    return targets.select(*id_cols, F.explode(found).alias("f")).select(*id_cols, "f.*")


def applicable(events: DataFrame, rules: DataFrame, disabled: DataFrame) -> DataFrame:
    """Event and rule pairs: the rule's surface is on, it lists the event and is not disabled. ``rules`` is a small dimension."""
    live = rules.where("enabled").join(disabled, "rule_id", "left_anti").select("rule_id", F.explode("events").alias("event_name"))
    return events.join(live, "event_name")


def overridden(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Severity ``warn`` means LOW without a decision; actions context and warn drop the decision."""
    o = overrides.select("rule_id", F.col("severity").alias("_s"), F.col("action").alias("_a"))
    soft = (F.col("_s") == "warn") | F.coalesce(F.col("_a").isin("context", "warn"), F.lit(False))
    severity = F.when(F.col("_s") == "warn", "LOW").otherwise(F.coalesce(F.upper("_s"), F.col("severity")))
    return findings.join(o, "rule_id", "left").withColumn("decision", F.when(F.coalesce(soft, F.lit(False)), None).otherwise(F.col("decision"))).withColumn("severity", severity).drop("_s", "_a")


def enforcement_mode(inside: Column, enrolled: Column, strict: Column) -> Column:
    return F.when(~F.coalesce(inside, F.lit(False)), "outside").when(F.coalesce(enrolled & strict, F.lit(False)), "strict").otherwise("relaxed")


#: Tools by intent, parts of names of tools that edit, events and platform events that tell it by themselves.
INTENTS = {"read": ("read", "read_file", "before_read_file"), "search": ("grep", "ripgrep", "rg"), "list": ("glob", "ls", "list"), "inspect": ("lookat", "look_at", "webfetch", "websearch")}
EDITS, EDIT_PARTS = ("edit", "write", "multiedit", "notebookedit", "patch", "applypatch", "apply_patch", "replace"), ("edit_file", "editfile", "serena", "morph", "str_replace", "strreplace")
LIFECYCLE = (
    "AfterAgentResponse", "AfterAgentThought", "CommandExecuted", "PermissionReplied", "PostCompact", "PreCompact", "SessionEnd", "SessionError",
    "SessionStart", "SessionStatus", "ShellEnv", "Stop", "SubagentStart", "SubagentStop", "UserPromptSubmit", "WorkspaceOpen",
)
MUTATING_EVENTS = ("file.edited",)


def tool_intent(event: Column, tool: Column, shell: Column) -> Column:
    """What a call is for: lifecycle, mutate, read, search, list, inspect, execute or unknown.

    ``shell`` has the facts of a shell's command and is null for any other tool; a shell without a command executes.
    """
    name = F.translate(F.lower(F.trim(F.coalesce(tool, F.lit("")))), "-", "_")
    edits = name.isin(*EDITS, "delete", "remove") | name.endswith("_edit")
    for part in EDIT_PARTS:
        edits = edits | name.contains(part)
    out = F.when(F.coalesce(event.isin(*MUTATING_EVENTS), F.lit(False)), "mutate").when(F.coalesce(event.isin(*LIFECYCLE), F.lit(False)), "lifecycle")
    out = out.when(name.isin(*SHELLS), F.coalesce(shell["intent"], F.lit("execute"))).when(edits, "mutate")
    for intent, names in INTENTS.items():
        out = out.when(name.isin(*names), intent)
    return out.otherwise("unknown")


def intents(events: DataFrame) -> DataFrame:
    """Events with ``shell``, ``intent``, ``intent_reason`` and ``path_source`` (where the files it names come from)."""
    out = with_shell(events).withColumn("intent", tool_intent(F.col("event_name"), F.col("tool_name"), F.col("shell")))
    named = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unset"))
    tool, event = named(F.col("tool_name")), named(F.col("event_name"))
    reason = (
        F.when(F.col("intent") == "lifecycle", F.concat(F.lit("lifecycle_event:"), event)).when(F.col("intent") == "mutate", F.concat(F.lit("mutation_evidence:"), tool))
        .when(F.col("intent").isin("read", "search", "list", "inspect"), F.concat(F.lit("read_only_tool:"), tool))
        .when(F.col("intent") == "execute", F.concat(F.lit("shell_execute:"), tool)).otherwise("unknown_tool_intent")
    )
    given = F.coalesce(F.col("path"), F.col("content")).isNotNull()
    source = F.when(F.trim("command") != "", F.coalesce("shell.path_source", F.lit("tool_input"))).when(given, "tool_input").otherwise("payload")
    return out.withColumn("intent_reason", reason).withColumn("path_source", source)


def category(rule_id: Column, prefixes: list[tuple[str, str]], other: str = "other") -> Column:
    """The first prefix in list order that fits."""
    out = F.lit(other)
    for prefix, name in reversed(prefixes):
        out = F.when(rule_id.startswith(prefix), name).otherwise(out)
    return out


#: The rule table of this repository (its own patterns), over document text.
TEXT_RULES = (
    Rule("TXT-EMAIL", (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",), "warn", "LOW", message="address in text"),
    Rule("TXT-SECRET", (r"\b(api[_-]?key|token|secret|password)\s*[=:]\s*[^\s]+", r"\bAKIA[0-9A-Z]{16}\b"), "block", "CRITICAL", case_sensitive=False, message="secret in text"),
    Rule("TXT-LICENSE", (r"(licensed under|all rights reserved|copyright \(c\))",), "context", "LOW", case_sensitive=False, message="license line"),
    Rule("TXT-SHOUT", (r"!![ \n].*!![ \n].*!!",), "ask", "MEDIUM", exclude_globs=("src1/*",), message="shouting"),
    Rule("TXT-TABLE", (r"\|[^|\n]*\|[^|\n]*\|",), "info", "LOW", path_globs=("doc*.txt",), message="table row"),
)
