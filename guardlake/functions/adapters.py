"""Platform payloads to canonical events: mapping tables as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Native event names of platforms whose names differ by more than case.
NATIVE_EVENTS = {
    "cursor": {
        "beforeShellExecution": "PreToolUse", "afterShellExecution": "PostToolUse", "beforeMCPExecution": "PreToolUse", "afterMCPExecution": "PostToolUse", "beforeReadFile": "PreToolUse", "beforeTabFileRead": "PreToolUse",
        "afterFileEdit": "PostToolUse", "afterTabFileEdit": "PostToolUse", "beforeSubmitPrompt": "UserPromptSubmit",
        "afterAgentResponse": "AfterAgentResponse", "afterAgentThought": "AfterAgentThought", "workspaceOpen": "WorkspaceOpen",
    },
    "opencode": {
        "tool.execute.before": "PreToolUse", "tool.execute.after": "PostToolUse", "permission.asked": "PermissionRequest", "permission.replied": "PermissionReplied",
        "command.executed": "CommandExecuted", "file.edited": "PostToolUse", "shell.env": "ShellEnv", "session.created": "SessionStart",
        "session.compacted": "PostCompact", "session.idle": "Stop", "session.error": "SessionError", "session.status": "SessionStatus",
    },
    "pi": {"tool_call": "PreToolUse", "user_bash": "PreToolUse", "tool_result": "PostToolUse", "tool_execution_end": "PostToolUse", "input": "UserPromptSubmit", "before_agent_start": "SessionStart", "turn_end": "TurnEnd", "agent_end": "Stop"},
}
#: Events known by the same name, and tools by other names.
EVENTS = ("PreToolUse", "PostToolUse", "PostToolUseFailure", "PermissionRequest", "UserPromptSubmit", "SessionStart", "SessionEnd", "Stop", "SubagentStart", "SubagentStop", "PreCompact", "PostCompact", "ConfigChange")
TOOLS = {"bash": "Bash", "shell": "Bash", "terminal": "Bash", "read": "Read", "read_file": "Read", "edit": "Edit", "write": "Write", "file_edit": "Write", "after_file_edit": "Write", "multiedit": "MultiEdit", "notebookedit": "NotebookEdit", "todowrite": "TodoWrite", "grep": "Grep", "glob": "Glob", "webfetch": "WebFetch", "websearch": "WebSearch"}


def _lookup(value: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def canonical_event(platform: Column, event: Column) -> Column:
    """By the platform's own table, else by name whatever its case and hyphens, else as it is."""
    folded = F.regexp_replace(F.lower(event), "[-_]", "")
    out = _lookup(folded, {e.lower(): e for e in EVENTS}, event)
    for name, table in NATIVE_EVENTS.items():
        out = F.when(platform == name, _lookup(event, table, out)).otherwise(out)
    return out


def canonical_tool(tool: Column) -> Column:
    folded = F.regexp_replace(F.lower(F.trim(tool)), "-", "_")
    return _lookup(folded, TOOLS, tool)


def first_present(*candidates: Column) -> Column:
    """The first value that is neither null nor blank, over sources in order."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in candidates))
