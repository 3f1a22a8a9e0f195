"""Guards, shell facts, patches and redaction over hand-made calls; what they must give is written by hand in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.functions import paths as P
from guardlake.functions import shell
from guardlake.operators import guards
from guardlake.operators import rules as R
from guardlake.plans import proxies as X
from guardlake.plans.proxies import HE

#: Calls: event, tool, command, path, content, response.
CALLS = (
    ("PreToolUse", "Bash", "git commit -m fix --no-verify", None, None, None),
    ("PreToolUse", "Bash", "git commit -nm fix", None, None, None),
    ("PreToolUse", "Bash", "git log -n 5", None, None, None),
    ("PreToolUse", "Bash", "git config core.hooksPath /dev/null", None, None, None),
    ("PreToolUse", "Bash", "cat .env", None, None, None),
    ("PreToolUse", "Bash", "cat .env.example", None, None, None),
    ("PreToolUse", "Read", None, "/srv/app/id_rsa", None, None),
    ("PreToolUse", "Bash", "rm -rf /etc/passwd", None, None, None),
    ("PreToolUse", "Bash", "/usr/bin/env python3 x.py", None, None, None),
    ("PreToolUse", "Bash", "echo hi > /dev/null", None, None, None),
    ("PreToolUse", "Bash", "sed -i s/a/b/ Makefile", None, None, None),
    ("PreToolUse", "Bash", "make test", None, None, None),
    ("PermissionRequest", "Edit", None, "/home/u/config/limits.toml", "limit = 3", None),
    ("PreToolUse", "Read", None, "/home/u/config/limits.toml", None, None),
    ("PreToolUse", "Write", None, "big.txt", "x" * 50_001, None),
    ("PreToolUse", "Write", None, "src/a.py", "skip all validation", None),
    ("PreToolUse", "Write", None, "docs/guide.md", "skip all validation", None),
    ("PreToolUse", "Edit", None, "repo/gate.toml", "enabled = false", None),
    ("PreToolUse", "Bash", "rm gate.toml", None, None, None),
    ("PreToolUse", "Write", None, "repo/.gate-off", "", None),
    ("PreToolUse", "Edit", None, "/opt/hook_layer/run.py", "pass", None),
    ("PreToolUse", "Bash", "cat hook_layer/run.py", None, None, None),
    ("Stop", None, None, None, None, "The test was already failing."),
    ("Stop", None, None, None, None, "All is done."),
    ("ConfigChange", None, None, "user_settings", '{"disableAllHooks": true}', None),
    ("PreToolUse", "Bash", "python3 -c \"open('out.txt','w')\"", None, None, None),
    ("PreToolUse", "Bash", "FOO=1 command cp a.txt /boot/vmlinuz && ls", None, None, None),
    ("PostToolUse", "Bash", "git push --no-verify", None, None, None),
    ("PreToolUse", "apply_patch", None, None, "*** Begin Patch\n*** Update File: app/.env\n+TOKEN=1\n*** End Patch", None),
    ("PreToolUse", "apply_patch", None, None, "*** Update File: gate.toml\n-enabled = true\n+enabled = false", None),
    ("PreToolUse", "Bash", "cat ../../etc/hosts", None, None, None),
    ("PreToolUse", "Bash", "cat > src/b.py <<'PY'\nskip all validation\nPY", None, None, None),
    ("PreToolUse", "Bash", "bash -c \"printf x; echo 'enabled = false' >>'gate.toml'\"", None, None, None),
    ("PreToolUse", "Bash", "python3 - <<'E'\nfrom pathlib import Path\nPath('hook_layer/a.py').write_text('pass')\nE", None, None, None),
    ("PreToolUse", "PowerShell", "Set-Content -Path C:\\app\\id_rsa -Value 1", None, None, None),
    ("PreToolUse", "Bash", "rtk grep -n x app/limits.toml", None, None, None),
    ("Stop", "Bash", "rm x", None, None, None),
    ("PreToolUse", "Bash", "apply_patch <<'EOF'\n*** Add File: src/c.py\n+skip all validation\nEOF", None, None, None),
    ("PreToolUse", "mcp_serena_edit", None, "a.py", "x", None),
    ("PreToolUse", "WebSearch", None, None, None, None),
    ("PreToolUse", "Grep", None, "a.py", None, None),
    ("PreToolUse", "Bash", None, None, None, None),
)
#: What the guards find: call, rule, decision, severity, target.
EXPECTED = (
    (0, "GIT-001", "deny", "HIGH", "--no-verify"),
    (1, "GIT-001", "deny", "HIGH", "-n (shorthand for --no-verify)"),
    (3, "GIT-001", "deny", "HIGH", "core.hookspath disabled"),
    (4, "GLOBAL-BUILTIN-SENSITIVE-DATA", "deny", "HIGH", "[command]"),
    (6, "GLOBAL-BUILTIN-SENSITIVE-DATA", "deny", "HIGH", "/srv/app/id_rsa"),
    (7, "GLOBAL-BUILTIN-SYSTEM-PROTECTION", "deny", "CRITICAL", "/etc/passwd"),
    (10, "BUILTIN-PROTECTED-PATHS", "ask", "HIGH", "Makefile"),
    (12, "BUILTIN-PROTECTED-PATHS", "deny", "HIGH", "/home/u/config/limits.toml"),
    (14, "WARN-LARGE-001", None, "MEDIUM", "big.txt"),
    (15, "BUILTIN-RULEBOOK-SECURITY", "deny", "HIGH", "src/a.py"),
    (17, "REPO-ENROLL-001", "deny", "HIGH", "repo/gate.toml"),
    (18, "REPO-ENROLL-001", "deny", "HIGH", "gate.toml"),
    (19, "REPO-ENROLL-001", "deny", "CRITICAL", "repo/.gate-off"),
    (20, "GLOBAL-BUILTIN-HOOK-INFRA-EXEC", "deny", "CRITICAL", "/opt/hook_layer/run.py"),
    (22, "STOP-001", "block", "HIGH", "was already"),
    (24, "CONFIG-001", "block", "CRITICAL", "user_settings"),
    (26, "GLOBAL-BUILTIN-SYSTEM-PROTECTION", "deny", "CRITICAL", "/boot/vmlinuz"),
    (28, "GLOBAL-BUILTIN-SENSITIVE-DATA", "deny", "HIGH", "app/.env"),
    (29, "REPO-ENROLL-001", "deny", "HIGH", "gate.toml"),
    (30, "GLOBAL-BUILTIN-SYSTEM-PROTECTION", "deny", "CRITICAL", "../../etc/hosts"),
    (31, "BUILTIN-RULEBOOK-SECURITY", "deny", "HIGH", "src/b.py"),
    (32, "REPO-ENROLL-001", "deny", "HIGH", "gate.toml"),
    (33, "GLOBAL-BUILTIN-HOOK-INFRA-EXEC", "deny", "CRITICAL", "hook_layer/a.py"),
    (34, "GLOBAL-BUILTIN-SENSITIVE-DATA", "deny", "HIGH", "C:\\app\\id_rsa"),
    (37, "BUILTIN-RULEBOOK-SECURITY", "deny", "HIGH", "src/c.py"),
)
#: By call: intent, its reason, where its files come from.
INTENT = (
    (0, "execute", "shell_execute:Bash", "command_text"),
    (4, "read", "read_only_tool:Bash", "command_text"),
    (6, "read", "read_only_tool:Read", "tool_input"),
    (7, "mutate", "mutation_evidence:Bash", "command_args"),
    (12, "mutate", "mutation_evidence:Edit", "tool_input"),
    (22, "lifecycle", "lifecycle_event:Stop", "payload"),
    (25, "mutate", "mutation_evidence:Bash", "script_write_target"),
    (28, "mutate", "mutation_evidence:apply_patch", "tool_input"),
    (31, "mutate", "mutation_evidence:Bash", "redirect_target"),
    (35, "search", "read_only_tool:Bash", "command_args"),
    (36, "lifecycle", "lifecycle_event:Stop", "command_text"),
    (38, "mutate", "mutation_evidence:mcp_serena_edit", "tool_input"),
    (39, "inspect", "read_only_tool:WebSearch", "payload"),
    (40, "search", "read_only_tool:Grep", "tool_input"),
    (41, "execute", "shell_execute:Bash", "payload"),
)
#: By call: what it would write.
WRITTEN = (
    (12, "/home/u/config/limits.toml", "limit = 3", "tool_input"),
    (28, "app/.env", "TOKEN=1", "patch"),
    (29, "gate.toml", "enabled = false", "patch"),
    (31, "src/b.py", "skip all validation", "shell_heredoc"),
    (32, "gate.toml", "enabled = false", "shell_echo"),
    (33, "hook_layer/a.py", "pass", "shell_python_write"),
    (37, "src/c.py", "skip all validation", "patch"),
    (38, "a.py", "x", "tool_input"),
)
#: By call with a command: what it runs, what it names, whether it changes files, whether it only reads.
SHELL = (
    (0, "git", "", False, False),
    (1, "git", "", False, False),
    (2, "git", "", False, False),
    (3, "git", "core.hooksPath", False, False),
    (4, "cat", "", False, True),
    (5, "cat", ".env.example", False, True),
    (7, "rm", "/etc/passwd", True, False),
    (8, "/usr/bin/env python3", "x.py", False, False),
    (9, "echo", "", False, True),
    (10, "sed", "s/a/b/ Makefile", True, False),
    (11, "make", "", False, False),
    (18, "rm", "gate.toml", True, False),
    (21, "cat", "hook_layer/run.py", False, True),
    (25, "python3", "out.txt", True, False),
    (26, "cp ls", "a.txt /boot/vmlinuz", True, False),
    (27, "git", "", False, False),
    (30, "cat", "../../etc/hosts", False, True),
    (31, "cat skip PY", "src/b.py <'PY", True, False),
    (32, "bash", "gate.toml", True, False),
    (33, "python3 from Path(hook_layer/a.py).write_text(pass) E", "Path <'E hook_layer/a.py", True, False),
    (34, "Set-Content", "C:\\app\\id_rsa C:appid_rsa", True, False),
    (35, "rtk", "app/limits.toml", False, True),
    (36, "rm", "", True, False),
    (37, "apply_patch *** +skip EOF", "Add File: src/c.py <'EOF", False, False),
)
PATCHES = ("*** Update File: src/a.py\n+one\n-two\n*** Add File: b.py\n+++ b/c.py\n+three", "--- a/d.py\n+++ b/d.py\n+x\n y", "+++ b//dev/null\n+lost", "no patch")
SECRETS = ("run --token=abc123 --x", "API_KEY:zzz password= open", "Authorization:Basic9 Bearer abcdefgh.ij", "bearer short", "cookie=a;b token : spaced", "my secretary = fine")
MASKED = ("run --token=[REDACTED] --x", "API_KEY:[REDACTED] password= open", "Authorization:[REDACTED] Bearer [REDACTED]", "bearer short", "cookie=[REDACTED] token : spaced", "my secretary = fine")
#: Tool output, and how many signs of failure it has; then whether it counts as one.
OUTPUTS = (
    ("FAILED tests/test_a.py::test", 1, True), ("FAIL src/a.test.ts", 1, True), ("Tests: 3 failed, 2 passed", 2, True), ("test result: FAILED. 1 passed", 1, True),
    ("2 failed, 7 passed in 3s", 1, True), ("src/a.c:10:5: error: no member", 1, True), ("make: *** [all] Error 2", 1, True), ("Build FAILED.", 1, True),
    ("a compilation error came", 1, True), ("Traceback (most recent call last)\nKeyError: 'x'", 2, True), ("Found 12 errors.", 1, True), ("error[E0308]: mismatched", 1, True), ("x  ✗ one case", 1, True),
    ("Successfully built a\nBuild FAILED", 1, False), ("12 passed in 0.3s\nFound 1 error\nKeyError: 'x'", 2, True), ("all fine, no errors here", 0, False), ("KeyError:", 1, False),
)
READS = (("grep -n error a.log", True), ("ls", True), ("git diff --stat", True), ("cat a | wc -l", True), ("command -v python", True), ("pytest -q", False), ("make test", False), ("environ", True), ("diff a b", False))
BENIGN = (("grep x y", True), ("rtk grep x y", True), ("diff a b", True), ("test -f a", True), ("curl -s --fail http://x", True), ("pytest", False), ("git diff --exit-code", True))


def _pick(column, values, kind: str = "string"):
    return F.get(F.array(*(F.lit(v).cast(kind) for v in values)), column.cast("int"))


def _calls(s, d):
    e = X.hook_events(s, d)
    n = F.col("k") % len(CALLS)
    columns = ("event_name", "tool_name", "command", "path", "content", "response")
    return e.select("seq", "session_id", n.alias("call"), *(_pick(n, [c[i] for c in CALLS]).alias(name) for i, name in enumerate(columns)))


def _quote(v) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def _values(rows) -> str:
    return "(values " + ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows) + ")"


def _each(values, **columns):
    """A query that takes each event's value by its number, and SQL with what is expected of it."""

    def query(s, d):
        e = X.hook_events(s, d)
        v = _pick(F.col("k") % len(values), values)
        return e.select("seq", *(f(v).alias(name) for name, (f, _) in columns.items()))

    rows = [(i, *(w[i] for _, w in columns.values())) for i in range(len(values))]
    sql = f"with {HE} select seq, {', '.join(columns)} from he join {_values(rows)} x(n, {', '.join(columns)}) on k % {len(values)} = n"
    return query, sql


def _shell(s, d):
    calls = guards.with_shell(_calls(s, d)).where("command is not null").withColumnRenamed("shell", "f")
    return calls.select("seq", F.array_join("f.executables", " ").alias("runs"), F.array_join("f.targets", " ").alias("names"), "f.mutating", "f.safe_read")


def _picked(rows) -> list[int]:
    return sorted({r[0] for r in rows})


QUERIES = {
    "call_intents": (
        lambda s, d: R.intents(_calls(s, d)).where(F.col("call").isin(_picked(INTENT))).select("seq", "intent", "intent_reason", "path_source"),
        f"with {HE} select seq, intent, intent_reason, path_source from he join {_values(INTENT)} x(call, intent, intent_reason, path_source) on k % {len(CALLS)} = call",
    ),
    "content_targets": (
        lambda s, d: guards.prepared(_calls(s, d)).where(F.col("call").isin(_picked(WRITTEN))).select("seq", F.explode("targets").alias("t")).select("seq", "t.*"),
        f"with {HE} select seq, x.path, x.content, x.source from he join {_values(WRITTEN)} x(call, path, content, source) on k % {len(CALLS)} = call",
    ),
    "guard_findings": (
        lambda s, d: guards.guard_findings(_calls(s, d)),
        f"with {HE} select seq, rule_id, decision, severity, target from he join {_values(EXPECTED)} x(call, rule_id, decision, severity, target) on k % {len(CALLS)} = call",
    ),
    "stop_reminders": (
        lambda s, d: guards.stop_reminders(_calls(s, d)),
        f"with {HE} select session_id, min(seq) as seq, 'STOP-002' as rule_id from he where k % {len(CALLS)} in (23, 36) group by 1",
    ),
    "shell_facts": (_shell, f"with {HE} select seq, runs, names, mutating, safe_read from he join {_values(SHELL)} x(call, runs, names, mutating, safe_read) on k % {len(CALLS)} = call"),
    "patch_facts": _each(
        PATCHES,
        files=(lambda v: F.array_join(shell.patch_paths(v), " "), ("src/a.py b.py c.py", "d.py", "", "")),
        added=(lambda v: F.regexp_replace(shell.patch_added(v), "\n", " "), ("one three", "x", "lost", "")),
    ),
    "redaction": _each(SECRETS, masked=(P.redacted, MASKED)),
    "error_signals": _each(
        [o for o, *_ in OUTPUTS], hits=(lambda v: P.error_hits(v).cast("int"), [n for _, n, _ in OUTPUTS]), failed=(P.is_error, [f for *_, f in OUTPUTS])
    ),
    "read_only_commands": _each([c for c, _ in READS], read_only=(P.read_only_command, [r for _, r in READS])),
    "benign_failures": _each([c for c, _ in BENIGN], benign=(P.benign_failure, [b for _, b in BENIGN])),
}
