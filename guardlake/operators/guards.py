"""Built-in guards: rules whose tests are more than one pattern, as expressions over events.

Events have ``event_name, tool_name, command, path, content, response``, may have ``patch`` and
``cwd``, and get by :func:`prepared` ``paths`` (all files that the call names), ``targets`` (path,
content and source of all that it would write) and ``shell``. Every guard is a column that is null
or (rule_id, decision, severity, target), in two steps: what it looks for, then the finding, so that
nothing is looked for twice; all run in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions.paths import matches_glob
from guardlake.functions.shell import CONTENTS, FACTS, patch_added, patch_paths, shell_facts
from guardlake.storage import saved

#: Events before a call, tools by kind, endings of harmless copies, phrases that wave findings away.
BEFORE, CLOSING, SETTINGS = ("PreToolUse", "PermissionRequest"), ("Stop", "SubagentStop"), ("ConfigChange",)
POWERSHELLS = ("powershell", "pwsh", "power_shell")
SHELLS = ("bash", "sh", "zsh", *POWERSHELLS, "cmd", "cmd.exe", "command_prompt", "shell", "local_shell", "terminal")
PATCHERS = ("patch", "applypatch", "apply_patch")
READERS = ("read", "glob", "grep", "ls")
WRITERS = ("write", "edit", "multiedit", "notebookedit", *PATCHERS)
SAFE_ENDINGS = (".example", ".sample", ".template", ".defaults", ".dist", ".test", ".bak")
PREEXISTING = ("pre-existing", "preexisting", "already existed", "was already", "existed before", "not introduced by", "outside the scope", "out of scope", "not my change")
WEAKENING = ("bypass_permissions", "allowManagedHooksOnly", "disable.*guard", "disable.*rule", "skip.*validation")
SETTINGS_SOURCES = ("project_settings", "local_settings", "user_settings")
DISABLED = r"(?i)\benabled\s*=\s*false\b"
LARGE = 50_000


@dataclass(frozen=True)
class Guards:
    """What is guarded. Sensitive patterns without a sign of regular expressions are plain text."""

    protected: tuple[str, ...] = ("Makefile", "*/config/*.toml")
    sensitive: tuple[str, ...] = (".env", ".pem", ".key", "id_rsa", "credentials")
    system: tuple[str, ...] = ("/etc/", "/usr/bin/", "/boot/")
    marker: str = "gate.toml"
    sentinels: tuple[str, ...] = (".gate-off",)
    infrastructure: tuple[str, ...] = ("hook_layer/", ".claude/hooks/")
    configuration: tuple[str, ...] = ("config/gate/config.json",)
    root: str = "/workspace"  #: Folder of calls that name none.
    weakening_exempt: tuple[str, ...] = field(default=("hook_layer/", "hook-layer/", ".claude/hooks/", "test_", "fixture"))


def _one_of(column: Column, parts: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(column).isin(*parts), F.lit(False))


def _kind(tool: Column) -> Column:
    return F.translate(F.trim(tool), "-", "_")


def with_shell(events: DataFrame) -> DataFrame:
    """Events with ``shell``, null unless a shell is called: each distinct command is lexed once and joined back."""
    tool = _kind(F.col("tool_name"))
    line = F.when(_one_of(tool, SHELLS), F.col("command"))
    asked = events.withColumn("_line", line).withColumn("_windows", _one_of(tool, POWERSHELLS))
    lines = asked.where("_line is not null")
    facts = saved(lines.select("_line", "_windows").distinct().withColumn("shell", shell_facts("_line", F.col("_windows"))))
    named = lines.join(facts, ["_line", "_windows"]).select(*events.columns, "shell")
    return named.unionByName(asked.where("_line is null").select(*events.columns, F.lit(None).cast(FACTS).alias("shell")))


def prepared(events: DataFrame) -> DataFrame:
    """Events with ``shell``, ``patch``, ``named``, ``paths`` and ``targets``, written out.

    The patch is that of the column, or what a patch tool gets as content or command. Paths are the call's own, then those of
    its patch, then those that its command names (so far ``named``) or writes; targets are its content, the lines that its patch adds, by file, and what
    its command writes.
    """
    column = lambda name: F.col(name) if name in events.columns else F.lit(None).cast("string")
    given = F.when(_one_of(_kind(F.col("tool_name")), PATCHERS), F.coalesce("content", "command"))
    patch = F.coalesce(column("patch"), given)
    out = with_shell(events.withColumn("patch", F.when(F.trim(patch) != "", patch)).withColumn("cwd", column("cwd")))
    none, nothing = F.array().cast("array<string>"), F.array().cast(CONTENTS)
    own = F.when(F.coalesce(F.col("path"), F.lit("")) != "", F.array("path")).otherwise(none)
    patched = F.coalesce(patch_paths(F.col("patch")), none)
    written = F.coalesce("shell.contents", nothing)
    extra = F.filter(F.transform(written, lambda t: t["path"]), lambda p: p.isNotNull())
    out = out.withColumn("named", F.array_distinct(F.concat(own, patched, F.coalesce("shell.targets", none))))
    out = out.withColumn("paths", F.array_distinct(F.concat("named", extra)))
    target = lambda path, content, source: F.struct(path.alias("path"), content.alias("content"), F.lit(source).alias("source"))
    plain = (F.size(own) > 0) & (F.coalesce(F.col("content"), F.lit("")) != "") & F.col("patch").isNull()
    added = F.coalesce(F.nullif(patch_added(F.col("patch")), F.lit("")), F.col("patch"))
    files = F.when(F.size(patched) > 0, patched).otherwise(F.array(F.lit("patch.diff")))
    contents = F.concat(
        F.when(F.coalesce(plain, F.lit(False)), F.array(target(F.col("path"), F.col("content"), "tool_input"))).otherwise(nothing),
        F.when(F.col("patch").isNotNull(), F.transform(files, lambda p: target(p, added, "patch"))).otherwise(nothing),
        written,
    )
    return saved(out.withColumn("targets", F.array_distinct(contents)))


def resolved(path: Column, folder: Column) -> Column:
    """A path from a folder, in lower case, without ``.``, ``..`` and doubled slashes; with a drive it stays as it is."""
    slashed = F.lower(F.translate(F.trim(path), "\\", "/"))
    parts = F.split(F.when(slashed.startswith("/"), slashed).otherwise(F.concat(F.lower(folder), F.lit("/"), slashed)), "/")
    step = lambda done, part: (
        F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, part))
    )
    whole = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(slashed.rlike("^[a-z]:/"), slashed).otherwise(whole)


def _finding(rule_id: str, decision: Column | str | None, severity: Column | str, target: Column, when: Column) -> Column:
    plain = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    row = F.struct(F.lit(rule_id).alias("rule_id"), plain(decision).alias("decision"), plain(severity).alias("severity"), target.cast("string").alias("target"))
    return F.when(F.coalesce(when, F.lit(False)), row)


def _first(paths: Column, test) -> Column:
    return F.get(F.filter(paths, test), 0)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _sensitive(g: Guards) -> tuple[list[str], str]:
    """The patterns, and that of a word's rest that makes a match harmless."""
    plain = [p + "(?=$|[^a-z0-9_])" if p in (r"\.key", r"\.pem") else p for p in (re.escape(x) if not set(x) & set("[](){}*+?|^$\\") else x for x in g.sensitive)]
    safe = "(?:" + "|".join(re.escape(s) for s in SAFE_ENDINGS) + "|(?:" + "|".join(s[1:] for s in SAFE_ENDINGS) + r")(?:[ \t\n;|&><]|$))"
    return plain, safe


#: What a guard looks for, and the finding made of it.
Guard = tuple[Column, Callable[[Column], Column]]


def sensitive_data(g: Guards) -> Guard:
    """A path, or the command, names a secret; copies for show are harmless."""
    plain, safe = _sensitive(g)
    path = _first(F.col("paths"), lambda p: ~F.lower(p).rlike("(?:" + "|".join(re.escape(s) for s in SAFE_ENDINGS) + ")$") & _any([F.lower(p).rlike(f"(?i){x}") for x in plain]))
    named = _any([F.lower("command").rlike(f"(?i)(?>{x})(?!{safe})") for x in plain])
    target = F.coalesce(path, F.when(F.col("shell").isNotNull() & named, "[command]"))
    return target, lambda t: _finding("GLOBAL-BUILTIN-SENSITIVE-DATA", "deny", "HIGH", t, t.isNotNull())


def system_protection(g: Guards) -> Guard:
    """A path of the system is named other than to run it; the null device is none."""
    folder = F.coalesce("cwd", F.lit(g.root))
    whole = F.transform("paths", lambda p: F.struct(p.alias("p"), resolved(p, folder).alias("at")))
    path = F.get(F.filter(whole, lambda x: (x["at"] != "/dev/null") & _any([x["at"].startswith(s.lower()) for s in g.system])), 0)["p"]
    pattern = r"(?:^|[\s;|&(<>=])((?:" + "|".join(re.escape(x.lower()) for x in g.system) + r")[^\s;|&()<>'\"]*)"
    named = F.regexp_extract_all(F.lower("command"), F.lit(pattern), F.lit(1))
    run = F.transform(F.col("shell.executables"), F.lower)
    other = F.exists(named, lambda x: (x != "/dev/null") & ~F.array_contains(run, x))
    target = F.coalesce(path, F.when(F.col("shell").isNotNull() & other, "[command]"))
    return target, lambda t: _finding("GLOBAL-BUILTIN-SYSTEM-PROTECTION", "deny", "CRITICAL", t, t.isNotNull())


def git_bypass() -> Guard:
    """Commit and push hooks skipped by an option, its short form, or a hooks path that leads nowhere."""
    low, tokens = F.lower("command"), F.transform(F.col("shell.tokens"), F.lower)
    long = low.contains("--no-verify") & low.rlike("git (commit|push|merge)")
    commit = (F.get(tokens, 0) == "git") & (F.get(tokens, 1) == "commit")
    short = commit & F.exists(F.slice(tokens, 3, 1 << 20), lambda t: t.rlike("^-(?!-).*n"))
    nowhere = low.contains("core.hookspath") & (low.contains("/dev/null") | low.contains("nul"))
    kind = F.when(long, "--no-verify").when(short, "-n (shorthand for --no-verify)").when(nowhere, "core.hookspath disabled")
    return F.when(F.col("shell").isNotNull(), kind), lambda t: _finding("GIT-001", "deny", "HIGH", t, t.isNotNull())


def _changing() -> Column:
    writes = F.coalesce(F.size("shell.contents") > 0, F.lit(False))
    return _one_of(_kind(F.col("tool_name")), WRITERS) | F.coalesce(F.col("shell.mutating"), F.lit(False)) | writes


def _reading() -> Column:
    return _one_of(F.col("tool_name"), READERS) | F.coalesce(F.col("shell.safe_read"), F.lit(False))


def protected_paths(g: Guards) -> Guard:
    """A change to a protected path; Makefiles ask, and running their targets is free."""
    path = _first(F.col("paths"), lambda p: _any([matches_glob(p, x) for x in g.protected]))
    makes, sed = (F.element_at(F.split(F.get("shell.tokens", 0), "/"), -1) == x for x in ("make", "sed"))
    acts = (_changing() | F.coalesce(sed, F.lit(False))) & ~_reading()

    def found(path: Column) -> Column:
        makefile = F.coalesce(F.element_at(F.split(path, "/"), -1) == "Makefile", F.lit(False))
        runs = F.coalesce(makefile & makes, F.lit(False))
        return _finding("BUILTIN-PROTECTED-PATHS", F.when(makefile, "ask").otherwise("deny"), "HIGH", path, path.isNotNull() & ~runs)

    return F.when(acts, path), found


def large_content() -> Guard:
    """The first content of more than 50,000 characters."""
    large = F.get(F.filter("targets", lambda t: F.length(t["content"]) > LARGE), 0)
    return large["path"], lambda t: _finding("WARN-LARGE-001", None, "MEDIUM", t, t.isNotNull())


def _below(path: Column, fragment: str) -> Column:
    bare = fragment.rstrip("/")
    return (F.lower(path) == bare) | F.lower(path).endswith("/" + bare) | F.lower(path).contains(bare + "/")


def infrastructure(g: Guards) -> Guard:
    """A change to the hook layer or its configuration, unless it only reads."""
    path = _first(F.col("paths"), lambda p: _any([_below(p, x) for x in (*g.configuration, *g.infrastructure)]))
    return F.when(~_reading(), path), lambda t: _finding("GLOBAL-BUILTIN-HOOK-INFRA-EXEC", "deny", "CRITICAL", t, t.isNotNull())


def weakened_rules(g: Guards) -> Guard:
    """Content that switches guards off, outside documents, fixtures and the hook layer."""

    def weakens(t: Column) -> Column:
        low = F.lower(F.translate(t["path"], "\\", "/"))
        shown = (low.startswith("docs/") & low.endswith(".md")) | (low.startswith("docs/examples/") & low.endswith(".json"))
        exempt = shown | _any([low.contains(x) for x in g.weakening_exempt])
        return ~F.coalesce(exempt, F.lit(False)) & _any([t["low"].contains(p.split(".*")[0].lower()) & t["low"].rlike(p.lower()) for p in WEAKENING])

    lowered = F.transform("targets", lambda t: F.struct(t["path"].alias("path"), F.lower(t["content"]).alias("low")))
    hit = F.get(F.filter(lowered, weakens), 0)
    return hit["path"], lambda t: _finding("BUILTIN-RULEBOOK-SECURITY", "deny", "HIGH", t, t.isNotNull())


def enrolment(g: Guards) -> Guard:
    """A change that would take the repository out of care: a sentinel, or the marker file by tool, shell or content."""
    name = lambda p: F.lower(F.element_at(F.split(p, "/"), -1))
    ours = lambda p: name(p).isin(g.marker, *g.sentinels)
    written = F.get(F.filter("targets", lambda t: ours(t["path"])), 0)
    path = F.coalesce(_first(F.col("named"), ours), written["path"])
    # a marker that only a content shows is critical if that switches it off
    off = ~F.exists("named", ours) & written["content"].rlike(DISABLED)
    deletes = _one_of(F.col("tool_name"), ("delete", "remove"))
    acts = ~F.coalesce(F.col("shell.safe_read"), F.lit(False)) & (_changing() | deletes)

    def found(hit: Column) -> Column:
        path = hit["path"]
        grade = F.when(name(path).isin(*g.sentinels) | deletes | F.coalesce(hit["off"], F.lit(False)), "CRITICAL").otherwise("HIGH")
        return _finding("REPO-ENROLL-001", "deny", grade, path, path.isNotNull())

    return F.when(acts, F.struct(path.alias("path"), off.alias("off"))), found


def waved_away() -> Guard:
    """A closing answer that calls findings old or out of scope: the first such phrase."""
    low = F.lower("response")
    phrase = F.coalesce(*(F.when(low.contains(p), p) for p in PREEXISTING))
    return phrase, lambda t: _finding("STOP-001", "block", "HIGH", t, t.isNotNull())


def settings_change() -> Guard:
    """Settings that switch hooks off or rewrite them; ``content`` is the change as JSON, ``path`` its source."""
    off = F.coalesce(F.get_json_object("content", "$.disableAllHooks") == "true", F.lit(False))
    hooks = F.get_json_object("content", "$.hooks").isNotNull()
    grade = F.when(off, "CRITICAL").when(hooks, "HIGH")
    source = F.col("path").isin(*SETTINGS_SOURCES)
    return F.when(source, grade), lambda t: _finding("CONFIG-001", "block", t, F.col("path"), t.isNotNull())


def guard_findings(events: DataFrame, g: Guards = Guards(), id_cols: tuple[str, ...] = ("seq",)) -> DataFrame:
    """``(*id_cols, rule_id, decision, severity, target)``: what the guards find, in one pass. Nulls guard nothing."""
    before = [sensitive_data(g), system_protection(g), git_bypass(), protected_paths(g), large_content(), infrastructure(g), weakened_rules(g), enrolment(g)]
    guards = [(*x, BEFORE) for x in before] + [(*waved_away(), CLOSING), (*settings_change(), SETTINGS)]
    ready = prepared(events.where(F.col("event_name").isin(*BEFORE, *CLOSING, *SETTINGS)))
    sought = ready.select("*", *(F.when(F.col("event_name").isin(*names), what).alias(f"_{i}") for i, (what, _, names) in enumerate(guards)))
    found = F.array(*(make(F.col(f"_{i}")) for i, (_, make, _) in enumerate(guards)))
    return sought.select(*id_cols, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f")).select(*id_cols, "f.*")


def stop_reminders(events: DataFrame) -> DataFrame:
    """STOP-002: the first closing event of a session, unless its answer waves findings away."""
    low = F.lower(F.coalesce("response", F.lit("")))
    waved = _any([low.contains(p) for p in PREEXISTING])
    closing = events.where(F.col("event_name").isin("Stop", "SubagentStop") & ~waved)
    return closing.groupBy("session_id").agg(F.min("seq").alias("seq")).select("session_id", "seq", F.lit("STOP-002").alias("rule_id"))
