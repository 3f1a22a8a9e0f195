"""Path, glob and text expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segments of third-party code, and languages by suffix.
THIRD_PARTY = (".venv", "venv", "site-packages", "node_modules", "vendor", "third_party", "__pycache__")
LANGUAGES = {".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".rs": "rust", ".go": "go", ".java": "java", ".sql": "sql", ".sh": "shell"}


def glob_regex(glob: str, star_crosses: bool = True) -> str:
    """A glob as a regular expression. In rule globs ``*`` crosses ``/``; in the path explorer only ``**`` does."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        out += ".*" if c == "*" and star_crosses else "[^/]*" if c == "*" else ("." if star_crosses else "[^/]") if c == "?" else re.escape(c)
        i += 1
    return "(?s)^" + out + "$"


def matches_glob(path: Column, glob: str) -> Column:
    """Case-folded: a glob with ``/`` is held against the path, one without against the name; a trailing ``/`` means all below."""
    folded = glob.lower()
    if folded.endswith("/"):
        return F.lower(path).rlike(f"(^|/){re.escape(folded)}")
    target = path if "/" in folded else F.element_at(F.split(path, "/"), -1)
    return F.lower(target).rlike(glob_regex(folded))


def third_party(path: Column) -> Column:
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, THIRD_PARTY)))


def language(path: Column) -> Column:
    suffix = F.regexp_extract(F.lower(path), r"(\.[a-z0-9]+)$", 1)
    out = F.lit(None).cast("string")
    for s, name in LANGUAGES.items():
        out = F.when(suffix == s, name).otherwise(out)
    return out


def repo_label(path: Column) -> Column:
    """The folder after ``repos``, else the one after ``/home/<user>``, else null."""
    after = F.regexp_extract(path, r"(?:^|/)repos/([^/]+)", 1)
    home = F.regexp_extract(path, r"^/home/[^/]+/([^/]+)", 1)
    return F.coalesce(F.when(after != "", after), F.when(home != "", home))


def prefixes(path: Column) -> Column:
    """Every prefix of a path, as (prefix, depth)."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("prefix"), n.alias("depth"))))


def trimmed(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, with a mark where something was cut."""
    return F.when(F.length(text) > limit, F.concat(text.substr(1, limit), F.lit("…[trimmed]"))).otherwise(text)


def effective_path(path: Column, hits: Column) -> Column:
    """The finding's own path, else its first hit that is neither content nor patch nor third-party code."""
    usable = F.filter(hits, lambda x: x.isNotNull() & ~x.isin("content", "patch.diff") & ~third_party(x))
    return F.coalesce(F.when(F.trim(path) != "", path), F.when(F.size(usable) > 0, F.element_at(usable, 1)))


def redacted(text: Column) -> Column:
    """Values that directly follow a secret's name, and bearer tokens of eight characters or more, are masked."""
    keyed = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password|cookie|authorization)(=|:)\S+", "$1$2[REDACTED]")
    return F.regexp_replace(keyed, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED]")


#: Signs of failure in tool output, signs that it is none, beginnings of commands that only read,
#: commands whose failure means nothing.
ERROR_SIGNS = (
    r"(?i)\bFAILED\b.*test", r"(?i)\bFAIL\s+(?:src/|tests/)", r"(?i)Tests?:\s+\d+\s+failed", r"(?i)test result: FAILED", r"(?i)\d+\s+failed,\s+\d+\s+passed",
    r"(?m)^.*:\d+:\d+:\s+error:", r"(?i)make:\s+\*\*\*.*Error\s+\d+", r"(?i)Build FAILED", r"(?i)compilation\s+error", r"Traceback \(most recent call last\)",
    r"(?:SyntaxError|TypeError|NameError|ValueError|AttributeError|ImportError|KeyError|IndexError|RuntimeError|AssertionError|FileNotFoundError|ModuleNotFoundError|OSError|PermissionError):",
    r"(?i)Found\s+\d+\s+error", r"(?i)error\[E\d+\]", "\u2717|\u2718",
)
SUCCESS_SIGNS = (
    r"(?m)^\s*\d+\s+passed(?:\s+in\s+[\d.]+s)?\s*$", r"(?i)DEPRECATION:|DeprecationWarning|PendingDeprecationWarning",
    r"(?i)\d+\s+warnings?\s+found\s+\(use\s+docker", r"(?i)Successfully\s+(built|installed|tagged|created)",
)
READ_ONLY = (
    "grep ", "grep\t", "egrep ", "fgrep ", "rg ", "ag ", "ack ", "cat ", "head ", "tail ", "less ", "more ", "bat ", "ls ", "ls\t", "ll ", "dir ", "tree ", "du ", "df ", "wc ", "find ", "locate ", "fd ",
    "git log", "git show", "git diff", "git status", "git blame", "git branch", "git tag", "git remote", "git stash list",
    "which ", "whereis ", "type ", "file ", "stat ", "echo ", "printf ", "env", "printenv", "man ", "help ", "pwd",
)
READ_ONLY_FORMS = r"^(?:command\s+-v|type\s+|hash\s+|readlink\s+|realpath\s+|basename\s+|dirname\s+)"
BENIGN_FORMS = r"(?i)^(?:(?:grep|egrep|fgrep|rg|ag|ack|diff)\b|test\s|\[\s|(?:which|command\s+-v|type\s+|hash\s+)\b|git\s+diff\b.*--exit-code|curl\b.*--fail)"


def error_hits(text: Column) -> Column:
    return sum((text.rlike(p).cast("int") for p in ERROR_SIGNS), F.lit(0))


def is_error(text: Column, least: int = 10) -> Column:
    """A sign of failure in a text of some length, unless there is one only and a sign that it is none."""
    hits = error_hits(text)
    claims = sum((text.rlike(p).cast("int") for p in SUCCESS_SIGNS), F.lit(0)) > 0
    return (F.length(F.trim(text)) >= least) & (hits >= 1) & ~(claims & (hits <= 1))


def read_only_command(command: Column) -> Column:
    """Commands that only show something, so that words of failure in their output mean nothing; of a pipe the first counts too."""

    def starts(c: Column) -> Column:
        out = F.lit(False)
        for p in READ_ONLY:
            out = out | c.startswith(p) | (c == p.strip())
        return out

    low = F.lower(F.trim(command))
    return starts(low) | low.rlike(READ_ONLY_FORMS) | (low.contains("|") & starts(F.trim(F.element_at(F.split(low, r"\|"), 1))))


def benign_failure(command: Column) -> Column:
    """Commands whose exit code tells no failure, such as a search without a match."""
    return F.regexp_replace(F.trim(command), r"(?i)^rtk\s+", "").rlike(BENIGN_FORMS)


def constant_name(text: Column, limit: int = 48) -> Column:
    """camelCase or free text as UPPER_SNAKE, cut to ``limit``."""
    split = F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")
    return F.upper(F.regexp_replace(split, "^_+|_+$", "")).substr(1, limit)


def path_scope(path: Column) -> Column:
    """Normalised: back slashes turned, ``./`` and repeated slashes dropped, no trailing slash."""
    slashed = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), r"/+", "/")
    return F.regexp_replace(F.regexp_replace(slashed, r"^\./", ""), r"(.)/$", "$1")


def path_query(path: Column, query: str) -> Column:
    """A query that starts with a dot is a suffix, any other a part of the path."""
    return F.lower(path).endswith(query.lower()) if query.startswith(".") else F.lower(path).contains(query.lower())
