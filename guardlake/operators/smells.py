"""Detectors that read the shape of Python code: wrappers, loggers, imports, test smells, pragmas.

Files are parsed once, in Arrow batches; a row of the result is (rule, relative_path,
identifier, detail). Detectors over lines are plain expressions and parse nothing.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.operators.detect import lines
from guardlake.operators.parse import parsed

#: Aliases that libraries are known by, names that make mocks, assertions by what they prove, pragmas.
ALIASES = {
    "altair": "alt", "geopandas": "gpd", "jax.numpy": "jnp", "matplotlib": "mpl", "matplotlib.pyplot": "plt", "networkx": "nx", "numpy": "np", "pandas": "pd", "plotly.express": "px",
    "polars": "pl", "pyarrow": "pa", "pyspark.sql.functions": "F", "pyspark.sql.types": "T", "pyspark.sql.window": "W", "scipy": "sp", "seaborn": "sns",
    "sqlalchemy": "sa", "statsmodels.api": "sm", "statsmodels.formula.api": "smf", "sympy": "sp", "tensorflow": "tf", "tkinter": "tk", "tkinter.ttk": "ttk", "torch.nn": "nn", "xml.etree.ElementTree": "ET",
}
MOCKS = ("Mock", "MagicMock", "AsyncMock")
CALLED = ("assert_called", "assert_called_once")
CALLED_WITH = ("assert_called_with", "assert_called_once_with", "assert_any_call", "assert_has_calls")
WEAK = ("assertTrue", "assertIsNotNone")
WEAK_NAMES = ("data", "event", "metadata", "payload", "response", "state", "success", "ok", "result")
HELPERS = set(
    "mock patch fixture print len list dict set str int float tuple bool bytes isinstance type getattr setattr hasattr sorted reversed enumerate range zip map filter any all min max sum round repr id vars dir super".split()
)
PRAGMAS = (r"#\s*type:\s*ignore", r"#\s*noqa\b", r"#\s*pyright:\s*ignore", r"#\s*pylint:\s*disable")
OLD_BUILDER = ((r"\.set_entry_point\s*\(", "set_entry_point()", 'add_edge(START, "node")'), (r"\.set_finish_point\s*\(", "set_finish_point()", 'add_edge("node", END)'))
LOOSE, GUARD = 7, 8  # calls of tested code that one test may make; lines within which a real assertion follows a guard
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        head = dotted(node.value)
        return f"{head}.{node.attr}" if head else node.attr
    return ""


def tail(node: ast.AST) -> str:
    return dotted(node.func).rsplit(".", 1)[-1] if isinstance(node, ast.Call) else ""


def _plain_body(node: ast.AST) -> list[ast.stmt]:
    return node.body[1:] if ast.get_docstring(node) is not None else node.body


def wrapper(fn: ast.AST) -> str:
    """What a function does nothing but call, with nothing but its own parameters."""
    body = _plain_body(fn)
    call = body[0].value if len(body) == 1 and isinstance(body[0], (ast.Return, ast.Expr)) else None
    if not isinstance(call, ast.Call) or fn.decorator_list or re.fullmatch("__.*__", fn.name):
        return ""
    own = {a.arg for a in (*fn.args.args, *fn.args.posonlyargs, *fn.args.kwonlyargs)} - {"self", "cls"}
    named = lambda x: isinstance(x, ast.Name) and x.id in own
    args = [a.value if isinstance(a, ast.Starred) else a for a in call.args]
    return dotted(call.func) if all(map(named, args)) and all(k.arg is None or named(k.value) for k in call.keywords) else ""


def _weak(node: ast.AST) -> bool:
    """Assertions that nearly any value passes."""
    if isinstance(node, ast.Call):
        return tail(node) in WEAK
    t = node.test if isinstance(node, ast.Assert) else None
    if isinstance(t, ast.Compare):
        value = getattr(t.comparators[0], "value", ...)
        op = t.ops[0]
        return (isinstance(op, (ast.IsNot, ast.NotEq)) and value is None) or (isinstance(op, ast.Is) and value is True) or (tail(t.left) == "len" and isinstance(op, (ast.Gt, ast.NotEq)) and value == 0)
    return isinstance(t, ast.Name) and t.id.lower() in WEAK_NAMES or tail(t) == "len"


def _called_only(node: ast.AST) -> bool:
    """Assertions that prove no more than a call."""
    t = node.test if isinstance(node, ast.Assert) else None
    return tail(node) in CALLED or isinstance(t, ast.Attribute) and t.attr == "called" or isinstance(t, ast.Compare) and isinstance(t.left, ast.Attribute) and t.left.attr == "call_count"


def _asserts(node: ast.AST) -> bool:
    return any(isinstance(x, ast.Assert) or tail(x).startswith("assert") or tail(x) in ("raises", "warns", "fail") for x in ast.walk(node))


def _decorator(node: ast.AST) -> str:
    return dotted(node.func if isinstance(node, ast.Call) else node)


def _test_smells(fn: ast.AST) -> Iterator[tuple[str, str, str]]:
    nodes = list(ast.walk(fn))
    calls = [x for x in nodes if isinstance(x, ast.Call)]
    tested = [x for x in calls if not tail(x).startswith("assert") and tail(x).lower() not in HELPERS]
    if len(tested) > LOOSE:
        yield "eager-test", fn.name, f"calls={len(tested)}"
    branch = next((x for x in nodes if isinstance(x, (ast.For, ast.While, ast.If)) and _asserts(x)), None)
    if branch is not None:
        yield "conditional-assertion", fn.name, f"line {branch.lineno}"
    proofs = sorted(x.lineno for x in nodes if tail(x) in CALLED_WITH or isinstance(x, ast.Assert) and not _weak(x) and not _called_only(x))
    for x in (x for x in nodes if _weak(x)):
        if not any(x.lineno < at <= x.lineno + GUARD for at in proofs):  # else it guards what follows
            yield "weak-test-assertion", f"{fn.name}:line-{x.lineno}", f"line {x.lineno}"
    mocked = any(tail(x) in MOCKS or tail(x) == "patch" or dotted(x.func) == "monkeypatch.setattr" for x in calls)
    only = sorted(x.lineno for x in nodes if _called_only(x))
    if mocked and only and not proofs:
        yield "mock-theater", fn.name, "call-only mock assertions at lines " + ", ".join(map(str, only))
    if isinstance(fn, ast.AsyncFunctionDef) and not any(re.search(r"\bmark\.(asyncio|anyio|trio)$", _decorator(d)) for d in fn.decorator_list):
        yield "pytest-asyncio-pattern", fn.name, f"missing-asyncio-mark line={fn.lineno}"
    for x in calls:
        if tail(x) == "SimpleNamespace" and len(x.keywords) >= 2:
            yield "schema-bypass-test-data", f"{fn.name}:line-{x.lineno}", f"line {x.lineno}: SimpleNamespace fake model"


def _private(module: str) -> bool:
    return sum(s.startswith("_") and not s.startswith("__") for s in module.split(".")) >= 2


def _imports(node: ast.AST) -> Iterator[tuple[str, str, str]]:
    base = node.module or "" if isinstance(node, ast.ImportFrom) else ""
    for a in node.names:
        full = f"{base}.{a.name}" if base else a.name
        if a.asname not in (None, a.name) and ALIASES.get(full) != a.asname:
            yield "import-alias", a.asname, full
    for module in [base] if base else [a.name for a in node.names]:
        if _private(module):
            yield "private-import-chain", module, f"line={node.lineno}"


def _returns_now(s: ast.stmt) -> bool:
    return isinstance(s, ast.Return) and isinstance(s.value, ast.Call) and re.fullmatch(r"(datetime\.)?datetime\.(now|utcnow)", dotted(s.value.func)) is not None


def smells_of(path: str, text: str, logger: str = "get_logger", disallowed: tuple[str, ...] = ("log", "LOG", "_logger")) -> Iterator[tuple[str, str, str, str]]:
    """(rule, path, identifier, detail) of one file; a file that does not parse has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    name = path.rsplit("/", 1)[-1]
    is_test = name.startswith("test_") or name.endswith("_test.py") or "/tests/" in f"/{path}"
    helps = name == "conftest.py" or {"_fixtures", "support"} & set(path.lower().split("/"))
    inside: dict[ast.AST, str] = {}
    found: list[tuple[str, str, str]] = []
    for node in ast.walk(tree):
        for child in ast.iter_child_nodes(node):
            inside[child] = node.name if isinstance(node, FUNCTIONS) else inside.get(node, "<module>")
        if isinstance(node, FUNCTIONS):
            if callee := wrapper(node):
                found.append(("unnecessary-wrapper", node.name, f"delegates to {callee}"))
            if is_test and not helps and any(_decorator(d) in ("pytest.fixture", "fixture") for d in node.decorator_list):
                found.append(("fixture-outside-conftest", node.name, f"line {node.lineno}"))
            if is_test and node.name.startswith("test_"):
                found += _test_smells(node)
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            found += _imports(node)
        elif isinstance(node, ast.ExceptHandler) and any(map(_returns_now, node.body)):
            found.append(("silent-datetime-fallback", inside.get(node, "<module>"), f"line {node.lineno}"))
        elif isinstance(node, ast.Call) and dotted(node.func) == "logging.getLogger":
            found.append(("direct-get-logger", f"L{node.lineno}", f"use {logger}() instead"))
        elif isinstance(node, ast.Assign) and tail(node.value) in ("getLogger", "get_logger", logger):
            found += [("wrong-logger-name", f"L{node.lineno}", f"'{t.id}' is not 'logger'") for t in node.targets if isinstance(t, ast.Name) and t.id in disallowed]
    for token in tokenize.generate_tokens(io.StringIO(text).readline) if "#" in text else ():
        if token.type == tokenize.COMMENT and any(re.search(p, token.string) for p in PRAGMAS):
            found.append(("type-suppression", f"line-{token.start[0]}", token.line.strip()[:80]))
    yield from ((rule, path, identifier, detail) for rule, identifier, detail in found)


VIOLATIONS = "rule string, relative_path string, identifier string, detail string"


def shape_violations(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Violations of all detectors that need a parse. Null sources are empty files."""

    return parsed(files, path_col, text_col, lambda p, t: smells_of(p or "", t), VIOLATIONS)


def deprecated_patterns(files: DataFrame, patterns: tuple[tuple[str, str], ...], path_col: str = "path", text_col: str = "text") -> DataFrame:
    """The first pattern that each line matches, comments aside."""
    first = F.coalesce(*(F.when(F.col("line").rlike(p), what) for p, what in patterns))
    hit = lines(files, path_col, text_col).where(~F.col("line").startswith("#")).withColumn("detail", first).where("detail is not null")
    return hit.select(F.lit("deprecated-pattern").alias("rule"), F.col(path_col).alias("relative_path"), F.concat(F.lit("L"), (F.col("at") + 1).cast("string")).alias("identifier"), "detail")


def old_builder_calls(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Outdated calls of graph builders, in files that use the library."""
    uses = files.where(F.col(text_col).rlike(r"\b(langgraph|StateGraph)\b"))
    found = F.filter(F.array(*(F.when(F.col(text_col).rlike(p), F.struct(F.lit(old).alias("identifier"), F.lit(f"{old}->{new}").alias("detail"))) for p, old, new in OLD_BUILDER)), lambda x: x.isNotNull())
    return uses.select(F.lit("langgraph-deprecated-api").alias("rule"), F.col(path_col).alias("relative_path"), F.explode(found).alias("f")).select("rule", "relative_path", "f.*")


def repeated_helpers(facts: DataFrame, least_files: int = 3) -> DataFrame:
    """Private helper names that are defined in ``least_files`` files or more."""
    helpers = facts.where((F.col("kind") == "function") & F.col("name").rlike("^_[a-z]")).groupBy("name").agg(F.count_distinct("path").alias("files"), F.min("path").alias("first_path"))
    return helpers.where(F.col("files") >= least_files)
