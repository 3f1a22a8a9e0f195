"""Statement streams, state classes and property-test candidates: one parse gives flat rows, detectors are queries on them."""

from __future__ import annotations

import ast
import builtins
import hashlib
from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.operators.parse import parsed, walked
from guardlake.storage import saved

FLOW = "path string, kind string, scope string, scope_at long, at long, line long, end_line long, hash string, flag string, params long, branches long, transforms long"
#: Marks of a graph source.
GRAPH_MARKS = ("from langgraph", "import langgraph", "StateGraph")
#: Lines that change a state in place.
MUTATIONS = (
    r"\bstate\s*\[.+\]\s*=", r"\bstate\s*\[.+\]\.append\b", r"\bstate\s*\[.+\]\.extend\b", r"\bstate\s*\[.+\]\.update\b",
    r"\bstate\.update\s*\(", r"\bstate\s*\[.+\]\.pop\b", r"\bstate\s*\[.+\]\.clear\b", r"\bstate\s*\[.+\]\s*\+=",
)
#: Names that suggest a property, transforming calls, and the properties that names suggest.
PROPERTY_NAMES = ("bound", "coerce", "dedupe", "extract", "filter", "format", "merge", "normalize", "parse", "rank", "score", "serialize", "sort", "validate")
TRANSFORM_CALLS = ("append", "extend", "update", "get", "split", "join", "strip", "replace", "lower", "upper", "sort", "sorted")
PROPERTIES = (
    (("parse", "serialize", "deserialize", "encode", "decode"), "round-trip / malformed-input contracts"),
    (("normalize", "canonical", "clean", "coerce"), "idempotence / canonicalization"),
    (("sort", "rank", "score", "order"), "ordering / monotonicity"),
    (("dedupe", "unique", "merge", "filter"), "dedup/filter/merge invariants"),
    (("bound", "limit", "clamp", "range", "validate"), "bounds / invalid-input rejection"),
)
LITERAL_CALLS = ("chr", "frozenset", "Path")

_BRANCHES = frozenset((ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.BoolOp, ast.Compare, ast.Match))
_TRANSFORMS = frozenset((ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Subscript))
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_IGNORED = {"decorator_list", "returns", "annotation", "ctx", "type_comment", "kind"}
_NUMBERED = (ast.arg, *_FUNCTIONS)
_BUILT_IN = frozenset((*dir(builtins), *dir(type(builtins))))
#: Fields that count to a structure, by kind of node, last first.
_SHAPED = {
    c: tuple(f for f in reversed(c._fields) if f not in _IGNORED and not (c in _NUMBERED and f in ("arg", "name"))) for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)
}


def shape(statement: ast.stmt) -> str:
    """Hash of a statement's structure: names by the order of their first appearance, constants by type.

    Called names, built-in names, attributes and keywords stay; annotations and decorators do not count.
    """
    kept = {x.func for x in walked(statement) if x.__class__ is ast.Call}
    numbers: dict[str, int] = {}
    parts, todo = [], [statement]
    while todo:
        item = todo.pop()
        kind = item.__class__
        if kind not in _SHAPED:
            parts.append(repr(item))
            continue
        label = kind.__name__
        if kind is ast.Constant:
            parts.append(repr(f"{label} {type(item.value).__name__}"))
            continue
        if kind is ast.Name:
            parts.append(repr(f"{label} {numbers.setdefault(item.id, len(numbers)) if item not in kept and item.id not in _BUILT_IN else item.id}"))
            continue
        if kind in _NUMBERED:
            name = item.arg if kind is ast.arg else item.name
            label = f"{label} {numbers.setdefault(name, len(numbers))}"
        parts.append(repr(label))
        for field in _SHAPED[kind]:
            value = getattr(item, field)
            todo += [*reversed(value), f"{field} {len(value)}"] if value.__class__ is list else [value, field]
    return hashlib.sha256("".join(f"{p}\0" for p in parts).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def _constant_name(name: str) -> bool:
    return name.isupper() or name.lstrip("_").isupper()


def _literal(node: ast.AST | None) -> bool:
    """Whether a value is data alone, walked without recursion."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, (ast.Tuple, ast.List, ast.Set)):
            todo += x.elts
        elif isinstance(x, ast.Dict):
            todo += [*x.keys, *x.values]
        elif isinstance(x, ast.UnaryOp):
            todo.append(x.operand)
        elif isinstance(x, ast.Call) and getattr(x.func, "id", getattr(x.func, "attr", "")) in LITERAL_CALLS:
            todo += [*x.args, *(k.value for k in x.keywords)]
        elif not (x is None or isinstance(x, ast.Constant) or isinstance(x, ast.Name) and _constant_name(x.id)):
            return False
    return True


def _flag(s: ast.stmt) -> str:
    """What a statement is to a block: an import, a constant, a module's logger, or code."""
    if isinstance(s, (ast.Import, ast.ImportFrom)):
        return "import"
    targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, ast.AnnAssign) else []
    names = [t.id for t in targets if isinstance(t, ast.Name)]
    if not targets or len(names) < len(targets):
        return "code"
    if all(map(_constant_name, names)) and _literal(s.value):
        return "constant"
    called = getattr(getattr(s.value, "func", None), "attr", getattr(getattr(s.value, "func", None), "id", ""))
    return "logger" if names == ["logger"] and called in ("getLogger", "get_logger") else "code"


def _bare_list(a: ast.expr) -> bool:
    a = a.value if isinstance(a, ast.Subscript) else a
    return isinstance(a, ast.Name) and a.id == "list"


def _typed_dict(base: ast.expr) -> bool:
    base = base.func if isinstance(base, ast.Call) and isinstance(base.func, ast.Name) else base
    return getattr(base, "attr", getattr(base, "id", "")) == "TypedDict"


#: Kinds of rows.
ALL = frozenset(("statement", "state_list", "string", "token", "symbol"))


def flow_of(path: str, text: str, kinds: frozenset[str] = ALL) -> list[tuple]:
    """Rows of one file by ``FLOW``, of ``kinds`` alone; none where it cannot be parsed or is too deep to be walked."""
    try:
        tree = ast.parse(text)
        return _flow(path, tree, kinds)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []


def _flow(path: str, tree: ast.Module, kinds: frozenset[str]) -> list[tuple]:
    out, nodes = [], walked(tree) if kinds - {"symbol"} else []
    scopes = [tree, *(x for x in nodes if isinstance(x, _FUNCTIONS))]
    for number, scope in enumerate(scopes if "statement" in kinds else ()):
        body = scope.body[1:] if ast.get_docstring(scope, clean=False) is not None else scope.body
        lead = 0
        while lead < len(body) and isinstance(body[lead], (ast.Import, ast.ImportFrom)):
            lead += 1
        name = getattr(scope, "name", "<module>")
        out += [(path, "statement", name, number, i, s.lineno, s.end_lineno, shape(s), "lead" if i < lead else _flag(s), 0, 0, 0) for i, s in enumerate(body)]
    for node in nodes:
        if isinstance(node, ast.ClassDef) and "state_list" in kinds and any(map(_typed_dict, node.bases)):
            fields = [x for x in node.body if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and _bare_list(x.annotation)]
            out += [(path, "state_list", node.name, node.lineno, i, x.lineno, x.end_lineno, "", x.target.id, 0, 0, 0) for i, x in enumerate(fields)]
        elif isinstance(node, ast.Constant) and "string" in kinds and isinstance(node.value, str):
            out.append((path, "string", "", 0, 0, node.lineno, node.end_lineno, "", "", 0, 0, 0))
        token = getattr(node, "id", None) or getattr(node, "attr", None) if isinstance(node, (ast.Name, ast.Attribute)) else node.name if isinstance(node, ast.alias) else None
        if token and "token" in kinds:
            out.append((path, "token", "", 0, 0, getattr(node, "lineno", 0), 0, "", token.lower(), 0, 0, 0))
    for node in tree.body if "symbol" in kinds else ():
        if isinstance(node, _FUNCTIONS) and not node.name.startswith("_"):
            args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
            inner = walked(node)
            calls = sum(getattr(x.func, "attr", getattr(x.func, "id", "")).lower() in TRANSFORM_CALLS for x in inner if isinstance(x, ast.Call))
            out.append((path, "symbol", node.name, 0, 0, node.lineno, node.end_lineno, "", "", sum(a.arg not in ("self", "cls") for a in args), sum(x.__class__ in _BRANCHES for x in inner), calls + sum(x.__class__ in _TRANSFORMS for x in inner)))
    return out


def flow_facts(files: DataFrame, path_col: str = "path", text_col: str = "text", kinds: Iterable[str] = ALL) -> DataFrame:
    """``FLOW`` rows of every file, of ``kinds`` alone, written once, as detectors read them several times. Null texts are empty files."""
    return saved(parsed(files, path_col, text_col, partial(flow_of, kinds=frozenset(kinds)), FLOW, copies=True))


def repeated_statement_blocks(facts: DataFrame, size: int = 3, least: int = 2) -> DataFrame:
    """Violations for every run of ``size`` statements of one scope whose structure stands ``least`` times or more.

    Windows that touch a scope's leading imports, hold imports alone, or are a module's constants and logger (one
    constant at least) are left out. Runs are counted before the shuffle; members come back by a join on the block.
    """
    w = Window.partitionBy("path", "scope_at").orderBy("at")
    flags = F.array(*(F.lead("flag", i).over(w) for i in range(size)))
    parts = F.array(*(F.lead("hash", i).over(w) for i in range(size)))
    runs = facts.where("kind = 'statement'").select("path", "scope", "line", flags.alias("flags"), parts.alias("parts"), F.lead("end_line", size - 1).over(w).alias("end_line")).where("end_line is not null")
    plain = lambda names: F.forall("flags", lambda f: f.isin(*names))
    declared = (F.col("scope") == "<module>") & plain(("constant", "logger")) & F.array_contains("flags", "constant")
    blocks = runs.where(~F.array_contains("flags", "lead") & ~plain(("import",)) & ~declared).select("path", "scope", "line", "end_line", F.substring(F.sha2(F.array_join("parts", "|"), 256), 1, 16).alias("block"))
    often = blocks.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("block")
    detail = F.concat(F.lit("lines "), "line", F.lit("-"), "end_line", F.lit(", block hash "), "block")
    return blocks.join(often, "block", "left_semi").select(F.lit("repeated-code-block").alias("rule"), F.col("path").alias("relative_path"), F.col("scope").alias("identifier"), detail.alias("detail"))


def is_graph_source(text: Column, declared: Column | None = None) -> Column:
    """Whether a source builds state graphs, by its own marks or because its project declares the dependency."""
    marked = F.lit(False)
    for mark in GRAPH_MARKS:
        marked = marked | F.coalesce(text.contains(mark), F.lit(False))
    return marked if declared is None else marked | F.coalesce(declared, F.lit(False))


def state_mutations(files: DataFrame, declared: Column | None = None) -> DataFrame:
    """Graph sources that change ``state`` in place: one violation a file, at its first such line. Comments do not count."""
    rows = files.where(is_graph_source(F.col("text"), declared)).select("path", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("at", "raw"))
    hit = rows.where(F.col("raw").rlike("|".join(MUTATIONS)) & ~F.ltrim("raw").startswith("#"))
    per = hit.groupBy("path").agg(F.count("*").alias("n"), F.min(F.struct((F.col("at") + 1).alias("line"), F.substring(F.regexp_replace("raw", r"^\s+|\s+$", ""), 1, 80).alias("code"))).alias("first"))
    return per.select(F.lit("langgraph-state-mutation").alias("rule"), F.col("path").alias("relative_path"), F.concat(F.lit("line-"), "first.line").alias("identifier"), F.concat(F.lit("mutations="), "n", F.lit(" first="), "first.code").alias("detail"))


def state_reducers(facts: DataFrame) -> DataFrame:
    """State classes of graph sources (facts of those alone) with list fields that no reducer gathers, fields in order."""
    per = facts.where("kind = 'state_list'").groupBy("path", "scope", "scope_at").agg(F.array_sort(F.collect_list(F.struct("at", "flag"))).alias("f"))
    fields = F.array_join(F.transform("f", lambda x: F.concat(F.lit("'"), x["flag"], F.lit("'"))), ", ")
    return per.select(F.lit("langgraph-state-reducer").alias("rule"), F.col("path").alias("relative_path"), F.col("scope").alias("identifier"), F.concat(F.lit("fields=["), fields, F.lit("]")).alias("detail"))


def property_tokens(files: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tokens that tests name, and those that property tests name; files are the tests, facts theirs."""
    low = F.lower("text")
    ours = files.where(low.contains("hypothesis") | low.contains("given(") | low.contains("@given")).select("path")
    tokens = facts.where("kind = 'token'").select("path", F.col("flag").alias("token"))
    return tokens.select("token").distinct(), tokens.join(ours, "path", "left_semi").select("token").distinct()


def property_candidates(facts: DataFrame, tokens: DataFrame, property_tokens: DataFrame, module: Column, least: int = 4) -> DataFrame:
    """Public functions that tests name and no property test does, with a score of ``least`` or more and its reasons.

    ``module`` is an expression over ``path``. Names meet tokens by name or by ``module.name``, case folded.
    """
    symbols = facts.where("kind = 'symbol'").withColumn("qualname", F.concat_ws(".", module, "scope"))

    def named(rows: DataFrame, by: DataFrame, how: str) -> DataFrame:
        """Semi or anti join on either key, as two equi-joins."""
        each = rows.select("path", "line", F.explode(F.array(F.lower("scope"), F.lower("qualname"))).alias("token"))
        found = each.join(by, "token", "left_semi").select("path", "line").distinct()
        return rows.join(found, ["path", "line"], how)

    tested = named(named(symbols, tokens, "left_semi"), property_tokens, "left_anti")
    name, whole = F.lower("scope"), F.lower("qualname")
    hits = F.filter(F.array(*map(F.lit, PROPERTY_NAMES)), lambda t: F.contains(name, t))
    params, branches, transforms = F.col("params"), F.col("branches"), F.col("transforms")
    by_name = F.array(*(F.when(F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda t: F.contains(whole, t)), True), F.lit(label)) for words, label in PROPERTIES))
    listed = F.filter(by_name, lambda x: x.isNotNull())
    props = F.when(F.size(listed) > 0, listed).when(transforms >= 3, F.array(F.lit("collection/string transform invariants"))).when(branches >= 4, F.array(F.lit("branch decision-table invariants"))).otherwise(F.array().cast("array<string>"))
    step = lambda n, high: F.when(n >= high, 2).when(n >= (1 if high < 4 else 2), 1).otherwise(0)
    score = F.when(F.size(hits) > 0, 2).otherwise(0) + step(params, 2) + step(branches, 4) + step(transforms, 3)
    why = F.concat_ws(
        "; ",
        F.when(F.size(hits) > 0, F.concat(F.lit("name suggests invariant work ("), F.array_join(F.slice(hits, 1, 3), ", "), F.lit(")"))),
        F.when(params >= 2, F.concat(params, F.lit(" inputs"))).when(params == 1, "input domain"),
        F.when(branches >= 4, F.concat(F.lit("branch/validation paths="), branches)).when(branches >= 2, F.concat(F.lit("branches="), branches)),
        F.when(transforms >= 3, F.concat(F.lit("collection/string transforms="), transforms)).when(transforms > 0, "data transformation"),
        F.when(F.size(props) > 0, F.concat(F.lit("candidate properties="), F.array_join(F.slice(props, 1, 2), "; "))),
    )
    detail = F.concat(F.lit("line "), "line", F.lit(": property_test_score="), score, F.lit("; reasons="), why, F.lit("; no Hypothesis/given test reference"))
    return tested.where(score >= least).select(F.lit("hypothesis-candidate").alias("rule"), F.col("path").alias("relative_path"), F.col("qualname").alias("identifier"), detail.alias("detail"))
