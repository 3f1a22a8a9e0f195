"""Corpus detectors: duplicates, repeated blocks and literals, untested symbols, similar functions."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.operators.parse import parsed
from guardlake.storage import saved


def duplicate_groups(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Groups of equal texts. Only the hash is shuffled, and it is counted before that."""
    h = F.sha2(F.coalesce(text_col, F.lit("")), 256)
    return files.groupBy(h.alias("hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1").select(F.substring("hash", 1, 16).alias("hash"), "n", "first_id")


def lines(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Trimmed non-empty lines with their place."""
    split = files.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "raw"))
    return split.select(id_col, F.col("at").cast("long").alias("at"), F.trim("raw").alias("line")).where("line <> ''")


def repeated_blocks(files: DataFrame, id_col: str, text_col: str, size: int = 3, least: int = 2) -> DataFrame:
    """Blocks of ``size`` consecutive lines that stand in the corpus ``least`` times or more."""
    w = Window.partitionBy(id_col).orderBy("at")
    parts = [F.col("line"), *(F.lead("line", i).over(w) for i in range(1, size))]
    blocks = lines(files, id_col, text_col).select(id_col, "at", F.when(parts[-1].isNotNull(), F.sha2(F.concat_ws("\n", *parts), 256)).alias("block")).where("block is not null")
    return blocks.groupBy("block").agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("files")).where(F.col("n") >= least)


def repeated_literals(tokens: DataFrame, least_files: int) -> DataFrame:
    """Literals in more than ``least_files`` files, with the smallest of them."""
    return tokens.groupBy("literal").agg(F.count_distinct("path").alias("files"), F.count("*").alias("n"), F.min("path").alias("first_path")).where(F.col("files") > least_files)


def call_sequences(calls: DataFrame, least: int = 3, functions: int = 2) -> DataFrame:
    """Ordered call lists of ``least`` calls or more that several functions share."""
    per = calls.groupBy("fn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), ">").alias("seq"), F.count("*").alias("k")).where(F.col("k") >= least)
    return per.groupBy("seq").agg(F.count("*").alias("functions"), F.min("fn").alias("first_fn")).where(F.col("functions") >= functions)


def untested(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Symbols that no test names, by name or qualified name; case is folded."""
    known = references.select(F.lower("token").alias("token")).distinct()
    by_name = symbols.join(known, F.lower("name") == F.col("token"), "left_anti")
    return by_name.join(known, F.lower("qualname") == F.col("token"), "left_anti")


def unique_callers(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Call sites of symbols whose name is unique in the corpus."""
    single = symbols.groupBy("name").agg(F.count("*").alias("k"), F.min("qualname").alias("qualname")).where("k = 1")
    return single.join(calls.groupBy("name").agg(F.count_distinct("site").alias("callers")), "name").select("name", "qualname", "callers")


def changed_to_tests(changed: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """Tests that name a symbol of a changed file."""
    hit = symbols.join(changed.select("path").distinct(), "path", "left_semi").select(F.lower("name").alias("token")).distinct()
    return references.select("test_path", F.lower("token").alias("token")).join(hit, "token", "left_semi").groupBy("test_path").agg(F.count_distinct("token").alias("symbols"))


def flat_siblings(files: DataFrame, least: int = 3) -> DataFrame:
    """Files of one folder that share a name prefix."""
    folder, name = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_extract("path", r"([^/]*)$", 1)
    parts = files.select(folder.alias("folder"), F.regexp_extract(name, r"^([A-Za-z0-9]+)_", 1).alias("prefix")).where("prefix <> ''")
    return parts.groupBy("folder", "prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# --- Python source facts ---------------------------------------------------------------


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


#: Branches of the complexity count, what nests, and what a branch count tells apart.
_BRANCHES = frozenset((ast.If, ast.For, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.Assert, ast.AsyncFor, ast.match_case))
_NESTS = frozenset((ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith, ast.Match))
_KINDS = {ast.If: 0, ast.For: 1, ast.While: 1, ast.AsyncFor: 1, ast.ExceptHandler: 2, ast.BoolOp: 3, ast.Assert: 4}
_FUNCTIONS = frozenset((ast.FunctionDef, ast.AsyncFunctionDef))
_ENDS = (ast.Return, ast.Raise, ast.Continue, ast.Break)
_BODIES = frozenset(("body", "orelse", "finalbody"))
#: The fields of each kind of node that its structure consists of.
_FIELDS = {c: tuple(f for f in c._fields if f not in ("ctx", "type_comment", "kind")) for c in vars(ast).values() if isinstance(c, type) and issubclass(c, ast.AST)}
#: Nodes of a path down a function; beyond it is a parse error.
DEEP = 1000
#: What the walk puts between nodes.
_BODY, _END, _UP, _CUT, _GUARD = range(5)


def _height(node: ast.AST) -> int:
    level, height = [node], 0
    while level:
        level, height = [c for n in level for c in ast.iter_child_nodes(n)], height + 1
    return height


def _names_any(node: ast.AST) -> bool:
    """Whether an argument, a variable, a result or an import names the type that turns checks off, at any depth."""
    if isinstance(node, ast.ImportFrom):
        return node.module in ("typing", "typing_extensions") and any(a.name == "Any" for a in node.names)
    kept = node.annotation if isinstance(node, (ast.arg, ast.AnnAssign)) else node.returns if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else None
    inner = ast.walk(kept) if kept is not None else ()
    return any(isinstance(x, ast.Name) and x.id == "Any" or isinstance(x, ast.Attribute) and x.attr == "Any" and getattr(x.value, "id", "") == "typing" for x in inner)


#: Kinds of facts.
ALL = frozenset("module function branches param fixture try_call class handler import call literal any dead parse_error".split())


def facts_of(path: str, text: str, kinds: frozenset[str] = ALL) -> list[tuple]:
    """Rows (path, kind, name, line, lines, params, complexity, depth, hash, detail) of one file; one parse error if it cannot
    be parsed, or a function is nested too deeply. Facts of other ``kinds`` are not gathered."""
    try:
        return _facts(path, text, kinds)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(path, "parse_error", "", getattr(e, "lineno", 0) or 0, 0, 0, 0, 0, "", type(e).__name__)] if "parse_error" in kinds else []


@lru_cache(1 << 12)
def _literal(kind: type, value: str) -> tuple[str, str, str]:
    """Text, digest and type of a literal."""
    return value[:200], _digest(value), kind.__name__


def _facts(path: str, text: str, kinds: frozenset[str]) -> list[tuple]:
    """One walk over the tree, without recursion. Counts run on, and a function's are the differences over its nodes.

    ``plain`` has the structure so far, node by node: its class, what it holds beside nodes, and the lengths of its lists, with
    names and constants replaced, so that clones by structure are equal.
    """
    tree = ast.parse(text)
    out = [(path, "module", "", 1, text.count("\n") + 1, 0, 0, 0, "", "")] if "module" in kinds else []
    names_any, calls, literals, dead, branches, hashed = ("any" in kinds), ("call" in kinds), ("literal" in kinds), ("dead" in kinds), ("branches" in kinds), ("function" in kinds)
    plain: list[str] = []
    put, todo, fields_of = plain.append, [tree], _FIELDS
    complexity = level = top = guards = seen = 0
    counts = [0] * 5  # by _KINDS
    open_: list[list] = []
    while todo:
        node = todo.pop()
        kind = node.__class__
        if kind is int:
            if node == _UP:
                level -= 1
            elif node == _BODY:
                open_[-1].append(len(plain))
            elif node == _END:
                fn, before, was, base, first, old, start = open_.pop()
                if seen - first > DEEP and _height(fn) > DEEP:
                    raise RecursionError
                out += _function(path, fn, complexity - before + 1, top - base, plain[start:], [x - y for x, y in zip(counts, was)], kinds) if hashed or branches else ()
                top = max(top, old)
            elif node == _CUT:
                del plain[todo.pop() :]
            else:
                guards += todo.pop()
            continue
        seen += 1
        if kind is ast.Name:
            put("Name")
            continue
        if kind is ast.Constant:
            value = node.value.__class__
            put(value.__name__)
            if literals and (value is str or value is int or value is float):
                name, digest, type_name = _literal(value, repr(node.value))
                out.append((path, "literal", name, node.lineno, 0, 0, 0, 0, digest, type_name))
            continue
        put(kind.__name__)
        if kind in _BRANCHES:
            complexity += 1
        if kind in _KINDS:
            counts[_KINDS[kind]] += 1
            if kind is ast.BoolOp:
                complexity += len(node.values) - 1
        if kind in _NESTS:
            level += 1
            top = max(top, level)
            todo.append(_UP)
        fields = fields_of[kind]
        if kind in _FUNCTIONS:
            open_.append([node, complexity, counts[:], level, seen, top])
            top = level
            documented = bool(ast.get_docstring(node))
            todo += [_END, *reversed(node.body[1:] if documented else node.body), _BODY, *(node.body[:1] if documented else ())]
            put(str(len(node.body)))
            fields = tuple(f for f in fields if f != "body")
            if dead:
                _dead(path, node.body, out)
        if kind in _OTHERS:
            if names_any and not guards and _names_any(node):
                out.append((path, "any", "", node.lineno, 0, 0, 0, 0, "", ""))
            if kind is ast.arg:  # what it is called and annotated does not count
                if node.annotation is not None:
                    todo += [len(plain), _CUT, node.annotation]
                continue
            _others(path, node, out, kinds)
        elif kind is ast.Call:
            if calls:
                f = node.func
                out.append((path, "call", f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", ""), node.lineno, 0, len(node.args), 0, 0, "", ""))
        guarded = kind is ast.If and getattr(node.test, "attr", getattr(node.test, "id", "")) == "TYPE_CHECKING"
        for f in fields:
            value = getattr(node, f)
            if value.__class__ is list:
                put(str(len(value)))
                if guarded and f == "body":
                    todo += [-1, _GUARD, *reversed(value), 1, _GUARD]
                else:
                    todo += reversed([x for x in value if isinstance(x, ast.AST)])
                    if value and not isinstance(value[-1], ast.AST):
                        put(repr(value))
                if dead and f in _BODIES and len(value) > 1:
                    _dead(path, value, out)
            elif value.__class__ not in fields_of:
                put(repr(value))
            elif fields_of[value.__class__]:
                todo.append(value)
            else:
                put(value.__class__.__name__)
    return out


_OTHERS = frozenset((ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Try, ast.ExceptHandler, ast.Import, ast.ImportFrom, ast.arg, ast.AnnAssign))


def _dead(path: str, body: list[ast.stmt], out: list[tuple]) -> None:
    for a, b in zip(body, body[1:]):
        if isinstance(a, _ENDS):
            out.append((path, "dead", "", b.lineno, 0, 0, 0, 0, "", ""))
            break


def _function(path: str, node: ast.AST, complexity: int, depth: int, plain: list[str], counts: list[int], wanted: frozenset[str]) -> Iterator[tuple]:
    """Facts of a function and its branches."""
    if "function" in wanted:
        body = node.body[1:] if ast.get_docstring(node) else node.body
        size = (body[-1].end_lineno - body[0].lineno + 1) if body else 0
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        params = len([a for a in args if a.arg not in ("self", "cls")])
        yield (path, "function", node.name, node.lineno, size, params, complexity, depth, _digest(" ".join(plain)), f"asserts={counts[4]}")
    if "branches" in wanted and any(counts[:4]):
        yield (path, "branches", node.name, node.lineno, *counts[:4], "", "")


def _others(path: str, node: ast.AST, out: list[tuple], wanted: frozenset[str]) -> None:
    """Facts of definitions, try statements, handlers and imports."""
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        if "param" in wanted:
            args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
            out += [(path, "param", a.arg, node.lineno, i, 0, 0, 0, "", node.name) for i, a in enumerate(args) if a.arg not in ("self", "cls")]
        if "fixture" in wanted and any(re.fullmatch(r"(pytest\.)?fixture", ast.unparse(d.func if isinstance(d, ast.Call) else d)) for d in node.decorator_list):
            out.append((path, "fixture", node.name, node.lineno, 0, 0, 0, 0, "", ""))
    elif isinstance(node, ast.Try) and "try_call" in wanted:
        parts = [*node.body, *node.handlers]
        called = dict.fromkeys(getattr(x.func, "attr", getattr(x.func, "id", "")) for s in parts for x in ast.walk(s) if isinstance(x, ast.Call))
        out += [(path, "try_call", c, node.lineno, i, 0, 0, 0, "", "") for i, c in enumerate(called) if c]
    elif isinstance(node, ast.ClassDef) and "class" in wanted:
        methods = sum(isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) for x in node.body)
        out.append((path, "class", node.name, node.lineno, node.end_lineno - node.lineno + 1, methods, 0, 0, "", ""))
    elif isinstance(node, ast.ExceptHandler) and "handler" in wanted:
        broad = node.type is None or isinstance(node.type, ast.Name) and node.type.id in ("Exception", "BaseException")
        silent = all(isinstance(x, (ast.Pass, ast.Continue)) or isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) for x in node.body)
        if broad or silent:
            out.append((path, "handler", "", node.lineno, 0, 0, 0, 0, "", ("broad" if broad else "") + (" silent" if silent else "")))
    elif isinstance(node, (ast.Import, ast.ImportFrom)) and "import" in wanted:
        base = "." * getattr(node, "level", 0) + (getattr(node, "module", None) or "") if isinstance(node, ast.ImportFrom) else ""
        out += [(path, "import", a.name, node.lineno, 0, len(node.names), 0, 0, "", base) for a in node.names]


FACTS = "path string, kind string, name string, line long, lines long, params long, complexity long, depth long, hash string, detail string"


def source_facts(files: DataFrame, path_col: str = "path", text_col: str = "text", kinds: Iterable[str] = ALL) -> DataFrame:
    """One parse of every file to flat facts of ``kinds``; detectors are queries on them. Null sources are empty files."""
    return parsed(files, path_col, text_col, partial(facts_of, kinds=frozenset(kinds)), FACTS, copies=True)


#: Limits of the size detectors.
LIMITS = {"complexity": 12, "lines": 50, "params": 4, "depth": 4, "module": 600, "module_soft": 350, "methods": 10, "class_lines": 400, "fanout": 5}


#: Kinds of facts that size violations come from.
SIZES = ("function", "class", "module", "parse_error", "handler", "any", "dead", "import")


def size_violations(facts: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Violations (rule, relative_path, identifier, detail) of the threshold detectors, in one pass over the facts."""
    fn, cls, mod = (F.col("kind") == k for k in ("function", "class", "module"))
    tests = [
        ("high-complexity", fn & (F.col("complexity") > limits["complexity"]), "complexity"), ("long-method", fn & (F.col("lines") > limits["lines"]), "lines"),
        ("too-many-params", fn & (F.col("params") > limits["params"]), "params"), ("deep-nesting", fn & (F.col("depth") > limits["depth"]), "depth"),
        ("god-class", cls & ((F.col("params") > limits["methods"]) | (F.col("lines") > limits["class_lines"])), "params"), ("oversized-module", mod & (F.col("lines") > limits["module"]), "lines"),
        ("oversized-module-soft", mod & (F.col("lines") > limits["module_soft"]) & (F.col("lines") <= limits["module"]), "lines"), ("python-parse-error", F.col("kind") == "parse_error", "line"),
        ("broad-except-swallow", (F.col("kind") == "handler") & F.col("detail").contains("broad") & F.col("detail").contains("silent"), "line"), ("silent-except", (F.col("kind") == "handler") & F.col("detail").contains("silent"), "line"),
        ("banned-any", F.col("kind") == "any", "line"), ("dead-code", F.col("kind") == "dead", "line"), ("import-fanout", (F.col("kind") == "import") & (F.col("params") > limits["fanout"]), "params"),
        ("assertion-free-test", fn & F.col("name").startswith("test_") & (F.col("detail") == "asserts=0"), "line"), ("long-test", fn & F.col("name").startswith("test_") & (F.col("lines") > 35), "lines"),
    ]
    found = F.filter(F.array(*(F.when(c, F.struct(F.lit(r).alias("rule"), F.col(v).cast("string").alias("detail"))) for r, c, v in tests)), lambda x: x.isNotNull())
    return facts.select("path", "name", "line", F.explode(found).alias("v")).select(F.col("v.rule").alias("rule"), F.col("path").alias("relative_path"), F.concat_ws(":", F.when(F.col("name") != "", F.col("name")), F.col("line").cast("string")).alias("identifier"), F.col("v.detail").alias("detail"))


def semantic_clones(facts: DataFrame, least_lines: int = 5) -> DataFrame:
    """Functions of equal structure, names and constants aside."""
    f = facts.where((F.col("kind") == "function") & (F.col("lines") >= least_lines))
    return f.groupBy("hash").agg(F.count("*").alias("n"), F.min(F.concat_ws(":", "path", "name")).alias("first")).where("n > 1")


def similar_texts(rows: DataFrame, id_col: str, text_col: str, least: float = 0.8, shingle: int = 5) -> DataFrame:
    """``(a, b, ratio)``: pairs of different texts whose word shingles overlap by ``least`` or more (Jaccard).

    Exact: of two such sets, ordered from rare to frequent in the corpus, the first
    ``size - ceil(least * size) + 1`` members share one, so pairs meet on those alone and texts
    meet on their rarest shingles. Equal texts collapse to the smallest id; null texts take no part;
    texts of fewer words are one shingle.
    """
    words = F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")
    parts = F.transform(F.sequence(F.lit(1), F.size("w") - shingle + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, shingle), " ")))
    whole = F.array(F.xxhash64(F.array_join("w", " ")))
    texts = rows.where(F.col(text_col).isNotNull()).groupBy(text_col).agg(F.min(id_col).alias("id")).select("id", words.alias("w"))
    sets = saved(texts.select("id", F.when(F.size("w") >= shingle, F.array_distinct(parts)).otherwise(whole).alias("s")).withColumn("n", F.size("s")))
    each = sets.select("id", "n", F.explode("s").alias("x"))
    counts = each.groupBy("x").agg(F.count("*").alias("k"))
    ranked = each.join(counts, "x").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("r"))
    first = F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
    heads = saved(ranked.select("id", "n", F.explode(first).alias("h")).where("h.k > 1").select("id", "n", F.col("h.x").alias("x")))
    other = heads.select(F.col("id").alias("b"), F.col("n").alias("m"), "x")
    near = (F.col("id") < F.col("b")) & (F.least("n", "m") >= least * F.greatest("n", "m"))
    pairs = heads.join(other, "x").where(near).select(F.col("id").alias("a"), "b").distinct()
    of = lambda c: sets.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.select("a", "b", (shared / (F.size("s_a") + F.size("s_b") - shared)).alias("ratio")).where(F.col("ratio") >= least)
