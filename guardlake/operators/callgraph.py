"""Call graph of source files: facts of definitions, imports and calls, resolved by joins.

One parse of a file gives flat facts. Names are resolved over imports and scopes by equi-joins,
callers and boundaries are aggregations, and what a function reaches is a closure by rounds of joins.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.operators.parse import parsed, walked
from guardlake.storage import drop_saved, saved

#: What logs, what makes a boundary of events or packages.
LOG_METHODS = ("bind", "critical", "debug", "error", "exception", "info", "log", "notice", "warning", "warn")
LOG_NAMES = ("audit", "audit_logger", "event_logger", "logger", "log", "metrics", "observability", "telemetry", "tracer")
EVENT_FOLDERS = ("consumers", "events", "handlers", "listeners", "publishers", "subscribers")
PACKAGE_FOLDERS = ("adapters", "api", "boundaries", "boundary", "clients", "gateways", "integrations", "ports", "repositories", "transport", "transports")
EVENT_CALLS = (
    "broadcast", "consume", "dispatch", "emit", "enqueue_event", "fire_event", "handle_event", "notify", "publish", "publish_event", "record_event",
    "send_event", "subscribe", "trigger_event",
)
EVENT_WORDS = ("consume", "dispatch", "emit", "event", "handle", "notify", "publish", "subscribe")
HTTP_METHODS = ("delete", "execute", "get", "patch", "post", "put", "request", "send")
PACKAGE_CLASSES = ("Adapter", "Api", "API", "Client", "Gateway", "Integration", "Port", "Repository", "Transport")
PACKAGE_NAMES = ("api", "client", "gateway", "http", "repository", "session", "transport")
#: What makes a seam, and what makes a helper; calls that transform; marks of integration tests.
SEAMS = (
    "adapter", "api", "client", "command", "controller", "deserialize", "enrich", "error", "event", "graph", "handler", "orchestrat", "parse", "persist",
    "pipeline", "planner", "projection", "render", "repository", "route", "router", "screen", "seam", "serialize", "service", "sse", "store", "stream",
    "sync", "workflow",
)
HELPER_PREFIXES = ("as_", "get_", "is_", "to_")
HELPER_NAMES = ("color", "colors", "icon", "icons", "label", "labels", "markup", "style", "styles", "title")
HELPER_MODULES = (".colors", ".constants", ".icons", ".labels", ".markup", ".styles", ".theme", ".themes", ".types", ".typing", ".utils")
TRANSFORMS = ("append", "extend", "update", "get", "split", "join", "strip", "replace", "lower", "upper", "sort", "sorted")
INTEGRATION = ("integration", "e2e", "end_to_end", "pipeline")
SEAM_BONUS, SEAM_LEAST = 6, 8
#: Kinds: def, call, import, token; scope is the function or class and function around, without those inside it.
FACTS = "path string, module string, kind string, scope string, name string, line long, chain array<string>, target string, params long, branches long, transforms long"
_BRANCHES = frozenset((ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.BoolOp, ast.Compare, ast.Match))
_SHAPES = frozenset((ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp, ast.Subscript))
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def module_name(path: str) -> str:
    """Dotted name of a file; a leading ``src`` and a closing ``__init__`` go."""
    parts = [p for p in path.removesuffix(".py").split("/") if p]
    parts = parts[1:] if parts[:1] == ["src"] else parts
    return ".".join(parts[:-1] if parts[-1:] == ["__init__"] else parts)


def chain_of(node: ast.AST) -> list[str]:
    """``a.b().c`` as a, b, c; what is neither a name, an attribute nor a call ends it."""
    out = []
    while isinstance(node, (ast.Attribute, ast.Call)):
        if isinstance(node, ast.Attribute):
            out.append(node.attr)
        node = node.func if isinstance(node, ast.Call) else node.value
    return [*([node.id] if isinstance(node, ast.Name) else []), *reversed(out)]


def facts_of(path: str, text: str) -> list[tuple]:
    """Facts of one file; a file that cannot be parsed has none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    module, out = module_name(path), []
    package = module if path.endswith("__init__.py") else module.rpartition(".")[0]

    def row(kind, scope="", name="", line=0, chain=(), target="", params=0, branches=0, transforms=0):
        out.append((path, module, kind, scope, name, line, chain, target, params, branches, transforms))

    def call(x: ast.Call, scope: str, owner: str) -> None:
        chain = chains[x]
        row("call", scope, chain[-1] if chain else "", x.lineno, chain, owner, int(isinstance(x.func, ast.Name)))

    def definitions(body: list[ast.stmt], owner: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                definitions(node.body, node.name)
                if not owner:
                    row("class", "", node.name, node.lineno)
            elif isinstance(node, _DEFS):
                scope, inner = f"{owner}.{node.name}" if owner else node.name, walked(node)
                calls = [x for x in inner if x.__class__ is ast.Call]
                chains.update((x, tuple(chain_of(x.func))) for x in calls)
                args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
                row(
                    "def", scope, node.name, node.lineno, (), owner, sum(a.arg not in ("self", "cls") for a in args), sum(x.__class__ in _BRANCHES for x in inner),
                    sum(x.__class__ in _SHAPES for x in inner) + sum(chains[x][-1].lower() in TRANSFORMS for x in calls if chains[x]),
                )
                for x in calls:
                    call(x, scope, owner)
                if node.name.startswith("test"):
                    for x in inner:
                        if isinstance(x, (ast.Name, ast.Attribute)):
                            row("token", scope, (x.id if isinstance(x, ast.Name) else x.attr).lower())

    chains: dict[ast.Call, tuple[str, ...]] = {}  # of the calls within definitions, then of all
    definitions(tree.body, "")
    for x in walked(tree):
        if x.__class__ is ast.Call:
            if x not in chains:
                chains[x] = tuple(chain_of(x.func))
                call(x, "", "")
        elif x.__class__ is ast.Import:
            for a in x.names:  # "import a.b" binds a
                row("import", "", a.asname or a.name.split(".")[0], x.lineno, (), a.name if a.asname else a.name.split(".")[0])
        elif x.__class__ is ast.ImportFrom:
            up = package.split(".")[: len(package.split(".")) - x.level + 1] if x.level else []
            base = ".".join(p for p in (*up, x.module or "") if p)
            for a in x.names:
                row("import", "", a.asname or a.name, x.lineno, (), f"{base}.{a.name}" if base else a.name)
    return list(dict.fromkeys(out))


def call_facts(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Facts of all files, one parse each: they are written once, as every query on them reads them several times. Null texts
    are empty files, files without a path have no facts."""
    return saved(parsed(files.where(F.col(path_col).isNotNull()), path_col, text_col, facts_of, FACTS))


def is_test(path: Column) -> Column:
    low = F.lower(F.translate(path, "\\", "/"))
    name = F.element_at(F.split(low, "/"), -1)
    return low.startswith("tests/") | low.contains("/tests/") | name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")


def _kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


def call_edges(facts: DataFrame) -> DataFrame:
    """``(caller, callee)``: dotted names of functions of the corpus, each edge once.

    A call resolves, in this order, to a method of its own class by ``self`` or ``cls``, a name imported in its file with what
    follows it, or a function of its file. Names bound otherwise resolve to nothing.
    """
    defs = _kind(facts, "def").select(F.concat_ws(".", "module", "scope").alias("callee")).distinct()
    calls = _kind(facts, "call").where((F.col("scope") != "") & (F.size("chain") > 0))
    calls = calls.select("path", "module", F.concat_ws(".", "module", "scope").alias("caller"), F.col("target").alias("owner"), F.col("chain")[0].alias("first"), F.array_join(F.slice("chain", 2, 100), ".").alias("rest"))
    imports = _kind(facts, "import").select("path", F.col("name").alias("first"), F.col("target").alias("bound"))
    rest = F.when(F.col("rest") != "", F.col("rest"))
    own = F.when(F.col("first").isin("self", "cls") & (F.col("owner") != ""), F.concat_ws(".", "module", "owner", rest))
    named = F.coalesce(own, F.when(F.col("bound").isNotNull(), F.concat_ws(".", "bound", rest)), F.concat_ws(".", "module", "first", rest))
    asked = calls.join(imports, ["path", "first"], "left").select("caller", named.alias("callee")).distinct()
    return asked.join(defs, "callee", "left_semi").select("caller", "callee")


def reaching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(name, steps)``: functions from which calls lead to one of ``seeds(name)``, and over how many at least; seeds have 0."""
    edges = saved(edges.select("caller", "callee"))
    found = [saved(seeds.select("name").distinct().withColumn("steps", F.lit(0).cast("long")))]
    while found[-1].take(1):
        known = reduce(DataFrame.union, found)
        step = edges.join(found[-1].select(F.col("name").alias("callee")), "callee").select(F.col("caller").alias("name")).distinct()
        found.append(saved(step.join(known, "name", "left_anti").withColumn("steps", F.lit(len(found)).cast("long"))))
    drop_saved(edges)
    return reduce(DataFrame.union, found)


def _logs() -> Column:
    """Whether a call fact writes a log or a metric."""
    base = F.transform(F.slice("chain", 1, F.greatest(F.size("chain") - 1, F.lit(0))), lambda p: F.ltrim(F.lower(p), F.lit("_")))
    prefixed = F.col("name").startswith("log_") | F.col("name").startswith("record_metric")
    return prefixed | ((F.col("params") == 0) & F.col("name").isin(*LOG_METHODS) & F.arrays_overlap(base, F.array(*map(F.lit, LOG_NAMES))))


def boundaries(facts: DataFrame) -> DataFrame:
    """``(path, function, line, boundary, logged, steps_to_log)`` of functions and methods at event and package boundaries.

    ``steps_to_log`` tells over how many calls it reaches a function that logs, null if over none. Test files and methods with
    double underscores are left out.
    """
    call = _kind(facts, "call").where("scope <> ''")
    parts = F.transform("chain", lambda p: F.ltrim(F.lower(p), F.lit("_")))
    http = F.lower("name").isin(*HTTP_METHODS) & F.arrays_overlap(parts, F.array(*map(F.lit, PACKAGE_NAMES)))
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    does = call.groupBy("path", "scope").agg(any_(_logs()).alias("logged"), any_(F.lower("name").isin(*EVENT_CALLS)).alias("fires"), any_(http).alias("talks"))
    functions = _kind(facts, "def").where(~is_test(F.col("path")) & ~F.col("name").rlike("^__.*__$"))
    joined = functions.join(does, ["path", "scope"], "left")
    folders = F.split(F.lower(F.translate("path", "\\", "/")), "/")
    has = lambda array, values: F.arrays_overlap(array, F.array(*map(F.lit, values)))
    event = has(folders, EVENT_FOLDERS) | has(F.split(F.lower("name"), "_"), EVENT_WORDS) | F.lower("name").startswith("on_") | F.coalesce("fires", F.lit(False))
    package = has(folders, PACKAGE_FOLDERS) | F.col("target").rlike("(" + "|".join(PACKAGE_CLASSES) + ")$") | F.coalesce("talks", F.lit(False))
    kind = F.when(event, "event boundary").when(package, "package boundary")
    name = F.concat_ws(".", "module", "scope").alias("name")
    seeds = call.where(_logs()).select(name).distinct()
    far = reaching(call_edges(facts), seeds).withColumnRenamed("steps", "steps_to_log")
    out = joined.withColumn("boundary", kind).where("boundary is not null").withColumn("name", name).join(far, "name", "left")
    return out.select("path", F.col("scope").alias("function"), "line", "boundary", F.coalesce("logged", F.lit(False)).alias("logged"), "steps_to_log")


def boundary_findings(facts: DataFrame) -> DataFrame:
    """PY-LOG-002: one finding a file for its boundaries without a log call, ``(path, n, functions, kinds)`` in order of lines."""
    silent = boundaries(facts).where("not logged")
    rows = F.array_sort(F.collect_list(F.struct("line", "function", "boundary")))
    names = lambda field: F.array_join(F.transform("rows", lambda r: r[field]), ", ")
    grouped = silent.groupBy("path").agg(F.count("*").alias("n"), rows.alias("rows"))
    return grouped.select(F.lit("PY-LOG-002").alias("rule_id"), "path", "n", names("function").alias("functions"), names("boundary").alias("kinds"))


def integration_seams(facts: DataFrame) -> DataFrame:
    """``(rule, relative_path, identifier, callers, seam_score, reasons)``: public functions of which the name is unique, called
    from two places or more, with a seam's role, that no integration test names, scoring 8 or more."""
    code = facts.where(~is_test(F.col("path")))
    top = code.where(F.col("kind").isin("def", "class") & (F.coalesce("target", F.lit("")) == "") & ~F.col("name").startswith("_"))
    single = top.groupBy("name").agg(F.count("*").alias("k")).where("k = 1").select("name")
    sites = _kind(code, "call").select("name", "path", "line").distinct().groupBy("name").agg(F.count("*").alias("callers")).where("callers >= 2")
    marks = facts.where(is_test(F.col("path")) & (F.col("kind") == "token"))
    where = F.lower(F.concat_ws("/", "path", "scope"))  # the file or the test says so
    tested = marks.where(reduce(lambda a, b: a | b, (where.contains(x) for x in INTEGRATION))).select(F.col("name").alias("token")).distinct()
    known = top.where("kind = 'def'").join(single, "name").join(sites, "name")
    known = known.withColumn("token", F.lower("name")).join(tested, "token", "left_anti")
    text = F.lower(F.concat_ws(".", "module", "name"))
    hits = F.filter(F.array(*map(F.lit, sorted(SEAMS))), lambda s: text.contains(s))
    low, module = F.lower("name"), F.concat(F.lit("."), F.lower("module"))
    helper = reduce(lambda a, b: a | b, [low.startswith(p) for p in HELPER_PREFIXES] + [module.contains(m) for m in HELPER_MODULES]) | low.isin(*HELPER_NAMES)
    branch = F.when(F.col("branches") >= 3, F.least("branches", F.lit(4).cast("long"))).otherwise(0)
    transform = F.when(F.col("transforms") >= 2, F.least("transforms", F.lit(4).cast("long"))).otherwise(0)
    score = F.col("callers") + SEAM_BONUS + branch + transform + F.when(F.col("callers") >= 5, 2).otherwise(0)
    say = lambda label, value: F.concat(F.lit(label), value.cast("string"))
    reasons = F.concat_ws(
        "; ", say("callers=", F.col("callers")), say("seam-role=", F.array_join(F.slice("hits", 1, 3), ", ")), F.when(F.col("branches") >= 3, say("branches=", F.col("branches"))),
        F.when(F.col("transforms") >= 2, say("transforms=", F.col("transforms"))), F.when(F.col("callers") >= 5, "high fan-in"),
    )
    out = known.withColumn("hits", hits).where((F.size("hits") > 0) & ~helper)
    return out.select(
        F.lit("missing-integration-test").alias("rule"), F.col("path").alias("relative_path"), F.concat_ws(".", "module", "name").alias("identifier"), "callers",
        score.cast("long").alias("seam_score"), reasons.alias("reasons"),
    ).where(F.col("seam_score") >= SEAM_LEAST)
