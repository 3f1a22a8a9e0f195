"""Call graph queries over a small package for every customer; what they must give is written by hand in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.operators import callgraph as G
from guardlake.operators import detect as D
from guardlake.operators import enrichers, smells
from guardlake.operators.parse import dealt
from guardlake.plans import proxies as X
from guardlake.plans.guard_queries import _values
from guardlake.plans.shape_queries import HINTED, HINTS
from guardlake.storage import saved

#: Files of one package; N is the customer's number.
PACKAGE = (
    ("src/pkN/parse.py", "def parse_orderN(text, sep):\n    out = []\n    for part in text.split(sep):\n        if part and part.strip():\n            out.append(part.strip())\n    return out\n"),
    (
        "src/pkN/front.py",
        "from .parse import parse_orderN\nfrom pkN import events as ev\nimport pkN.parse\n\n\nclass OrderNClient:\n    def __init__(self):\n        dispatch(1)\n\n    def send(self, x):\n"
        "        rows = parse_orderN(x, ',')\n        return self.push(rows)\n\n    def push(self, rows):\n        logger.info('push')\n        return ev.emit_rowsN(rows)\n\n\n"
        "def get_rowsN(x):\n    return parse_orderN(x, ';') + pkN.parse.parse_orderN(x, '|')\n\n\ndef fetchN(x):\n    return session.get(x)\n",
    ),
    ("src/pkN/events.py", "def emit_rowsN(rows):\n    return bus.publish(rows)\n\n\ndef on_doneN(x):\n    log_done(x)\n\n\ndef tellN(x):\n    return on_doneN(emit(x))\n"),
    ("src/pkN/broken.py", "def f(:\n"),
    ("tests/test_pkN.py", "from pkN.front import get_rowsN\n\n\ndef test_rows():\n    assert get_rowsN('a')\n\n\ndef test_other():\n    notify(1)\n"),
)
#: A test more for even numbers, which names the seam.
FLOW = ("tests/integration/test_flowN.py", "def test_flow():\n    assert parse_orderN('a', 'b') == []\n")
EDGES = (
    ("pkN.front.OrderNClient.send", "pkN.parse.parse_orderN"), ("pkN.front.OrderNClient.send", "pkN.front.OrderNClient.push"),
    ("pkN.front.OrderNClient.push", "pkN.events.emit_rowsN"), ("pkN.front.get_rowsN", "pkN.parse.parse_orderN"), ("pkN.events.tellN", "pkN.events.on_doneN"),
    ("tests.test_pkN.test_rows", "pkN.front.get_rowsN"),
)
BOUNDARIES = (
    ("src/pkN/front.py", "OrderNClient.send", 10, "package boundary", False, 1), ("src/pkN/front.py", "OrderNClient.push", 14, "package boundary", True, 0),
    ("src/pkN/front.py", "fetchN", 23, "package boundary", False, None), ("src/pkN/events.py", "emit_rowsN", 1, "event boundary", False, None),
    ("src/pkN/events.py", "on_doneN", 5, "event boundary", True, 0), ("src/pkN/events.py", "tellN", 9, "event boundary", False, 1),
)
GROUPED = (
    ("src/pkN/front.py", 2, "OrderNClient.send, fetchN", "package boundary, package boundary"), ("src/pkN/events.py", 2, "emit_rowsN, tellN", "event boundary, event boundary"),
)


def _customers(s, d):
    return dealt(X.table(s, d, "customer").select("c_custkey"), "c_custkey")


def _files(s, d):
    k = F.col("c_custkey").cast("string")
    file = lambda f: F.struct(F.replace(F.lit(f[0]), F.lit("N"), k).alias("path"), F.replace(F.lit(f[1]), F.lit("N"), k).alias("text"))
    flow = F.when(F.col("c_custkey") % 2 == 0, F.array(file(FLOW))).otherwise(F.array().cast("array<struct<path:string,text:string>>"))
    each = F.explode(F.concat(F.array(*(file(f) for f in PACKAGE)), flow)).alias("f")
    return _customers(s, d).select(each).select("f.*")


def _facts(s, d):
    return G.call_facts(_files(s, d))


def _expected(columns: str, rows, where: str = "") -> str:
    """Rows for every customer with its number for N."""
    texts = [c for c, v in zip(columns.split(", "), rows[0]) if isinstance(v, str)]
    picked = ", ".join(f"replace({c}, 'N', c_custkey::varchar) as {c}" if c in texts else c for c in columns.split(", "))
    return f"select {picked} from customer cross join {_values(rows)} x({columns}) {where}"


def _hinted(s, d):
    """The enrichers' files in a folder for every customer; names are the customer's own."""
    k = F.concat(F.lit("r"), F.col("c_custkey").cast("string"))
    file = lambda f: F.struct(F.concat(k, F.lit("/" + f[0])).alias("path"), F.replace(F.replace(F.lit(f[1]), F.lit("a("), F.concat(F.lit("a"), k, F.lit("("))), F.lit("c("), F.concat(F.lit("c"), k, F.lit("("))).alias("text"))
    files = _customers(s, d).select(F.explode(F.array(*(file(f) for f in HINTED))).alias("f")).select("f.*")
    facts = saved(D.source_facts(files, kinds=D.ALL - {"literal"}))
    return enrichers.enriched(D.size_violations(facts).union(smells.shape_violations(files)), facts)


def _body(n: int, line: str = "    x = 1\n") -> str:
    return line * n


#: Files that trip the limits, and what is found: file, rule, identifier, detail.
SIZED = (
    ("deep.py", "def f():\n    if a:\n        if b:\n            if c:\n                if d:\n                    if e:\n                        pass\n"),
    ("big.py", _body(601, "x = 1\n")),
    ("soft.py", _body(400, "x = 1\n")),
    ("god.py", "class A:\n" + "".join(f"    def m{i}(self): pass\n" for i in range(11))),
    ("broad.py", "try:\n    f()\nexcept Exception:\n    pass\n"),
    ("quiet.py", "for x in y:\n    try:\n        f()\n    except ValueError:\n        continue\n"),
    ("any.py", "x: Any = 1\n"),
    ("dead.py", "def f():\n    return 1\n    x = 2\n"),
    ("fan.py", "from m import a, b, c, d, e, g\n"),
    ("test_a.py", "def test_long():\n" + _body(36)),
    ("broken.py", "x = (\n"),
    ("terms.py", "def f():\n    return " + "+".join(["1"] * 5000) + "\n"),
    ("many.py", "def f(a, b, c, d, e):\n" + _body(51)),
    ("knot.py", "def f():\n" + "".join("    if a: pass\n" for _ in range(12))),
    ("fine.py", "def f(self, a):\n    return a\n"),
)
TRIPPED = (
    (0, "deep-nesting", "f:1", "5"), (1, "oversized-module", "1", "602"), (2, "oversized-module-soft", "1", "401"), (3, "god-class", "A:1", "11"),
    (4, "broad-except-swallow", "3", "3"), (4, "silent-except", "3", "3"), (5, "silent-except", "4", "4"), (6, "banned-any", "1", "1"), (7, "dead-code", "3", "3"),
    *((8, "import-fanout", f"{n}:1", "6") for n in "abcdeg"), (9, "assertion-free-test", "test_long:1", "1"), (9, "long-test", "test_long:1", "36"),
    (10, "python-parse-error", "1", "1"), (11, "python-parse-error", "0", "0"), (12, "too-many-params", "f:1", "5"), (12, "long-method", "f:1", "51"), (13, "high-complexity", "f:1", "13"),
)


def _sized(s, d):
    """A file for every customer, in a folder of its own."""
    n = (F.col("c_custkey") % len(SIZED)).cast("int")
    pick = lambda i: F.get(F.array(*(F.lit(f[i]) for f in SIZED)), n)
    files = _customers(s, d).select(F.concat_ws("/", F.col("c_custkey").cast("string"), pick(0)).alias("path"), pick(1).alias("text"))
    return D.size_violations(D.source_facts(files, kinds=D.SIZES))


QUERIES = {
    "call_edges": (lambda s, d: G.call_edges(_facts(s, d)), _expected("caller, callee", EDGES)),
    "boundaries": (lambda s, d: G.boundaries(_facts(s, d)), _expected("path, function, line, boundary, logged, steps_to_log", BOUNDARIES)),
    "boundary_logging": (
        lambda s, d: G.boundary_findings(_facts(s, d)), f"select 'PY-LOG-002' as rule_id, * from ({_expected('path, n, functions, kinds', GROUPED)})"
    ),
    "seam_scores": (
        lambda s, d: G.integration_seams(_facts(s, d)),
        _expected(
            "rule, relative_path, identifier, callers, seam_score, reasons",
            [("missing-integration-test", "src/pkN/parse.py", "pkN.parse.parse_orderN", 2, 15, "callers=2; seam-role=parse; branches=3; transforms=4")], "where c_custkey % 2 = 1",
        ),
    ),
    "size_limits": (
        _sized,
        f"select x.rule, c_custkey || '/' || f.path as relative_path, identifier, detail from customer join {_values(enumerate(p for p, _ in SIZED))} f(n, path) on c_custkey % {len(SIZED)} = n "
        f"join {_values(TRIPPED)} x(file, rule, identifier, detail) on file = n",
    ),
    "enriched_violations": (
        _hinted,
        f"""select x.rule, 'r' || c_custkey || '/' || f.path as relative_path, case when x.rule = 'unnecessary-wrapper' then identifier || 'r' || c_custkey else identifier end as identifier, detail,
replace(hint, 'called in t/', 'called in r' || c_custkey || '/t/') as hint from customer cross join {_values(enumerate(p for p, _ in HINTED))} f(n, path) join {_values(HINTS)} x(file, rule, identifier, detail, hint) on file = n""",
    ),
}
