"""Code detectors over generated and hand-made files; what they must give is written in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.operators import detect as D
from guardlake.operators import smells
from guardlake.operators.parse import dealt
from guardlake.plans import proxies as X
from guardlake.plans.guard_queries import _pick, _values

#: Hand-made files: path, then text.
FILES = (
    ("src/w.py", "def a(x, y):\n    \"\"\"Doc.\"\"\"\n    return b.c(x, y)\n\n\ndef d(x):\n    return e(x + 1)\n"),
    ("src/log.py", "import logging\nlog = logging.getLogger('x')\nlogger = get_logger()\n"),
    ("src/imp.py", "import numpy as np\nimport json as j\nfrom a import b as b\nfrom pkg._x._y import z\nimport os._a.b\n"),
    ("src/now.py", "def when():\n    try:\n        return f()\n    except ValueError:\n        return datetime.now()\n"),
    ("src/prag.py", "x = 1  # type: ignore\ny = '# noqa'\nz = 2  # noqa: E501\n"),
    ("tests/test_a.py", "def test_eager():\n    a1(); a2(); a3(); a4(); a5(); a6(); a7(); a8(); len([])\n    assert x == 1\n"),
    ("tests/test_b.py", "def test_if():\n    for i in y:\n        assert i == 2\n\n\n@pytest.fixture\ndef fix():\n    return 1\n"),
    ("tests/conftest.py", "import pytest\n\n\n@pytest.fixture(scope='session')\ndef fix():\n    return 1\n"),
    ("tests/test_c.py", "def test_weak():\n    r = f()\n    assert r is not None\n\n\ndef test_guard():\n    r = f()\n    assert r is not None\n    assert r.x == 3\n"),
    ("tests/test_d.py", "def test_mock():\n    m = Mock()\n    run(m)\n    m.assert_called_once()\n\n\ndef test_args():\n    m = Mock()\n    run(m)\n    m.assert_called_once_with(1)\n"),
    ("tests/test_e.py", "async def test_plain():\n    assert await f() == 1\n\n\n@pytest.mark.asyncio\nasync def test_marked():\n    assert await f() == 1\n"),
    ("tests/test_f.py", "def test_fake():\n    s = SimpleNamespace(a=1, b=2)\n    assert f(s) == 1\n"),
    ("src/bad.py", "def broken(:\n"),
    ("src/graph.py", "from langgraph.graph import StateGraph\ng.set_entry_point('a')\n# g.set_finish_point('b')\nold_call(1)\n# old_call(2)\nx = os.popen('ls')\n"),
)
#: What the shape detectors find: file, rule, identifier, detail.
SHAPES = (
    (0, "unnecessary-wrapper", "a", "delegates to b.c"),
    (1, "direct-get-logger", "L2", "use get_logger() instead"),
    (1, "wrong-logger-name", "L2", "'log' is not 'logger'"),
    (2, "import-alias", "j", "json"),
    (2, "private-import-chain", "pkg._x._y", "line=4"),
    (3, "silent-datetime-fallback", "when", "line 4"),
    (4, "type-suppression", "line-1", "x = 1  # type: ignore"),
    (4, "type-suppression", "line-3", "z = 2  # noqa: E501"),
    (5, "eager-test", "test_eager", "calls=8"),
    (6, "conditional-assertion", "test_if", "line 2"),
    (6, "fixture-outside-conftest", "fix", "line 7"),
    (8, "weak-test-assertion", "test_weak:line-3", "line 3"),
    (9, "mock-theater", "test_mock", "call-only mock assertions at lines 4"),
    (10, "pytest-asyncio-pattern", "test_plain", "missing-asyncio-mark line=1"),
    (11, "schema-bypass-test-data", "test_fake:line-2", "line 2: SimpleNamespace fake model"),
)
PATTERNS = ((r"\bold_call\(", "old_call is gone"), (r"os\.popen", "use subprocess"))
STALE = ((13, "L4", "old_call is gone"), (13, "L6", "use subprocess"))
BUILDER = ((13, "set_entry_point()", 'set_entry_point()->add_edge(START, "node")'), (13, "set_finish_point()", 'set_finish_point()->add_edge("node", END)'))


def _files(s, d):
    """A hand-made file for every customer, in a folder of its own."""
    c = dealt(X.table(s, d, "customer").select("c_custkey"), "c_custkey")
    n = F.col("c_custkey") % len(FILES)
    return c.select(F.concat(F.lit("r"), F.col("c_custkey").cast("string"), F.lit("/"), _pick(n, [p for p, _ in FILES])).alias("path"), _pick(n, [t for _, t in FILES]).alias("text"))


def _sql(rule: str, columns: str, rows) -> str:
    paths = _values(enumerate(p for p, _ in FILES))
    return (
        f"select {rule} 'r' || c_custkey || '/' || f.path as relative_path, {columns} from customer join {paths} f(n, path) on c_custkey % {len(FILES)} = n join {_values(rows)} x(file, {columns}) on file = n"
    )


#: Files of one folder for the enrichers, and the hints that their violations get: file, rule, identifier, detail, hint.
HINTED = (
    ("t/w.py", "def a(x):\n    return b(x)\n\n\ndef c(x):\n    return d(x)\n\n\na(1)\na(2)\n"),
    ("t/use.py", "c(1)\n"),
    ("t/conftest.py", "@pytest.fixture\ndef one():\n    return 1\n\n\n@fixture()\ndef two():\n    return 2\n"),
    ("t/test_x.py", "@pytest.fixture\ndef mine():\n    return 3\n"),
    ("u/test_y.py", "@pytest.fixture\ndef yours():\n    return 3\n"),
    ("t/many.py", "def f(p, q, r, s, t):\n    if p:\n        pass\n    for x in q:\n        for y in r:\n            if x or y:\n                pass\n    if r: pass\n    if s: pass\n    if t: pass\n    if p: pass\n    if q: pass\n    while p and q and r: pass\n"),
    ("t/quiet.py", "try:\n    load(1)\n    x.parse()\n    load(2)\nexcept ValueError:\n    pass\n"),
)
HINTS = (
    (0, "unnecessary-wrapper", "a", "delegates to b", "called 2 times in this file"),
    (0, "unnecessary-wrapper", "c", "delegates to d", "called in t/use.py"),
    (3, "fixture-outside-conftest", "mine", "line 2", "move to conftest.py: one, two"),
    (4, "fixture-outside-conftest", "yours", "line 2", "make a conftest.py"),
    (5, "too-many-params", "f:1", "5", "group: p, q, r, s, t"),
    (5, "high-complexity", "f:1", "14", "7 if, 3 loops - a table of cases; a function for each loop"),
    (6, "silent-except", "5", "5", "may raise: load, parse"),
)


#: The generated functions of ``corpus_queries``: n loops of two lines, k parameters, some files broken.
GENERATED = "g as (select 'src/m' || p_partkey || '.py' as path, 'fn' || p_partkey as name, p_size + 10 as n, p_size % 7 + 1 as k, p_partkey % 97 = 0 as broken from part)"


def _sources(s, d, kinds=D.ALL):
    from guardlake.plans.corpus_queries import _sources as generated

    return D.source_facts(generated(s, d), kinds=kinds)


QUERIES = {
    "shape_violations": (lambda s, d: smells.shape_violations(_files(s, d)), _sql("", "rule, identifier, detail", SHAPES)),
    "deprecated_patterns": (lambda s, d: smells.deprecated_patterns(_files(s, d), PATTERNS), _sql("'deprecated-pattern' as rule,", "identifier, detail", STALE)),
    "old_builder_calls": (lambda s, d: smells.old_builder_calls(_files(s, d)), _sql("'langgraph-deprecated-api' as rule,", "identifier, detail", BUILDER)),
    "source_facts": (
        lambda s, d: _sources(s, d).groupBy("kind").agg(F.count("*").alias("n"), F.max("lines").alias("lines")),
        f"with {GENERATED} select 'module' as kind, count(*) as n, max(2 * n + 6) as lines from g where not broken union all select 'function', count(*), max(2 * n + 1) from g where not broken "
        "union all select 'import', count(*), 0 from g where not broken union all select 'literal', sum(2 * n)::bigint, 0 from g where not broken union all select 'branches', count(*), max(n) from g where not broken union all select 'param', sum(k)::bigint, max(k - 1) from g where not broken "
        "union all select 'parse_error', count(*), 0 from g where broken having count(*) > 0",
    ),
    "size_violations": (
        lambda s, d: D.size_violations(_sources(s, d, D.SIZES)),
        f"""with {GENERATED} select 'high-complexity' as rule, path as relative_path, name || ':4' as identifier, (n + 1)::varchar as detail from g where not broken and n + 1 > 12
union all select 'long-method', path, name || ':4', (2 * n + 1)::varchar from g where not broken and 2 * n + 1 > 50
union all select 'too-many-params', path, name || ':4', k::varchar from g where not broken and k > 4
union all select 'python-parse-error', path, (2 * n + 6)::varchar, (2 * n + 6)::varchar from g where broken""",
    ),
    "semantic_clones": (
        lambda s, d: D.semantic_clones(_sources(s, d, ["function"])).select("n", "first"),
        f"with {GENERATED} select count(*) as n, min(path || ':' || name) as first from g where not broken group by g.n having count(*) > 1",
    ),
    "repeated_helpers": (
        lambda s, d: smells.repeated_helpers(D.source_facts(_files(s, d).withColumn("text", F.concat(F.lit("def _help"), F.length("path").cast("string"), F.lit("():\n    pass\n"))))),
        f"select '_help' || length(path) as name, count(*) as files, min(path) as first_path from (select 'r' || c_custkey || '/' || f.path as path from customer join {_values(enumerate(p for p, _ in FILES))} f(n, path) on c_custkey % {len(FILES)} = n) group by 1 having count(*) >= 3",
    ),
}
