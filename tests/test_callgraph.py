"""Call facts of odd files, resolution of names, closures with cycles, deep expressions."""

from guardlake.operators import callgraph as G
from guardlake.operators import detect as D

SCHEMA = "path string, text string"


def edges(spark, *files):
    return {tuple(r) for r in G.call_edges(G.call_facts(spark.createDataFrame(list(files), SCHEMA))).collect()}


def test_names_resolve_over_imports_and_scopes(spark):
    got = edges(
        spark,
        ("src/a/__init__.py", "from .b import f as g\ndef top():\n    return g()\n"),
        ("src/a/b.py", "def f():\n    def inner():\n        return f()\n    return inner()\nclass C:\n    def m(self):\n        return self.n() + C.n(self) + other.f()\n    def n(self): ...\n"),
        ("src/c.py", "import a.b\nimport a.b as ab\nfrom a import b\nfrom ..x import y\ndef h():\n    a.b.f(); ab.f(); b.C.m(None); y(); (lambda: 1)(); z[0].f()\n"),
        ("bad.py", "def f(:"), (None, "def f(): g()"), ("none.py", None), ("deep.py", "x = " + "(" * 300 + ")" * 300),
    )
    assert got == {("a.top", "a.b.f"), ("a.b.f", "a.b.f"), ("a.b.C.m", "a.b.C.n"), ("c.h", "a.b.f"), ("c.h", "a.b.C.m")}


def test_closure_with_cycles(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("e", "f"), ("c", "s")], "caller string, callee string")
    got = {r.name: r.steps for r in G.reaching(calls, spark.createDataFrame([("s",)], "name string")).collect()}
    assert got == {"s": 0, "c": 1, "b": 2, "d": 2, "a": 3}
    assert G.reaching(calls, spark.createDataFrame([], "name string")).count() == 0


def test_logs_by_name_and_by_prefix(spark):
    text = "\n".join(f"def on_{i}(x):\n    {call}\n" for i, call in enumerate(["logger.info(x)", "self._telemetry.bind(a=1)", "log(x)", "log_done(x)", "q.record_metric_x()", "info(x)", "get().logger.warn(x)", "print(x)"]))
    found = G.boundaries(G.call_facts(spark.createDataFrame([("m.py", text), ("tests/m.py", text), ("conftest.py", text)], SCHEMA)))
    assert {r.function: r.logged for r in found.collect()} == dict(zip((f"on_{i}" for i in range(8)), [True, True, False, True, True, False, True, False]))


def test_integration_test_by_its_name(spark):
    code = ("src/flow/store.py", "def save(x):\n    if x and x.a:\n        x.update(x.get(1))\n    return x\n")
    use = ("src/flow/use.py", "def a():\n    save(1)\ndef b():\n    save(2)\n")
    plain = ("tests/test_s.py", "def test_s():\n    save(1)\n")
    named = ("tests/test_s.py", "def test_end_to_end():\n    save(1)\n")
    seams = lambda *files: [r.identifier for r in G.integration_seams(G.call_facts(spark.createDataFrame(list(files), SCHEMA))).collect()]
    assert seams(code, use, plain) == ["flow.store.save"] and seams(code, use, named) == [] and seams(code) == []
    assert seams(code, use, ("src/other.py", "def save(): ...\n")) == []


def test_deep_expressions_are_one_parse_error():
    rows = D.facts_of("a.py", "def f():\n    return " + "+".join(["1"] * 5000))
    assert [r[1] for r in rows] == ["parse_error"]
    literal = [r for r in D.facts_of("b.py", f"a = {'x' * 300!r}\nb = {'x' * 301!r}\n") if r[1] == "literal"]
    assert literal[0][2] == literal[1][2] and literal[0][8] != literal[1][8]
