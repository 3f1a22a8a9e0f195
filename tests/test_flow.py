"""Statement runs, state graphs and property candidates on small sources."""

from pyspark.sql import functions as F

from guardlake.operators import detect, flow
from guardlake.operators.more import long_lines

FILES = "path string, text string"


def facts(spark, **files):
    return flow.flow_facts(spark.createDataFrame(list(files.items()), FILES))


def test_shapes():
    shape = lambda s: flow.shape(__import__("ast").parse(s).body[0])
    assert shape("a = b + 1") == shape("x = y + 22") != shape("a = a + 1")
    assert shape("a = f(b)") != shape("a = g(b)")
    assert shape("a.b = 1") != shape("a.c = 1")
    assert shape("x = len") != shape("x = y")
    assert shape("def f(a: int) -> str:\n    return a") == shape("@d\ndef g(b):\n    return b")
    assert shape("f(1, 2)") != shape("f(1, k=2)")
    assert shape("if a:\n    b = 1\nelse:\n    c = 1") != shape("if a:\n    b = 1\n    c = 1")
    assert shape("x = 1") != shape("x = '1'") and shape("x = True") != shape("x = 1")


def test_windows_left_out(spark):
    constants = "A = 1\nB = [2, -3]\nlogger = logging.getLogger(__name__)\nD = frozenset({1})\n"
    late = "f()\nimport a\nimport b\nimport c\n"
    code = "a1 = g()\nb1 = h()\nC = i()\n"
    f = facts(spark, p=constants, q=constants, r=late, s=late, t=code, u="import x\n" + code, v=None, w="")
    got = sorted((r.relative_path, r.detail.split(",")[0]) for r in flow.repeated_statement_blocks(f).collect())
    assert got == [("r", "lines 1-3"), ("s", "lines 1-3"), ("t", "lines 1-3"), ("u", "lines 2-4")]


def test_scopes_do_not_run_together(spark):
    body = "    a()\n    b()\n"
    f = facts(spark, p=f"class X:\n  def f(self):\n{body}\n  def f(self):\n{body}", q=f"def f():\n{body}    c()\n")
    assert flow.repeated_statement_blocks(f).count() == 0
    assert flow.repeated_statement_blocks(f, size=2).count() == 3


def test_deep_and_broken_files_give_no_rows(spark):
    deep = "x = " + "+".join(["1"] * 20000)
    f = facts(spark, a=deep, b="def (", c="x = 1\0", d="y = 1\n")
    assert {r.path for r in f.select("path").collect()} <= {"a", "d"}


def test_mutations_need_a_graph(spark):
    text = "state['a'] = 1\r\n  # state['b'] = 2\n\tstate.update (x)\nmystate['c'] = 1\nif state['a'] == 2: pass\n"
    rows = spark.createDataFrame([("a", "import langgraph\n" + text, False), ("b", text, False), ("c", text, True), ("d", None, True)], FILES + ", known boolean")
    got = {r.relative_path: (r.identifier, r.detail) for r in flow.state_mutations(rows, F.col("known")).collect()}
    assert got == {"a": ("line-2", "mutations=3 first=state['a'] = 1"), "c": ("line-1", "mutations=3 first=state['a'] = 1")}


def test_state_classes(spark):
    text = "class A(typing.TypedDict):\n    b: list[int] = 1\n    a: 'list'\n    c: List[int]\n\n\nclass B(TypedDict('x', {})):\n    z: list\n\n\nclass C(dict):\n    z: list\n"
    got = {r.identifier: r.detail for r in flow.state_reducers(facts(spark, p=text)).collect()}
    assert got == {"A": "fields=['b']", "B": "fields=['z']"}


def test_candidates_meet_tokens_by_either_name(spark):
    source = "def parse(a, b):\n    return a\n\n\ndef Merge(a, b):\n    return a\n\n\ndef _hidden(a, b):\n    return a[0][1][2]\n\n\ndef rank(a, b):\n    return a\n"
    tests = spark.createDataFrame([("t1", "from m import parse, MERGE, _hidden\n"), ("t2", "# given(\nrank\n"), ("t3", "from x import Rank\n")], FILES)
    tokens, ours = flow.property_tokens(tests, flow.flow_facts(tests))
    got = flow.property_candidates(facts(spark, m=source), tokens, ours, F.col("path"))
    assert sorted(r.identifier for r in got.collect()) == ["m.Merge", "m.parse"]


def test_long_lines_of_strings(spark):
    long = "x" * 130
    text = f"a = {long}\nb = '{long}'\nc = '''\n{long}\n'''\nd = f('s', {long})\n# {long}\n"
    files = spark.createDataFrame([("p", text), ("q", f"def (\n{long}\n")], FILES)
    got = long_lines(files, "path", "text", 120, flow.flow_facts(files))
    assert sorted((r.path, r.line) for r in got.collect()) == [("p", 1), ("q", 2)]


def test_unchecked_types_at_any_depth():
    text = "from typing import Any, List\nif TYPE_CHECKING:\n    from typing import Any\n    z: Any\nx: dict[str, Any] = {}\ny: int\ndef f(a: typing.Any, *b: 'Any', **c: Any | None) -> list[Any]:\n    return Any\n"
    assert [r[3] for r in detect.facts_of("p", text) if r[1] == "any"] == [1, 5, 7, 7, 7]
