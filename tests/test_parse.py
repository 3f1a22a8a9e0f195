"""Files are parsed once and on all cores, however few splits their table is read in."""

import ast

import pytest
from pyspark.sql import functions as F

from guardlake.operators import callgraph as G
from guardlake.operators import detect as D
from guardlake.operators import enrichers, flow
from guardlake.operators.parse import ROWS, parsed, walked
from guardlake.plans import QUERIES, corpus_queries, flow_queries, graph_queries, shape_queries

SCHEMA = "path string, text string"


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["source_facts", "size_violations", "semantic_clones", "size_limits"])
def test_queries_parse_on_all_cores(spark, sf, name):
    """The tables are one split each; before, one task parsed all files."""
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name][0](spark, sf))


@pytest.mark.parametrize("files", [corpus_queries._sources, shape_queries._files, graph_queries._files, flow_queries._sources])
def test_files_lie_in_many_splits(spark, sf, files):
    rows = files(spark, sf).withColumn("at", F.spark_partition_id())
    assert rows.select("at").distinct().count() > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("query", [G.call_edges, G.boundaries, G.boundary_findings, G.integration_seams])
def test_graph_queries_parse_once(spark, query):
    facts = G.call_facts(spark.createDataFrame([("src/a.py", "def f():\n    log.info(1)\n")], SCHEMA))
    assert "MapIn" not in plan(query(facts)) + plan(facts)


def test_flow_queries_parse_once(spark):
    facts = flow.flow_facts(spark.createDataFrame([("a.py", "def f(x):\n    a = x\n    b = a\n    return b\n")], SCHEMA))
    assert "MapIn" not in plan(flow.repeated_statement_blocks(facts)) + plan(flow.property_candidates(facts, *flow.property_tokens(spark.createDataFrame([], SCHEMA), facts), F.col("path")))


def test_enrichers_read_violations_once(spark):
    files = spark.createDataFrame([("a.py", "try:\n    f()\nexcept ValueError:\n    pass\n")], SCHEMA)
    facts = D.saved(D.source_facts(files))
    got = enrichers.enriched(D.size_violations(D.source_facts(files)), facts)
    assert "MapIn" not in plan(got) and [r.hint for r in got.collect()] == ["may raise: f"]


def test_a_long_sum_is_no_parse_error():
    """Walks have no recursion: a function of 700 terms has its facts, as has a module of 3000."""
    kinds = lambda text: {r[1] for r in D.facts_of("a.py", text)}
    assert kinds("def f():\n    return " + "+".join(["x"] * 700)) == {"module", "function"}
    assert kinds("x = " + "+".join(["x"] * 3000)) == {"module"}
    assert kinds("def f():\n    return " + "+".join(["x"] * 1200)) == {"parse_error"}


def test_facts_of_chosen_kinds_are_the_same():
    text = "from typing import Any\n\n\nclass A:\n    def f(self, x: Any, y):\n        'doc'\n        try:\n            return g(x) if y and x else 2\n            h(1)\n        except Exception:\n            pass\n"
    every = D.facts_of("a.py", text)
    rows = flow.flow_of("a.py", text)
    for kinds in ({"symbol"}, {"token", "string"}, {"statement"}):
        assert flow.flow_of("a.py", text, frozenset(kinds)) == [r for r in rows if r[1] in kinds]
    for kinds in ({"function"}, set(D.SIZES), {"literal", "call"}, {"param", "try_call", "branches"}):
        assert sorted(D.facts_of("a.py", text, frozenset(kinds))) == sorted(r for r in every if r[1] in kinds)


def test_structure_aside_from_names():
    """Clones differ in names, constants of a type, annotations and documentation alone."""
    digest = lambda body, kind="def f(a: int, b):": next(r[8] for r in D.facts_of("a.py", kind + "\n    " + body + "\n") if r[1] == "function" and r[3] == 1)
    assert digest("'doc'\n    return a + 1") == digest("return zz + 7", "def g():")
    different = ["return a + 1", "return a - 1", "return a + 'x'", "return a.b + 1", "return a.c + 1", "return (a, 1)", "return [a, 1]", "return f(a, 1)", "return f(a)(1)", "return f(a, b=1)", "return f(a, c=1)", "if a: return 1", "while a: return 1", "def g(x): return 1", "def h(x): return 1", "def g(x, y): return 1", "return lambda x: 1"]
    assert len({digest(b) for b in different}) == len(different)
    assert digest("def g(x: int): return 1") == digest("def g(y): return 2")


def test_walk_keeps_the_order_of_the_library():
    tree = ast.parse("@d\nclass A(B, metaclass=C):\n    def f(self, *a, b: int = 1, **k) -> x:\n        with o() as p, q: yield from {**z}\n        match w:\n            case {'a': 1, **r} | [A(b=2), *s]: del s[1:2].t\n")
    held = [n for n in ast.walk(tree) if n._fields and not isinstance(n, ast.expr_context)]
    assert walked(tree) == held


def test_copies_have_the_rows_of_their_text(spark):
    files = spark.createDataFrame([(str(i), "ab"[i % 2] * (1 + i % 2 * 20_000)) for i in range(10)] + [(None, "a"), ("n", None)], SCHEMA).coalesce(1)
    got = parsed(files, "path", "text", lambda p, t: [(p, len(t)), (p, ROWS)] if t else [], "path string, n long", copies=True)
    want = [(str(i), n) for i in range(10) for n in (1 if i % 2 == 0 else 20_001, ROWS)] + [(None, 1), (None, ROWS)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
