"""Repeated statements, state graphs and property-test candidates over sources dealt to customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.operators import flow
from guardlake.operators.parse import dealt
from guardlake.plans import proxies as X
from guardlake.plans.guard_queries import _values

#: Sources; ``@k`` is the customer's key. A customer's source and its number give the path.
SOURCES = (
    "import os\nimport re\nA = 1\nB = (2, 3)\nC = {'k': A}\n\n\ndef one(x):\n    y = load(x)\n    y.check_@k(1)\n    return y\n",
    "def two(item):\n    \"\"\"Doc.\"\"\"\n    value: int = 3\n    got = load(item)\n    got.check_@k(2)\n    return got\n",
    "from langgraph.graph import StateGraph\n\n\nclass S@k(TypedDict):\n    a: list\n    b: Annotated[list[int], add]\n    c: list[str]\n    d: int\n\n\ndef node(state):\n    # state['x'] = 1\n    state['n@k'] = 2\n    state['m'].append(3)\n    return {}\n",
    "class Plain(TypedDict):\n    a: list\n\n\ndef node(state):\n    state['n'] = 2\n",
    "def parse_rows@k(text, limit):\n    rows = text.split()\n    return [r.strip() for r in rows if r]\n\n\ndef plain@k(x):\n    return x\n\n\ndef merge_all@k(a, b):\n    return a or b\n\n\ndef decide@k(a):\n    if a > 1:\n        return 1\n    if a < 0:\n        return 2\n    return a.get(1)\n\n\ndef sort_it@k(a, b):\n    return sorted(a)\n",
    "def broken(:\n",
)
TESTS = (
    "def test_rows():\n    assert parse_rows@k('a', 1) == []\n    assert plain@k(1) == 1\n    assert decide@k(1)\n    assert merge_all@k(0, 1)\n",
    "from hypothesis import given\n\n\ndef test_merge():\n    merge_all@k(1, 2)\n",
)
#: Runs that every customer's copy has, whatever its key: names and constants do not count.
COPIED = ((2, "node", "lines 13-15"), (4, "<module>", "lines 1-11"), (4, "<module>", "lines 6-19"), (4, "<module>", "lines 10-23"), (4, "decide@k", "lines 15-19"))


def _dealt(s, d, texts, folder):
    """Every text for every customer, the key written into it."""
    c = dealt(X.table(s, d, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(texts)))).alias("f"))
    key = F.col("c_custkey").cast("string")
    return c.select(F.concat(F.lit(folder + "/c"), key, F.lit("/f"), F.col("f.i").cast("string"), F.lit(".py")).alias("path"), F.replace("f.t", F.lit("@k"), key).alias("text"))


def _sources(s, d):
    return _dealt(s, d, SOURCES, "src")


def _blocks(s, d):
    found = flow.repeated_statement_blocks(flow.flow_facts(_sources(s, d), kinds=["statement"]))
    return found.withColumn("detail", F.regexp_replace("detail", ", block hash .*", ""))


def _candidates(s, d):
    tests = _dealt(s, d, TESTS, "tests")
    tokens, property_tokens = flow.property_tokens(tests, flow.flow_facts(tests, kinds=["token"]))
    module = F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit("."))
    return flow.property_candidates(flow.flow_facts(_sources(s, d), kinds=["symbol"]), tokens, property_tokens, module)


def _rows(rule: str, rows) -> str:
    k = lambda c: f"replace(v.{c}, '@k', c_custkey::varchar)"
    return f"select '{rule}' as rule, 'src/c' || c_custkey || '/f' || v.f || '.py' as relative_path, {k('i')} as identifier, {k('t')} as detail from customer, {_values(rows)} v(f, i, t)"


QUERIES = {
    "statement_blocks": (_blocks, _rows("repeated-code-block", [(0, "one", "lines 9-11"), (1, "two", "lines 4-6"), *COPIED])),
    "state_mutations": (lambda s, d: flow.state_mutations(_sources(s, d)), _rows("langgraph-state-mutation", [(2, "line-13", "mutations=2 first=state['n@k'] = 2")])),
    "state_reducers": (lambda s, d: flow.state_reducers(flow.flow_facts(_sources(s, d).where(flow.is_graph_source(F.col("text"))))), _rows("langgraph-state-reducer", [(2, "S@k", "fields=['a', 'c']")])),
    "property_candidates": (
        _candidates,
        _rows("hypothesis-candidate", [
            (4, "src.c@k.f4.parse_rows@k", "line 1: property_test_score=6; reasons=name suggests invariant work (parse); 2 inputs; collection/string transforms=3; candidate properties=round-trip / malformed-input contracts; no Hypothesis/given test reference"),
            (4, "src.c@k.f4.decide@k", "line 14: property_test_score=4; reasons=input domain; branch/validation paths=4; data transformation; candidate properties=branch decision-table invariants; no Hypothesis/given test reference"),
        ]),
    ),
}
