import json
import random

import pytest
from pyspark.sql import functions as F

from guardlake.functions import decisions as D
from guardlake.functions import paths as P
from guardlake.operators import baseline as B
from guardlake.operators import correlate as C
from guardlake.operators import detect
from guardlake.operators import rules as R
from guardlake.operators import sessions as S
from guardlake.sources import traces as T


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_decision_orders(spark):
    f = F.from_json(F.lit('[{"decision":"allow","severity":"LOW"},{"decision":"deny","severity":"LOW"},{"decision":"block","severity":"HIGH"},{"decision":"deny","severity":"HIGH"}]'), "array<struct<decision:string,severity:string>>")
    assert one(spark, D.engine_decision(f))[0] == "block"
    warn = F.array(F.lit("warn"))
    assert one(spark, D.first_of(warn, D.SESSION_ORDER), D.first_of(warn, D.RESULT_ORDER))[:] == ("allow", "warn")
    assert one(spark, D.severity_rank(F.lit("odd")), D.severity_rank(F.lit("odd"), "LOW"))[:] == (20, 10)
    assert one(spark, D.round_half_up(F.lit(2.5)))[0] == 3


@pytest.mark.parametrize("path,glob,hit", [("a/b/C.py", "*.PY", True), ("a/b/c.py", "a/*", True), ("a/b/c.py", "b/", True), ("a/bb/c.py", "b/", False), ("a/b/c.py", "c", False)])
def test_globs(spark, path, glob, hit):
    assert one(spark, P.matches_glob(F.lit(path), glob))[0] is hit


def test_text_functions(spark):
    assert one(spark, P.redacted(F.lit("token=abc, x Bearer aa.bb Bearer abcdefgh")))[0] == "token=[REDACTED] x Bearer aa.bb Bearer [REDACTED]"
    assert one(spark, P.is_error(F.lit("Traceback (most recent call last)")), P.is_error(F.lit("it failed badly: 0 errors")), P.is_error(F.lit("KeyError:")))[:] == (True, False, False)
    assert one(spark, P.repo_label(F.lit("/x/repos/r1/a.py")), P.repo_label(F.lit("/home/u/p/a")), P.repo_label(F.lit("a")))[:] == ("r1", "p", None)
    assert one(spark, P.effective_path(F.lit(""), F.array(F.lit("content"), F.lit("a/venv/b"), F.lit("src/x"))))[0] == "src/x"
    assert one(spark, P.trimmed(F.lit("abcdef"), 3))[0] == "abc…[trimmed]"


@pytest.fixture()
def log(tmp_path):
    lines = [
        "", "not json", "[1, 2]", "3", json.dumps({"command": "ls", "returncode": 1, "session_id": "s"}), json.dumps({"rule_id": "R", "decision": "deny", "session_id": "s", "timestamp": "bad", "message": "x" * 300}),
        json.dumps({"rule_id": "M"}), json.dumps({"findings": [{"rule_id": "R", "decision": "warn", "metadata": {"path": "p"}}], "session_id": "s", "timestamp": "2024-01-02T00:00:00+00:00"}),
        json.dumps({"event_name": "Stop", "session_id": "s", "platform": "odd", "threadID": "t", "session_title": None, "title": "T", "timestamp": "2023-01-01T00:00:00Z", "candidate_paths": ["a"]}), json.dumps({"findings": 3}),
        json.dumps({"session_id": "s", "event_name": "Stop"}), json.dumps({"event_name": "Stop", "session_id": "s"}),
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_log_scan(spark, log):
    rows = T.classified(T.scan(spark, log))
    assert {r["category"]: r["count"] for r in rows.groupBy("category").count().collect()} == {"subprocesses": 1, "rules": 2, "results": 1, "events": 3}
    rule = T.rules(rows).collect()
    assert len(rule) == 1 and rule[0].message == "x" * 180 + "…[trimmed]"
    event = [r for r in T.events(rows).collect() if r.timestamp][0]
    assert (event.platform, event.codex_session_id, event.session_title, event.platform_source, event.candidate_paths) == ("unknown", "t", None, "normalized", ["a"])
    assert T.results(rows).first().findings[0].path == "p"
    run = T.subprocesses(rows).first()
    assert (run.returncode, run.duration_ms) == (1, 0.0)
    assert T.deduplicated(rows).count() == 6
    kept = T.look_back(rows, 24)
    assert kept.count() == 6  # the event of 2023 is too old; rows without a readable time stay
    assert T.since(rows, 30, F.lit("2024-01-10").cast("timestamp")).count() == 6


def test_log_stream(spark, log, tmp_path):
    q = T.classified(T.follow(spark, log)).groupBy("category").count().writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("live").agg(F.sum("count")).first()[0] == 7


def test_caps(spark):
    rows = spark.range(100).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "events").otherwise("rules").alias("category"))
    out = T.capped(rows, {"events": 3, "rules": 50}).groupBy("category").agg(F.count("*").alias("n"), F.min("seq").alias("low")).collect()
    assert {r.category: (r.n, r.low) for r in out} == {"events": (3, 94), "rules": (50, 1)}


def test_reports(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"files": {"a.py": {"summary": {"percent_covered": 79.5}}}}))
    assert T.coverage_json(spark, str(tmp_path / "c.json")).collect()[0][:] == ("a.py", 80)
    (tmp_path / "c.xml").write_text('<r><class filename="b.py" line-rate="0.5"></class></r>')
    assert T.coverage_xml(spark, str(tmp_path / "c.xml")).collect()[0][:] == ("b.py", 50)
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert T.lint_pyrefly(frame(json.dumps({"errors": [{"path": "p", "name": "n"}]}))).first()[:] == ("p", 1, 1, "error", "n", "", "pyrefly")
    assert T.lint_biome(frame(json.dumps([{"severity": "FATAL", "location": {"path": {"file": "f"}, "span": [4, 5]}}]))).first()[:] == ("f", 1, 4, "warning", "unknown", "", "biome")
    clippy = {"reason": "compiler-message", "message": {"level": "error", "message": "m", "code": {"code": "c"}, "spans": [{"file_name": "a", "line_start": 1, "column_start": 2}, {"file_name": "b", "line_start": 3, "column_start": 4, "is_primary": True}]}}
    assert T.lint_clippy(frame(json.dumps(clippy), "x", "{}")).collect() == [("b", 3, 4, "error", "c", "m", "clippy")]


def test_claim_is_greedy_and_one_to_one(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rng = random.Random(5)
    results = [(i, at(rng.randrange(60)), "k") for i in range(15)]
    events = [(100 + i, at(rng.randrange(60)), "k") for i in range(12)]
    free, want = {e: int(t[-2:]) for e, t, _ in events}, {}
    for i, t, _ in sorted(results):
        near = min(((abs(int(t[-2:]) - x), e) for e, x in free.items()), default=(99, None))
        if near[0] <= 5:
            want[i] = near[1]
            del free[near[1]]
    frame = lambda rows: spark.createDataFrame(rows, "seq long, t string, key string").select("seq", F.col("t").cast("timestamp").alias("ts"), "key")
    got = C.claim(frame(results), frame(events), ["key"], 5_000_000).where("event_seq is not null").collect()
    assert {r.seq: r.event_seq for r in got} == want


def test_roots_and_cycles(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (7, 8), (8, 7), (9, 7)], "child long, parent long")
    assert {r.child: r.root for r in S.roots(edges).collect()} == {2: 1, 3: 1, 4: 1, 7: 7, 8: 8, 9: 9}


def test_baseline_guard(spark):
    a, b = (spark.createDataFrame(x, "rule string, stable_id string") for x in ([("r", "1"), ("r", "2")], [("r", "2"), ("r", "3")]))
    assert B.inflated(a, b).count() == 0 and not B.same(a, b) and B.same(a, a)
    assert B.tally(b, a).first()[:] == ("r", 2, 1, 1, 1)
    assert one(spark, B.stable_id(F.lit("r"), F.lit("p"), F.lit("i"), F.lit("")))[0] == "r|p|i"


def test_rules_match_flags(spark):
    t = spark.createDataFrame([(1, "a.py", "x\nSECRET y"), (2, "skip/a.py", "secret"), (3, "b.py", None)], "id long, path string, content string")
    rule = R.Rule("X", (r"^secret",), case_sensitive=False, exclude_globs=("skip/*",))
    assert [r.id for r in R.evaluate(t, (rule,), ("id",)).collect()] == [1]


SOURCE = '''
import os
from typing import Any


def f(a: Any, b, c, d, e):
    """Doc."""
    if a:
        for x in b:
            while c:
                if d and e:
                    with a:
                        return 1
                    print(2)
    return 2
    print(3)


def g(q):
    try:
        return q
    except Exception:
        pass


def test_nothing():
    f(1, 2, 3, 4, 5)
'''


def test_source_detectors(spark):
    twin = "def h(a):\n    y = a\n    y = y + 1\n    y = y + 2\n    y = y + 3\n    return y\n"
    files = spark.createDataFrame([("a.py", SOURCE), ("b.py", "def ("), ("c.py", None), ("d.py", twin), ("e.py", twin.replace("y", "z"))], "path string, text string")
    facts = detect.source_facts(files)
    found = {(r.rule, r.relative_path) for r in detect.size_violations(facts).collect()}
    for rule in ("too-many-params", "deep-nesting", "banned-any", "dead-code", "broad-except-swallow", "silent-except", "assertion-free-test"):
        assert (rule, "a.py") in found
    assert ("python-parse-error", "b.py") in found and not [x for x in found if x[1] == "c.py"]
    assert detect.semantic_clones(facts).collect()[0].n == 2


def test_similar_texts(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(1, base), (2, base.replace("w5 ", "v ")), (3, base), (4, " ".join(f"q{i}" for i in range(60)))], "id long, text string")
    assert [(r.a, r.b) for r in detect.similar_texts(rows, "id", "text").collect()] == [(1, 2)]
