"""The mix against a loop over the streams, its shares against sharing round by round, positions against numeric integration."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from guardlake.llm import curriculum as M
from oracle import check

SCHEMA = "doc_id long, text string, source string, size long, target string"


def shares(sizes, weights, passes=3):
    """Targets by sharing the excess anew until none is above its limit."""
    total, fixed = sum(sizes.values()), {s: 0.0 for s, n in sizes.items() if not n}
    while True:
        left, w = total - sum(fixed.values()), sum(weights[s] for s in sizes if s not in fixed)
        now = {s: left * weights[s] / w for s in sizes if s not in fixed} if w else {}
        above = [s for s in now if now[s] > passes * sizes[s] * (1 + 1e-12)]
        if not above:
            return {**{s: float(v) for s, v in fixed.items()}, **now}
        fixed |= {s: passes * sizes[s] for s in above}


def brute(rows):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()) for i, t, s, *_ in rows]
    order = sorted({s for _, s, _, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    sizes = Counter()
    for _, s, n, _ in docs:
        sizes[s] += n
    sizes |= {s: sizes[s] for s in order}
    sizes = {s: sizes[s] for s in order}
    target, out = shares(sizes, weights), []
    for s in order:
        at, quota = 0, int(target[s] + 1e-6)
        for i, _, n, _ in sorted((d for d in docs if d[1] == s), key=lambda d: (d[3], d[2])):
            taken = sum(min(max(quota - p * sizes[s] - at, 0), n) for p in range(3))
            out.append((i, n, sizes[s], round(target[s], 6), taken))
            at += n
    return out, target


def key(r):
    return tuple((v is None, v or 0) for v in r)


def held(spark, rows):
    plan = M.curriculum(spark.createDataFrame(rows, SCHEMA))
    got = plan.collect()
    want, target = brute(rows)
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=key) == sorted(want, key=key)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        assert (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    return plan, got


def corpus():
    text = lambda n, k: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(i, text(1 + i * 7 % 40, i), "hot" if i % 3 else f"s{i % 5}", i, None) for i in range(200)]
    rows += [(None, text(5, 1), "hot", 0, ""), (None, text(5, 2), None, 0, ""), (None, None, None, 0, ""), (900, "", "empty", 0, ""), (901, " \t\n", "empty", 0, ""), (902, "one word", "é", 0, ""), (903, text(3000, 9), "Z", 0, "")]
    return rows + [(7, "a b c", "hot", 1, "")] * 50 + [rows[0]] * 3


def test_mix_equals_brute_force(spark):
    held(spark, corpus())


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1, "c": 1000}, {"a": 0, "b": 3}, {"a": 10, "b": 1, "c": 1, "d": 500, "e": 2, "f": 1}])
def test_small_sources_are_capped(spark, sizes):
    held(spark, [(k * 1000 + j, f"w{j} x", s, 0, None) for k, (s, n) in enumerate(sizes.items()) for j in range(n)] + [(9, None, s, 0, None) for s in sizes])


def test_buckets_and_parts_change_nothing(spark, monkeypatch):
    rows = corpus()
    before = sorted(held(spark, rows)[1], key=lambda r: key((r.doc_id, r.source, r.hash, r.start)))
    monkeypatch.setattr(M, "BUCKET", 7)
    monkeypatch.setattr(M, "COPIES", 4)
    after = held(spark, rows)[0].repartition(5).collect()
    assert sorted(after, key=lambda r: key((r.doc_id, r.source, r.hash, r.start))) == before


def test_positions_follow_the_schedules(spark):
    plan, got = held(spark, corpus())
    assert [r.position for r in got if r.position is not None] == sorted(r.position for r in got if r.position is not None)
    def demand(schedule, t, steps=4000):
        """Share of the integral up to ``t``, by the midpoint rule."""
        def weight(x):
            (t0, w0), (t1, w1) = next(p for p in zip(schedule, schedule[1:]) if x <= p[1][0])
            return w0 + (w1 - w0) * (x - t0) / (t1 - t0)
        return sum(weight((j + 0.5) * t / steps) for j in range(steps)) * t / steps / M.integral(schedule)
    each = M.occurrences(plan).collect()
    words = defaultdict(int)
    for r in each:
        offset = r.start + (r["pass"] - 1) * r.source_size
        words[r.source] += r.words
        if r["pass"] > 1 or r.doc_id in range(40):
            assert demand(M.SCHEDULES[r.turn], r.position) == pytest.approx(offset / r.target, abs=1e-4)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert {s: n for s, n in taken.items() if n} == dict(words)
    assert [r.position for r in each] == sorted(r.position for r in each)


def test_training_order_has_the_texts(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    plan = M.curriculum(docs)
    rows = M.training_order(docs, plan).collect()
    assert len(rows) == M.occurrences(plan).count()
    assert all(r.words <= len((r.text or "").split(" ")) or r.doc_id == 902 for r in rows)


def test_empty(spark):
    assert M.curriculum(spark.createDataFrame([], SCHEMA)).count() == 0


def test_native(spark, sf):
    plan = M.op12_curriculum(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_reruns_agree_on_other_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("size", F.lit("clash")).withColumn("hash", F.lit(1))
    a, b = (sorted(M.curriculum(d).drop("target").collect(), key=lambda r: r.doc_id) for d in (docs, docs.repartition(9, "n_chars")))
    assert a == b


def test_sql_with_nulls(spark, sf, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    query = lambda s, d: M.op12_curriculum(s, f"{d}")
    import duckdb

    df = query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(M.oracle())
    norm = lambda r: tuple("-" if v is None else round(v, 6) for v in r)
    columns = df.columns
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert sorted(map(str, (norm([r[c] for c in columns]) for r in df.collect()))) == sorted(map(str, (norm([r[c] for c in columns]) for r in want)))
