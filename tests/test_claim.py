"""The greedy claim on one dense key: no group of a key in one task, and the same answer as one by one."""

import random

import pytest
from pyspark.sql import functions as F

from guardlake import storage
from guardlake.operators import claims
from guardlake.operators import correlate as C


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, t long, key string").select("seq", F.timestamp_micros("t").alias("ts"), "key")


def greedy(results, events, tolerance):
    free, out = {e: (t, k) for e, t, k in events}, {}
    for seq, at, key in sorted(results, key=lambda r: r[0]):
        near = min(((abs(at - t), e) for e, (t, k) in free.items() if k == key), default=None)
        out[seq] = near[::-1] if near and near[0] <= tolerance else (None, None)
        if out[seq][0] is not None:
            del free[out[seq][0]]
    return out


def test_claim_on_a_dense_key(spark):
    rng = random.Random(3)
    rows = lambda first, n: [(first + i, rng.randrange(400), rng.choice(["hot", "hot", "hot", "b", None])) for i in range(n)]
    results, events = rows(0, 150), rows(1000, 130)
    got = C.claim(frame(spark, results), frame(spark, events), ["key"], 25)
    assert {r.seq: (r.event_seq, r.distance) for r in got.collect()} == greedy(results, events, 25)
    assert got.count() == len(results)


def test_claim_does_not_group_a_key_in_python(spark):
    got = C.claim(frame(spark, [(1, 0, "a"), (2, 1, "a")]), frame(spark, [(9, 0, "a")]), ["key"], 5)
    plan = got._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Window" not in plan
    assert {r.seq: r.event_seq for r in got.collect()} == {1: 9, 2: None}


@pytest.mark.parametrize("rows", [25, 10_000])
def test_blocks_do_not_change_the_claim(spark, rows):
    """Bursts at one instant, dense stretches, sparse ends, null keys and times; blocks far smaller than a burst."""
    rng = random.Random(rows)
    times = lambda n: [rng.choice([500, 500, rng.randrange(480, 520), rng.randrange(2000), None]) for _ in range(n)]
    results = [(i, t, rng.choice(["hot", "hot", None])) for i, t in enumerate(times(120))]
    events = [(1000 + i, t, rng.choice(["hot", "hot", None])) for i, t in enumerate(times(110))]
    got = claims.claim(frame(spark, results), frame(spark, events), ["key"], 60, rows)
    want = greedy([r for r in results if r[1] is not None], [e for e in events if e[1] is not None], 60)
    assert {r.seq: (r.event_seq, r.distance) for r in got.collect()} == {i: want.get(i, (None, None)) for i in range(120)}


def test_a_burst_takes_few_rounds(spark, monkeypatch):
    """10,000 results at one instant, 9,000 events near it."""
    written = []
    monkeypatch.setattr(claims, "saved", lambda df: written.append(1) or storage.saved(df))
    results = [(i, 1000, "a") for i in range(10_000)]
    events = [(20_000 + i, 1000 + (i * 7919) % 300, "a") for i in range(9_000)]
    got = {r.seq: (r.event_seq, r.distance) for r in C.claim(frame(spark, results), frame(spark, events), ["key"], 250).collect()}
    order = sorted((abs(t - 1000), e) for e, t, _ in events if abs(t - 1000) <= 250)
    assert got == {i: (order[i][::-1] if i < len(order) else (None, None)) for i in range(10_000)}
    assert len(written) <= 5


def test_empty_sides(spark):
    some, none = frame(spark, [(1, 5, "a")]), frame(spark, [])
    assert [tuple(r) for r in C.claim(some, none, ["key"], 5).collect()] == [(1, None, None)]
    assert C.claim(none, some, ["key"], 5).count() == 0


def test_blocks_are_cut_by_keys_alone(spark):
    """However many ranges the rows are sorted in, a key's blocks hold ``rows`` rows each, but for its last."""
    results, events = ([(first + i, (i * 7919) % 9973, "ab"[i % 3 == 0]) for i in range(5000)] for first in (0, 10_000))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = claims._cut(claims._sorted(frame(spark, results), frame(spark, events), ["key"]), 3000, 0)
        got = placed.groupBy("key", "block").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).orderBy("key", "block").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert [(r.block, r.n) for r in got] == [(0, 3000), (1, 3000), (2, 666), (0, 3000), (1, 334)]
    assert all(a.high <= b.low for a, b in zip(got, got[1:]) if a.key == b.key)


def test_chains_at_an_end_of_blocks_are_cut_anew(spark, monkeypatch):
    """More results than events on either side of an end of blocks: each displaced one crosses it, one a round."""
    written = []
    monkeypatch.setattr(claims, "saved", lambda df: written.append(1) or storage.saved(df))
    rng = random.Random(8)
    results = [(i, rng.randrange(1000), "a") for i in rng.sample(range(2000), 520)]
    events = [(5000 + i, rng.randrange(1000), "a") for i in range(480)]
    got = claims.claim(frame(spark, results), frame(spark, events), ["key"], 100, 500)
    assert {r.seq: (r.event_seq, r.distance) for r in got.collect()} == greedy(results, events, 100)
    assert len(written) <= 24
