import random

from pyspark.sql import functions as F

from guardlake.operators import ledger, metrics, state
from guardlake.plans import proxies
from guardlake.streaming import live


def staged(spark, df, folder, parts=3):
    df.repartition(parts).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_counter_equals_batch(spark, sf, tmp_path):
    f = proxies.rule_findings(spark, sf).select("session_id", "rule_id", "path", F.when(F.col("k") % 3 > 0, F.concat(F.lit("a"), (F.col("k") % 2).cast("string"))).alias("attempt"), "seq", "decision", "severity")
    got = drained(live.escalations(staged(spark, f, str(tmp_path / "in"), 1)), "escalated")
    columns = (*state.KEY, "seq", "repeat")
    assert sorted(r[:] for r in got.select(*columns).collect()) == sorted(r[:] for r in state.escalated(f).select(*columns).collect())


def test_reminders_come_once_while_they_live(spark, sf, tmp_path):
    e = proxies.hook_events(spark, sf).select("session_id", "tool_name", "seq")
    got = drained(live.reminders(staged(spark, e, str(tmp_path / "in"), 1), "tool_name"), "reminded")
    want = e.groupBy("session_id", F.col("tool_name").alias("topic")).agg(F.min("seq").alias("seq"))
    assert sorted(r[:] for r in got.collect()) == sorted(r[:] for r in want.collect())


def test_windows_equal_batch(spark, sf, tmp_path):
    e = proxies.hook_events(spark, sf).select("seq", "ts", "platform")
    stream = live.counts(live.timed(staged(spark, e, str(tmp_path / "in")), late="40 days"), "1 day", "platform")
    got = drained(stream, "windows", "complete").groupBy(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket")).agg(F.sum("n").alias("n"))
    assert sorted(r[:] for r in got.collect()) == sorted(r[:] for r in metrics.buckets(e, "day").collect())


def test_dedupe_and_idempotent_sink(spark, sf, tmp_path):
    e = proxies.hook_events(spark, sf).select("seq", "ts")
    stream = live.unique(live.timed(staged(spark, e.union(e), str(tmp_path / "in")), late="40 days"), ["seq"])
    q = stream.writeStream.foreachBatch(live.upsert(str(tmp_path / "out"), ["seq"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.count()


def marks(spark, n, seed):
    """Rows over a few hours, dense and sparse, some at the same instant, numbered in the order of time."""
    rng = random.Random(seed)
    times = sorted(rng.choice([rng.randrange(3_000), rng.randrange(40_000), 7200, 10_800]) * 1_000_000 + rng.choice([0, 0, 500_000]) for _ in range(n))
    rows = [(i, t, f"s{rng.randrange(3)}", f"t{rng.randrange(2)}", rng.choice(["attempt", "attempt", "lock", "plan"])) for i, t in enumerate(times)]
    return rows, spark.createDataFrame(rows, "seq long, t long, session_id string, tool string, kind string").withColumn("ts", F.timestamp_micros("t")).drop("t")


def one_by_one(rows, ttl, key):
    kept, out = {}, []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        last = kept.get(key(r))
        if last is None or r[1] // 1_000_000 - last > ttl:
            kept[key(r)] = r[1] // 1_000_000
            out.append(r[0])
    return sorted(out)


def test_lifetimes_equal_a_loop_and_the_stream(spark, tmp_path):
    rows, df = marks(spark, 400, 1)
    for ttl in (0, 7, 3600):
        assert sorted(r.seq for r in ledger.alive(df, "ts", ttl, "session_id", "tool").collect()) == one_by_one(rows, ttl, lambda r: r[2:4])
    three = spark.createDataFrame([(0, 0), (1, 7000), (2, 7300), (3, None), (4, 3600)], "seq long, at long").withColumn("ts", F.timestamp_seconds("at"))
    assert sorted(r.seq for r in ledger.alive(three).collect()) == [0, 1]
    assert ledger.alive(three.limit(0)).count() == 0
    end = spark.createDataFrame([(10_000, "end", "t0", "plan")], "seq long, session_id string, tool string, kind string").withColumn("ts", F.timestamp_seconds(F.lit(10**6)))
    columns = ["seq", "ts", "session_id", "tool"]
    folder = str(tmp_path / "in")
    for part in (df.where("seq < 150"), df.where("seq between 150 and 390"), df.where("seq > 390"), end):
        part.select(*columns).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.select(*columns).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = [r.seq for r in drained(live.alive(stream, "tool", 3600), "living").collect() if r.seq < 10_000]
    assert sorted(got) == one_by_one(rows, 3600, lambda r: r[2:4])


def test_locks_of_a_stream_equal_batch(spark, tmp_path):
    rows, df = marks(spark, 300, 2)
    of = lambda kind: df.where(F.col("kind") == kind)
    want = {r.seq: r.locked for r in ledger.locks_held(of("lock"), of("attempt"), of("plan"), 1800).collect()}
    last, loop = {}, {}
    for seq, t, session, _, kind in rows:
        if kind == "attempt":
            at, what = last.get(session, (None, None))
            loop[seq] = what == "lock" and t // 1_000_000 - at <= 1800
        else:
            last[session] = (t // 1_000_000, kind)
    assert want == loop
    end = spark.createDataFrame([(10_000, "end", "t0", "plan")], "seq long, session_id string, tool string, kind string").withColumn("ts", F.timestamp_seconds(F.lit(10**6)))
    folder = str(tmp_path / "in")
    for part in (df.where("seq % 3 = 0 and seq < 100"), df.where("seq % 3 > 0 and seq < 100"), df.where("seq >= 100"), end):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drained(live.locks_held(stream, 1800, late="12 hours"), "locked")
    assert {r.seq: r.locked for r in got.collect()} == loop


def test_pruned_and_ingested(spark):
    counters = spark.createDataFrame([(f"k{i:02}", i) for i in range(20)], "key string, n long")
    kept = lambda protected, most: sorted(r.key for r in ledger.pruned(counters, spark.createDataFrame([(k,) for k in protected], "key string"), most).collect())
    assert kept(["k00", "k01", "none"], 4) == ["k00", "k01", "k18", "k19"]
    assert kept(["k00", "k01", "k02"], 2) == ["k00", "k01", "k02"]
    assert len(kept(["k00"], 512)) == 20
    records = spark.createDataFrame([(1, "a", "k", False), (2, "a", "k", True), (3, "b", "k", True), (4, "b", "k", None), (5, None, None, True)], "seq long, source string, key string, ok boolean")
    got = {(r.source, r.kind): r.n for r in ledger.ingested(records, F.col("ok"), "key").collect()}
    assert got == {("a", "accepted"): 1, ("a", "rejected"): 1, ("b", "ignored"): 1, ("b", "rejected"): 1, (None, "accepted"): 1}
