"""State kept beside a log, routing tables and the dashboards' orders.

State with a lifetime is a window over time; the streaming twins are in ``streaming/live.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.storage import drop_saved, saved

#: Collectors that must be asked for, and what each platform can enforce.
OPT_IN = (
    "dead-code", "boundary-logging", "feature-envy", "flat-sibling-files", "import-alias", "import-fanout", "langgraph-deprecated-api",
    "langgraph-state-mutation", "langgraph-state-reducer", "private-import-chain", "pytest-asyncio-pattern",
)
CAPABILITY = {"opencode": "degraded", "codex": "partial", "cursor": "partial", "unknown": "unknown"}
#: Lifetime of reads, reminders, locks and plans; counters of denials have none.
TTL = 3600


def capability(platform: Column) -> Column:
    """What a platform's hooks can enforce; any other than those known to do less is full."""
    low = F.lower(F.trim(platform))
    out = F.lit("full")
    for name, level in CAPABILITY.items():
        out = F.when(low == name, level).otherwise(out)
    return out


def routed(results: DataFrame, catalog: DataFrame, surface: str, event: str | None = None) -> DataFrame:
    """Results of collectors that the catalog sends to the surface and event; those it does not know stay.

    ``catalog(collector, surfaces, events)`` is a small dimension with a row per collector.
    """
    here = F.array_contains("surfaces", surface)
    if event is not None:
        here = here & F.array_contains("events", event)
    known = catalog.select("collector", here.alias("_here"))
    return results.join(known, "collector", "left").where(F.coalesce("_here", F.lit(True))).drop("_here")


def enabled(results: DataFrame, switched: DataFrame) -> DataFrame:
    """Results of enabled collectors: on unless switched off, but for those that must be asked for. ``switched(collector, on)``."""
    s = switched.select("collector", F.col("on").alias("_on"))
    return results.join(s, "collector", "left").where(F.coalesce("_on", ~F.col("collector").isin(*OPT_IN))).drop("_on")


def layered(layers: list[DataFrame]) -> DataFrame:
    """Settings ``(key, value)`` merged over layers in order: the last layer that has a key wins, null included."""
    merged = layers[0].select("key", "value", F.lit(0).alias("layer"))
    for i, layer in enumerate(layers[1:], 1):
        merged = merged.union(layer.select("key", "value", F.lit(i).alias("layer")))
    return merged.groupBy("key").agg(F.max_by(F.struct("value"), "layer").alias("s"), F.max("layer").alias("layer")).select("key", "s.value", "layer")


def alive(rows: DataFrame, ts: str = "ts", ttl: int = TTL, *key: str) -> DataFrame:
    """The first row of each key, and each later one that comes when what the last kept row left has expired.

    A state is alive up to ``ttl`` seconds after it was set, whole seconds; a row renews nothing while its key is alive.
    Rows without a time stay out. Of one second of a key only the first row can stay. Kept rows are further apart than ``ttl``,
    so each time bucket holds one at most, and the first row after a row's expiry lies in the next bucket or in the first one
    after that. The chain from a key's first row along these pointers is followed by doubling them: a round of joins for each
    bit of its length. No task holds more of a key than two buckets' seconds, or a row for each of its buckets.
    """
    width, whole = ttl + 1, F.struct(*rows.columns)
    named = rows.where(F.col(ts).isNotNull()).withColumn("_key", F.to_json(F.struct(*key), {"ignoreNullFields": "false"}) if key else F.lit(""))
    firsts = named.groupBy("_key", F.unix_timestamp(F.col(ts)).alias("_at")).agg(F.min_by(whole, F.struct(ts, "seq")).alias("_row"))
    firsts = saved(firsts)
    times = firsts.select("_key", "_at", F.floor(F.col("_at") / width).alias("_bucket"))
    asks = times.select("_key", F.col("_bucket") + 1, F.col("_at") + width, F.col("_at").alias("_from"))
    both = times.select("_key", "_bucket", F.col("_at").alias("_time"), F.lit(None).cast("long").alias("_from")).union(asks)
    at_or_after = Window.partitionBy("_key", "_bucket").orderBy(F.desc("_time"), F.asc_nulls_first("_from")).rowsBetween(Window.unboundedPreceding, 0)
    reached = F.last(F.when(F.col("_from").isNull(), F.col("_time")), ignorenulls=True).over(at_or_after)
    inside = both.withColumn("_to", reached).where("_from is not null and _to is not null").select("_key", F.col("_from").alias("_at"), "_to")
    by_time = Window.partitionBy("_key").orderBy("_bucket")
    buckets = times.groupBy("_key", "_bucket").agg(F.min("_at").alias("_first"))
    beyond = F.when(F.lead("_bucket").over(by_time) > F.col("_bucket") + 1, F.lead("_first").over(by_time)).otherwise(F.lead("_first", 2).over(by_time))
    buckets = buckets.select("_key", "_bucket", beyond.alias("_beyond"))
    jumps = times.join(inside, ["_key", "_at"], "left").join(buckets, ["_key", "_bucket"]).select("_key", "_at", F.coalesce("_to", "_beyond").alias("_to"))
    jumps = saved(jumps.where("_to is not null"))
    kept = saved(times.groupBy("_key").agg(F.min("_at").alias("_at")))
    while jumps.take(1):
        further = saved(kept.union(kept.join(jumps, ["_key", "_at"]).select("_key", "_to")))
        twice = saved(jumps.join(jumps.select("_key", F.col("_at").alias("_to"), F.col("_to").alias("_then")), ["_key", "_to"]).select("_key", "_at", F.col("_then").alias("_to")))
        drop_saved(kept, jumps)
        kept, jumps = further, twice
    return firsts.join(kept, ["_key", "_at"]).select("_row.*")


def locks_held(locks: DataFrame, attempts: DataFrame, plans: DataFrame, ttl: int = TTL) -> DataFrame:
    """Attempts, and whether a lock of the session set before holds: the last one, not expired, and no repair plan since."""
    marks = (
        attempts.select("session_id", "seq", "ts", F.lit("attempt").alias("kind"))
        .union(locks.select("session_id", "seq", "ts", F.lit("lock"))).union(plans.select("session_id", "seq", "ts", F.lit("plan")))
    )
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("kind") != "attempt", F.struct("kind", "ts")), ignorenulls=True).over(w)
    held = (F.col("l.kind") == "lock") & (F.unix_timestamp("ts") - F.unix_timestamp("l.ts") <= ttl)
    return marks.withColumn("l", last).where("kind = 'attempt'").select("session_id", "seq", F.coalesce(held, F.lit(False)).alias("locked"))


def full_read_needed(reads: DataFrame, exempt: tuple[str, ...] = (".md", ".txt", ".json", ".lock"), most_bytes: int = 40_000) -> DataFrame:
    """Partial reads of files that are neither exempt nor over ``most_bytes`` and were not read in full before."""
    w = Window.partitionBy("session_id", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    free = F.coalesce(F.col("bytes") > most_bytes, F.lit(False))
    for suffix in exempt:
        free = free | F.lower("path").endswith(suffix)
    seen = F.coalesce(F.max(F.col("full").cast("int")).over(w), F.lit(0)) == 1
    return reads.withColumn("_seen", seen).where(~F.col("full") & ~F.col("_seen") & ~free).select("seq", "session_id", "path")


def fingerprint(tool: Column, paths: Column, targets: Column, tool_input: Column) -> Column:
    """What makes two attempts the same: tool, paths, contents by hash, input. Null for an attempt that names no file.

    ``targets`` is an array of (path, source, content).
    """
    files = F.array_sort(F.array_distinct(F.filter(paths, lambda p: F.coalesce(p, F.lit("")) != "")))
    contents = F.array_sort(F.array_distinct(F.transform(F.filter(targets, lambda t: F.coalesce(t["path"], F.lit("")) != ""), lambda t: F.concat_ws("\x00", t["path"], t["source"], F.sha2(t["content"], 256)))))
    whole = F.concat_ws("\x01", F.lower(tool), F.array_join(files, "\x02"), F.array_join(contents, "\x02"), F.sha2(tool_input, 256))
    return F.when((F.size(files) > 0) | (F.size(contents) > 0), F.sha2(whole, 256))


def pruned(counters: DataFrame, protected: DataFrame, most: int = 512) -> DataFrame:
    """``most`` counters ``(key, n)``: the protected keys among them take their places first, all of them even if they are more,
    then the largest others, ties to the larger key."""
    kept = counters.join(protected.select("key").distinct(), "key", "left_semi").select(*counters.columns)
    others = counters.join(protected.select("key").distinct(), "key", "left_anti").select(*counters.columns)
    return kept.union(others.orderBy(F.desc("n"), F.desc("key")).limit(max(most - kept.count(), 0)))


def stale_entries(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """By rule, baseline entries that are still found, and those that are stale."""
    now = current.select("stable_id", F.lit(True).alias("_now")).distinct()
    both = baseline.join(now, "stable_id", "left")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return both.groupBy("rule").agg(n(F.col("_now").isNotNull()).alias("kept"), n(F.col("_now").isNull()).alias("stale"))


def ingested(records: DataFrame, valid: Column, *key: str) -> DataFrame:
    """Counts of records by source: accepted, ignored as repeats of a valid record's key, rejected as invalid.

    The first valid record of a key is accepted, whatever was rejected before it. Firsts are found by a minimum, so a frequent
    key is counted before it is shuffled. ``seq`` is unique; keys may be null and equal so.
    """
    checked = records.select("source", "seq", F.struct(*key).alias("_key"), F.coalesce(valid, F.lit(False)).alias("_valid"))
    firsts = checked.where("_valid").groupBy("_key").agg(F.min_by("source", "seq").alias("source"))
    accepted = firsts.groupBy("source").agg(F.count("*").alias("accepted"))
    seen = checked.groupBy("source").agg(F.count(F.when(F.col("_valid"), 1)).alias("valid"), F.count("*").alias("all"))
    both = seen.join(accepted.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    n = F.coalesce("accepted", F.lit(0))
    kinds = {"accepted": n, "ignored": F.col("valid") - n, "rejected": F.col("all") - F.col("valid")}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("n")) for k, v in kinds.items()))).alias("k")
    return both.select("source", each).select("source", "k.kind", "k.n").where("n > 0")


def merged_live(snapshot: DataFrame, live: DataFrame, *key: str) -> DataFrame:
    """A snapshot and the rows that came since: of equal keys the highest version stays, so a stale snapshot undoes nothing."""
    both = snapshot.unionByName(live)
    others = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct("version", "seq")).alias("_r")).select(*key, *(f"_r.{c}" for c in others))


def newest(rows: DataFrame, most: int = 250_000) -> DataFrame:
    """The last ``most`` rows of a live view by time; rows without a time go first."""
    return rows.orderBy(F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)).desc(), F.desc("seq")).limit(most)


def in_time(rows: DataFrame) -> DataFrame:
    """A stable sort by time: a bad timestamp counts as the epoch, so it comes first."""
    return rows.orderBy(F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(0)), "seq")


def tree_children(nodes: DataFrame, by: str = "findings") -> DataFrame:
    """Places of nodes ``(parent, name, is_dir, findings, events, blocks)`` under their parents: folders first, then by count or name."""
    order = [F.desc("is_dir"), *([] if by == "name" else [F.desc(by)]), F.asc("name")]
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(*order)).cast("long"))


def attached(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Commands whose session the events have seen; others attach to nothing."""
    return runs.join(events.select("session_id").distinct(), "session_id", "left_semi")


def findings_by_path(findings: DataFrame, events: DataFrame) -> DataFrame:
    """Every finding counted at every path that its session touched: both sides are counted by session first."""
    per = findings.groupBy("session_id").agg(F.count("*").alias("n"))
    paths = events.select("session_id", F.explode("candidate_paths").alias("path")).distinct()
    return paths.join(per, "session_id").groupBy("path").agg(F.sum("n").alias("findings"), F.count("*").alias("sessions"))


def deprecated_references(symbols: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tests that name a deprecated symbol: ``symbols(name, deprecated)``, ``tokens(test, token)``."""
    old = symbols.where("deprecated").select(F.lower("name").alias("token")).distinct()
    return tokens.select("test", F.lower("token").alias("token")).distinct().join(old, "token").select("test", "token")
