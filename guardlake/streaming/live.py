"""Live traces: deduplication, tumbling counts and keyed counters as Structured Streaming.

The log has no watermark of its own; one is added, which bounds the state. Rows later than
it are dropped by the stream and found by the next batch run over the same log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from guardlake.functions.decisions import ENFORCEMENT, is_in
from guardlake.operators.state import KEY


def timed(rows: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Event time as a timestamp with a watermark; times without zone are taken in the session's."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each key once within the watermark."""
    return rows.dropDuplicatesWithinWatermark(key)


def counts(rows: DataFrame, width: str, *keys: str, ts: str = "ts") -> DataFrame:
    """Counts in tumbling windows aligned to the epoch."""
    return rows.groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), *keys, "n")


def volumes(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """Hourly decisions: one row per hour with a count for each kind of decision."""
    d = F.col("decision")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return rows.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("total"), n(is_in(d, ENFORCEMENT)).alias("enforced")).select(F.col("w.start").alias("bucket"), "total", "enforced")


class DenyCounter(StatefulProcessor):
    """Numbers the denials of each key, and marks those that escalate; state is one number per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.count.get()[0] if self.count.exists() else 0
        for part in rows:
            part = part.sort_values("seq")
            repeat = range(n + 1, n + 1 + len(part))
            n += len(part)
            yield pd.DataFrame({**dict(zip(KEY, key)), "seq": part["seq"], "repeat": list(repeat), "escalated": [r >= 3 for r in repeat]})
        self.count.update((n,))

    def close(self) -> None:
        pass


def escalations(findings: DataFrame) -> DataFrame:
    """Streaming twin of the batch escalation, with the same key; findings without path or attempt share one of each."""
    hits = findings.where(is_in(F.col("decision"), ENFORCEMENT)).fillna({"path": "__pathless__", "attempt": "__unknown_attempt__"}).select(*KEY, "seq")
    schema = ", ".join(f"{c} string" for c in KEY) + ", seq long, repeat long, escalated boolean"
    return hits.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=DenyCounter(), outputStructType=schema, outputMode="Append", timeMode="None")


class Reminder(StatefulProcessor):
    """Lets the first row of each key pass, and again once the key has not been let through for its lifetime."""

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", StructType([StructField("seq", LongType())]), ttlDurationMs=1000 * self.seconds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        seqs = [x for part in rows for x in part["seq"].tolist()]
        if not self.seen.exists():
            self.seen.update((min(seqs),))
            yield pd.DataFrame({"session_id": [key[0]], "topic": [key[1]], "seq": [min(seqs)]})

    def close(self) -> None:
        pass


def reminders(rows: DataFrame, topic: str, seconds: int = 3600) -> DataFrame:
    """Once per session and topic, and again when the state, kept for ``seconds`` of processing time, has expired."""
    keyed = rows.select("session_id", F.col(topic).alias("topic"), "seq").groupBy("session_id", "topic")
    return keyed.transformWithStateInPandas(statefulProcessor=Reminder(seconds), outputStructType="session_id string, topic string, seq long", outputMode="Append", timeMode="ProcessingTime")


class InOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them and handles them in the order of time and ``seq``.

    State is the rows that wait, by time and ``seq``, and one (time, seq, kind) that lives ``seconds`` of event time from when
    it was set; a timer at a row's time takes it up, one after the lifetime clears what is left. Rows later than the watermark are
    dropped by the engine before they come here.
    """

    def __init__(self, seconds: int) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        place = StructType([StructField("at", LongType()), StructField("seq", LongType())])
        kind = StructType([StructField("kind", StringType())])
        self.handle, self.waiting = handle, handle.getMapState("waiting", place, kind)
        self.set = handle.getValueState("set", StructType([*place.fields, *kind.fields]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for at, seq, kind in zip(part["at"].tolist(), part["seq"].tolist(), part["kind"].tolist()):
                self.waiting.updateValue((at, seq), (kind,))
                self.handle.registerTimer(at // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        due = sorted((tuple(place), kind[0]) for place, kind in self.waiting.iterator() if place[0] // 1000 <= now)
        out = []
        for (at, seq), kind in due:
            last = self.set.get() if self.set.exists() else None
            living = last is not None and at // 1_000_000 - last[0] // 1_000_000 <= self.seconds
            kept = self.handled(at, seq, kind, last if living else None)
            if kept is not None:
                out.append((seq, kept))
            self.waiting.removeKey((at, seq))
        if self.set.exists() and (self.set.get()[0] // 1_000_000 + self.seconds + 1) * 1000 <= now:
            self.set.clear()
        if out:
            yield self.frame(key, out)

    def keep(self, at: int, seq: int, kind: str) -> None:
        self.set.update((at, seq, kind))
        self.handle.registerTimer((at // 1_000_000 + self.seconds + 1) * 1000)

    def close(self) -> None:
        pass


class Alive(InOrder):
    """Lets the first row of each key pass, and the first one after what it left has expired."""

    def handled(self, at: int, seq: int, kind: str, last: tuple | None) -> bool | None:
        if last is not None:
            return None
        self.keep(at, seq, kind)
        return True

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"session_id": [key[0]] * len(rows), "topic": [key[1]] * len(rows), "seq": pd.Series([s for s, _ in rows], dtype="int64")})


class Locks(InOrder):
    """Tells for each attempt whether a lock set before it holds: not expired, and no repair plan since."""

    def handled(self, at: int, seq: int, kind: str, last: tuple | None) -> bool | None:
        if kind == "attempt":
            return last is not None and last[2] == "lock"
        self.keep(at, seq, kind)
        return None

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        columns = {"seq": pd.Series([s for s, _ in rows], dtype="int64"), "locked": pd.Series([k for _, k in rows], dtype="bool")}
        return pd.DataFrame({"session_id": [key[0]] * len(rows), **columns})


def _ordered(rows: DataFrame, ts: str, late: str, *key) -> DataFrame:
    marked = rows.withWatermark(ts, late)
    return marked.select(*key, F.col(ts), F.unix_micros(F.col(ts)).alias("at"), "seq", F.col("kind") if "kind" in rows.columns else F.lit("row").alias("kind"))


def alive(rows: DataFrame, topic: str, seconds: int = 3600, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Once per session and topic, and again when that has expired, by event time: the streaming twin of ``ledger.alive``."""
    keyed = _ordered(rows, ts, late, "session_id", F.col(topic).alias("topic")).groupBy("session_id", "topic")
    return keyed.transformWithStateInPandas(statefulProcessor=Alive(seconds), outputStructType="session_id string, topic string, seq long", outputMode="Append", timeMode="EventTime")


def locks_held(marks: DataFrame, seconds: int = 3600, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """``marks(session_id, seq, ts, kind)`` with kinds lock, plan and attempt: the streaming twin of ``ledger.locks_held``."""
    keyed = _ordered(marks, ts, late, "session_id").groupBy("session_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Locks(seconds), outputStructType="session_id string, seq long, locked boolean", outputMode="Append", timeMode="EventTime")


def upsert(path: str, key: list[str]):
    """A ``foreachBatch`` sink that is idempotent by batch: each batch replaces its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(key).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
