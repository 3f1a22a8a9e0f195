"""Mixing sources to target weights with a curriculum that changes over training time.

Each source follows a schedule of weights over training time from 0 to 1. The integral of the
schedule is the source's weight; weights share out the words of all documents, up to a number of
passes over a source. A source's documents form a stream in the order of a hash, repeated pass
after pass; its first words, as many as its target, are what the mix takes. The demand for them
grows with the integral of the schedule; a document's training position is the time at which the
demand reaches its place in the stream, and the documents are sorted by it. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardlake.llm.common import saved, table

Schedule = list[tuple[float, float]]
#: Times and weights, linear in between; sources take the schedules in turn. The integrals are the weights 5, 2 and 1.
SCHEDULES: list[Schedule] = [
    [(0.0, 7.5), (1.0, 2.5)],
    [(0.0, 2.0), (1.0, 2.0)],
    [(0.0, 0.5), (0.5, 0.75), (1.0, 2.0)],
]
PASSES = 3
#: Distinct documents of a source that one bucket of its stream holds, about, and copies of one that a task lists.
BUCKET, COPIES = 4096, 65_536
WORD = r"[^\x20\x09-\x0D]+"


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]))


def time_of(schedule: Schedule, share: Column) -> Column:
    """The time by which the schedule has integrated to ``share`` of its whole: the segment, then its quadratic."""
    total, done, out = integral(schedule), 0.0, F.lit(schedule[-1][0])
    pieces = []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        slope, rest = (w1 - w0) / (t1 - t0), share * total - done
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        at = F.lit(t0) + F.coalesce(F.try_divide(2 * rest, F.lit(w0) + root), F.lit(0.0))
        done += area
        pieces.append((share * total <= done, F.least(F.greatest(at, F.lit(t0)), F.lit(t1))))
    for inside, at in reversed(pieces):
        out = F.when(inside, at).otherwise(out)
    return out


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` from 0 by code point, null last: places within ranges of a sort, and the ranges' counts."""
    parts = saved(sources.orderBy(F.asc_nulls_last("source")).withColumn("place", F.monotonically_increasing_id()))
    parts = parts.withColumn("range", F.shiftright("place", 33))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy("range").agg(F.count("*").alias("n"), F.min("place").alias("first"))  # a row per range, not per source
    counts = counts.select("range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return parts.join(F.broadcast(counts), "range").withColumn("rank", F.col("earlier") + F.col("place") - F.col("first")).drop("range", "place", "first", "earlier")


def targets(sources: DataFrame, weights: list[float], passes: int = PASSES) -> DataFrame:
    """``(source, source_size, documents)`` with ``turn`` and ``target``.

    Sources take the weights in turn. All words are shared by weight; a target stops at ``passes`` times its source's size
    and the excess is shared among the others by weight until none is above. What is capped stays so, hence each round
    only sums over the sources.
    """
    turn = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    known = saved(
        _ranked(sources).select(
            "source", "source_size", "documents", turn.alias("turn"), (F.lit(passes) * F.col("source_size")).alias("most"),
            reduce(lambda rest, i: F.when(turn == i, float(weights[i])).otherwise(rest), range(len(weights)), F.lit(0.0)).alias("weight"),
        )
    )
    total, level, capped = known.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        above = (F.col("most") == 0) | (F.lit(level) * F.col("weight") > F.col("most"))
        r = known.agg(F.count(F.when(above, 1)), F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight")))).first()
        if r[0] == capped or not r[2]:
            break
        capped, level = r[0], (total - (r[1] or 0)) / r[2]
    target = F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double"))
    return known.select("source", "source_size", "documents", "turn", target.alias("target"))


def _streams(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Classes of equal rows ``(source, hash, id, size, copies)``, and ``(source, source_size, documents)``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    rows = docs.select(F.col(source_col).alias("source"), key.alias("hash"), F.col(id_col).alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    classes = saved(rows.groupBy("source", "hash", "id", "size").agg(F.count("*").alias("copies")))
    sources = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("documents"))
    return classes, sources


def _placed(classes: DataFrame, known: DataFrame) -> DataFrame:
    """``classes`` with their source's columns and ``start``, the words before them in one pass over the source's stream.

    The stream of a source is cut into buckets of hashes, so no task holds a whole source: words add up within
    buckets, and over the buckets of a source.
    """
    same = F.col("classes.source").eqNullSafe(F.col("known.source"))
    joined = classes.alias("classes").join(known.alias("known"), same).select("classes.*", "source_size", "documents", "turn", "target")
    leading = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    buckets = F.ceil(F.col("documents") / F.lit(BUCKET))
    words = (F.col("size") * F.col("copies")).alias("words")
    joined = joined.select("*", words, F.shiftright(leading * buckets, 32).alias("bucket"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = joined.groupBy("source", "bucket").agg(F.sum("words").alias("n"))
    totals = totals.select(F.col("source").alias("of"), F.col("bucket").alias("cut"), F.coalesce(F.sum("n").over(before(Window.partitionBy("source").orderBy("bucket"))), F.lit(0)).alias("earlier"))
    inside = before(Window.partitionBy("source", "bucket").orderBy("hash", F.asc_nulls_last("id"), "size"))
    placed = joined.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    with_totals = placed.join(totals, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("cut")))
    return with_totals.withColumn("start", F.col("earlier") + F.col("inside")).drop("of", "cut", "earlier", "inside", "bucket", "words", "documents")


def curriculum(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    schedules: list[Schedule] | None = None, passes: int = PASSES,
) -> DataFrame:
    """``(id_col, source_col, hash, size, source_size, target, taken, position)``: a row per document, by ``position``.

    ``size`` is the number of words, a null text has none. ``taken`` counts the words that the mix takes over all passes: a
    source's ``taken`` sum to its target rounded down, the last document taken being cut. ``position`` is the training time
    of a document's first word in its first pass, null if nothing of it is taken; :func:`occurrences` has all passes. Null
    is a source of its own, the last; ids may be null or repeat. Rows equal in id, text and source take neighbouring places.
    ``hash`` tells id and text apart. Other columns are not read; an empty table gives no rows.
    """
    schedules = schedules or SCHEDULES
    classes, sources = _streams(docs, id_col, text_col, source_col)
    placed = _placed(classes, targets(sources, [integral(s) for s in schedules], passes))
    # copies of one document are listed from their count, many of them in parts of their own
    parts = F.sequence(F.lit(0), F.ceil(F.col("copies") / COPIES) - 1)
    placed = placed.select("*", F.explode(parts).alias("part"))
    end = F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1
    each = placed.select("*", F.explode(F.sequence(F.col("part") * COPIES, end)).alias("copy")).withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    quota = F.floor(F.col("target") + F.lit(1e-6))
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0))
    rest = quota - whole * F.col("source_size") - F.col("start")
    taken = whole * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    out = each.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "hash", "size", "source_size", "target", taken.cast("long").alias("taken"), "turn", "start",
    )
    return out.select(
        id_col, source_col, "hash", "size", "source_size", "target", "taken", _position(schedules, F.col("start")).alias("position"), "start", "turn"
    ).orderBy(F.asc_nulls_last("position"), "hash", F.asc_nulls_last(source_col))


def _position(schedules: list[Schedule], offset: Column) -> Column:
    """The time at which a source's demand reaches a word of its stream, null beyond the words taken."""
    share = F.try_divide(offset.cast("double"), F.col("target"))
    at = reduce(lambda rest, i: F.when(F.col("turn") == i, time_of(schedules[i], share)).otherwise(rest), range(len(schedules)), F.lit(None).cast("double"))
    return F.when((F.col("taken") > 0) & (offset < F.col("target")), at)


def occurrences(plan: DataFrame, schedules: list[Schedule] | None = None) -> DataFrame:
    """Rows of :func:`curriculum`, one for each pass that takes words of the document: with ``pass``, ``words`` and that
    pass's ``position``, range-sorted by it. This is the order of training; texts join by id and ``hash``."""
    # a document is in as many passes as its words fit into what is taken, rounded up
    passes = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    each = plan.where("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), passes)))
    words = F.least(F.col("size"), F.col("taken") - (F.col("pass") - 1) * F.col("size")).cast("long")
    offset = F.col("start") + (F.col("pass") - 1) * F.col("source_size")
    each = each.withColumn("words", words).withColumn("position", _position(schedules or SCHEDULES, offset))
    return each.orderBy("position", "hash", "pass")


def training_order(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(position, pass, words, id_col, text_col)`` of :func:`occurrences` over documents: the texts in the order of training."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    texts = docs.select(key.alias("hash"), F.col(text_col)).dropDuplicates(["hash"])
    return occurrences(plan).join(texts, "hash").select("position", "pass", "words", id_col, text_col).orderBy("position", "pass")


def op12_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def oracle() -> str:
    """DuckDB SQL of the query. The level of the shares is the largest that any set of capped sources, cheapest first, asks for."""
    cases = []
    for turn, schedule in enumerate(SCHEDULES):
        total, done, whens = integral(schedule), 0.0, ""
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
            slope, rest = (w1 - w0) / (t1 - t0), f"(start / target * {total} - {done})"
            at = f"{t0} + coalesce(2 * {rest} / nullif({w0} + sqrt(greatest({w0 * w0} + 2 * {slope} * {rest}, 0)), 0), 0)"
            done += (t1 - t0) * (w0 + w1) / 2
            whens += f" when start / target * {total} <= {done} then least(greatest({at}, {t0}), {t1})"
        cases.append(f"when turn = {turn} then case {whens} else {schedule[-1][0]} end")
    weights = " ".join(f"when {i} then {integral(s)}" for i, s in enumerate(SCHEDULES))
    return rf"""
with rows as (
  select doc_id, source, md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as hash,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size
  from documents
),
sizes as (select source, sum(size)::bigint as source_size from rows group by source),
turns as (select *, (row_number() over (order by source nulls last) - 1) % {len(SCHEDULES)} as turn from sizes),
weighed as (select *, (case turn {weights} end)::double as weight, {PASSES} * source_size as most from turns),
capped as (
  select sum(most) over w - most as used, sum(weight) over () - (sum(weight) over w - weight) as open
  from weighed window w as (order by most / weight, source nulls last rows unbounded preceding)
),
level as (select greatest(max(((select sum(source_size) from sizes) - used) / open), 0) as level from capped),
shared as (select source, source_size, turn, least(weight * level, most)::double as target from weighed, level),
placed as (
  select r.*, s.source_size, s.turn, s.target, floor(s.target + 1e-6)::bigint as quota,
    (sum(r.size) over (partition by r.source order by r.hash, r.doc_id nulls last, r.size rows unbounded preceding) - r.size)::bigint as start
  from rows r join shared s on r.source is not distinct from s.source
),
counted as (
  select *, case when source_size > 0 then quota // source_size else 0 end as whole from placed
),
taking as (
  select *, (whole * size + least(greatest(quota - whole * source_size - start, 0), size))::bigint as taken from counted
)
select doc_id, size, source_size, target, taken,
  case when taken > 0 and start < target then case {' '.join(cases)} end end as position
from taking
"""
