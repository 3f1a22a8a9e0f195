"""Hard-negative mining by blocked dense products.

Blocks of anchors are broadcast to tasks that stream the candidates: each product of an anchor
block and a candidate block is one matrix product in double precision, exact below 2**53. A first
pass keeps the best rows of an anchor's own label, five per task, and merges them. A second pass
keeps, for every anchor and positive, the best rows of other labels whose score lies in the
positive's window. Rows whose entries are too large for an exact product are multiplied as
Python integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guardlake.llm.common import drop_saved, few_tasks, saved, shared_dir, table
from guardlake.llm.whitening import EXACT, by_length, finite, integers, matrix

#: Bytes of an anchor block, its rows at most, and scores of one product.
BLOCK_BYTES, BLOCK_ROWS, SCORES = 16 << 20, 4096, 2 << 20
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows as longs, held at the ends of long."""
    top = lambda m: max(abs(int(m.max())), abs(int(m.min())), 1)
    if top(a) * top(c) * a.shape[1] < EXACT:
        return (a.astype(float) @ c.astype(float).T).astype(np.int64)
    # entries too large for doubles; rows of small entries keep the fast product
    small_a, small_c = (np.abs(m.astype(float)).max(axis=1) ** 2 * a.shape[1] < EXACT / 4 for m in (a, c))
    out = np.empty((len(a), len(c)), np.int64)
    for some_a in (small_a, ~small_a):
        for some_c in (small_c, ~small_c):
            if not some_a.any() or not some_c.any():
                continue
            x, y = a[some_a], c[some_c]
            if some_a is small_a and some_c is small_c:
                part = (x.astype(float) @ y.astype(float).T).astype(np.int64)
            else:
                part = np.minimum(np.maximum(x.astype(object) @ y.astype(object).T, LEAST), MOST).astype(np.int64)
            out[np.ix_(some_a, some_c)] = part
    return out


class Best:
    """The first ``k`` candidates of each group: higher scores first, ties by smaller id, then by row."""

    def __init__(self, groups: int, k: int) -> None:
        self.k = k
        self.worst = np.full(groups, LEAST, np.int64)  # the k-th score so far
        self.kept: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(5))  # group, score, id, row, whether the id is null

    def offer(self, *new: np.ndarray) -> None:
        g, s, i, r, null = (np.concatenate([a, b]) for a, b in zip(self.kept, new))
        order = np.lexsort((r, i, null, ~s, g))  # ~s falls as s rises, without overflow
        g, s, i, r, null = g[order], s[order], i[order], r[order], null[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
        place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
        keep = place < self.k
        self.kept = g[keep], s[keep], i[keep], r[keep], null[keep]
        full = place == self.k - 1
        self.worst[g[full]] = s[full]


def _hits(ok: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidates that can be among a row's first ``k``: all that tie with its k-th score too."""
    if scores.shape[1] > k:
        masked = np.where(ok, scores, LEAST)
        kth = np.partition(masked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        ok = ok & (scores >= kth[:, None])
    return np.nonzero(ok)


class Anchors:
    """A block of anchors of one length, with the scores of their positives once they are known."""

    def __init__(self, row: np.ndarray, label: np.ndarray, x: np.ndarray) -> None:
        self.row, self.label, self.x = row, label, x
        #: Of each pair of anchor and positive: the anchor's place, the least and the largest score of a negative.
        self.pairs: np.ndarray | None = None
        self.low = self.high = np.zeros(0, np.int64)


def _scan(anchors: Anchors, dim: int, k: int):
    """The first ``k`` positives of each anchor, or negatives of each pair, that a task sees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = anchors.pairs
        best = Best(len(anchors.row) if pairs is None else len(pairs), k)
        step = max(64, SCORES // max(len(anchors.row), 1))
        for d, t in by_length(batches, "x"):
            if d != dim:
                continue
            x = np.concatenate([matrix(c) for c in t["x"].chunks])
            row, label = t["row"].to_numpy(), t["label"].to_numpy()
            own = t["id"].fill_null(0).to_numpy(), row, t["id"].is_null().to_numpy().astype(np.int64)
            for at in range(0, len(x), step):
                part = slice(at, at + step)
                scores = products(anchors.x, x[part])
                same = anchors.label[:, None] == label[part]
                if pairs is None:
                    ok = same & (anchors.row[:, None] != row[part]) & (scores >= best.worst[:, None])
                    g, c = _hits(ok, scores, k)
                    best.offer(g, scores[g, c], *(v[part][c] for v in own))
                    continue
                some = max(1, SCORES // scores.shape[1])
                for first in range(0, len(pairs), some):
                    p = np.arange(first, min(first + some, len(pairs)))
                    s = scores[pairs[p]]
                    ok = (s >= np.maximum(anchors.low[p], best.worst[p])[:, None]) & (s <= anchors.high[p][:, None]) & ~same[pairs[p]]
                    g, c = _hits(ok, s, k)
                    best.offer(p[g], s[g, c], *(v[part][c] for v in own))
        g, s, i, r, null = best.kept
        ids = pa.array(i, mask=null.astype(bool))
        yield pa.RecordBatch.from_pydict({"at": pa.array(g, pa.int32()), "score": pa.array(s), "row": pa.array(r), "id": ids})

    return run


#: What a scan returns: the place of an anchor or pair, and a candidate for it.
FOUND = "at int, score long, row long, id long"


def _first(found: DataFrame, k: int) -> DataFrame:
    """Tasks' candidates merged: ``(at, rank, score, row, id)`` of the first ``k`` of each group."""
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("at", "rank", "score", "row", "id")


def hard_negatives(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor: str = "vec_id % 100 = 0",
    scale: float = 256, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5),
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Scores are inner products of ``floor(scale * x)``, held at the ends of long. Rows fitting the condition ``anchor`` are
    anchors. Negatives score at least ``share`` of the positive and at most as much. Rows with a null label or vector, or a
    null or non-finite entry, take no part; nor do empty vectors. Vectors of another length are not compared. Every row counts
    for itself, repeated ones too; rows with a null id take part, last among ties, and are no anchors unless the condition says so.
    An anchor without positives, or a positive without negatives, has no rows. Other columns are not read.
    """
    label = F.col(label_col).cast("long")
    cols = [F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(F.expr(anchor), F.lit(False)).alias("anchor")]
    rows = df.select(*cols).where(F.col("label").isNotNull() & finite(F.col("v")))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", integers(F.col("v"), scale).alias("x"))
    rows = saved(rows)
    lengths = rows.where("anchor").groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()
    base, blocks = shared_dir(df.sparkSession), []
    for dim, n in sorted(lengths):
        size = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
        count = -(-n // size)
        own = rows.where(F.col("anchor") & (F.size("x") == dim)).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)))
        dealt = saved(own.repartition("block").select("block", "row", "id", "label", "x")) if count > 1 else own
        for block in range(count):
            path = f"{base}/{dim}-{block}"
            _mined(rows, dealt.where(F.col("block") == block), dim, positives, negatives, share).write.parquet(path)
            blocks.append(path)
        if count > 1:
            drop_saved(dealt)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    out = df.sparkSession.read.schema(schema).parquet(*blocks) if blocks else df.sparkSession.createDataFrame([], schema)
    return out


def _mined(rows: DataFrame, block: DataFrame, dim: int, positives: int, negatives: int, share: tuple[int, int]) -> DataFrame:
    """Both passes over all rows for one block of anchors, whose rows and positives pass through the driver."""
    t = block.select("row", "id", "label", "x").toArrow()
    anchors = Anchors(t["row"].to_numpy(), t["label"].to_numpy(), np.concatenate([matrix(c) for c in t["x"].chunks]) if t.num_rows else np.zeros((0, dim), np.int64))
    ids = t["id"].to_pylist()
    spark, scanned = rows.sparkSession, rows.select("row", "id", "label", "x").where(F.size("x") == dim)
    scanned = scanned.coalesce(few_tasks(scanned))
    found = _first(scanned.mapInArrow(_scan(anchors, dim, positives), FOUND), positives).collect()
    anchors.pairs = np.array([r["at"] for r in found], np.int64)
    times, of = share
    anchors.high = np.array([r["score"] for r in found], np.int64)
    anchors.low = np.array([min(-(-times * r["score"] // of), MOST) for r in found], np.int64)
    pairs = spark.createDataFrame(
        [(i, ids[r["at"]], r["id"], r["score"]) for i, r in enumerate(found)], "at int, anchor_id long, positive_id long, positive_score long"
    )
    best = _first(scanned.mapInArrow(_scan(anchors, dim, negatives), FOUND), negatives)
    return best.join(pairs, "at").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


ORACLE = """
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda c: floor(256 * c::double)::double) as x
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.x, b.x)::bigint as score
  from good a join good b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select p.anchor_id, p.positive_id,
  row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id)::integer as rank,
  s.other_id as negative_id, p.positive_score, s.score as negative_score
from positives p join scored s on s.anchor_id = p.anchor_id and not s.same
  and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) <= 5
"""
