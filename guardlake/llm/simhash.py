"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most ``2r`` bits exactly when some value lies
within ``r`` bits of both, so it is enough that every fingerprint emits all values of
its ball of radius ``r`` and that equal values meet. Any two members of a meeting are
within ``2r`` by the triangle inequality; the distance is still checked.

What is shuffled is not each of the 2081 values but the *prefixes* of the ball: values
that share their leading bits travel as one row (fingerprint, prefix, flips used) and
are unfolded by the task that receives the prefix. A prefix that gathers too many
values is refined by further bits until it is light or a whole 64-bit value, at which
depth a meeting has no more than 2081 distinct fingerprints. Copies collapse to one row
per fingerprint first, so a group of exact copies never becomes a group of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm.common import connected_components, few_tasks, saved, table
from guardlake.llm.words import trim

BITS = 64
SEED = 42


def fingerprint(data: bytes, words: int = 4) -> int:
    """SimHash of a text given as UTF-8; 0 for a text without words."""
    return fingerprint_of(data.lower().split(), words)


def fingerprint_of(tokens: list[bytes], words: int) -> int:
    if not tokens:
        return 0
    n = len(tokens) - words + 1
    if n <= 1:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        joined = b" ".join(tokens)
        ends = np.cumsum([len(t) for t in tokens]) + np.arange(len(tokens))
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[i:j], SEED) for i, j in zip(starts, ends[words - 1 :].tolist())]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """``(id, fp)``: fp is the fingerprint's bits as a signed long. Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])
        trim()

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("fp", T.LongType())])
    return src.mapInArrow(run, schema)


def masks(lo: int, hi: int, flips: int) -> dict[int, np.ndarray]:
    """By number of flips: the masks that flip exactly so many of the bits [lo, hi), bit 0 leading."""
    bit = [1 << (BITS - 1 - i) for i in range(lo, hi)]
    return {k: np.array([sum(c) for c in combinations(bit, k)] or [0] * (k == 0), np.uint64) for k in range(flips + 1)}


def _expand(lo: int, hi: int, radius: int):
    """Rows (fp, key, used) to rows whose key also fixes the bits [lo, hi) of the value."""
    ms = masks(lo, hi, radius)
    keep = np.uint64(((1 << hi) - 1) << (BITS - hi))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                fp, key = (np.asarray(b.column(i)).view(np.uint64) for i in (0, 1))
                used, out = np.asarray(b.column(2)), []
                for k in range(radius + 1):
                    m, ok = ms[k], used <= radius - k
                    if ok.any() and len(m):
                        f = np.repeat(fp[ok], len(m))
                        fixed = np.repeat(key[ok], len(m)) | ((f & keep) & ~np.uint64(((1 << lo) - 1) << (BITS - lo)))
                        out.append((f, fixed ^ np.tile(m, int(ok.sum())), np.repeat(used[ok] + k, len(m))))
                if out:
                    f, v, u = (np.concatenate(x) for x in zip(*out))
                    yield pa.record_batch([pa.array(f.view(np.int64)), pa.array(v.view(np.int64)), pa.array(u.astype(np.int32))], names=["fp", "key", "used"])

    return run


def forest(item: np.ndarray, value: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the items (positions in ``fp``) sharing a value as their links do, one per item at most.

    A member more than ``bits`` from the first of its meeting would be no link and is left out.
    """
    order = np.argsort(value, kind="stable")
    value, item = value[order], item[order]
    same = value[1:] == value[:-1]
    member = np.zeros(len(value), bool)
    member[1:] |= same
    member[:-1] |= same
    value, item = value[member], item[member]
    none = np.zeros(0, np.int64)
    if not len(item):
        return none, none
    start = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    first = np.repeat(item[start], np.diff(np.append(start, len(value))))
    linked = (first != item) & (np.bitwise_count(fp[first] ^ fp[item]) <= bits)
    pair = np.unique(np.stack([first[linked], item[linked]]), axis=1)
    label = np.arange(len(fp))
    while True:
        a, b = label[pair[0]], label[pair[1]]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(fp)))
    return label[own], own


def _meet(depth: int, radius: int, most: int):
    """Rows sorted by key, the value's first ``depth`` bits: the connections made by equal values."""
    ms = masks(depth, BITS, radius)
    each = unfolds(depth, radius)
    free = np.uint64((1 << (BITS - depth)) - 1)

    def edges(fp: np.ndarray, key: np.ndarray, used: np.ndarray) -> pa.RecordBatch | None:
        ids, item = np.unique(fp, return_inverse=True)
        values, items = [], []
        for k in range(radius + 1):
            for u in range(radius + 1 - k):
                if (ok := used == u).any() and len(ms[k]):
                    values.append(((key[ok] | (fp[ok] & free))[:, None] ^ ms[k][None, :]).ravel())
                    items.append(np.repeat(item[ok], len(ms[k])))
        a, b = forest(np.concatenate(items), np.concatenate(values), ids, 2 * radius)
        if not len(a):
            return None
        return pa.record_batch([pa.array(ids[a].view(np.int64)), pa.array(ids[b].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                new = (np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)).view(np.uint64), np.asarray(b.column(2)).astype(np.int64))
                held = [np.concatenate(x) for x in zip(held, new)]
                if each[held[2]].sum() >= most:
                    cut = len(held[1]) - int(np.argmax((held[1] != held[1][-1])[::-1])) if (held[1] != held[1][-1]).any() else 0
                    if cut and (out := edges(*(x[:cut] for x in held))) is not None:  # the last key may go on
                        yield out
                    held = [x[cut:] for x in held]
        if len(held[0]) and (out := edges(*held)) is not None:
            yield out
        trim()

    return run


def unfolds(depth: int, radius: int) -> np.ndarray:
    """By flips used: the number of values that a row of this depth stands for."""
    free = BITS - depth
    return np.array([sum(comb(free, k) for k in range(radius - u + 1)) for u in range(radius + 1)], np.int64)


def ball_edges(fps: DataFrame, radius: int = 2, step: int = 12, heavy: int = 1_000_000) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct fingerprints just as all links of up to ``2*radius`` bits do.

    ``heavy`` bounds the values that one prefix unfolds to in one task; it only chooses
    how finely a prefix is split, never what is compared.
    """
    schema = "fp long, key long, used int"
    rows = fps.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("used"))
    found, lo = [], 0
    while True:
        hi = min(lo + step, BITS)
        rows = rows.mapInArrow(_expand(lo, hi, radius), schema)
        light, too_heavy = rows, None
        if hi < BITS:
            rows = light = saved(rows)
            weight = F.element_at(F.array(*map(F.lit, unfolds(hi, radius).tolist())), F.col("used") + 1)
            too_heavy = saved(rows.groupBy("key").agg(F.sum(weight).alias("n")).where(F.col("n") > heavy).select("key"))
            if too_heavy.take(1):
                light = rows.join(too_heavy, "key", "left_anti").select("fp", "key", "used")
            else:
                too_heavy = None
        found.append(light.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(hi, radius, heavy), "a long, b long"))
        if too_heavy is None:
            break
        rows, lo = rows.join(too_heavy, "key", "left_semi").select("fp", "key", "used"), hi
    return reduce(DataFrame.union, found).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 2, tasks: int | None = None) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: documents linked at up to ``2*radius`` differing bits.

    Null and empty texts have fingerprint zero and link like any other; ids repeated in
    the input keep one row each; other columns are not looked at. An empty table gives
    an empty result. ``tasks`` gathers what a scan leaves into so many tasks.
    """
    fp = with_fingerprint(docs, id_col, text_col, words)
    fp = saved(fp.coalesce(tasks) if tasks else fp)
    classes = saved(fp.groupBy("fp").agg(F.min("id").alias("low")))
    comp = connected_components(ball_edges(classes.select("fp"), radius))
    named = classes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = saved(named.join(least, "component").select("fp", "component_id"))
    return fp.join(ids, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return simhash_components(docs, tasks=few_tasks(docs))
