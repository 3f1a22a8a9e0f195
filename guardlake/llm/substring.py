"""Substring dedup: seed on winnowed anchors, extend, remove repeated passages.

A window is ``length`` consecutive words. Its seed is the smallest hash among its
``gram``-word sequences (winnowing), so equal windows have equal seeds, and consecutive
windows with one seed form a run of some words more than ``length``. Documents meet on
seeds only:

1. seeds that occur once in the corpus cannot lie in a repeat, those that occur more
   often can;
2. runs with such a seed are joined on seed and hash: of equal runs all but the first
   are repeats as a whole, which is the extension of a seed to both sides;
3. runs that share the seed but not all words (the ends of a passage) are compared
   window by window among the first runs only.

Between the steps, what is to be looked at again (seeds, runs, windows, documents) is
handed back to the scan as a bitmap of hashes of bounded size, whatever the corpus; a
false positive costs work and changes no result, as every step joins on the keys.
Nothing groups a seed's occurrences in one task: counts and firsts are aggregated before
the shuffle, the joins are plain equi-joins that adaptive execution splits. Windows are
told apart by the seed and a hash of 64 bits from another family, over words that are
themselves told apart by 64-bit hashes of their bytes under either seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm import words as W
from guardlake.llm.common import drop_saved, few_tasks, saved, table

LENGTH, GRAM = 20, 5


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray] | None:
    """The runs of a slice of texts: row, first window's word number in its text, windows, seed,
    hash, whether a window may occur twice in it, the first window's index in ``windows``."""
    start, end, row = W.spans(data, offsets)
    n = len(start)
    if n < length:
        return None
    low = W.windows(W.word_hashes(data, start, end), gram)
    grams, width, have = low, length - gram + 1, 1
    while have < width:
        by = min(have, width - have)
        low, have = np.minimum(low[:-by], low[by:]), have + by
    hashes = W.windows(W.word_hashes(data, start, end, seed=1), length)
    windows = np.arange(n - length + 1)
    whole = row[windows] == row[windows + length - 1]
    new = np.ones(len(windows), bool)
    new[1:] = (low[1:] != low[:-1]) | ~whole[:-1] | (row[windows[1:]] != row[windows[:-1]])
    first = np.flatnonzero(new & whole)
    if not len(first):
        return None
    stop = np.append(np.flatnonzero(new | ~whole), len(windows))
    count = stop[np.searchsorted(stop, first, "right")] - first
    # runs of more than ``length`` windows are cut, so that the first and last window cover a run
    parts = -(-count // length)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first, count = np.repeat(first, parts) + nth * length, np.minimum(np.repeat(count, parts) - nth * length, length)
    seed, last = low[first], first + count - 1
    side = np.arange(width)
    left = first + (grams[first[:, None] + side] == seed[:, None]).argmax(1)
    right = last + width - 1 - (grams[last[:, None] + side[::-1]] == seed[:, None]).argmax(1)
    return {
        "row": row[first], "start": first - np.searchsorted(row, row[first]), "n": count, "seed": seed,
        "hash": W.joined(W.joined(hashes[first], hashes[last]), count.astype(np.uint64)), "twice": left != right, "first": first,
        "windows": hashes,
    }


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).alias("doc"), text.alias("t"))


def _identity(doc: pa.Array, extra: np.ndarray | int = 0) -> np.ndarray:
    """A hash of each document id, and of a number beside it."""
    if pa.types.is_integer(doc.type):
        h = np.asarray(doc.cast(pa.int64())).view(np.uint64)
    else:
        h = np.array([xxhash.xxh64_intdigest(str(x)) for x in doc.to_pylist()], np.uint64)
    return W.mix(W.mix(h) + np.asarray(extra).astype(np.uint64))


def _bitmap(hashes: DataFrame, bits: int | None = None) -> np.ndarray:
    """The leading bits of the longs in column ``h`` as a set of 2**bits bits.

    By default eight to sixteen bits a row, 2 MB at least and 128 MB at most; a set fuller
    than that lets more pass than it need, and changes no result.
    """
    hashes = saved(hashes)
    if bits is None:
        bits = min(max(hashes.count().bit_length() + 3, 24), 30)
    at = F.shiftrightunsigned("h", 64 - bits)
    bit = F.expr(f"shiftleft(1L, int(shiftrightunsigned(h, {64 - bits}) & 63))")
    words = hashes.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(bit).alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["at"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    drop_saved(hashes)
    return out


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(64 - (len(bitmap).bit_length() + 5))
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _seeds(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in W.pieces(b.column(1)):
                if (r := runs(data, offsets, length, gram)) is not None:
                    seed, n = np.unique(r["seed"], return_counts=True)
                    n += np.isin(seed, r["seed"][r["twice"]])
                    yield pa.record_batch([pa.array(seed.view(np.int64)), pa.array(n)], names=["h", "n"])

    return run


def _runs(length: int, gram: int, seeds, instances=None):
    """The runs with one of the seeds, or the given instances of runs with the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, _, data, offsets in W.pieces(b.column(1)):
                if (r := runs(data, offsets, length, gram)) is None:
                    continue
                hit = np.flatnonzero(_in(seeds.value, r["seed"]))
                doc = b.column(0).take(pa.array(at + r["row"][hit]))
                if instances is not None:
                    some = np.flatnonzero(_in(instances.value, r["hash"][hit] ^ _identity(doc, r["start"][hit])))
                    hit, doc = hit[some], doc.take(pa.array(some))
                first, n = r["first"][hit], r["n"][hit]
                out = [doc, pa.array(r["start"][hit].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(r["seed"][hit].view(np.int64)), pa.array(r["hash"][hit].view(np.int64)), pa.array(r["twice"][hit])]
                if instances is not None:
                    ends = np.append(0, np.cumsum(n))
                    each = np.repeat(first - ends[:-1], n) + np.arange(ends[-1])
                    out.append(pa.Array.from_buffers(pa.binary(), len(hit), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(r["windows"][each]))]))
                yield pa.record_batch(out, names=["doc", "start", "n", "seed", "hash", "twice", "windows"][: len(out)])

    return run


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h = np.asarray(b.column("hash")).view(np.uint64) ^ _identity(b.column("doc"), np.asarray(b.column("start")))
        yield pa.record_batch([pa.array(h.view(np.int64))], names=["h"])


def _unfold(windows=None, all_columns: bool = True):
    """A row for each window of a run, or for those in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                n = np.asarray(b.column("n")).astype(np.int64)
                row = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                w = np.frombuffer(b"".join(b.column("windows").to_pylist()), np.int64)
                if not all_columns:
                    yield pa.record_batch([pa.array(w)], names=["h"])
                    continue
                hit = np.flatnonzero(_in(windows.value, w.view(np.uint64)))
                row, start = row[hit], np.asarray(b.column("start"))[row[hit]] + step[hit]
                yield pa.record_batch([b.column("seed").take(pa.array(row)), pa.array(w[hit]), b.column("doc").take(pa.array(row)), pa.array(start.astype(np.int32))], names=["seed", "w", "doc", "start"])

    return run


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, bits: int | None = None, tasks: int | None = None
) -> DataFrame:
    """``(id_col, start, end)``: word ranges, not merged, covered by windows that also start earlier.

    Earlier is a smaller id, or the same id and an earlier word. Rows with a null id
    take no part; rows that repeat an id count as one document. ``bits`` sizes the bitmaps
    (by default from what they hold), ``tasks`` gathers what a scan leaves into so many tasks.
    """
    send = docs.sparkSession.sparkContext.broadcast
    src = _texts(docs, id_col, text_col).where("doc is not null")
    long, integer = T.LongType(), T.IntegerType()
    key = ["seed", "hash"]
    run = [
        src.schema["doc"], T.StructField("start", integer), T.StructField("n", integer),
        *(T.StructField(c, long) for c in key), T.StructField("twice", T.BooleanType()),
    ]
    scanned = lambda step, fields: src.mapInArrow(step, T.StructType(fields)).coalesce(tasks) if tasks else src.mapInArrow(step, T.StructType(fields))
    common = src.mapInArrow(_seeds(length, gram), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    seeds = send(_bitmap(common, bits))
    found = saved(scanned(_runs(length, gram, seeds), run))
    first = found.groupBy(*key).agg(F.min(F.struct("doc", "start")).alias("f"), F.count("*").alias("k"), F.max("twice").alias("twice"))
    first = saved(first.select(*key, F.col("f.doc").alias("d0"), F.col("f.start").alias("s0"), "k", "twice"))
    again = found.select("doc", "start", "n", *key).join(first.where("k > 1").select(*key, "d0", "s0"), key).where("doc <> d0 or start <> s0")
    copies = saved(again.select("doc", "start", (F.col("start") + F.col("n") + (length - 1)).alias("end")))
    several = first.groupBy("seed").agg(F.count("*").alias("m"), F.max("twice").alias("t")).where("m > 1 or t").select("seed")
    several = saved(several)  # then the join below deals both sides out plainly, and a hot seed can be split
    ends = saved(first.join(several, "seed").select(F.col("d0").alias("doc"), F.col("s0").alias("start"), "hash"))
    instances = send(_bitmap(ends.mapInArrow(_instances, "h long"), bits))
    drop_saved(found, first, several, ends)
    ends = saved(scanned(_runs(length, gram, seeds, instances), [*run, T.StructField("windows", T.BinaryType())]))
    more = ends.mapInArrow(_unfold(all_columns=False), "h long").groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    each = T.StructType([T.StructField("seed", long), T.StructField("w", long), run[0], run[1]])
    single = ends.mapInArrow(_unfold(send(_bitmap(more, bits))), each)
    least = single.groupBy("seed", "w").agg(F.min(F.struct("doc", "start")).alias("f"), F.count("*").alias("k")).where("k > 1")
    least = saved(least.select("seed", "w", F.col("f.doc").alias("d0"), F.col("f.start").alias("s0")))
    late = single.join(least, ["seed", "w"]).where("doc <> d0 or start <> s0").select("doc", "start", (F.col("start") + length).alias("end"))
    return copies.union(late).withColumnRenamed("doc", id_col)


def _merged(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in found or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                n_words, n_removed, kept = [], [], []
                for text, found in zip(b.column(1), b.column(2) if b.num_columns > 2 else repeat(None)):
                    ws = text.as_py().split()
                    n_words.append(len(ws))
                    for s, e in reversed(_merged(found.as_py() if found is not None else None)):
                        del ws[s:e]
                    n_removed.append(n_words[-1] - len(ws))
                    text = b" ".join(ws)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text)
                yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())], names=["doc", "n_words", "n_removed", "kept"])

    return run


def _only(bitmap, inside: bool):
    """The rows whose document is, or is not, in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_in(bitmap.value, _identity(b.column(0).fill_null(0 if pa.types.is_integer(b.column(0).type) else ""))) == inside))

    return run


def _doc_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([pa.array(_identity(b.column(0)).view(np.int64))], names=["h"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digest: bool = False, bits: int | None = None, tasks: int | None = None
) -> DataFrame:
    """``(id_col, n_words, n_removed, kept_text)`` per row: the words outside repeated passages, joined by one space.

    With ``digest`` the last column is ``kept_sha256``. Null and empty texts have no words;
    texts shorter than ``length`` words keep all; an empty table gives an empty result.
    Only documents with repeats are shuffled with their text.
    """
    spans = repeated_spans(docs, id_col, text_col, length, bits=bits, tasks=tasks)
    found = saved(spans.groupBy(F.col(id_col).alias("doc")).agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    with_spans = docs.sparkSession.sparkContext.broadcast(_bitmap(found.select("doc").mapInArrow(_doc_hashes, "h long"), bits))
    src = _texts(docs, id_col, text_col)
    kept_type = T.StringType() if digest else T.BinaryType()
    out = T.StructType([src.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", kept_type)])
    untouched, kept_words = _only(with_spans, False), _kept(digest)
    whole = src.mapInArrow(lambda batches: kept_words(untouched(batches)), out)
    cut = src.mapInArrow(_only(with_spans, True), src.schema).join(found, "doc", "left").select("doc", "t", "spans").mapInArrow(_kept(digest), out)
    kept = F.col("kept").alias("kept_sha256") if digest else F.col("kept").cast("string").alias("kept_text")
    return whole.union(cut).select(F.col("doc").alias(id_col), "n_words", "n_removed", kept)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return remove_repeats(docs, digest=True, tasks=few_tasks(docs))
