"""Quality and toxicity by hierarchical empirical Bayes.

A document classifier gives evidence for each document: a logistic regression on hashed
words, word beginnings and style classes, of which those are kept whose counts over
labelled documents are far from chance. Sites give the rest: means
over all documents of a path are shrunk towards the host's, the host's towards the global
mean, with weights estimated from the spread of hosts (method of moments), so a sparse
site says little. The document's own share is left out of its site's mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from guardlake.llm import words as W
from guardlake.llm.common import saved, table

#: Labelled documents that the classifier is fitted on (those with the smallest hashes), and features kept per target.
#: Labelled rows that the document classifier is fitted on at most.
MAX_LABELLED = 20_000
TARGETS = ("low", "toxic")

_byte = np.arange(256)
ALNUM = (_byte >= 48) & (_byte <= 57) | (_byte >= 65) & (_byte <= 90) | (_byte >= 97) & (_byte <= 122) | (_byte >= 128)
UPPER = (_byte >= 65) & (_byte <= 90)
LETTER = UPPER | (_byte >= 97) & (_byte <= 122) | (_byte >= 128)
FOLD = np.where(UPPER, _byte + 32, _byte).astype(np.uint8)


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[offsets])


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and rows, repeats included."""
    start, end, row = W.spans(data, offsets, ~ALNUM)
    folded, long = FOLD[data], end - start >= 5
    word = W.word_hashes(folded, start, end)
    begin = W.word_hashes(folded, start[long], start[long] + 5, seed=1)
    n_words = np.bincount(row, minlength=len(offsets) - 1)
    same = np.bincount(row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])], minlength=len(offsets) - 1)
    size, letters = np.diff(offsets), _per_row(LETTER[data], offsets)
    marks = [_per_row(data == c, offsets) for c in b"!|&#$%*<>{}@/0"]
    ratios = [_per_row(UPPER[data], offsets) / np.maximum(letters, 1), letters / np.maximum(size, 1), same / np.maximum(n_words, 1), size / np.maximum(n_words, 1) / 40, *(m / np.maximum(n_words, 1) for m in marks)]
    rows = np.arange(len(size))
    style = [W.mix((np.minimum(np.ceil(r * 20), 20) + 100 * i + 7).astype(np.uint64)) for i, r in enumerate(ratios)]
    return np.concatenate([word, begin, *style]), np.concatenate([row, row[long], *[rows] * len(style)])


def _texts(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("t"), *more)


def _sampled(labels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = labels.value
        for b in batches:
            hit = [i for i, x in enumerate(b.column(0).to_pylist()) if x in known]
            b = b.take(pa.array(hit, pa.int64()))
            for at, n, data, offsets in W.pieces(b.column(1)) if hit else ():
                f, row = features(data, offsets)
                both = np.unique(np.stack([row.astype(np.uint64), f]), axis=1)
                at_row = np.searchsorted(both[0], np.arange(n + 1))
                lists = pa.ListArray.from_arrays(pa.array(at_row, pa.int32()), pa.array(both[1].view(np.int64)))
                ys = [known[x] for x in b.column(0).slice(at, n).to_pylist()]
                yield pa.record_batch([pa.array([y[0] for y in ys], pa.int32()), pa.array([y[1] for y in ys], pa.int32()), lists], names=["low", "toxic", "f"])

    return run


def _known(key: np.ndarray, f: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, in order, and places in the sorted ``key`` of the distinct known features."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(key, f), len(key) - 1)
    hit = key[place] == f
    pair = np.unique(row[hit] * len(key) + place[hit])
    return pair // len(key), pair % len(key)


def _logistic(row: np.ndarray, col: np.ndarray, width: int, y: np.ndarray, ridge: float = 0.3, steps: int = 200) -> np.ndarray:
    """Weights and offset of a ridge logistic regression on sparse zero-one features, by accelerated gradient steps."""
    times = lambda v: np.bincount(row, weights=v[col], minlength=len(y)) + v[-1]
    back = lambda g: np.append(np.bincount(col, weights=g[row], minlength=width), g.sum())
    shrink = np.append(np.full(width, ridge), 1e-6)
    v, top = np.ones(width + 1), 1.0
    for _ in range(15):  # the largest eigenvalue bounds the step
        v = back(times(v))
        top = np.linalg.norm(v)
        v /= top
    rate = 1 / (top / 4 + ridge)
    w = ahead = np.zeros(width + 1)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(ahead), -35, 35)))
        new = ahead - rate * (back(p - y) + shrink * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> dict | None:
    """The document classifier, on every feature that tells a label better than chance; null, and rows without ``quality`` or ``toxic``, are left out. None without labels."""
    known = labels.where("quality is not null and toxic is not null").groupBy(id_col).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where(F.col(id_col).isNotNull())
    known = saved(known)
    # the smallest hashes: a range of them that holds a few more, so that no task merges many partitions' smallest
    share = min(1.0, 1.2 * (max_labelled + 1000) / max(known.count(), 1))
    low = known.where(F.xxhash64(id_col) <= int(-(2**63) + share * (2**64 - 1025)))
    sample = {r[0]: (int(r["q"] == 0), int(r["t"] != 0)) for r in low.orderBy(F.xxhash64(id_col), id_col).limit(max_labelled).collect()}
    spark = docs.sparkSession
    seen = saved(_texts(docs, id_col, text_col).mapInArrow(_sampled(spark.sparkContext.broadcast(sample)), "low int, toxic int, f array<long>"))
    totals = seen.agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).first()
    if not totals["n"]:
        return None
    n = totals["n"]
    counts = seen.select(*TARGETS, F.explode("f").alias("f")).groupBy("f").agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TARGETS))
    gains = []
    for t in TARGETS:
        pos, neg = float(totals[t] or 0), float(n - (totals[t] or 0))
        a, b = F.col(t) + 0.0, F.col("n") - F.col(t) + 0.0
        share = lambda x, rate: F.when(x > 0, x * F.log(x / (F.col("n") * rate))).otherwise(0.0)
        absent = lambda x, whole, rate: F.when(whole - x > 0, (whole - x) * F.log((whole - x) / ((n - F.col("n")) * rate))).otherwise(0.0)
        gains.append(2 * (share(a, pos / n) + share(b, neg / n) + absent(a, pos, pos / n) + absent(b, neg, neg / n)) if pos and neg else F.lit(0.0))
    scored = saved(counts.where(F.col("n") > 2).select("f", *(g.alias(t) for g, t in zip(gains, TARGETS))))
    floor = float(2 * np.log(scored.count() + 1) + 4)  # far above what chance gives so many features
    best = [scored.where(F.col(t) > floor).select("f").toArrow()["f"].to_numpy() for t in TARGETS]
    key = np.unique(np.concatenate(best).view(np.uint64))
    shared = spark.sparkContext.broadcast(key)

    def known_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = shared.value
        for b in batches:
            f = b.column("f")
            row, place = _known(key, np.asarray(f.flatten()).view(np.uint64), np.repeat(np.arange(len(f)), np.asarray(f.value_lengths())))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(f) + 1)), pa.int32()), pa.array(place.astype(np.int32)))
            yield pa.record_batch([b.column("low"), b.column("toxic"), lists], names=["low", "toxic", "at"])

    rows = seen.mapInArrow(known_features, "low int, toxic int, at array<int>").toArrow().combine_chunks()  # bounded by max_labelled
    at = rows["at"].combine_chunks()
    at = at.chunk(0) if isinstance(at, pa.ChunkedArray) else at
    row, place = np.repeat(np.arange(rows.num_rows), np.asarray(at.value_lengths())), np.asarray(at.flatten())
    weight, offset = np.zeros((len(key), len(TARGETS))), []
    for j, t in enumerate(TARGETS):
        own = np.searchsorted(key, np.sort(best[j].view(np.uint64)))
        column = np.full(len(key), -1)
        column[own] = np.arange(len(own))
        mine = column[place] >= 0
        w = _logistic(row[mine], column[place[mine]], len(own), rows[t].to_numpy().astype(np.float64))
        weight[own, j] = w[:-1]
        offset.append(float(w[-1]))
    return {"key": key, "weight": weight, "offset": offset}


def _rated(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            for at, n, data, offsets in W.pieces(b.column(1)):
                f, row = features(data, offsets)
                hit, place = _known(m["key"], f, row)
                e = [np.bincount(hit, weights=m["weight"][place, j], minlength=n) + m["offset"][j] for j in range(len(TARGETS))]
                p = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in e]
                yield pa.record_batch([b.column(0).slice(at, n), *(b.column(i).slice(at, n) for i in (2, 3)), *map(pa.array, p)], names=["id", "host", "path", *TARGETS])

    return run


def _pull(between: float, groups: int, freedom: float, mean: float) -> float:
    """How many documents the broader mean weighs: the variance within groups over that between them, by moments."""
    within = mean * (1 - mean)
    variance = max((between - groups * within) / freedom, 1e-9) if freedom > 0 else 1e-9
    return min(max(within / variance - 1, 1.0), 1e6)


def _logit(c):
    return F.log(c / (1 - c))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", most: float = 0.5, site: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``(id_col, doc_low, doc_toxic, low, toxic, keep)``: the document's own and the fused probabilities.

    ``path_col`` names a part of the host; a null host or path is a site of its own.
    ``site`` scales what sites add to the log odds. Null texts have style features only;
    rows that repeat each count. Without labels all probabilities are null and all are kept.
    """
    model = fit(docs, labels, id_col, text_col, max_labelled)
    if model is None:
        null = F.lit(None).cast("double")
        return docs.select(id_col, *(null.alias(c) for c in ("doc_low", "doc_toxic", "low", "toxic")), F.lit(True).alias("keep"))
    spark = docs.sparkSession
    src = _texts(docs, id_col, text_col, F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"))
    schema = T.StructType([src.schema["id"], *(T.StructField(c, T.StringType()) for c in ("host", "path")), *(T.StructField(c, T.DoubleType()) for c in TARGETS)])
    rated = saved(src.mapInArrow(_rated(spark.sparkContext.broadcast(model)), schema))
    paths = rated.groupBy("host", "path").agg(F.count("*").alias("n"), *(F.sum(t).alias(f"s_{t}") for t in TARGETS))
    paths = saved(paths)
    squares = lambda part, n: F.sum(F.col(part) * F.col(part) / F.col(n))
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("hn"), F.count("*").alias("hk"), F.sum(F.col("n") * F.col("n")).alias("h_nn"),
        *(F.sum(f"s_{t}").alias(f"h_{t}") for t in TARGETS), *(squares(f"s_{t}", "n").alias(f"p_{t}") for t in TARGETS),
    )
    hosts = saved(hosts)
    spread = hosts.agg(
        F.sum("hn").alias("n"), F.count("*").alias("k"), F.sum("hk").alias("paths"), F.sum(F.col("hn") * F.col("hn")).alias("nn"), F.sum(F.col("h_nn") / F.col("hn")).alias("path_nn"),
        *(F.sum(f"h_{t}").alias(t) for t in TARGETS), *(squares(f"h_{t}", "hn").alias(f"q_{t}") for t in TARGETS), *(F.sum(f"p_{t}").alias(f"p_{t}") for t in TARGETS),
    ).first()
    if not spread["n"]:
        null = F.lit(None).cast("double")
        return docs.select(id_col, *(null.alias(c) for c in ("doc_low", "doc_toxic", "low", "toxic")), F.lit(True).alias("keep"))
    here = rated.join(paths, ["host", "path"]).join(hosts, "host")
    out = {}
    for t in TARGETS:
        mean = min(max(spread[t] / spread["n"], 1e-6), 1 - 1e-6)
        # sums of squares between hosts, and between the paths of a host
        hosts_pull = _pull(spread[f"q_{t}"] - spread["n"] * mean * mean, spread["k"] - 1, spread["n"] - spread["nn"] / spread["n"], mean)
        paths_pull = _pull(spread[f"p_{t}"] - spread[f"q_{t}"], spread["paths"] - spread["k"], spread["n"] - spread["path_nn"], mean)
        host = (F.col(f"h_{t}") - F.col(t) + hosts_pull * mean) / (F.col("hn") - 1 + hosts_pull)
        path = (F.col(f"s_{t}") - F.col(t) + paths_pull * host) / (F.col("n") - 1 + paths_pull)
        odds = _logit(F.col(t)) + site * (_logit(F.least(F.greatest(path, F.lit(1e-6)), F.lit(1 - 1e-6))) - _logit(F.lit(mean)))
        out[t] = 1 / (1 + F.exp(-odds))
    done = here.select(F.col("id").alias(id_col), *(F.col(t).alias(f"doc_{t}") for t in TARGETS), *(out[t].alias(t) for t in TARGETS))
    return done.withColumn("keep", (F.col("low") < most) & (F.col("toxic") < most))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
