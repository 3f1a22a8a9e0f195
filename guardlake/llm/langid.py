"""Language identification by Bayesian evidence fusion.

Languages are the tags that enough text is declared to be in. Four kinds of evidence are
multiplied:

* the text: letter trigrams, hashed, under a multinomial model per language counted over
  all rows with a declared language;
* the declared markup language, through the confusion of declared and textual language
  counted over all rows;
* the address suffix and the host: priors counted over all rows, the host's shrunk towards
  its suffix's and that towards the global one, so a sparse host says little.

Priors and confusions are grouped sums of the posteriors that the text alone gives. A row
carries the languages that its text does not rule out, mostly one to three, so neither the
plan nor the shuffled rows grow with the number of languages.
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

BITS = 14
UNKNOWN = "und"
#: Letters: A-Z, a-z and all bytes of characters beyond ASCII.
LETTER = np.array([65 <= c <= 90 or 97 <= c <= 122 or c >= 128 for c in range(256)])
#: A language needs this share of the letters of all declared text, so there are 4,000 at most
#: and the model that is broadcast has 262 MB at most (64 KB a language).
LEAST_SHARE = 1 / 4000
#: Languages whose text evidence is so many nats behind the best are left out of a row; texts whose
#: evidence a letter is this share of the way down, from that of the language's own texts to that of
#: a trigram never seen, are in no known language.
BEHIND, FAR = 60.0, 0.6
#: Weight, in documents, of the belief that declarations tell the truth nine times in ten.
TRUST = 10.0


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams around a letter of lower-cased texts, and each trigram's row."""
    parts = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(parts) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    plain = np.where(LETTER[data], data, 32).astype(np.uint64)
    at = np.flatnonzero(LETTER[data])
    code = W.mix(plain[at - 1] << np.uint64(16) | plain[at] << np.uint64(8) | plain[at + 1])
    return (code >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(ends, at, "left")


def _rows(b: pa.RecordBatch, column: int, limit: int = 500_000, most: int = 128) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch in runs of ``most`` rows and about ``limit`` characters at most, or one text."""
    held, first, size = [], 0, 0
    for i, t in enumerate(b.column(column).to_pylist()):
        if held and (size + len(t or "") > limit or len(held) == most):
            yield first, held
            held, first, size = [], i, 0
        held.append(t)
        size += len(t or "")
    if held:
        yield first, held
    W.trim()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])
        total.clear()

    for b in batches:
        said = np.array(b.column(0).to_pylist(), str)
        for first, texts in _rows(b, 1, most=1000):
            code, row = trigrams(texts)
            langs, own = np.unique(said[first : first + len(texts)], return_inverse=True)
            key, n = np.unique(own[row] << BITS | code, return_counts=True)
            start = np.searchsorted(key, np.arange(len(langs) + 1) << BITS)
            for i, lang in enumerate(langs.tolist()):
                if lang not in total:
                    total[lang] = np.zeros(1 << BITS, np.int64)
                total[lang][key[start[i] : start[i + 1]] & ((1 << BITS) - 1)] += n[start[i] : start[i + 1]]
        if len(total) > 256:  # 32 MB
            yield from counted()
    yield from counted()


def _packed(t: pa.Table) -> pa.Table:
    n = np.zeros(1 << BITS, "<f4")
    n[t["bucket"].to_numpy()] = t["n"].to_numpy()
    return pa.table({"lang": t["lang"].slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})


def text_model(rows: DataFrame, least_share: float = LEAST_SHARE) -> dict | None:
    """Languages with log P(trigram | language), and the least of that a letter, and its spread, in texts of the language.

    ``1 / least_share`` bounds the languages. None if no row declares any.
    """
    counts = rows.where("said is not null").select("said", "text").mapInArrow(_count, "lang string, bucket long, n long")
    counts = saved(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    shares = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    total = shares.agg(F.sum("n")).first()[0] or 0
    enough = shares.where(F.col("n") >= total * least_share).select("lang")
    got = counts.join(F.broadcast(enough), "lang").groupBy("lang").applyInArrow(_packed, "lang string, n binary").toArrow().sort_by("lang")
    if not got.num_rows:
        return None
    n = np.stack([np.frombuffer(x, "<f4") for x in got["n"].to_pylist()])
    logp = np.empty((1 << BITS, len(n) + 1), np.float32)
    mean, spread, floor = (np.empty(len(n)) for _ in range(3))
    base = np.zeros(1 << BITS)
    for i, own in enumerate(n):
        own = own.astype(np.float64)
        log = np.log((own + 0.5) / (own.sum() + 0.5 * len(own)))
        share = own / own.sum()
        logp[:, i] = log
        base += log / len(n)
        mean[i], floor[i] = share @ log, np.log(0.5 / (own.sum() + 0.5 * len(own)))
        spread[i] = np.sqrt(max(share @ log**2 - mean[i] ** 2, 0.0))
    # single precision holds what tells languages apart; what they share goes to the last column
    logp[:, :-1] -= base[:, None].astype(np.float32)
    logp[:, -1] = base
    return {"langs": got["lang"].to_pylist(), "logp": logp, "lowest": mean - FAR * (mean - floor), "spread": spread}


def _structs(fields: list[tuple[str, pa.Array]], ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([a for _, a in fields], names=[n for n, _ in fields]))


CANDIDATES = T.ArrayType(T.StructType([T.StructField("l", T.IntegerType()), T.StructField("ll", T.DoubleType()), T.StructField("p", T.DoubleType()), T.StructField("near", T.BooleanType())]))


def _scores(model, at: int, temper: float):
    """The rows without their text, with letters and the languages that the text leaves open: tempered
    log likelihood, posterior by the text alone (cut at a thousandth), whether the text is as likely as the language's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = len(m["langs"])
        for b in batches:
            for first, texts in _rows(b, at, most=max(1, min(128, (8 << 20) // k))):
                code, row = trigrams(texts)
                r = len(texts)
                n = np.bincount(row, minlength=r)
                counts = np.bincount(row << BITS | code, minlength=r << BITS).reshape(r, -1).astype(np.float32)
                score = (counts @ m["logp"]).astype(np.float64)
                each = (score[:, :-1] + score[:, -1:]) / np.maximum(n, 1)[:, None]
                near = each >= m["lowest"] - 4 * m["spread"] / np.sqrt(np.maximum(n, 1))[:, None]
                score = score[:, :-1] * temper
                score -= score.max(axis=1, keepdims=True)
                p = np.exp(score)
                p = np.where(p >= 1e-3 * p.sum(axis=1, keepdims=True), p, 0)
                p /= p.sum(axis=1, keepdims=True)
                i, lang = np.nonzero(score >= -BEHIND)
                ends = np.searchsorted(i, np.arange(r + 1))
                lists = _structs([("l", pa.array(lang.astype(np.int32))), ("ll", pa.array(score[i, lang])), ("p", pa.array(p[i, lang])), ("near", pa.array(near[i, lang]))], ends)
                part = b.slice(first, r)
                keep = [(f, c) for j, (f, c) in enumerate(zip(b.schema.names, part.columns)) if j != at]
                yield pa.record_batch([*(c for _, c in keep), lists, pa.array(n.astype(np.int64))], names=[*(f for f, _ in keep), "open", "letters"])

    return run


def _sums(seen: DataFrame, by: list[str]) -> DataFrame:
    """Per key, the posteriors' sums by language as a list of ``(l, s)``."""
    each = seen.select(*by, F.explode("open").alias("o")).where("o.p > 0").groupBy(*by, F.col("o.l").alias("l")).agg(F.sum("o.p").alias("s"))
    return each.groupBy(*by).agg(F.collect_list(F.struct("l", "s")).alias("sums"))


def _dense(column: pa.Array, k: int, field: str, empty: float = 0.0) -> np.ndarray:
    """A list of structs with a language ``l`` as a matrix of rows and languages; null is no list."""
    out = np.full((len(column), k), empty)
    size = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten()
    out[np.repeat(np.arange(len(column)), size), np.asarray(flat.field("l"))] = np.asarray(flat.field(field))
    return out


def _fused(shared, k: int, pull: float, least: float, least_letters: int):
    def shrunk(own: np.ndarray, prior: np.ndarray) -> np.ndarray:
        return (own + pull * prior) / (own.sum(axis=1, keepdims=True) + pull)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, world, given = shared.value
        place = {x: i for i, x in enumerate(langs)}
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, (1 << 20) // k)):
                b = whole.slice(at, max(1, (1 << 20) // k))
                c = dict(zip(b.schema.names, b.columns))
                prior = shrunk(_dense(c["by_host"], k, "s"), shrunk(_dense(c["by_suffix"], k, "s"), world[None, :]))
                said = np.array([place.get(x, k) for x in c["said"].to_pylist()], np.int64)
                f = _dense(c["open"], k, "ll", -np.inf) + np.log(prior) + given[said]
                best = f.argmax(axis=1)
                top = f[np.arange(len(f)), best]
                share = 1 / np.exp(f - top[:, None]).sum(axis=1)
                near = _dense(c["open"], k, "near")[np.arange(len(f)), best] > 0
                ok = (np.asarray(c["letters"]) >= least_letters) & (share >= least) & near
                name = [langs[i] if good else UNKNOWN for i, good in zip(best.tolist(), ok.tolist())]
                yield pa.record_batch([c["id"], c["said"], pa.array(name, pa.string()), pa.array(share), pa.array(ok)], names=["id", "declared", "language", "confidence", "accepted"])

    return run


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", suffix_col: str | None = None,
    pull: float = 20.0, temper: float = 0.1, least: float = 0.5, least_letters: int = 3, least_share: float = LEAST_SHARE,
) -> DataFrame:
    """``(id_col, declared, language, confidence, accepted)`` for every row.

    ``pull`` is the weight of the broader prior in documents, ``temper`` scales the text's
    log likelihood, as trigrams overlap. A row is accepted if its text has ``least_letters``
    letters, the posterior of its best language is ``least`` or more, and its letters are not
    far less likely in that language than the language's own texts (``FAR``); else,
    and where no row declares a language, ``language`` is ``und``. Null texts have no letters; a
    null or malformed declaration, host or suffix is no evidence, nor is a tag that less than
    ``least_share`` of the declared letters bear: such rows are judged by the other evidence.
    Ties go to the smaller tag; rows that repeat each get their result.
    """
    none = F.lit(None).cast("string")
    said = F.lower(F.regexp_extract(F.col(declared_col).cast("string"), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)) if declared_col else none
    rows = docs.select(
        F.col(id_col).alias("id"), F.when(said != "", said).alias("said"), (F.col(host_col).cast("string") if host_col else none).alias("host"),
        (F.col(suffix_col).cast("string") if suffix_col else none).alias("suffix"), F.col(text_col).cast("string").alias("text"),
    )
    model = text_model(rows, least_share)
    if model is None:
        return rows.select(F.col("id").alias(id_col), F.col("said").alias("declared"), F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    send = docs.sparkSession.sparkContext.broadcast
    langs, k = model["langs"], len(model["langs"])
    plain = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*plain, T.StructField("open", CANDIDATES), T.StructField("letters", T.LongType())])
    scored = saved(rows.mapInArrow(_scores(send(model), rows.columns.index("text"), temper), schema))
    seen = scored.where(F.col("letters") >= least_letters)
    # how often each tag is declared of each language: at most the languages' number squared, mostly few
    pairs = seen.where("said is not null").select("said", F.explode("open").alias("o")).where("o.p > 0").groupBy("said", "o.l").agg(F.sum("o.p").alias("s")).toArrow()
    place = {x: i for i, x in enumerate(langs)}
    confusion = np.zeros((k + 1, k))
    np.add.at(confusion, (np.array([place.get(x, k) for x in pairs["said"].to_pylist()], np.int64), pairs["l"].to_numpy()), pairs["s"].to_numpy())
    truth = TRUST * (0.9 * np.eye(k) + 0.1 / k)
    given = np.zeros((k + 1, k))  # the last row is for no evidence
    given[:k] = np.log((confusion[:k] + truth) / (confusion[:k].sum(axis=0) + TRUST))
    everywhere = np.zeros(k)
    for r in seen.select(F.explode("open").alias("o")).groupBy("o.l").agg(F.sum("o.p").alias("s")).collect():
        everywhere[r["l"]] = r["s"]
    world = (everywhere + 1.0) / (everywhere.sum() + k)
    lists = "array<struct<l:int,s:double>>"
    here = scored
    for by, keys in (("by_suffix", ["suffix"] if suffix_col else []), ("by_host", ["host", "suffix"] if host_col else [])):
        if not keys:
            here = here.withColumn(by, F.lit(None).cast(lists))
            continue
        sums = saved(_sums(seen.where(F.col(keys[0]).isNotNull()), keys).select(*(F.col(c).alias(f"k_{c}") for c in keys), F.col("sums").cast(lists).alias(by)))
        here = here.join(sums, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in keys], "left").drop(*(f"k_{c}" for c in keys))
    here = here.select("id", "said", "open", "letters", "by_suffix", "by_host")
    out = T.StructType([rows.schema["id"], *(T.StructField(n, t) for n, t in (("declared", T.StringType()), ("language", T.StringType()), ("confidence", T.DoubleType()), ("accepted", T.BooleanType())))])
    return here.mapInArrow(_fused(send((langs, world, given)), k, pull, least, least_letters), out).withColumnRenamed("id", id_col)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def langid_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: the markup's lang attribute, the host and the last label of its name."""
    from guardlake.llm.urls import host

    pages = table(spark, sf_dir, "pages")
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&[a-z#0-9]+;", " ")
    rows = pages.select("page_id", text.alias("text"), F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", 1).alias("lang"), host(F.col("url")).alias("host"))
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"([^.]+)$", 1))
    return identify(rows, "page_id", "text", "lang", "host", "suffix")
