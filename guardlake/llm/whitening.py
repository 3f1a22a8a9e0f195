"""Embedding whitening from an exact integer scatter matrix.

Entries become integers, a shift is subtracted, and tasks add up the cross-products of the
distinct vectors without rounding: products of blocks run in double precision only where every
sum stays below 2**53, larger entries are split into limbs first, and totals are Python integers.
From them ``n * X'X - S S'`` is formed exactly; only then is it turned into doubles, divided by
``n * n`` and decomposed. Vectors of different lengths are fitted apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.llm.common import few_tasks, saved, table

#: Doubles hold all integers up to this one, longs stay clear of their end.
EXACT, WIDE = 1 << 53, 1 << 62
#: Bits of a limb: products of two limbs add up exactly over 4,096 rows.
LIMB, LIMB_ROWS = 20, 4096
#: Bytes of fitted models that travel to the tasks at once; more lengths of vectors take further passes.
MODEL_BYTES = 64 << 20
OUT = "component int, n long, deviation long, deviation_wide string, whitened double, explained double, identity_error double"


def finite(vector: Column) -> Column:
    """True for a vector that is not null, not empty, and holds no null or non-finite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def integers(vector: Column, scale: float) -> Column:
    """``floor(scale * c)`` of every entry as long; beyond the ends of long, those ends."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def by_length(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Non-empty batches, rows of one vector length at a time."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        length = pc.list_value_length(rows[column])
        for d in pc.unique(length).to_pylist():
            yield d, rows.filter(pc.equal(length, d)).combine_chunks()


class Scatter:
    """Exact cross-products of rows with a leading 1, so that row 0 holds the number of rows and their sums."""

    def __init__(self, shift: list[int]) -> None:
        self.shift = np.array(shift, np.int64)
        d = len(shift) + 1
        self.recent, self.bound = np.zeros((d, d), np.int64), 0
        self.total: np.ndarray | None = None

    def _flush(self) -> None:
        new = self.recent.astype(object)
        self.total = new if self.total is None else self.total + new
        self.recent[:], self.bound = 0, 0

    def add(self, x: np.ndarray) -> None:
        low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
        top = max(max(abs(a - s), abs(b - s)) for a, b, s in zip(low, high, self.shift.tolist()))
        top = max(top, 1)
        if top * top * min(len(x), 64) >= EXACT:
            return self._limbs(x)
        y = np.concatenate([np.ones((len(x), 1)), (x - self.shift).astype(float)], axis=1)
        step = max(1, (EXACT - 1) // (top * top))
        for at in range(0, len(y), step):
            part = y[at : at + step]
            if self.bound + top * top * len(part) >= WIDE:
                self._flush()
            self.recent += (part.T @ part).astype(np.int64)
            self.bound += top * top * len(part)

    def _limbs(self, x: np.ndarray) -> None:
        """Entries too large for one product: ``sum(limb[k] << LIMB * k)``, the last limb signed."""
        self._flush()
        for at in range(0, len(x), LIMB_ROWS):
            y = x[at : at + LIMB_ROWS].astype(object) - self.shift.astype(object)
            y = np.concatenate([np.ones((len(y), 1), object), y], axis=1)
            limbs, mask = [], (1 << LIMB) - 1
            while any(abs(v) > mask for v in (y.min(), y.max())):
                limbs.append((y & mask).astype(float))
                y = y >> LIMB
            limbs.append(y.astype(float))
            for j, a in enumerate(limbs):
                for k, b in enumerate(limbs):
                    self.total = self.total + ((a.T @ b).astype(np.int64).astype(object) << (LIMB * (j + k)))

    def rows(self) -> list[list[str]]:
        self._flush()
        return [[str(v) for v in row] for row in self.total]


def _partial(shifts: dict[int, list[int]]):
    """One row per length and row of its matrix from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Scatter] = {}
        for d, rows in by_length(batches, "x"):
            sums = found.setdefault(d, Scatter(shifts[d]))
            for chunk in rows["x"].chunks:
                sums.add(matrix(chunk))
        for d, sums in found.items():
            entries = sums.rows()
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([d] * len(entries), pa.int32()), "i": pa.array(range(len(entries)), pa.int32()),
                "sums": pa.array(entries, pa.list_(pa.string())),
            })

    return run


def _merged(t: pa.Table) -> pa.Table:
    """The tasks' sums of one row of a matrix, added as integers of any size."""
    total = [sum(map(int, column)) for column in zip(*t["sums"].to_pylist())]
    return pa.table({"dim": t["dim"][:1], "i": t["i"][:1], "sums": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})


def _covariance(heads: dict[int, list[int]]):
    """Rows of the exact ``n * X'X - S S'``, then divided by ``n * n`` into the nearest doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, i, sums in zip(*(batch[c].to_pylist() for c in ("dim", "i", "sums"))):
                n, s = heads[d][0], heads[d][1:]
                out.append([(n * int(v) - s[i - 1] * other) / (n * n) for v, other in zip(sums[1:], s)])
            yield pa.RecordBatch.from_pydict({"dim": batch["dim"], "i": batch["i"], "v": pa.array(out, pa.list_(pa.float64()))})

    return run


def decomposed(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest eigenvalues, their unit vectors as rows (the largest entry positive), and the trace."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    rows = vectors[:, order].T
    lead = rows[np.arange(len(rows)), np.abs(rows).argmax(axis=1)]
    trace = float(np.trace(v))
    # what rounding leaves of an eigenvalue of zero counts as zero
    values = np.where(values[order] > trace * len(v) * np.finfo(float).eps, values[order], 0.0)
    return values, rows * np.where(lead < 0, -1.0, 1.0)[:, None], trace


def _decompose(components: int):
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t["i"].to_numpy())
        v = np.concatenate([matrix(c) for c in t["v"].chunks])[order]
        values, rows, trace = decomposed(v, components)
        return pa.table({
            "dim": pa.array([t["dim"][0].as_py()], pa.int32()), "values": pa.array([values.tolist()]), "rows": pa.array([rows.tolist()]),
            "trace": pa.array([trace]),
        })

    return run


class Model:
    """A fitted length: number of distinct vectors, their sums, eigenvalues and unit vectors."""

    def __init__(self, n: int, s: list[int], values: list[float], rows: list[list[float]], trace: float) -> None:
        self.n, self.s, self.trace = n, s, trace
        self.values, self.rows = np.array(values), np.array(rows, float)
        self.error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exact: longs where they hold it, else Python integers."""
        top = max(abs(int(x.max())), abs(int(x.min())))
        if self.n * top + max(map(abs, self.s)) < WIDE:
            return self.n * x - np.array(self.s, np.int64)
        return self.n * x.astype(object) - np.array(self.s, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows by components; not a number where the eigenvalue is zero."""
        y = centred.astype(float) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (y @ self.rows.T) / np.sqrt(self.values), np.nan)

    def deviation(self, centred: np.ndarray) -> list[int]:
        top = max(abs(int(centred.max())), abs(int(centred.min())))
        exact = centred if top * top * centred.shape[1] < WIDE else centred.astype(object)
        return [int(v) for v in (exact * exact).sum(axis=1)]

    def size(self) -> int:
        return self.rows.nbytes + 40 * len(self.s)


def _moments(models: dict[int, Model], means: dict[int, list[float]] | None):
    """Sums over the fit list of whitened values, or of products of values less their means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for d, rows in by_length(batches, "x"):
            if d not in models:
                continue
            for chunk in rows["x"].chunks:
                w = np.nan_to_num(models[d].whitened(models[d].centred(matrix(chunk))))
                if means is not None:
                    w = w - means[d]
                sums[d] = sums.get(d, 0) + (w.sum(axis=0) if means is None else (w.T @ w).ravel())
        for d, total in sums.items():
            yield pa.RecordBatch.from_pydict({
                "dim": pa.array([d] * len(total), pa.int32()), "at": pa.array(range(len(total)), pa.int32()), "value": pa.array(total, pa.float64()),
            })

    return run


def _measured(fit: DataFrame, models: dict[int, Model]) -> None:
    """Set each model's largest entry of whitened's covariance less the identity, over components with a positive eigenvalue."""

    def totals(means: dict[int, list[float]] | None) -> dict[int, list[float]]:
        sums = fit.mapInArrow(_moments(models, means), "dim int, at int, value double").groupBy("dim", "at").agg(F.sum("value").alias("value"))
        out: dict[int, list[float]] = {}
        for r in sums.orderBy("dim", "at").collect():  # components squared of each length
            out.setdefault(r.dim, []).append(r.value / models[r.dim].n)
        return out

    products = totals(totals(None))
    for d, model in models.items():
        live = np.flatnonzero(model.values > 0)
        c = np.array(products[d]).reshape(len(model.values), -1)[np.ix_(live, live)]
        model.error = float(np.abs(c - np.eye(len(live))).max()) if len(live) else None


def _applied(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, rows in by_length(batches, "x"):
            if d not in models:
                continue
            m = models[d]
            k = len(m.values)
            centred = m.centred(np.concatenate([matrix(c) for c in rows["x"].chunks]))
            deviation, w = m.deviation(centred), m.whitened(centred)
            fits = [-(1 << 63) <= v < 1 << 63 for v in deviation]
            each = np.repeat(np.arange(len(w)), k)
            wide = pa.array([None if ok else str(v) for v, ok in zip(deviation, fits)], pa.string())
            plain = pa.array([v if ok else None for v, ok in zip(deviation, fits)], pa.int64())
            explained = m.values / m.trace if m.trace > 0 else np.zeros(k)
            columns = {
                "id": rows["id"].combine_chunks().take(each), "component": pa.array(np.tile(np.arange(1, k + 1), len(w)), pa.int32()),
                "n": pa.array(np.full(len(each), m.n), pa.int64()), "deviation": plain.take(each), "deviation_wide": wide.take(each),
                "whitened": pa.array(w.ravel(), from_pandas=True), "explained": pa.array(np.tile(explained, len(w))),
                "identity_error": pa.array([m.error] * len(each), pa.float64()),
            }
            yield from pa.table(columns).to_batches()

    return run


def fitted(fit: DataFrame, components: int) -> dict[int, Model]:
    """The model of each vector length from a table of distinct integer vectors ``x``.

    What reaches the driver grows with the lengths of vectors alone: a shift, the sums, and ``components`` unit vectors each.
    """
    shifts = {r.dim: r.shift for r in fit.groupBy(F.size("x").alias("dim")).agg(F.min("x").alias("shift")).collect()}
    if not shifts:
        return {}
    partial = fit.coalesce(few_tasks(fit)).mapInArrow(_partial(shifts), "dim int, i int, sums array<string>")
    merged = saved(partial.groupBy("dim", "i").applyInArrow(_merged, "dim int, i int, sums array<string>"))
    heads = {r.dim: [int(v) for v in r.sums] for r in merged.where("i = 0").collect()}
    rows = merged.where("i > 0").mapInArrow(_covariance(heads), "dim int, i int, v array<double>")
    parts = rows.groupBy("dim").applyInArrow(_decompose(components), "dim int, values array<double>, rows array<array<double>>, trace double")
    models = {}
    for r in parts.collect():
        n, s = heads[r.dim][0], heads[r.dim][1:]
        models[r.dim] = Model(n, [a + n * b for a, b in zip(s, shifts[r.dim])], r["values"], r.rows, r.trace)
    return models


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256, components: int = 4) -> DataFrame:
    """``(id_col, component, n, deviation, deviation_wide, whitened, explained, identity_error)``, a row per vector and component.

    Vectors that are null, empty, or hold a null or non-finite entry are left out; so are all other columns. Entries become
    ``floor(scale * c)``. The fit takes each distinct vector once, vectors of each length apart; all rows are transformed,
    repeated rows, null and repeated ids too. A length below ``components`` has as many components as entries. A component
    without variance has an ``explained`` of 0 and a null ``whitened`` (one distinct vector: all), and ``identity_error`` is
    over the others, null if there are none. ``deviation`` is null where it does not fit a long, and ``deviation_wide`` has its digits then.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(finite(F.col("v")))
    rows = rows.select("id", integers(F.col("v"), scale).alias("x"))
    fit = saved(rows.select("x").distinct())
    models = fitted(fit, components)
    parts, at = [], sorted(models)
    while at:
        group, size = {}, 0
        while at and (not group or size + models[at[0]].size() <= MODEL_BYTES):
            d = at.pop(0)
            group[d] = models[d]
            size += models[d].size()
        _measured(fit, group)
        schema = f"id {df.select(id_col).schema[0].dataType.simpleString()}, {OUT}"
        parts.append(rows.mapInArrow(_applied(group), schema))
    if not parts:
        parts = [rows.limit(0).mapInArrow(_applied({}), f"id {df.select(id_col).schema[0].dataType.simpleString()}, {OUT}")]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.withColumnRenamed("id", id_col)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
