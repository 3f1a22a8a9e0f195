"""Whitening against sums of Python integers and an eigendecomposition of their own."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from guardlake.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, x string"


def brute(rows, scale=256, components=4):
    """By length: n, S, eigenvalues, unit vectors and trace; and the integer vectors of the rows that stay."""
    x = [(i, [min(max(floor(Fraction(scale) * Fraction(c)), -(2**63)), 2**63 - 1) for c in v]) for i, v, *_ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    models = {}
    for d in {len(v) for _, v in x}:
        fit = sorted({tuple(v) for _, v in x if len(v) == d})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        v = np.array([[float(Fraction(n * sum(r[i] * r[j] for r in fit) - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
        values, vectors = np.linalg.eigh(v)
        models[d] = n, s, values[::-1][:components], vectors.T[::-1][:components], np.trace(v)
    return x, models


def held(spark, rows, **options):
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA), **options).collect()
    x, models = brute(rows, **options)
    want = sorted((i if i is not None else -1, k + 1, models[len(v)][0], sum((models[len(v)][0] * c - t) ** 2 for c, t in zip(v, models[len(v)][1]))) for i, v in x for k in range(min(4, len(v))))
    exact = lambda r: int(r.deviation_wide) if r.deviation is None else r.deviation
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.component, r.n, exact(r)) for r in got) == want
    return got, x, models


def test_values_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(400, 9)) * np.arange(1, 10) + 3
    rows = [(i, v, 0, "a") for i, v in enumerate(data.tolist())]
    rows += [(500 + i, rows[0][1], 1, "copy") for i in range(300)] + [rows[3], (None, rows[4][1], 2, None)]
    rows += [(900, None, 0, None), (901, [], 0, None), (902, [1.0, None] + [0.0] * 7, 0, None), (903, [float("nan")] * 9, 0, None), (904, [float("inf")] + [0.0] * 8, 0, None)]
    got, x, models = held(spark, rows)
    n, s, values, vectors, trace = models[9]
    assert n == 400
    table = {}
    for r in got:
        table.setdefault(r.component, {})[r.vec_id] = r.whitened
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-9 and r.identity_error < 1e-9
    for k in range(4):
        want = {i: float((np.array(v) - np.array(s) / n) @ vectors[k] / np.sqrt(values[k])) for i, v in x}
        sign = np.sign(want[0] * table[k + 1][0])
        assert all(abs(sign * want[i] - table[k + 1][i]) < 1e-8 for i in want)


@pytest.mark.parametrize("size", [1e6, 1e12, 1e30])
def test_large_entries_stay_exact(spark, size):
    rng = np.random.default_rng(6)
    held(spark, [(i, v, 0, None) for i, v in enumerate((rng.normal(size=(150, 3)) * size + 7 * size).tolist())])


def test_scatter_flushes_and_limbs():
    rng = np.random.default_rng(8)
    for top in (3, 1 << 24, 1 << 29, 1 << 40, (1 << 62) - 1):
        x = rng.integers(-top, top, size=(5000, 3))
        sums = whitening.Scatter(x[0].tolist())
        for at in range(0, len(x), 1700):
            sums.add(x[at : at + 1700])
        y = np.concatenate([np.ones((len(x), 1), object), x.astype(object) - x[0].astype(object)], axis=1)
        assert sums.rows() == [[str(v) for v in row] for row in y.T @ y]


def test_lengths_apart_and_components_without_variance(spark):
    rows = [(1, [1.0, 2.0], 0, None), (2, [2.0, 4.0], 0, None), (3, [3.0, 6.0], 0, None), (4, [5.0], 0, None), (5, [7.0], 0, None), (6, [1.0, 1.0, 1.0], 0, None), (7, [1.0, 1.0, 1.0], 0, None)]
    got, _, _ = held(spark, rows)
    by = {(r.vec_id, r.component): r for r in got}
    assert by[1, 1].explained == pytest.approx(1) and by[1, 2].explained == 0 and by[1, 2].whitened is None and by[1, 1].identity_error < 1e-12
    assert abs(by[4, 1].whitened) == 1 and (4, 2) not in by
    assert by[6, 1].n == 1 and by[6, 1].whitened is None and by[6, 1].identity_error is None and by[6, 3].deviation == 0


def test_models_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MODEL_BYTES", 1)
    rng = np.random.default_rng(9)
    held(spark, [(i, rng.normal(size=1 + i % 5).tolist(), 0, None) for i in range(60)])


def test_empty(spark):
    got = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert got.columns[0] == "vec_id" and got.count() == 0


def test_query(spark, sf):
    got = whitening.op11_whitening(spark, sf)
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x, models = brute([(r.vec_id, [float(np.float32(c)) for c in r.embedding]) for r in rows])
    n, s, values, _, trace = models[64]
    deviation = {i: sum((n * c - t) ** 2 for c, t in zip(v, s)) for i, v in x}
    for r in got.collect():
        assert r.deviation == deviation[r.vec_id] and r.n == n and abs(r.explained - values[r.component - 1] / trace) < 1e-9 and r.identity_error < 1e-9
    assert got.count() == 4 * len(x)
