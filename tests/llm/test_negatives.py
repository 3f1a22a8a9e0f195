"""Hard negatives against a loop over all rows."""

from math import floor

import numpy as np
import pytest

from guardlake.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, row long"
MOST = 2**63 - 1


def brute(rows, step=100):
    good = [(k, i, [min(max(floor(256 * c), -MOST - 1), MOST) for c in v], y) for k, (i, v, y, *_) in enumerate(rows) if y is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    score = lambda a, b: min(max(sum(p * q for p, q in zip(a[2], b[2])), -MOST - 1), MOST)
    order = lambda r: (-r[0], MOST if r[1] is None else r[1])
    out = []
    for a in good:
        if a[1] is None or a[1] % step:
            continue
        others = [(score(a, b), b[1], b[3] == a[3]) for b in good if b[0] != a[0] and len(a[2]) == len(b[2])]
        for sp, p, _ in sorted((o for o in others if o[2]), key=order)[:5]:
            window = sorted((o for o in others if not o[2] and 80 * sp <= 100 * o[0] <= 100 * sp), key=order)[:5]
            out += [(a[1], p, rank, n, sp, sn) for rank, (sn, n, _) in enumerate(window, 1)]
    return out


def key(r):
    return tuple(-(10**30) if v is None else v for v in r)


def held(spark, rows):
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert sorted(map(key, got)) == sorted(map(key, want))
    return want


def test_random_rows_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=6)
    rows = [(50 * i, (centre + 0.6 * rng.normal(size=6)).tolist(), int(rng.integers(3)), i) for i in range(160)]
    assert len(held(spark, rows)) > 500


def test_edges(spark):
    """Nulls, copies and ties in a third of the rows, repeated and null ids, other lengths, negative scores."""
    rng = np.random.default_rng(4)
    rows = [(10 * i, rng.integers(-2, 3, size=3).astype(float).tolist(), int(rng.integers(3)), None) for i in range(100)]
    rows += [(5000 + i, [1.0, 1.0, 0.5], i % 2, None) for i in range(50)] + [rows[10], rows[10], (100, [0.25, 1.0, 1.0], 2, None)]
    rows += [(None, [1.0, 1.0, 1.0], 0, 1), (None, [1.0, 1.0, 1.0], 1, 1), (7000, None, 1, 1), (7100, [1.0, None, 0.0], 1, 1), (7200, [float("nan")] * 3, 1, 1), (7300, [1.0] * 3, None, 1), (7400, [], 0, 1)]
    rows += [(8000, [1.0, 2.0], 0, 1), (8001, [1.0, 2.0], 0, 1), (8002, [1.0, 2.0], 1, 1), (8100, [float("-inf")] * 3, 0, 1), (-100, [1.0, -0.0, 0.0], 1, 1)]
    assert held(spark, rows)


@pytest.mark.parametrize("size", [1e7, 1e9, 1e12, 1e300])
def test_large_entries(spark, size):
    """Scores over 2**53, and beyond the ends of long, where they are held."""
    rng = np.random.default_rng(5)
    rows = [(10 * i, ((1 + 0.2 * rng.random(4)) * (size if i % 3 else 1)).tolist(), i % 2, None) for i in range(60)]
    assert held(spark, rows)


def test_blocks_of_anchors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 4)
    monkeypatch.setattr(negatives, "SCORES", 64)
    rows = [(50 * i, (1 + 0.3 * rng.normal(size=4)).tolist(), int(rng.integers(3)), i) for i in range(40)]
    assert held(spark, rows)


def test_empty_and_lonely(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert held(spark, [(100, [1.0], 0, None)]) == []
