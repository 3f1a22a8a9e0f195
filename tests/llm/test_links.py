"""Links of hubs, audits of tables without links, long vectors; item ids that are null or hold odd characters."""

import hashlib

import numpy as np

from guardlake.llm import decontaminate, hnsw

SCHEMA = "vec_id long, embedding array<double>"


def star(rng, centre, n, cosine):
    side = rng.normal(size=(n, len(centre)))
    side -= (side @ centre)[:, None] * centre
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * centre + np.sqrt(1 - cosine**2) * side


def test_a_hub_and_its_leaves_count_each_other(spark):
    """A centre with 300 links to vectors that have no other, beside a cluster of 100 and a vector of it that also links outside."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    dense = rng.normal(size=64) + 0.05 * rng.normal(size=(100, 64))
    edge = star(rng, dense[0] / np.linalg.norm(dense[0]), 5, 0.951)
    x = np.concatenate([centre[None], star(rng, centre, 300, 0.955), dense, edge, rng.normal(size=(200, 64))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = u @ u.T >= 0.95
    got = {r.vec_id: r.n_links for r in hnsw.embedding_components(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA)).collect()}
    assert got == {i: int(true[i].sum()) - 1 for i in range(len(x))}
    assert got[0] >= 300 and got[1] == 1


def test_audit_of_a_table_without_links(spark):
    rng = np.random.default_rng(4)
    got = hnsw.embedding_components(spark.createDataFrame([(i, v) for i, v in enumerate(rng.normal(size=(900, 64)).tolist())], SCHEMA)).collect()
    assert {r.n_links for r in got} == {0} and got[0].audit_recall >= 0.99


def test_long_vectors_are_dealt_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 768 * 8 * 30)
    monkeypatch.setattr(hnsw, "BLOCK_BYTES", 768 * 8 * 100)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(250, 768))
    x[1], x[7] = x[0] + 0.01, 2 * x[6]
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.embedding_components(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], SCHEMA), shards=1, blocks=1).collect()}
    assert got == {i: {0: (1, 0), 1: (1, 0), 6: (1, 6), 7: (1, 6)}.get(i, (0, i)) for i in range(250)}


def test_null_ids_stay_alone(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0])]
    got = [(r.vec_id, r.n_links, r.component_id) for r in hnsw.embedding_components(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(x for x in got if x[0] is not None) == [(1, 1, 1), (2, 1, 1)] and {x for x in got if x[0] is None} == {(None, 0, None)}


def test_items_with_null_and_odd_ids(spark):
    words = [f"w{i}" for i in range(10)]
    docs = spark.createDataFrame([(1, "a " + " ".join(words) + " b"), (2, "x y z")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, " ".join(words)), ("a\0b", "x y"), ("a", "q r"), ("a\0b", "y z")], "item_id string, text string")
    for block in (3, 200_000):
        got = {r.doc_id: (r.n_words, [(s.start, s.end) for s in r.spans], list(r["items"])) for r in decontaminate.contaminated_spans(docs, bench, block_words=block).collect()}
        assert got == {1: (12, [(1, 11)], []), 2: (3, [(0, 3)], ["a\0b"])}
    assert hashlib.sha256(b"a\0b").hexdigest()
