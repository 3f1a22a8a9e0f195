"""Embedding near-duplicates with a navigable small-world graph per shard.

Equal vectors collapse to one class. Classes are dealt to shards by hash; each shard builds
hierarchical navigable small-world layers (Malkov and Yashunin, 2018), whole batches of
vectors at a time. Every block of queries is searched in every shard. A beam is widened for
queries whose beam ends inside the links, and for the whole block while an audit misses a link:
every hundredth id of its queries, and vectors planted near nodes of the shard, so that there are
links to find, are held against the whole shard. Beyond a quarter of the shard the exact search
takes over. Cosines are verified in double precision.

Links found from either side count for both, so a pair that one search misses is not lost.
Queries with many links in a shard are searched there exactly; they and the nodes they link with
are counted instead of listing their pairs, and only a spanning forest of the links leaves a task,
from which components are united.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.llm import words as W
from guardlake.llm.common import connected_components, drop_saved, saved, table

COSINE = 0.95
#: Links of a query in a shard up to which they are listed as pairs; those of others are counted, from an exact search.
LISTED = 64
#: Planted queries of an audit, in each half; bytes of the vectors of a shard and of a block of queries.
PLANTED, SHARD_BYTES, BLOCK_BYTES = 128, 128 << 20, 48 << 20


def select(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row, up to ``m`` diverse neighbours of the candidates: one is taken if it is nearer
    to the row than to any taken before, then the nearest others fill up. Ids of -1 are none."""
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    rows, k = ids.shape
    v = vectors[ids]
    between = np.einsum("rid,rjd->rij", v, v)
    taken = np.zeros((rows, k), bool)
    count = np.zeros(rows, np.int64)
    for i in range(k):
        near = np.where(taken[:, :i], between[:, i, :i], -2).max(axis=1, initial=-2)
        ok = (ids[:, i] >= 0) & (sims[:, i] > near) & (count < m)
        taken[:, i] = ok
        count += ok
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2)) * k + np.arange(k)
    first = np.argsort(rank, axis=1)[:, :m]
    out_ids, out_sims = np.take_along_axis(ids, first, 1), np.take_along_axis(sims, first, 1)
    if k < m:
        out_ids = np.pad(out_ids, ((0, 0), (0, m - k)), constant_values=-1)
        out_sims = np.pad(out_sims, ((0, 0), (0, m - k)), constant_values=-2)
    return out_ids, np.where(out_ids >= 0, out_sims, -2).astype(np.float32)


class Graph:
    """Layers over unit vectors in single precision; node numbers are positions in ``vectors``."""

    def __init__(self, vectors: np.ndarray, m: int = 16, build_beam: int = 48, seed: int = 7) -> None:
        self.vectors = vectors.astype(np.float32)
        n = len(vectors)
        uniform = (W.mix(np.arange(n, dtype=np.uint64) + np.uint64(seed)) >> np.uint64(11)) / float(1 << 53)
        level = np.minimum((-np.log(np.maximum(uniform, 1e-18)) / np.log(m)).astype(int), 12)
        order = np.argsort(-level, kind="stable")
        #: From the top: the layer's links by node, -1 for none.
        self.layers: list[np.ndarray] = []
        self.start = int(order[0]) if n else 0
        for floor in range(int(level.max(initial=0)), -1, -1):
            own = order[: int((level >= floor).sum())]
            self.layers.append(self._layer(own, m if floor else 2 * m, build_beam))

    def _layer(self, nodes: np.ndarray, m: int, beam: int) -> np.ndarray:
        links = np.full((len(self.vectors), m), -1, np.int32)
        weights = np.full((len(self.vectors), m), -2, np.float32)
        done = 0
        while done < len(nodes):
            batch = nodes[done : done + (256 if done == 0 else min(done, 512))]
            v = self.vectors[batch]
            among = v @ v.T
            among[np.triu_indices(len(batch))] = -2  # earlier ones of the batch only
            k = min(beam, len(batch))
            near = np.argpartition(-among, k - 1, axis=1)[:, :k]
            sims = np.take_along_axis(among, near, 1)
            ids = np.where(sims > -2, batch[near], -1)
            if done:
                found, found_sims = self._search(links, v, self._entries(v), beam)
                ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([sims, found_sims], axis=1)
            links[batch], weights[batch] = select(sims, ids, self.vectors, m)
            self._back(links, weights, batch, m)
            done += len(batch)
        return self._reached(links, nodes)

    @staticmethod
    def _reached(links: np.ndarray, nodes: np.ndarray, least: int = 4, more: int = 8) -> np.ndarray:
        """Nodes that hardly any list names, as pruning left them, get a place with their own neighbours."""
        flat = links[nodes].ravel()
        named = np.bincount(flat[flat >= 0], minlength=len(links))
        extra = np.full((len(links), more), -1, np.int32)
        used = np.zeros(len(links), np.int64)
        for x in nodes[named[nodes] < least].tolist():
            need = least - int(named[x])
            for y in links[x].tolist():
                if need > 0 and y >= 0 and used[y] < more and x not in links[y]:
                    extra[y, used[y]] = x
                    used[y] += 1
                    need -= 1
        return np.concatenate([links, extra], axis=1)

    def _back(self, links: np.ndarray, weights: np.ndarray, batch: np.ndarray, m: int) -> None:
        """Adds the links back to the new nodes; full lists are selected anew."""
        to, sim = links[batch].ravel(), weights[batch].ravel()
        source = np.repeat(batch, m)[to >= 0]
        to, sim = to[to >= 0], sim[to >= 0]
        order = np.lexsort((-sim, to))
        to, sim, source = to[order], sim[order], source[order]
        target, start, size = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(start, size)
        keep = place < 2 * m  # the nearest new ones of a hub
        width = int(min(size.max(initial=0), 2 * m))
        new = np.full((len(target), width), -1, np.int64)
        new_sims = np.full((len(target), width), -2, np.float32)
        row = np.repeat(np.arange(len(target)), size)
        new[row[keep], place[keep]], new_sims[row[keep], place[keep]] = source[keep], sim[keep]
        for at in range(0, len(target), 512):
            t, more = target[at : at + 512], new[at : at + 512]
            more = np.where((more[:, :, None] == links[t][:, None, :]).any(axis=2), -1, more)
            ids = np.concatenate([links[t], more], axis=1)
            sims = np.concatenate([weights[t], np.where(more >= 0, new_sims[at : at + 512], -2)], axis=1)
            links[t], weights[t] = select(sims, ids, self.vectors, m)

    def _entries(self, v: np.ndarray) -> np.ndarray:
        """Per query, the node that the layers built so far lead to."""
        at = np.full(len(v), self.start)
        for links in self.layers:
            at = self._search(links, v, at, 4)[0][:, 0]
        return at

    def _search(self, links: np.ndarray, v: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from one entry per query: ids and cosines, nearest first. Some queries at a time,
        as each holds a flag for every node."""
        step = max(16, min(1024, (32 << 20) // max(len(self.vectors), beam * 16)))
        if len(v) <= step:
            return self._walked(links, v, entry, beam)
        parts = [self._walked(links, v[at : at + step], entry[at : at + step], beam) for at in range(0, len(v), step)]
        return np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    def _walked(self, links: np.ndarray, v: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q, m = len(v), links.shape[1]
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -2, np.float32)
        closed = np.ones((q, beam), bool)
        seen = np.zeros((q, len(self.vectors)), bool)
        ids[:, 0], sims[:, 0], closed[:, 0] = entry, np.einsum("qd,qd->q", v, self.vectors[entry]), False
        seen[np.arange(q), entry] = True
        active = np.arange(q)
        while len(active):
            opened = np.where(closed[active], -3, sims[active])
            best = opened.argmax(axis=1)
            live = opened[np.arange(len(active)), best] > -3
            active, best = active[live], best[live]
            if not len(active):
                break
            node = ids[active, best]
            closed[active, best] = True
            new = links[node].astype(np.int64)
            ok = (new >= 0) & ~seen[active[:, None], new]
            r, c = np.nonzero(ok)
            seen[active[r], new[r, c]] = True
            new_sims = np.full(new.shape, -2, np.float32)
            new_sims[r, c] = np.einsum("qd,qd->q", v[active[r]], self.vectors[new[r, c]])
            all_sims = np.concatenate([sims[active], new_sims], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[active] = np.take_along_axis(all_sims, top, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(ok, new, -1)], axis=1), top, 1)
            closed[active] = np.take_along_axis(np.concatenate([closed[active], ~ok], axis=1), top, 1)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, v: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        v, layers = v.astype(np.float32), self.layers
        self.layers = layers[:-1]
        entry = self._entries(v)
        self.layers = layers
        return self._search(layers[-1], v, entry, min(beam, len(self.vectors)))


def exact(vectors: np.ndarray, queries: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of all pairs (query, node) with the cosine: some queries at a time against every node."""
    step = max(1, (4 << 20) // max(len(vectors), 1))
    for at in range(0, len(queries), step):
        q, x = np.nonzero(queries[at : at + step] @ vectors.T >= cosine)
        yield q + at, x


def searched(graph: Graph, vectors: np.ndarray, queries: np.ndarray, cosine: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of pairs (query, node) with the cosine that a beam finds, widened fourfold for queries
    whose beam ends inside their links. Beams of over a quarter of the nodes give way to the exact search."""
    margin, n = 1e-4, len(vectors)
    most = max(n // 4, 64)
    for at in range(0, len(queries), 2048):
        todo, width = np.arange(at, min(at + 2048, len(queries))), beam
        while len(todo) and width <= most:
            ids, sims = graph.search(queries[todo], width)
            whole = (sims[:, -1] < cosine - margin) | (width >= n)  # the beam reaches beyond the links
            r, c = np.nonzero((sims >= cosine - margin) & (ids >= 0) & whole[:, None])
            q, x = todo[r], ids[r, c]
            ok = np.einsum("rd,rd->r", queries[q], vectors[x]) >= cosine
            yield q[ok], x[ok]
            todo, width = todo[~whole], 4 * width
        for q, x in exact(vectors, queries[todo], cosine):
            yield todo[q], x


def planted(vectors: np.ndarray, nodes: np.ndarray, cosine: float, seed: int) -> np.ndarray:
    """Unit vectors near the given nodes, at cosines from ``cosine`` to 1."""
    rng = np.random.default_rng(seed)
    v = vectors[nodes]
    side = rng.normal(size=v.shape)
    side -= np.einsum("rd,rd->r", side, v)[:, None] * v
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(cosine + (1 - cosine) * 0.02, 1, (len(v), 1))
    near = c * v + np.sqrt(1 - c * c) * side / np.where(norm > 1e-9, norm, 1)
    return near / np.linalg.norm(near, axis=1, keepdims=True)


def audited(graph: Graph, vectors: np.ndarray, queries: np.ndarray, own: np.ndarray, cosine: float, beam: int = 96, plants: int = PLANTED) -> tuple[int, int, int]:
    """A beam that finds every link of the audited queries, or is beyond the last graph search; then how many links there are of
    queries that did not choose it, and how many of them are found with it.

    Audited are half of the queries and ``plants`` vectors planted near nodes of the shard; the others are held out. While a
    held-out link is missed the beam is doubled, and audited and held-out queries are searched again.
    ``own`` is each query's node in the shard, or -1: a query's link to itself is no link.
    """
    pairs = lambda found, own: {(q, x) for qs, xs in found for q, x in zip(qs.tolist(), xs.tolist()) if own[q] != x}
    nodes = np.argsort(W.mix(np.arange(len(vectors), dtype=np.uint64)))[: 2 * plants]
    halves = []
    for half in (0, 1):
        near = planted(vectors, nodes[half::2], cosine, half)
        q = np.concatenate([queries[half::2], near])
        q_own = np.concatenate([own[half::2], np.full(len(near), -1)])
        halves.append((q, q_own, pairs(exact(vectors, q, cosine), q_own)))
    (first, first_own, want), (second, second_own, there) = halves
    found: set = set()
    while True:
        while beam <= max(len(vectors) // 4, 64) and not want <= pairs(searched(graph, vectors, first, cosine, beam), first_own):
            beam *= 2
        found = there & pairs(searched(graph, vectors, second, cosine, beam), second_own)
        if found == there or beam > max(len(vectors) // 4, 64):
            return beam, len(there), len(found)
        beam *= 2


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the pairs connect, fewer than there are nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _build(t: pa.Table) -> pa.Table:
    vectors = np.concatenate([_matrix(c) for c in t["u"].chunks])
    graph = Graph(vectors)
    blob = pickle.dumps((t["key"].to_numpy(), t["mult"].to_numpy(), vectors, graph.layers, graph.start), protocol=5)
    parts = [blob[i : i + (16 << 20)] for i in range(0, len(blob), 16 << 20)]
    same = lambda name: pa.array([t[name][0].as_py()] * len(parts), pa.int32())
    return pa.table({"dim": same("dim"), "shard": same("shard"), "part": pa.array(range(len(parts)), pa.int32()), "data": pa.array(parts, pa.binary())})


#: What a search returns. pair: query, its shard, node, multiplicities of both; count: query, shard and number of
#: its links there; within: node, shard and number of the counted queries of that shard that link with it; edge: of the
#: forest; audit: links there are (a) and links found (b) of the held-out queries.
FOUND = "kind string, a long, b long, a_shard int, b_shard int, a_mult long, b_mult long"


def _query(cosine: float):
    def rows(kind: str, a, b=None, a_shard=None, b_shard=None, a_mult=None, b_mult=None) -> pa.Table:
        n = len(a)
        column = lambda x, t: pa.nulls(n, t) if x is None else pa.array(np.broadcast_to(x, n), t)
        return pa.table({
            "kind": pa.array([kind] * n, pa.string()), "a": column(a, pa.int64()), "b": column(b, pa.int64()), "a_shard": column(a_shard, pa.int32()),
            "b_shard": column(b_shard, pa.int32()), "a_mult": column(a_mult, pa.int64()), "b_mult": column(b_mult, pa.int64()),
        })

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out = [rows("edge", np.zeros(0, np.int64))]
        if not queries.num_rows or not index.num_rows:
            return out[0]
        shard = index["shard"][0].as_py()
        parts = sorted(zip(index["part"].to_pylist(), index["data"].to_pylist()))
        keys, mult, vectors, layers, start = pickle.loads(b"".join(p for _, p in parts))
        del parts
        graph = Graph.__new__(Graph)
        graph.vectors, graph.layers, graph.start = vectors.astype(np.float32), layers, start
        own, own_shard, own_mult = (queries[c].to_numpy() for c in ("key", "home", "mult"))
        q_vectors = np.concatenate([_matrix(c) for c in queries["u"].chunks])
        node = {int(k): i for i, k in enumerate(keys)}
        some = np.flatnonzero(np.array(queries["audit"].to_pylist(), bool))
        beam, true, got = audited(graph, vectors, q_vectors[some], np.array([node.get(int(k), -1) for k in own[some]]), cosine)
        out.append(rows("audit", [true], [got]))
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        counted = np.zeros(len(own), bool)
        for q, x in searched(graph, vectors, q_vectors, cosine, beam):
            other = own[q] != keys[x]
            q, x = q[other], x[other]
            if not len(q):
                continue
            counted |= np.bincount(q, minlength=len(own)) > LISTED
            few = ~counted[q]
            q, x = q[few], x[few]
            out.append(rows("pair", own[q], keys[x], own_shard[q], shard, own_mult[q], mult[x]))
            a, b = _forest(np.concatenate([a, own[q]]), np.concatenate([b, keys[x]]))
        many = np.flatnonzero(counted)
        homes = np.unique(own_shard[many])
        within = np.zeros((len(homes), len(keys)), np.int64)
        for q, x in exact(vectors, q_vectors[many], cosine):
            q = many[q]
            other = own[q] != keys[x]
            q, x = q[other], x[other]
            if not len(q):
                continue
            links = np.bincount(q, weights=mult[x], minlength=len(own)).astype(np.int64)
            some = np.unique(q)
            out.append(rows("count", own[some], b_shard=shard, b_mult=links[some]))
            np.add.at(within, (np.searchsorted(homes, own_shard[q]), x), own_mult[q])
            a, b = _forest(np.concatenate([a, own[q]]), np.concatenate([b, keys[x]]))
        home, x = np.nonzero(within)
        out.append(rows("within", keys[x], b_shard=homes[home], b_mult=within[home, x]))
        out.append(rows("edge", a, b))
        return pa.concat_tables(out)

    return run


def embedding_components(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE,
    shards: int = 8, shard_rows: int = 200_000, block_rows: int = 65_536, blocks: int = 2, audit: str = "rep % 100 = 0",
) -> DataFrame:
    """``(id_col, n_links, component_id, kept, audit_recall)``: vectors linked at a cosine of ``cosine`` or more.

    A vector that is null, empty or zero, or holds a null or non-finite component, links
    with nothing; vectors of different lengths do not link; rows with a null id stay alone. Rows that repeat id and vector
    are one vector; an id with several vectors has a row for each. ``shard_rows`` and a number of bytes bound a shard,
    ``block_rows`` and bytes a block of queries; there are ``shards`` and ``blocks`` at least. Queries that fit ``audit``, a
    condition on the smallest id ``rep`` of a vector, and planted ones are held against the whole of each shard;
    ``audit_recall`` is the share of their links found of those that did not choose the beam (null without vectors).
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).distinct()
    good = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # scaled by the largest component first, so squares neither overflow nor vanish
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = saved(rows.withColumn("top", F.when(good, top)).withColumn("ok", F.coalesce(F.col("top") > 0, F.lit(False))))
    valid = rows.where("ok").select("id", F.transform("v", lambda x: x + 0.0).alias("v"), "top")
    classes = valid.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("top").alias("top"))
    classes = classes.withColumn("s", F.transform("v", lambda x: x / F.col("top"))).withColumn("norm", F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("key"), "rep", "mult", "v", F.transform("s", lambda x: x / F.col("norm")).alias("u")))
    n, dim = classes.agg(F.count("*"), F.coalesce(F.max(F.size("u")), F.lit(1))).first()
    shard_rows, block_rows = max(1, min(shard_rows, SHARD_BYTES // (8 * dim))), max(1, min(block_rows, BLOCK_BYTES // (8 * dim)))
    shards, blocks = max(shards, -(-n // shard_rows)), max(blocks, -(-n // block_rows))
    dealt = classes.select("key", "mult", "u", F.coalesce(F.expr(audit), F.lit(False)).alias("audit"), F.size("u").alias("dim"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
    index = saved(dealt.select("dim", "shard", "key", "mult", "u").groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, part int, data binary"))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    asked = dealt.withColumnRenamed("shard", "home").withColumn("shard", every(shards))
    known = index.withColumn("block", every(blocks))
    keys = ("dim", "shard", "block")
    found = saved(known.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_query(cosine), FOUND))
    audit = found.where("kind = 'audit'").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    pairs = found.where("kind = 'pair'")
    both = pairs.select(F.col("a").alias("key"), "b_shard", F.col("b").alias("other"), "b_mult")
    both = both.union(pairs.select("b", "a_shard", "a", "a_mult")).distinct()
    counted = found.where("kind = 'count'").select(F.col("a").alias("key"), "b_shard", F.col("b_mult").alias("n"))
    # a query counted in a shard is counted for that shard's nodes too, so the pair is dropped from the lists of either
    own_shard = dealt.select("key", F.col("shard").alias("own_shard"))
    dense = counted.select("key", "b_shard", F.lit(True).alias("dense"))
    listed = both.join(own_shard, "key").join(dense, ["key", "b_shard"], "left")
    other = dense.select(F.col("key").alias("other"), F.col("b_shard").alias("own_shard"), F.lit(True).alias("other_dense"))
    listed = listed.join(other, ["other", "own_shard"], "left").where("dense is null and other_dense is null").select("key", "b_shard", F.col("b_mult").alias("n"))
    within = found.where("kind = 'within'").select(F.col("a").alias("key"), "b_shard", F.col("b_mult").alias("n"))
    within = within.join(dense, ["key", "b_shard"], "left_anti")
    in_shard = listed.union(within).union(counted).groupBy("key", "b_shard").agg(F.sum("n").alias("n"))
    linked = in_shard.groupBy("key").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("kind = 'edge'").select("a", "b").distinct()).withColumnRenamed("node", "key")
    named = classes.select("key", "rep", "v", "mult").join(linked, "key", "left").join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = saved(named.select("v", "rep", "component", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    done = saved(named.join(least, "component").select("v", "n_links", "component_id"))
    drop_saved(index, found, classes, named)
    joined = rows.where("ok").select("id", F.transform("v", lambda x: x + 0.0).alias("v")).join(done, "v").select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    recall = F.lit(audit["b"] / audit["a"] if audit["a"] else None).cast("double")
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return joined.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"), recall.alias("audit_recall"))


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))
