"""Each operator against SQL, a brute-force version, the library, or held-out rows."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from guardlake.llm import bpe, decontaminate, hnsw, langid, mixing, quality, registry, simhash, substring, urls, words
from oracle import check


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def groups(nodes, links):
    """Smallest node reachable, by union."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, sf, name):
    check(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], sf)


# 1 ------------------------------------------------------------------------------------


def linked(rows, cosine=0.95):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    pairs = [(a, b) for a in ok for b in ok if a != b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine]
    n, comp = Counter(a for a, _ in pairs), groups([i for i, _ in rows], pairs)
    return {i: (n[i], comp[i], comp[i] == i) for i, _ in rows}


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(20)] + [(400 + i, [1.0, 2.0, 3.0, 4.0 + 0.01 * i]) for i in range(30)]
    rows += [(500, None), (501, [0.0] * 4), (502, [1.0, None, 2.0, 3.0]), (503, [float("nan")] * 4), (504, []), (505, [1.0, 2.0]), (506, [2.0, 4.0]), (507, [1e-30, 2e-30, 3e-30, 4e-30]), (508, [float("inf"), 1.0, 1.0, 1.0]), (509, [-0.0, 1.0, 0.0, 0.0]), (510, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + rows[:5], "vec_id long, embedding array<double>")
    assert {r[0]: tuple(r)[1:4] for r in hnsw.embedding_components(df).collect()} == linked(rows)
    assert hnsw.embedding_components(df).first().audit_recall == 1.0


def test_planted_links_and_a_dense_cluster(spark):
    """Pairs planted on both sides of the cosine at 64 dimensions, a cluster of which each links with all, one id with two vectors."""
    rng = np.random.default_rng(7)
    plain = rng.normal(size=(1500, 64))
    near = plain[:300] / np.linalg.norm(plain[:300], axis=1, keepdims=True)
    side = rng.normal(size=near.shape)
    side -= (side * near).sum(axis=1, keepdims=True) * near
    cosines = rng.uniform(0.93, 0.97, (300, 1))
    near = cosines * near + np.sqrt(1 - cosines**2) * side / np.linalg.norm(side, axis=1, keepdims=True)
    dense = rng.normal(size=64) + 0.02 * rng.normal(size=(1200, 64))
    x = np.concatenate([plain, near, dense])
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    twice = [(7, (-x[7]).tolist()), (5000, (-1.001 * x[7]).tolist())]
    got = hnsw.embedding_components(spark.createDataFrame(rows + twice, "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = u @ u.T >= 0.95
    want = groups(range(len(x)), [(a, b) for a, b in zip(*np.nonzero(true)) if a < b])
    plain_rows = [r for r in got if r.vec_id not in (7, 5000)]
    assert {r.vec_id: (r.n_links, r.component_id) for r in plain_rows} == {i: (int(true[i].sum()) - 1, want[i]) for i in range(len(x)) if i != 7}
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id in (7, 5000)) == sorted([(7, int(true[7].sum()) - 1, want[7]), (7, 1, 7), (5000, 1, 7)])
    assert got[0].audit_recall > 0.99


def test_graph_recall():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    x = np.concatenate([centres[rng.integers(60, size=2500)] + 0.15 * rng.normal(size=(2500, 32)), np.repeat(centres[:1], 300, 0) + 0.01 * rng.normal(size=(300, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, true = hnsw.Graph(x), x @ x.T >= 0.95
    beam, links, seen = hnsw.audited(graph, x, x[:128], np.arange(128), 0.95)
    q, n = map(np.concatenate, zip(*hnsw.searched(graph, x, x, 0.95, beam)))
    assert true[q, n].all() and len(set(zip(q, n))) == len(q) and len(q) >= 0.99 * true.sum() and seen >= 0.99 * links
    q, n = map(np.concatenate, zip(*hnsw.exact(x, x, 0.95)))
    assert len(q) == true.sum()


# 2 ------------------------------------------------------------------------------------


def test_url_aliases(spark):
    html = '<LINK rel="canonical" href="{}">'
    rows = [(1, "http://a.net/x", html.format("https://B.example.org/es/1")), (2, "https://b.example.org/es/1?z#f", None), (3, "http://c.net/q?x=1#y", '<meta http-equiv="refresh" content="0; url=/r">'), (4, "http://c.net/r", html.format("//a.net/x")),
            (5, "http://x.org/1", html.format("http://q.com/de/1")), (6, "http://q.com/de/1", ""), (7, "http://z.net/a/b", html.format("c")), (8, "http://z.net/a/c", html.format("http://q.com/de/1")), (9, None, "x"), (11, "HTTP://EXAMPLE.ORG/EN/1", ""), (12, "http://example.org/en/12", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.filter_urls(pages).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 6, 12}  # 7 and 8 share a class with an explicit allow
    joined = urls.with_rule(pages.select("page_id", urls.host(F.col("url")).alias("host"), urls.path(F.col("url")).alias("path")), urls.RULES * 101)
    folded = urls.filter_urls(pages, html_col=None)
    assert {r.page_id: r.rule for r in joined.collect()} == {r.page_id: r.rule for r in folded.collect()}
    more = urls.filter_urls(pages, redirects=spark.createDataFrame([("http://new.net/", "http://q.com/de/1")], "src string, dst string"), html_col=None)
    assert more.where("verdict = 'block'").count() == 3


# 3 ------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    got = quality.classify(docs, labels.where(half)).withColumnRenamed("toxic", "p_toxic").join(labels.where(~half), "doc_id").toPandas()
    assert ((got.low >= 0.5) == (got.quality == 0)).mean() > 0.95
    assert ((got.p_toxic >= 0.5) == (got.toxic == 1)).mean() > 0.94
    assert (got.p_toxic[got.toxic == 0] >= 0.5).mean() < 0.02


def test_sparse_sites_shrink(spark):
    rows = [(i, "plain words here and there", "big", "x") for i in range(60)] + [(100 + i, "BAD!! BAD!! BAD!! BAD!!", "bad", "x") for i in range(60)] + [(200, "other text", "single", "x"), (201, "other text", "bad", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert got[0].keep and not got[100].keep
    assert abs(got[200].low - got[200].doc_low) < 0.05 < got[201].low - got[201].doc_low


def test_posteriors_equal_brute_force(spark, sf, docs):
    """Host and path means, their variances and the fusion, from the documents' own probabilities."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs.withColumn("lang", F.when(F.col("doc_id") % 7 > 0, F.col("lang"))), labels).collect()
    site = {r.doc_id: (r.source or "", r.lang if r.doc_id % 7 else "") for r in docs.collect()}
    for t in quality.TARGETS:
        p = {r.doc_id: r[f"doc_{t}"] for r in got}
        n, mean = len(p), sum(p.values()) / len(p)
        hosts, paths = {}, {}
        for i, x in p.items():
            hosts.setdefault(site[i][0], []).append(x)
            paths.setdefault(site[i], []).append(x)
        total = lambda groups: sum(sum(g) ** 2 / len(g) for g in groups.values())
        inside = sum(len(g) ** 2 / len(hosts[h]) for (h, _), g in paths.items())
        pull_host = quality._pull(total(hosts) - n * mean**2, len(hosts) - 1, n - sum(len(g) ** 2 for g in hosts.values()) / n, mean)
        pull_path = quality._pull(total(paths) - total(hosts), len(paths) - len(hosts), n - inside, mean)
        for r in got:
            x, h, s = p[r.doc_id], hosts[site[r.doc_id][0]], paths[site[r.doc_id]]
            host = (sum(h) - x + pull_host * mean) / (len(h) - 1 + pull_host)
            path = min(max((sum(s) - x + pull_path * host) / (len(s) - 1 + pull_path), 1e-6), 1 - 1e-6)
            logit = lambda q: np.log(q / (1 - q))
            want = 1 / (1 + np.exp(-(logit(x) + 0.5 * (logit(path) - logit(mean)))))
            assert abs(r[t] - want) < 1e-6


# 4 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [mixing.HEAD, 50])
def test_scores(spark, docs, texts, head, monkeypatch):
    monkeypatch.setattr(mixing, "HEAD", head)
    got = {r.doc_id: r for r in mixing.score(docs).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    c = Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(w in c for w in ws), n)
        assert abs(r.base_score - sum(log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * abs(r.base_score)
        assert r.score < 0 and 0 < r.bits_per_byte < 12


def pieces_of(text):
    """The symbols of a text, one by one: heads with what precedes them, and words."""
    out, before = [], b""
    for w in text.encode().lower().split():
        out += [(b" " + before)[-3:] + b"\t" + (w + b" ")[:3], w]
        before = w
    return [*out, (b" " + before)[-3:] + b"\t\n"]


@pytest.fixture(scope="module")
def mixed(docs, texts):
    held = mixing._held("doc_id", 10)
    shares, gate = mixing._gates(docs, held, "lang", 8)
    k = len(shares)
    return k, shares, mixing.symbols_of(docs, "text", F.when(held, -1).otherwise(gate), k).cache()


def test_symbols_equal_brute_force(docs, texts, mixed):
    k, shares, vocabulary = mixed
    want = Counter(p for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for p in pieces_of(t))
    got = {bytes(r["w"]): sum(r[f"n{g}"] for g in range(k)) for r in vocabulary.collect()}
    assert {w: n for w, n in got.items() if n} == want and set(got) == {p for t in texts.values() for p in pieces_of(t)}


def test_scores_equal_brute_force(docs, texts, mixed):
    """The model walks each text byte by byte and gate by gate; and the next bytes' probabilities add up to one."""
    k, shares, vocabulary = mixed
    model = mixing.Model(mixing.train(vocabulary, k))
    got = {r.doc_id: r.score for r in mixing.score(docs).collect()}
    for i, t in list(texts.items())[:25]:
        whole = []
        for g in range(k):
            logs, _ = model.byte_logs(pieces_of(t), g)
            assert len(logs) == sum(len(w) + 1 for w in t.encode().split()) + 1
            whole.append(sum(logs.tolist()) + np.log((shares[g] + 0.5) / (sum(shares) + 0.5 * k)))
        want = (max(whole) + np.log(sum(np.exp(x - max(whole)) for x in whole))) / np.log(10)
        assert abs(got[i] - want) < 1e-6 * abs(want)
    for known in (b"the\t", b" of\tt", b" \t", b"ing\tab"):
        logs, symbol = model.byte_logs([known + bytes([b]) for b in range(256) if b != 9], 0)
        last = np.append(symbol[1:] != symbol[:-1], True)
        assert abs(np.exp(logs[last]).sum() - 1) < 0.01  # but for the tab, which no text has there


def test_score_depends_on_the_order_of_words_and_not_on_cores(spark, docs):
    base = {r.doc_id: r.score for r in mixing.score(docs.repartition(3)).collect()}
    again = {r.doc_id: r.score for r in mixing.score(docs.repartition(11, "text")).collect()}
    assert all(abs(base[i] - again[i]) < 1e-9 * abs(base[i]) for i in base)
    two = spark.createDataFrame([(1, "of the house and the garden " * 30, "en"), (2, "of the house", "en"), (3, "the of house", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in mixing.score(two).collect()}
    assert got[2].base_score == pytest.approx(got[3].base_score) and got[2].score > got[3].score


def test_a_task_hands_each_symbol_on_once(texts, monkeypatch):
    """However many slices its texts come in; a full store is handed on early, and nothing is lost."""
    some = [t.encode() for t in texts.values()][:200]
    batches = [pa.record_batch([pa.array(some[i : i + 10], pa.binary()), pa.array([g % 3 - 1 for g in range(len(some[i : i + 10]))], pa.int32())], names=["t", "gate"]) for i in range(0, len(some), 10)]
    want = {g: Counter(p for i, t in enumerate(some) if i % 10 % 3 - 1 == g for p in pieces_of(t.decode())) for g in (0, 1)}
    every = {p for t in some for p in pieces_of(t.decode())}
    for room in (mixing.GATHER, 1000):
        monkeypatch.setattr(mixing, "GATHER", room)
        rows = [r for b in mixing._vocabulary(2)(iter(batches)) for r in b.to_pylist()]
        assert {r["w"] for r in rows} == every and (len(rows) == len(every)) == (room > 1000)
        for g in (0, 1):
            got = Counter()
            for r in rows:
                got[r["w"]] += r[f"n{g}"]
            assert +got == want[g]


def test_counts_beyond_32_bits(monkeypatch):
    """Counts of a slot add up exactly, whether one symbol passes 32 bits or many do together."""
    symbols, n = [b"garden", b"gardens", b"of\tgar"], np.array([3 << 30, 2, 7])
    monkeypatch.setattr(mixing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    sizes = mixing.sized(3)

    def counted(*rows):
        out = np.zeros((2, -(-sum(sizes) // mixing.PART), mixing.PART), np.int64)
        for b in mixing._count(1, sizes)(iter([pa.record_batch([pa.array(symbols, pa.binary()), pa.array(n)], names=["w", "n0"]) for n in rows])):
            for r in b.to_pylist():
                out[:, r["part"]] += np.frombuffer(zlib.decompress(r["data"]), np.int64).reshape(2, -1)
        return out

    assert (counted(n * 5) == 5 * counted(n)).all() and counted(n).max() > 3 << 30
    small = np.array([2, 5, 7])
    monkeypatch.setattr(mixing, "WIDE", 20)
    wide = counted(small)
    monkeypatch.setattr(mixing, "WIDE", 2**31 - 1)
    assert (wide == counted(small)).all() and wide.sum() > 0


def test_rare_symbols_in_many_rows(docs, monkeypatch):
    """A text with more rare symbols than a row takes has the same score, and one row in the result."""
    monkeypatch.setattr(mixing, "HEAD", 50)
    some = docs.where("doc_id < 60").cache()
    base = {r.doc_id: r for r in mixing.score(some).collect()}
    monkeypatch.setattr(mixing, "LIST", 3)
    got = mixing.score(some).collect()
    assert len(got) == len(base) == some.count() and max(r.n_tokens for r in got) > 100
    for r in got:
        assert r[:5] == base[r.doc_id][:5] and abs(r.score - base[r.doc_id].score) < 1e-9 * abs(r.score)


def test_equal_beginnings_are_looked_up_once():
    symbols = [b"garden", b"gardens", b"gardener", b"of\tgar", b"of\tgas", b"he\tgar", b"a", b"a" * 40]
    owner, which, data, symbol, context = mixing.coded(symbols)
    own = {i: (s if b"\t" in s else s + b" ")[:] for i, s in enumerate(symbols)}
    starts = [(i, p) for i, s in own.items() for p in range(s.index(b"\t") + 1 if b"\t" in s else 3, len(s))]
    assert len(owner) == len(which) == len(starts) and owner.tolist() == [i for i, _ in starts]
    assert len(data) == len({own[i][: p + 1] for i, p in starts}) < len(starts)
    assert bytes(data[which].tolist()) == bytes(own[i][p] for i, p in starts)
    for i in range(len(symbols)):  # alone, a symbol has the same contexts
        _, w, _, _, alone = mixing.coded(symbols[i : i + 1])
        assert all((c[which][owner == i] == a[w]).all() for c, a in zip(context, alone))
    two = mixing.coded([b"garden", b"garden"], np.array([0, 1]))
    assert len(two[2]) == 2 * len(mixing.coded([b"garden"])[2])  # gates learn apart


def test_packed_hashes():
    some = [b"", b"a", b" \tab", b"ing\tthe", b"12345678"]
    size = np.array([len(x) for x in some])
    packed = np.array([int.from_bytes(x, "little") for x in some], np.uint64)
    assert (words.packed_hashes(packed, size) == words.word_hashes(np.frombuffer(b"".join(some), np.uint8), np.cumsum(size) - size, np.cumsum(size))).all()


# 6 ------------------------------------------------------------------------------------


def test_languages(docs):
    got = langid.identify(docs).collect()
    assert np.mean([r.declared == r.language for r in got]) > 0.97 and np.mean([r.accepted for r in got]) > 0.99


def test_wrong_declaration_is_overruled(spark):
    en, de = "the house and the garden of this town with many people in it", "das haus und der garten in dieser stadt mit vielen leuten darin"
    rows = [(i, en, "en", "a") for i in range(40)] + [(100 + i, de, "de", "b") for i in range(40)] + [(500, de, "en", "b"), (501, "und der", None, "b"), (502, "und der", None, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[500].language == "de" and got[501].language == "de" and got[501].confidence > got[502].confidence


# 7 ------------------------------------------------------------------------------------


def without_repeats(texts, length=20):
    seen, out = set(), {}
    for i in sorted(texts):
        ws = (texts[i] or "").encode().split()
        gone = [False] * len(ws)
        for k in range(len(ws) - length + 1):
            key = tuple(ws[k : k + length])
            if key in seen:
                gone[k : k + length] = [True] * length
            seen.add(key)
        out[i] = (len(ws), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(ws, gone) if not g)).hexdigest())
    return out


def test_repeats_on_documents(docs, texts):
    assert {r[0]: tuple(r)[1:] for r in substring.remove_repeats(docs, digest=True).collect()} == without_repeats(texts)


@pytest.mark.parametrize("seed,bits", [(1, None), (2, 8)])
def test_repeats_on_random_texts(spark, seed, bits):
    rng, rows = random.Random(seed), {}
    for i in range(60):
        rows[i] = " ".join(rng.choice("ab" if i % 3 else "x") for _ in range(rng.choice([0, 1, 15, 30, 80, 200]))) if i % 7 else None
    base = [str(rng.random()) for _ in range(300)]
    for i in range(60, 100):
        a = rng.randrange(250)
        rows[i] = f"pre{i} " + "\n".join(base[a : a + rng.randrange(10, 60)]) + " post " + " ".join(base[5:40] * 2)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in substring.remove_repeats(df, digest=True, bits=bits).collect()} == without_repeats(rows)
    named = df.withColumn("doc_id", F.format_string("d%03d", "doc_id"))
    assert {int(r[0][1:]): tuple(r)[1:] for r in substring.remove_repeats(named, digest=True, bits=bits).collect()} == without_repeats(rows)


def test_structured_words_are_told_apart(spark):
    """Thue-Morse words, on which all polynomial hashes modulo 2**64 agree, within and across words."""
    t = "a"
    while len(t) < 1024:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    base = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([*base, t])), (2, " ".join([*base, u])), (3, " ".join(t)), (4, " ".join(u)), (5, " ".join([*base, t, "z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: tuple(r)[1:] for r in substring.remove_repeats(df, digest=True).collect()} == without_repeats(dict(rows))
    data = np.frombuffer((t + u + t).encode(), np.uint8)
    at = np.array([0, 1024, 2048])
    a, b, c = words.word_hashes(data, at, at + 1024)
    assert a == c != b
    assert len(set(words.windows(words.word_hashes(data, np.arange(2048), np.arange(2048) + 1), 1024)[[0, 1024]])) == 2


def test_word_hashes_look_at_every_byte():
    rng = np.random.default_rng(6)
    for size in (1, 7, 8, 9, 16, 17, 40):
        one = rng.integers(33, 127, size).astype(np.uint8)
        data = np.concatenate([np.concatenate(([np.uint8(32)], np.where(np.arange(size) == k, one + 1, one).astype(np.uint8))) for k in range(-1, size)])
        start = np.arange(size + 1) * (size + 1) + 1
        h = words.word_hashes(data, start, start + size)
        assert len(set(h.tolist())) == size + 1 and (h != words.word_hashes(data, start, start + size, seed=1)).all()


# 8 ------------------------------------------------------------------------------------


def test_bpe_equals_library(texts):
    from tokenizers import Tokenizer

    theirs, ours = Tokenizer.from_file(bpe.default_path()), bpe.Tokenizer(bpe.read_model(bpe.default_path()))
    rng = random.Random(3)
    letters = "aaabcdeehhinorsttt''.,! 0123\t\n  éßΣσςİıＡḰ̈ñ日本語한글\x1c\x85\xa0​　😀ﬁ½Ⅷ٣"
    cases = [t or "" for t in texts.values()] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    cases += ["a<|endoftext|>b <|startoftext|>", "<|end", "", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "".join(rng.choice("aehinorst") for _ in range(5000)), "the" * 200 + " of"]
    for t, ids in zip(cases, ours.encode(cases)):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert ours.decode(ids) == theirs.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, sf, texts):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(bpe.default_path())
    got = bpe.op8_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())


# 9 ------------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items, window=10):
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    windows, out = {}, {}
    for i, t in items:
        ws = WORD.findall(low(t))
        for k in range(max(1, len(ws) - window + 1) if ws else 0):
            windows.setdefault(tuple(ws[k : k + window]), set()).add(str(i))
    for d, t in docs:
        ws = WORD.findall(low(t))
        hit, found = [0] * len(ws), set()
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if (x := windows.get(tuple(ws[k : k + n]))) is not None:
                    found |= x
                    hit[k : k + n] = [1] * n
        out[d] = (len(ws), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0)
    return out


def test_decontamination_query(spark, sf, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r[0]: tuple(r)[1:] for r in decontaminate.op9_decontaminate(spark, sf).collect()} == contaminated(texts.items(), items)


@pytest.mark.parametrize("block_words", [200_000, 15])
def test_decontamination_on_random_texts(spark, block_words):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("ABc") for _ in range(rng.choice([0, 1, 3, 5, 9, 10, 11, 14])))) for i in range(12)] + [(50, None), (51, "..")]
    rows = [(i, ",".join(rng.choice("aBCd") for _ in range(rng.choice([0, 2, 9, 30, 60])))) for i in range(200)] + [(900, None)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), len(r.spans) > 0) for r in decontaminate.contaminated_spans(d, b, block_words=block_words).collect()}
    assert got == contaminated(rows, items)


def test_removal(spark):
    passage = " ".join(f"Item{i}" for i in range(12))
    rows = [(1, f"Before, this.\n{passage}! After that and more words to keep it so here we go on"), (2, passage), (3, "clean\n text")]
    got = {r.doc_id: r.text for r in decontaminate.remove_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, passage.lower())], "item_id long, text string")).collect()}
    assert set(got) == {1, 3} and "tem5" not in got[1] and got[1].startswith("Before, this.\n! After") and got[3] == "clean\n text"


# 10 -----------------------------------------------------------------------------------


def near(texts):
    fp = {i: simhash.fingerprint((t or "").encode()) for i, t in texts.items()}
    ids = sorted(fp)
    f = np.array([fp[i] for i in ids], np.uint64)
    links = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(f ^ f[a]) <= 4).tolist() if b > a]
    return {i: (f"{fp[i]:016x}", c) for i, c in groups(ids, links).items()}


def test_fingerprint_by_hand():
    import xxhash

    words = b"A b c D e".lower().split()
    hs = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(2)]
    assert simhash.fingerprint(b"A b\tc D  e") == sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hs) * 2 > 2)
    assert simhash.fingerprint(b" \n") == 0


def test_simhash_on_documents(docs, texts):
    assert {r[0]: tuple(r)[1:] for r in simhash.simhash_components(docs).collect()} == near(texts)


@pytest.mark.parametrize("heavy", [1_000_000, 3000])
def test_balls_equal_all_pairs(spark, heavy):
    rng = np.random.default_rng(4)
    f = rng.integers(0, 2**63, 150, dtype=np.uint64)
    for _ in range(2):
        f = np.concatenate([f, f ^ (np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(f)).astype(np.uint64))])
    f = np.unique(f)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    edges = [(r.a, r.b) for r in simhash.ball_edges(df, heavy=heavy).collect()]
    nodes = f.view(np.int64).tolist()
    pairs = [(nodes[a], nodes[b]) for a in range(len(f)) for b in np.flatnonzero(np.bitwise_count(f ^ f[a]) <= 4).tolist() if b > a]
    assert groups(nodes, edges) == groups(nodes, pairs)


# pipeline -----------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, sf, docs, texts):
    from tokenizers import Tokenizer

    got = {r.doc_id: (r.n_tokens, r.token_ids) for r in corpus_pipeline.run(spark, sf).collect()}
    now = {r.doc_id: texts[r.doc_id] for r in langid.identify(docs).where("accepted").collect()}
    now = {i: now[i] for i, (_, c) in near(now).items() if i == c}
    cut = {r.doc_id: r.kept_text for r in substring.remove_repeats(spark.createDataFrame(list(now.items()), "doc_id long, text string")).where("n_removed > 0").collect()}
    want = without_repeats(now)
    assert {i for i, w in want.items() if w[1]} == set(cut)
    now = {i: cut.get(i, t) for i, t in now.items() if cut.get(i, t)}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    marked = contaminated(now.items(), items)
    clean = {i: t for i, t in now.items() if not marked[i][4]}
    theirs = Tokenizer.from_file(bpe.default_path())
    for i, t in clean.items():
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert got[i] == (len(ids), np.array(ids, "<u4").tobytes())
    assert set(got) - set(clean) <= {i for i, m in marked.items() if m[4]}
