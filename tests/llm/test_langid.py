"""Language identification: every posterior by brute force, many tags, strange texts."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from guardlake.llm import langid


def posteriors(rows, suffix=True, pull=20.0, temper=0.1):
    """(id, said, host, suffix, text) -> id: (language, posterior), all languages looked at one by one."""
    grams = {i: langid.trigrams([t])[0].tolist() for i, *_, t in rows}
    counts = defaultdict(lambda: defaultdict(int))
    for i, said, *_ in rows:
        for g in grams[i] if said else ():
            counts[said][g] += 1
    total = sum(sum(c.values()) for c in counts.values())
    langs = sorted(x for x, c in counts.items() if sum(c.values()) >= total * langid.LEAST_SHARE)
    size = 1 << langid.BITS
    logp = {x: (lambda c, n: lambda g: math.log((c.get(g, 0) + 0.5) / (n + 0.5 * size)))(counts[x], sum(counts[x].values())) for x in langs}
    ll, own = {}, {}
    for i, *_ in rows:
        score = [temper * sum(map(logp[x], grams[i])) for x in langs]
        ll[i] = [s - max(score) for s in score]
        p = [math.exp(s) for s in ll[i]]
        p = [x if x >= 1e-3 * sum(p) else 0.0 for x in p]
        own[i] = [x / sum(p) for x in p]
    k = len(langs)
    host_sum, suffix_sum, world, said_sum = defaultdict(lambda: [0.0] * k), defaultdict(lambda: [0.0] * k), [0.0] * k, defaultdict(lambda: [0.0] * k)
    for i, said, host, end, _ in rows:
        if len(grams[i]) >= 3:
            for s in ([host_sum[host, end]] if host is not None else []) + ([suffix_sum[end]] if end is not None else []) + ([said_sum[said]] if said else []) + [world]:
                for j in range(k):
                    s[j] += own[i][j]
    n = sum(world)
    world = [(w + 1) / (n + k) for w in world]
    shrunk = lambda s, q: [(a + pull * b) / (sum(s) + pull) for a, b in zip(s, q)]
    out = {}
    for i, said, host, end, _ in rows:
        prior = shrunk(suffix_sum[end], world) if end is not None and suffix else world
        prior = shrunk(host_sum[host, end], prior) if host is not None else prior
        f = [a + math.log(b) for a, b in zip(ll[i], prior)]
        if said in langs:
            for j, x in enumerate(langs):
                f[j] += math.log((said_sum[said][j] + 10 * (0.9 * (x == said) + 0.1 / k)) / (sum(said_sum[d][j] for d in langs) + 10))
        e = [math.exp(x - max(f)) for x in f]
        best = e.index(max(e))
        out[i] = (langs[best], e[best] / sum(e))
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        language, share = want[r[0]]
        assert abs(r.confidence - share) < 2e-3, (r, language, share)
        if r.accepted:
            assert r.language == language


def test_documents_equal_brute_force(spark, sf):
    rows = [(r.doc_id, r.lang, r.source, None, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    same(langid.op6_langid(spark, sf).collect(), posteriors(rows))


def test_pages_equal_brute_force(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        html = r.html or ""
        text = re.sub(r"<[^>]*>|&[a-z#0-9]+;", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", html))
        said = re.search(r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z-]+)""", html)
        tag = re.fullmatch(r"([A-Za-z]{2,3})(?:[-_].*)?", said[1]) if said else None
        host = re.sub(r"[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", r.url.split("://", 1)[1])[0]) if r.url and "://" in r.url else ""
        rows.append((r.page_id, tag[1].lower() if tag else None, host, re.search(r"([^.]*)$", host)[1], text))
    same(langid.langid_pages(spark, sf).collect(), posteriors(rows))


@pytest.mark.parametrize("tags", [2000])
def test_many_tags(spark, tags):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [a + b + c for a in letters for b in letters for c in letters][:tags]
    rows = [(i, " ".join("".join(rng.choice(letters[j % 20 : j % 20 + 6]) for _ in range(6)) for _ in range(20)), x, "h") for i, (j, x) in enumerate([*enumerate(names), *enumerate(names)])]
    rows += [(9000 + i, "the same words for a large language " * 40, "en", "h") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    assert all(r.language == "en" for r in got if r.doc_id >= 9000)
    # a tag below the share is no language: its rows are judged all the same, and no row is lost
    few = langid.identify(docs, least_share=0.01).collect()
    assert len(few) == len(rows) and {r.language for r in few} <= {"en", "und"}


def test_unknown_language_is_rejected(spark):
    en = "the house and the garden of this town with many people in it"
    rows = [(i, f"{en} {i}", "en") for i in range(50)] + [(100 + i, "das haus und der garten in dieser stadt mit vielen leuten", "de") for i in range(50)] + [(900, "これは日本語で書かれた文章であり、どの言語にも属しません。" * 3, None), (901, "zzq xxjq wvvk qqpz jjxw zzqk " * 4, None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), host_col=None).collect()}
    assert not got[900].accepted and got[900].language == "und" and not got[901].accepted
    assert all(r.accepted for i, r in got.items() if i < 900)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "the garden", "en", "a"), (None, None, None, None)], "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit("x") for c in ("id", "said", "open", "letters", "by_host", "k_host", "ll", "l", "s")})
    assert {(r.doc_id, r.accepted) for r in langid.identify(docs).collect()} == {(1, True), (None, False)}
    assert np.isfinite([r.confidence for r in langid.identify(docs).collect()]).all()
