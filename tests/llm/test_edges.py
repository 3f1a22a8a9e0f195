"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from guardlake.llm import bpe, decontaminate, hnsw, langid, mixing, quality, simhash, substring, urls, warc

CLASH = ("id", "doc", "t", "h", "fp", "key", "seed", "spans", "n_words", "items", "token_ids", "n_tokens", "host", "path", "said", "gate", "label", "score", "component_id", "language", "accepted", "kept_text", "u", "v")


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"wort{i % 997} und" for i in range(60_000))
    rows = [(1, "The of and to in a", "en", "a"), (2, None, None, None), (3, "", "de", ""), (4, " \n\t ", "xx-YY", "a"), (5, long, "de", "b"), (6, long, "de", "b"), (7, "x " * 3000, "en", "a"), (None, "null id text", "en", None), (1, "The of and to in a", "en", "a"), (8, "éÉ ß 日本 \x00 \x1c !!", "fr", "c"), (9, "!!! ??? 123", "fr", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def small(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "the of and to in a"), (4, "the"), (4, "the")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 0, 1), (7, None, None), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    return bench, labels


def test_texts(spark, docs, small):
    bench, labels = small
    n = docs.count()
    got = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    assert simhash.simhash_components(docs).count() == n
    assert got[2].component_id == got[3].component_id == got[4].component_id == 2 and got[2].fingerprint == "0" * 16 and got[6].component_id == 5
    kept = {r.doc_id: r for r in substring.remove_repeats(docs).collect()}
    assert kept[2].n_words == 0 and kept[6].n_removed == kept[6].n_words and kept[5].n_removed > 0 and kept[7].n_words - kept[7].n_removed == 1 and kept[None].n_removed == 0
    assert bpe.encode(docs, bpe.default_path()).where("doc_id = 2").first().n_tokens == 0
    hits = {r.doc_id: r for r in decontaminate.contaminated_spans(docs, bench).collect()}
    assert hits[1]["items"] == ["3", "4"] and hits[2].n_words == 0 and hits[5]["items"] == []
    assert "clash" == decontaminate.remove_contamination(docs, bench).first().spans
    lang = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert not lang[2].accepted and not lang[9].accepted and lang[5].language == "de"
    q = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert quality.classify(docs, labels).count() == n and q[2].keep is not None
    assert quality.classify(docs, labels.limit(0)).where("keep").count() == n
    s = mixing.score(docs)
    assert s.count() == n and s.where("score is null or isnan(score)").count() == 0 and s.where("doc_id = 2").first().n_tokens == 1


def test_no_languages(spark, docs):
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("accepted").count() == 0


def test_empty_tables(spark, docs, small):
    bench, labels = small
    none = docs.limit(0)
    for out in (simhash.simhash_components(none), substring.remove_repeats(none), bpe.encode(none, bpe.default_path()), decontaminate.contaminated_spans(none, bench), decontaminate.remove_contamination(none, bench), langid.identify(none), quality.classify(none, labels), mixing.score(none)):
        assert out.count() == 0
    assert decontaminate.contaminated_spans(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_pages(spark, tmp_path):
    rows = [(1, None, None), (2, "http://a.org/x", ""), (3, "http://a.org/x", None), (None, "nourl", "p"), (4, "x://h\n/ü?", "p"), (4, "x://h\n/ü?", "p"), (5, "http://b.com/de/1", "y" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "node", "key", "payload", "refers", "id", "rule")})
    assert urls.filter_urls(pages).count() == 7 and urls.filter_urls(pages.limit(0)).count() == 0
    for i, p in enumerate((pages, pages.limit(0))):
        folder = tmp_path / str(i)
        folder.mkdir()
        got = warc.read_archives(warc.write_archives(p, f"file://{folder}"), f"file://{folder}").collect()
        assert len(got) == (0 if i else 7)
        if not i:
            by = {(r.page_id, r.record_type, r.refers_to) for r in got}
            assert by == {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (None, "response", None), (5, "response", None)}
            assert max(len(r.payload or b"") for r in got) == 300_000
    small = warc.write_archives(pages, f"file://{tmp_path / '0'}", min_bytes=1)
    assert {r.page_id for r in warc.read_archives(small, f"file://{tmp_path / '0'}").collect() if r.record_type == "revisit"} == set()


def test_embeddings(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "v", "rep", "u", "mult", "n")})
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hnsw.embedding_components(df).collect()} == {1: (0, 1, True), 2: (0, 2, True)}
    assert hnsw.embedding_components(df.limit(0)).count() == 0


def test_stages(spark, docs, small, tmp_path):
    small[0].write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, docs.limit(0)):
        now = start
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, str(tmp_path))
            now.write.mode("overwrite").parquet(f"{tmp_path}/{i}")
            now = spark.read.parquet(f"{tmp_path}/{i}")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == corpus_pipeline.COLUMNS
        assert (now.count() > 0) == (start is docs)
