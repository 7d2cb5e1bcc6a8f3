"""BM25 search against scoring every document, and the shard index against a plain sum."""

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from veldra.llm import queries, search


def against_sql(spark, docs):
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    return sorted(db.execute(queries.ORACLE_SQL["op1_search"]).fetchall())


@pytest.mark.parametrize("shard, block", [(search.SHARD, search.QUERIES), (90, 4)])
def test_against_scoring_everything(spark, monkeypatch, shard, block):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "QUERIES", block)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in search.more_like_this(docs).collect())
    want = against_sql(spark, docs)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_pruned_search_is_exact():
    rng = np.random.default_rng(5)
    n = 20_000
    term, doc = rng.zipf(1.3, n) % 50, rng.integers(0, 3000, n)
    _, keep = np.unique(np.stack([term, doc]), axis=1, return_index=True)
    term, doc = term[keep], doc[keep]
    gain = np.round(rng.random(len(term)), 1)  # many ties
    shard = search.Shard(term, doc, gain)
    for size in (1, 3, 12):
        asked = rng.choice(60, size, replace=False)
        weights = np.round(rng.random(size), 1) + 0.1
        total = {}
        for t, w in zip(asked, weights, strict=True):
            for d, g in zip(doc[term == t], gain[term == t], strict=True):
                total[int(d)] = total.get(int(d), 0.0) + g * w
        want = sorted(((-round(s, search.DIGITS), d) for d, s in total.items() if d != 7))[:10]
        ids, scores = shard.search(asked, weights, 7, 10)
        assert [d for _, d in want] == ids.tolist()
        assert np.allclose([-s for s, _ in want], scores)


def test_lists_behind_the_pivot_are_not_read():
    # Forty rare words that near copies share and sixty that every second document holds.
    rng = np.random.default_rng(11)
    rare = [(1000 + t, d) for t in range(40) for d in [*range(12), *rng.integers(0, 6000, 5)]]
    common = [(t, d) for t in range(60) for d in np.flatnonzero(rng.random(6000) < 0.5)]
    term, doc = np.unique(np.array(rare + common), axis=0).T
    gain = rng.random(len(term)) + 0.5
    shard = search.Shard(term, doc, gain)
    asked = np.unique(term)
    weights = np.where(asked >= 1000, 9.0, 0.1)
    ids, scores = shard.search(asked, weights, None, 10)
    total = np.bincount(doc, weights=gain * weights[np.searchsorted(asked, term)])
    want = np.lexsort((np.arange(len(total)), -np.round(total, search.DIGITS)))[:10]
    assert ids.tolist() == want.tolist() and np.allclose(scores, total[want])
    assert shard.read + shard.probed < 0.1 * shard.asked


def test_blocks_end_the_search_of_found_documents():
    # A found document stays only if the rest's maxima in its own run of documents suffice.
    n = 64 * search.RUN
    doc = np.concatenate([np.arange(n), np.arange(n), np.arange(n)])
    term = np.repeat([0, 1, 2], n)
    gain = np.concatenate([np.where(np.arange(n) < 20, 10.0, 9.0), np.where(np.arange(n) < search.RUN, 3.0, 0.5), np.full(n, 0.1)])
    shard = search.Shard(term, doc, gain)
    ids, scores = shard.search(np.arange(3), np.ones(3), None, 10)
    assert ids.tolist() == list(range(10)) and np.allclose(scores, 13.1)
    assert shard.probed <= 3 * search.RUN


def test_queries_together_with_bars_are_exact():
    # Three kinds of documents, some copies, and bars from none to beyond any score.
    rng = np.random.default_rng(3)
    n, kinds = 1500, rng.integers(0, 3, 1500)
    rows = [(t, d) for d in range(n) for t in {*(kinds[d] * 100 + rng.zipf(1.2, 30) % 100).tolist(), *rng.integers(300, 2000, 5).tolist()}]
    rows += [(t, n + i) for i in range(12) for t, d in rows if d == 4]
    term, doc = np.unique(np.array(rows), axis=0).T
    gain, idf = rng.random(2000)[term] + rng.random(n + 12)[doc] * (doc < n) + 0.1, rng.random(2000) + 0.1
    asked = [np.unique(term[doc == d]) for d in range(0, 400, 2)]
    shard = search.Shard(term, doc, gain, weights=(np.arange(2000), idf))
    total = np.zeros((len(asked), n + 12))
    for i, terms in enumerate(asked):
        mine = np.isin(term, terms)
        total[i] = np.round(np.bincount(doc[mine], weights=(gain * idf[term])[mine], minlength=n + 12), search.DIGITS)
        total[i, 2 * i] = 0.0
    best = np.argsort(-total, axis=1, kind="stable")[:, :10]
    tenth = np.take_along_axis(total, best, 1)[:, -1]
    at, here = search.places(shard.names, np.concatenate(asked))
    assert here.all()
    edge = np.append(0, np.cumsum([len(t) for t in asked]))
    assert 0 < len(shard.long) < len(shard.names)
    for bars in (np.full(len(asked), -np.inf), 0.7 * tenth, tenth, np.full(len(asked), 1e6)):
        for i, (ids, scores) in enumerate(shard.search_all(at, None, edge, list(range(0, 400, 2)), bars, 10)):
            want = [d for d in best[i].tolist() if total[i, d] >= bars[i]]
            assert ids.tolist()[: len(want)] == want
            assert np.allclose(scores[: len(want)], total[i, want])


def test_bars_of_shards_before_spare_postings():
    # All documents have twelve copies; those in another shard tell that nothing but copies can enter.
    rng = np.random.default_rng(8)
    texts = [rng.choice(2000, 100, replace=False) for _ in range(250)]
    term = np.concatenate([t for t in texts for _ in range(12)])
    doc = np.repeat(np.arange(3000), 100)
    weights = np.log(1 + 3000 / np.bincount(term, minlength=2000).clip(1))
    read = []
    for bar in (-np.inf, weights[texts[0]].sum()):
        shard = search.Shard(term, doc, np.ones(len(term)))
        at, _ = search.places(shard.names, texts[0])
        ids, scores = shard.search_all(at, weights[texts[0]], np.array([0, len(at)]), [0], np.array([bar]), 10)[0]
        assert ids.tolist() == list(range(1, 11)) and np.allclose(scores, weights[texts[0]].sum())
        read.append(shard.read)
    assert read[1] < 0.2 * read[0]


def test_shards_of_a_strand(spark, monkeypatch):
    # Several shards to a task, several blocks of queries, counts of a byte and of more.
    monkeypatch.setattr(search, "SHARD", 40)
    monkeypatch.setattr(search, "QUERIES", 3)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(5000, "the " * 300 + "of and"), (5001, "the " * 70000 + "of and"), (5002, "of and the")], docs.schema)).coalesce(2)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", property(lambda self: 2))
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in search.more_like_this(docs).collect())
    want = against_sql(spark, docs)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_queries_have_all_terms(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(100, " ".join(words)), *((i + 1, f"{w} other{i}") for i, w in enumerate(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    df = search.document_frequencies(docs).where("term IS NOT NULL")
    assert search.queries_of(docs, df, len(rows), 100, None)[0].count() == 60
    assert search.queries_of(docs, df, len(rows), 100, 25)[0].count() == 25


def test_counts_of_terms(spark):
    texts = [" The the\tTHE  end\n", "", "é É e", "\x1cx \x0b y", " "]
    terms, doc, term, tf = search.counted(pa.array(texts))
    got = [Counter() for _ in texts]
    for d, t, n in zip(doc, term, tf, strict=True):
        got[d][terms[int(t)].as_py().encode()] += int(n)
    assert got == [Counter(t.encode().lower().split()) for t in texts]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    words = search.document_frequencies(frame).where("term IS NULL").first().df
    assert words == sum(len(t.encode().split()) for t in texts)


def test_odd_rows(spark):
    rows = [(0, "Rare words here"), (1, "rare WORDS here too"), (2, None), (3, ""), (None, "rare words"), (4, "rare " * 30000), (5, "rare words"), (5, "rare words"), (100, None), (200, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS term", "2 AS df")
    got = search.more_like_this(docs).collect()
    assert {r.query_id for r in got} == {0} and [r.doc_id for r in sorted(got, key=lambda r: r["rank"])][0] in (1, 5)
    assert {r.doc_id for r in got} == {1, 4, 5}
    assert search.more_like_this(docs.limit(0)).collect() == []
