"""The multi-index against a search of everything."""

import heapq

import numpy as np

from veldra.llm import multi_index, queries


def exact(rows, every=100, top=10):
    """The nearest of each query row among all others; rows that repeat an id follow one another."""
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for at, (i, v) in enumerate(zip(ids, m, strict=True)):
        if i % every == 0:
            d = np.sqrt(((m - v) ** 2).sum(axis=1))
            best = [b for b in np.lexsort((ids, d)) if b != at][:top]
            out.setdefault(int(i), []).extend((int(ids[b]), float(d[b])) for b in best)
    return out


def test_recall_and_scores(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, got = exact(rows), {}
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for r in queries.op5_multi_index(spark, sf_dir).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - np.linalg.norm(vectors[r.query_id] - vectors[r.vec_id])) < 1e-12
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert np.mean([len({i for i, _ in want[q]} & set(got[q])) / 10 for q in want]) >= 0.9


def test_recall_with_few_candidates(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.2 * rng.normal(size=16)).tolist()) for i in range(8000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in multi_index.nearest(frame, share=0.05, least=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(rows)
    assert np.mean([len({i for i, _ in want[q]} & got[q]) / 10 for q in want]) >= 0.9


def test_odd_rows_and_split_cells(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 60)] + [(100, [1.0, 2.0, 3.0, 5.0]), (200, [9.0, 9.0, 9.0, 9.0]), (200, [9.0, 9.0, 9.0, 9.0])]
    bad = [(300, None), (400, [0.0] * 4), (500, [nan, 1.0, 1.0, 1.0]), (600, [inf, 1.0, 1.0, 1.0]), (700, [None, 1.0, 1.0, 1.0]), (800, []), (900, [1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cell", "2 AS v")
    want = {q: sorted(f) for q, f in exact(rows).items()}
    assert len(want[200]) == 20
    for size in (multi_index.ROWS, 7):
        monkeypatch.setattr(multi_index, "ROWS", size)
        monkeypatch.setattr(multi_index, "QUERIES", max(1, size // 7))
        got = {}
        for r in multi_index.nearest(frame).collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert {q: sorted(f) for q, f in got.items()} == want
    assert multi_index.nearest(frame.limit(0)).collect() == []
    assert multi_index.nearest(frame.where("vec_id = 100")).collect() == []


def test_components_of_any_size(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 30)] + [(100, [1e200, 1.0, 0.0, 0.0]), (200, [1e200, 0.0, 0.0, 1e190]), (300, [3e-200, 0.0, 4e-200, 0.0]), (301, [3e-200, 0.0, 0.0, 0.0])]
    got = {}
    for r in sorted(multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert {q: len(f) for q, f in got.items()} == {100: 10, 200: 10, 300: 10}
    assert got[100][0][0] == 200 and abs(got[100][0][1] / 1e190 - 1) < 1e-12 and abs(got[100][1][1] / 1e200 - 1) < 1e-12
    assert got[300][0] == (301, 4e-200)


def test_books_grow_and_stay_bounded():
    sizes = [multi_index.centroids_for(n) for n in (0, 50_000, 1 << 17, 10**7, 10**12)]
    assert sizes == sorted(sizes) and sizes[0] == 32 and sizes[-1] ** 2 <= 65_536


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(3)
    a, b, counts = rng.random(7), rng.random(5), rng.integers(0, 3, (7, 5))
    order = [(a[i] + b[j], i * 5 + j) for i in range(7) for j in range(5) if counts[i, j]]
    assert multi_index.walk(a, b, counts, 10**9) == [c for _, c in heapq.nsmallest(99, order)]


def test_recall_with_pruning_on_isotropic_vectors(spark):
    rng = np.random.default_rng(11)
    centres = 0.07 * rng.normal(size=(10, 64)) / 8
    vectors = centres[np.arange(20_000) % 10] + rng.normal(size=(20_000, 64)) / 8
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = {}
    for r in multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(rows)
    recall = np.mean([len({i for i, _ in want[q]} & got[q]) / 10 for q in want])
    assert recall >= 0.9, recall
