"""Approximate nearest neighbours with an inverted multi-index.

Each half of a vector is quantised to one of ``K`` centroids of its own; a pair of centroids is a cell,
and a cell's list holds its vectors. A query sorts both halves' centroids by distance and walks pairs
in order of summed distance with a heap until the cells passed hold enough entries, which are then
compared exactly in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import materialize

#: Centroids of each half by the number of vectors; the table of cells has their square, 65,536 at most.
BOOKS = ((0, 32), (1 << 17, 64), (1 << 21, 128), (1 << 25, 256))
#: Components beyond this are cut to it where centroids are compared, so that squares stay finite; distances are not.
FAR = 1e120
#: The centroids are fitted on so many vectors, the first in the order of ``xxhash64(vec_id)``.
SAMPLE, ROUNDS = 8192, 8
#: A query passes cells until they hold this share of all vectors, and at least so many.
SHARE, LEAST = 0.04, 2048
#: The share is raised until the walks of so many sampled vectors meet this share of their nearest in the sample.
TRIED, RECALL = 256, 0.95
#: Rows of vectors and of queries that meet in one task's group, about.
ROWS, QUERIES = 8192, 2048
TOP = 10


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds from a farthest-first start; deterministic."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    centres = x[chosen].copy()
    for _ in range(rounds):
        label = distances(x, centres).argmin(axis=1)
        for j in range(k):
            if (label == j).any():
                centres[j] = x[label == j].mean(axis=0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances from rows to centroids."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, 0.0)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells in order of summed distance until they hold ``enough`` entries; ``counts`` is K by K."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, cells, held = [(first[one[0]] + second[two[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        n = int(counts[one[i], two[j]])
        if n:
            cells.append(int(one[i]) * len(second) + int(two[j]))
            held += n
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(one) and b < len(two) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (first[one[a]] + second[two[b]], a, b))
    return cells


def needed_share(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], top: int = TOP) -> float:
    """The share of the sample ``x`` that walks must pass to meet :data:`RECALL` of the true nearest in it.

    Nearest vectors of the whole table are nearer than those of a sample, so they need no larger share.
    """
    half = books[0].shape[1]
    one, two = distances(x[:, :half], books[0]), distances(x[:, half:], books[1])
    a, b = one.argmin(axis=1), two.argmin(axis=1)
    shares = []
    for i in range(min(TRIED, len(x))):
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[: min(top, len(x) - 1)]
        cell = one[i, a] + two[i, b]
        shares.append(np.searchsorted(np.sort(cell), cell[near], side="right") / len(x))
    return float(np.quantile(np.concatenate(shares), RECALL)) if shares and len(x) > 1 else 0.0


def distance(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances from rows to ``q``, scaled where squares would leave the range of doubles."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        apart = m - q
        out = np.sqrt((apart**2).sum(axis=1))
        for i in np.flatnonzero(~np.isfinite(out) | ((out < 1e-150) & (apart != 0).any(axis=1))):
            half = m[i] / 2 - q / 2  # halves: a difference may be out of range itself
            most = np.abs(half).max()
            out[i] = 2 * most * np.sqrt(((half / most) ** 2).sum()) if most else np.abs(apart[i]).max()
    return out


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``(vec_id, v)`` for vectors that can take part, components as doubles.

    Left out: null ids, null or empty vectors, vectors with null or non-finite components, zero vectors,
    and vectors of another length than most have (ties: the longer), to which no distance is defined.
    """
    v = F.col("embedding").cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(sound)
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (usual.d if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def centroids_for(n: int) -> int:
    """Centroids of each half for ``n`` vectors."""
    return max(k for least, k in BOOKS if n >= least)


def nearest(vectors: DataFrame, every: int = 100, top: int = TOP, k: int | None = None, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` nearest found for each vector whose id divides by ``every``.

    Score is the Euclidean distance; ties go to the smaller ``vec_id``. Candidates are all rows but the
    query's own; rows that repeat an id are candidates, also of one another, and where a query's id repeats,
    each of its rows is answered with ranks of its own. Finite components of any size take part. Which
    vectors do is said at :func:`valid_vectors`; a table with none gives no rows. Every such vector is
    indexed. Cells with many entries or queries are dealt to several groups, so a vector that fills a third
    of the table does not meet in one task; nothing is dropped for that.
    """
    spark = vectors.sparkSession
    rows = valid_vectors(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(SAMPLE).select("v").toPandas()  # bounded by SAMPLE
    empty = "query_id long, rank int, vec_id long, score double"
    if sample.empty:
        return spark.createDataFrame([], empty)
    k = k or centroids_for(rows.count())
    x = np.clip(np.array(sample["v"].tolist(), dtype=np.float64), -FAR, FAR)
    half = x.shape[1] // 2
    books = (kmeans(x[:, :half], k), kmeans(x[:, half:], k))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.clip(_matrix(b.column(1)), -FAR, FAR)
            if len(m):
                one, two = distances(m[:, :half], books[0]).argmin(axis=1), distances(m[:, half:], books[1]).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((one * len(books[1]) + two).astype(np.int32))], ["vec_id", "v", "cell"])

    # Rows are numbered once and for all, as the table is read from files from here on.
    numbered = rows.mapInArrow(quantise, "vec_id long, v array<double>, cell int").withColumn("row", F.monotonically_increasing_id())
    index = materialize(numbered, "multi-index")
    held = {r.cell: r.n for r in index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most k * k rows
    counts = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    counts[list(held)] = list(held.values())
    enough = max(least, int(np.ceil(max(share, needed_share(x, books, top)) * counts.sum())))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = counts.reshape(len(books[0]), len(books[1]))
        for b in batches:
            m = np.clip(_matrix(b.column(1)), -FAR, FAR)
            if len(m):
                one, two = distances(m[:, :half], books[0]), distances(m[:, half:], books[1])
                cells = [walk(p, q, grid, enough) for p, q in zip(one, two, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cells, pa.list_(pa.int32()))], ["query_id", "q", "own", "cells"])

    asked = index.where(F.col("vec_id") % every == 0).select("vec_id", "v", "row")
    routed = materialize(asked.mapInArrow(route, "query_id long, q array<double>, own long, cells array<int>"), "routes")
    wanted = {r.cell: r.n for r in routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}

    # Neighbouring small cells share a group; a large one has n parts of entries times m parts of queries.
    deal, group, size, asks = [], 0, 0, 0
    for cell in sorted(wanted):
        n, m = -(-held[cell] // ROWS), -(-wanted[cell] // QUERIES)
        if n > 1 or m > 1 or size + held[cell] > ROWS or asks + wanted[cell] > QUERIES:
            group, size, asks = group + 1, 0, 0
        deal.append((cell, group, n, m))
        size, asks = size + held[cell], asks + wanted[cell]
        if n > 1 or m > 1:
            group, size, asks = group + n * m, 0, 0
    table = F.broadcast(spark.createDataFrame(deal, "cell int, g int, n int, m int"))  # at most k * k rows
    entries = index.join(table, "cell").withColumn("part", F.pmod(F.xxhash64("row"), "n"))
    entries = entries.select("cell", "vec_id", "row", "v", F.explode(F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda j: F.col("g") + F.col("part") * F.col("m") + j)).alias("grp"))
    queries = routed.select("query_id", "q", "own", F.explode("cells").alias("cell")).join(table, "cell").withColumn("part", F.pmod(F.xxhash64("own"), "m"))
    queries = queries.select("cell", "query_id", "own", "q", F.explode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.col("g") + i * F.col("m") + F.col("part"))).alias("grp"))

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        lists = {c: (g["vec_id"].to_numpy(), g["row"].to_numpy(), np.stack(g["v"].to_numpy())) for c, g in left.groupby("cell")} if len(left) else {}
        for own, visits in right.groupby("own"):
            here = [lists[c] for c in visits["cell"] if c in lists]
            if here:
                ids, places, m = (np.concatenate([h[i] for h in here]) for i in range(3))
                others = places != own
                ids, score = ids[others], distance(m[others], visits["q"].iloc[0])
                best = np.lexsort((ids, score))[:top]
                found.append(pd.DataFrame({"query_id": visits["query_id"].iloc[0], "own": own, "vec_id": ids[best], "score": score[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "own": [], "vec_id": [], "score": []})

    near = entries.groupBy("grp").cogroup(queries.groupBy("grp")).applyInPandas(rerank, "query_id long, own long, vec_id long, score double")
    order = Window.partitionBy("query_id", "own").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
