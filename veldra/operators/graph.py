"""The structural graph of a corpus and retrieval over it.

Nodes are chunks; edges join parts of a split section, neighbours in a file, chapter mates and, where
those are few, other chunks of the file. Edges are kept in both directions with multiplicity, because a
step of the expansion looks at a fixed number of entries. Adjacency order is by priority, then by the
position at which an edge was made (``turn``), then by neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.operators import retrieval as rt
from veldra.operators.methods import EDGE_PRIORITY, GRAPH_CAP, GRAPH_K, GRAPH_SEEDS, HYBRID_GRAPH_K, HYBRID_GRAPH_SEEDS, RRF_K
from veldra.sources.stores import staged


def edges(chunks: DataFrame) -> DataFrame:
    """``(src, dst, etype, turn)`` for ``chunks(idx, source_file, chapter, section_title, section_number, part_total)``.

    ``idx`` is document order. Neighbours come from windows over a file, not from joins over ranges; the
    search for far chunks of a file looks as many places ahead as a node has nearer mates, plus two.
    """
    in_file = Window.partitionBy("source_file").orderBy("idx")
    nodes = chunks.select("idx", "source_file", "chapter", "section_title", "section_number", "part_total")
    nodes = nodes.withColumn("pos", F.row_number().over(in_file))

    def near(df: DataFrame, window, etype: str) -> DataFrame:
        ahead = F.array(*[F.lead("idx", d).over(window) for d in (1, 2)])
        mates = df.select(F.col("idx").alias("a"), ahead.alias("ahead"))
        return mates.select("a", F.explode("ahead").alias("b")).where("b IS NOT NULL").withColumn("etype", F.lit(etype))

    key = ["source_file", "section_title", "section_number"]
    split = nodes.where("part_total > 1").select(*key, "idx")
    part = split.select(*key, F.col("idx").alias("a")).join(split.select(*key, F.col("idx").alias("b")), key).where("a < b").select("a", "b", F.lit("part").alias("etype"))
    sibling = near(nodes, in_file, "sibling")
    chapter = near(nodes.where("chapter <> ''"), Window.partitionBy("source_file", "chapter").orderBy("idx"), "chapter")
    low = F.least("a", "b")

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "etype").select("e.*", "etype")

    once = both(part.union(sibling)).select("a", "b", "etype", low.alias("turn"))
    # Each node of a chapter adds both its sides, so every pair stands there twice: at either end's turn.
    twice = both(chapter).select("a", "b", "etype", F.explode(F.array("a", "b")).alias("turn"))
    known = once.union(twice)

    seen = known.where("b > a").select("a", "b").distinct()
    ahead = seen.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    place = nodes.select("source_file", "pos", F.col("idx").alias("b"))
    reach = nodes.select("idx", "source_file", "pos").join(ahead.withColumnRenamed("a", "idx"), "idx", "left")
    reach = reach.select(F.col("idx").alias("a"), "source_file", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + F.coalesce("m", F.lit(0)).cast("int") + 2)).alias("pos"))
    far = reach.join(place, ["source_file", "pos"]).join(seen, ["a", "b"], "left_anti")
    far = rt.rank_within(far.select("a", "b"), "a", [F.asc("b")], 2).select("a", "b", F.lit("statute").alias("etype"))
    every = known.union(both(far).select("a", "b", "etype", low.alias("turn")))
    return every.select(F.col("a").alias("src"), F.col("b").alias("dst"), "etype", "turn")


def edge_counts(made: DataFrame) -> DataFrame:
    """``(etype, edges)``: undirected edges of each type with multiplicity, the most frequent first."""
    return made.groupBy("etype").agg((F.count(F.lit(1)) / 2).cast("long").alias("edges")).orderBy(F.desc("edges"), "etype")


def adjacency(made: DataFrame, cap: int = GRAPH_CAP) -> DataFrame:
    """The first ``cap`` entries of each node's list: ``(src, dst, etype, rn)``."""
    priority = F.array_position(F.array(*[F.lit(e) for e in EDGE_PRIORITY]), F.col("etype"))
    return rt.rank_within(made, "src", [priority, F.asc("turn"), F.asc("dst")], cap, "rn").select("src", "dst", "etype", "rn")


def expand(seeds: DataFrame, near: DataFrame, depth: int = 2) -> DataFrame:
    """``(qid, idx, distance, edge, seed)`` of all nodes reached from ``seeds(qid, idx, ord)``.

    Each level is two joins; the first to reach a node (by the order of the frontier, then of the list)
    names its edge and seed. Depth is small and fixed, so the loop unrolls into one plan.
    """
    frontier = seeds.select("qid", "idx", "ord", F.col("idx").alias("seed"))
    visited = frontier.select("qid", "idx", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("edge"), "seed")
    for d in range(1, depth + 1):
        step = frontier.join(near, F.col("idx") == F.col("src")).select("qid", F.col("dst").alias("idx"), "seed", "etype", "ord", "rn")
        step = step.join(visited.select("qid", "idx"), ["qid", "idx"], "left_anti")
        first = rt.rank_within(step, ["qid", "idx"], [F.asc("ord"), F.asc("rn")], 1, "n")
        frontier = first.withColumn("ord", F.row_number().over(Window.partitionBy("qid").orderBy("ord", "rn"))).select("qid", "idx", "ord", "seed", F.col("etype").alias("edge"))
        visited = visited.union(frontier.select("qid", "idx", F.lit(d).alias("distance"), "edge", "seed"))
        frontier = frontier.drop("edge")
    return visited


def retrieve(chunks: DataFrame, questions: DataFrame, near: DataFrame, seeds: int = GRAPH_SEEDS, k: int = GRAPH_K, depth: int = 2) -> DataFrame:
    """Hits of dense seeds and what the graph adds to them, ranked by cosine."""
    first = rt.dense_topk(chunks, questions, seeds).select("qid", "idx", F.col("rank").alias("ord"))
    near = staged(near, "adjacency")  # read once for each step
    pool = rt.similarities(expand(first, near, depth), chunks, questions)
    best = rt.rank_within(pool, "qid", [F.desc("similarity"), F.asc("idx")], k)
    return best.select("qid", "rank", "idx", "similarity", F.col("distance").alias("graph_distance"), F.col("edge").alias("graph_edge"), F.col("seed").alias("graph_seed_origin"))


def retrieve_hybrid(chunks: DataFrame, questions: DataFrame, near: DataFrame, seeds: int = HYBRID_GRAPH_SEEDS, k: int = HYBRID_GRAPH_K, depth: int = 2, rrf_k: int = RRF_K, index: rt.Index | None = None) -> DataFrame:
    """Hits of dense and BM25 seeds and what the graph adds, fused by their ranks inside the pool.

    ``dense_rank`` and ``bm25_rank`` shown are those among the seeds, -1 where a hit was no seed.
    """
    scores = staged(rt.bm25_scores(index or rt.build_index(chunks), questions), "scores")
    dense = rt.dense_topk(chunks, questions, seeds).select("qid", "idx", F.col("rank").alias("dense_rank"))
    lexical = rt.bm25_topk(scores, chunks, questions, seeds).select("qid", "idx", F.col("rank").alias("bm25_rank"))
    either = staged(dense.join(lexical, ["qid", "idx"], "full_outer"), "seeds")
    order = Window.partitionBy("qid").orderBy(F.col("dense_rank").asc_nulls_last(), "bm25_rank")
    first = either.withColumn("ord", F.row_number().over(order))
    near = staged(near, "adjacency")  # read once for each step
    pool = rt.similarities(expand(first, near, depth), chunks, questions).join(scores, ["qid", "idx"], "left")
    pool = pool.withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0)))
    ranked = rt.rank_within(pool, "qid", [F.desc("similarity"), F.asc("idx")], name="d")
    ranked = rt.rank_within(ranked, "qid", [F.round("bm25_score", 9).desc(), F.asc("idx")], name="b")
    ranked = ranked.withColumn("rrf_score", 1.0 / (rrf_k + F.col("d")) + 1.0 / (rrf_k + F.col("b")))
    best = rt.rank_within(ranked, "qid", [F.round("rrf_score", 12).desc(), F.asc("idx")], k)
    shown = best.join(either, ["qid", "idx"], "left")
    return shown.select(
        "qid", "rank", "idx", "similarity", "bm25_score",
        *[F.coalesce(c, F.lit(-1)).cast("int").alias(c) for c in ("dense_rank", "bm25_rank")], "rrf_score",
        F.col("distance").alias("graph_distance"), F.col("edge").alias("graph_edge"), F.col("seed").alias("graph_seed_origin"),
    )
