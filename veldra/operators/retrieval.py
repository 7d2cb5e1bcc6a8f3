"""Scoring, top-k and fusion: dense similarity, BM25, reciprocal ranks.

A corpus is ``(idx, text, ...)`` with ``vector`` where dense retrieval is asked for; questions are
``(qid, question, vector)``. Rankings carry ids and scores; text is joined for the few hits at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.functions import text as tx
from veldra.functions import vectors as vx
from veldra.sources.stores import reuse_or_build, staged

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Question vectors and corpus vectors that meet in one product: scores of some 130 MB.
QUESTION_BLOCK, CORPUS_PART = 1024, 16_384


def rank_within(df: DataFrame, by: str | list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """0-based rank by ``order`` within ``by``, cut at ``k``; a limit that Spark applies before its shuffle too."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    return ranked if k is None else ranked.where(F.col(name) < k)


def dense_topk(corpus: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``(qid, idx, similarity, rank)``: the ``k`` chunks of largest cosine for each question.

    The corpus is dealt to parts and the questions to blocks; each part meets each block once, and a matrix
    product of the two keeps ``k`` rows a question, so the shuffle behind it carries ``k`` rows for each part
    and question. Vectors meet only vectors of their own length. Ties go to the smaller ``idx``; ``k`` may
    exceed the corpus.
    """
    vectors = corpus.where("vector IS NOT NULL AND idx IS NOT NULL").select(F.col("idx").cast("long").alias("idx"), vx.doubles(F.col("vector")).alias("v"))
    asked = questions.where("vector IS NOT NULL").select("qid", vx.normalize(F.col("vector")).alias("v"))
    parts, blocks = (-(-df.count() // size) or 1 for df, size in ((vectors, CORPUS_PART), (asked, QUESTION_BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = vectors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("idx"), F.lit(parts)).cast("int").alias("part"), every(blocks).alias("block"), "idx", "v")
    wanted = asked.select(F.size("v").alias("dim"), every(parts).alias("part"), F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("block"), "qid", "v")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qid": [], "idx": [], "similarity": []})
        idx, qid = left["idx"].to_numpy(), right["qid"].to_numpy()
        m, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        score = q @ (m / np.where(length == 0, 1.0, length)).T
        if len(idx) > 4 * k:  # what may tie with the k-th stays in
            least = np.partition(score, -k, axis=1)[:, -k]
            row, column = np.nonzero(score >= least[:, None])
        else:
            row, column = (x.ravel() for x in np.indices(score.shape))
        order = np.lexsort((idx[column], -score[row, column], row))
        row, column = row[order], column[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, column = row[place < k], column[place < k]
        return pd.DataFrame({"qid": qid[row], "idx": idx[column], "similarity": score[row, column]})

    keys = ["dim", "part", "block"]
    kind = f"qid {questions.schema['qid'].dataType.simpleString()}, idx long, similarity double"
    near = held.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInPandas(best, kind)
    return rank_within(near, "qid", [F.desc("similarity"), F.asc("idx")], k)


@dataclass
class Index:
    """An inverted index: ``postings(token, idx, dl, tf)`` as a table, the number of chunks and their mean length."""

    postings: DataFrame
    n: int
    avgdl: float


def postings(corpus: DataFrame) -> DataFrame:
    """``(token, idx, dl, tf)``: tokens exploded, then counted before they are shuffled."""
    split = corpus.select("idx", tx.tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    return split.select("idx", "dl", F.explode("t").alias("token")).groupBy("token", "idx", "dl").agg(F.count(F.lit(1)).alias("tf"))


def build_index(corpus: DataFrame, path: str | None = None, force: bool = False) -> Index:
    """The index of ``corpus(idx, text)``: texts are tokenised once. A ``path`` keeps it, and an index kept there is reused."""
    posted = reuse_or_build(corpus.sparkSession, path, lambda: postings(corpus), force) if path else staged(postings(corpus), "postings")
    n = corpus.count()
    total = posted.agg(F.sum("tf").alias("t")).first().t or 0
    return Index(posted, n, total / n if n else 0.0)


def idf_table(index: Index) -> DataFrame:
    """``(token, df, idf)``: Okapi idf, negative values replaced by a quarter of the mean over the vocabulary."""
    df = index.postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(index.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    return raw.join(F.broadcast(floor), F.lit(True)).select("token", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def bm25_scores(index: Index, questions: DataFrame) -> DataFrame:
    """``(qid, idx, bm25_score)`` for chunks that share a token with the question; repeated question tokens count each time.

    Both sides of the join with the postings come from tables, so the rows of a common token can be split.
    """
    asked = questions.select("qid", F.explode(tx.tokens(F.col("question"))).alias("token")).groupBy("qid", "token").agg(F.count(F.lit(1)).alias("qtf"))
    weighed = staged(asked.join(idf_table(index), "token").select("qid", "token", (F.col("qtf") * F.col("idf")).alias("weight")), "asked")
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / index.avgdl)
    part = F.col("weight") * F.col("tf") * (K1 + 1) / norm
    return weighed.join(index.postings, "token").groupBy("qid", "idx").agg(F.sum(part).alias("bm25_score"))


def bm25_topk(scores: DataFrame, corpus: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """``(qid, idx, bm25_score, rank)``: pools of ``k``, filled up with the first chunks that score 0.

    A question with fewer than ``k`` scored chunks finds its fill among the first ``2k`` chunks.
    """
    few = F.broadcast(corpus.select("idx").where("idx IS NOT NULL").orderBy("idx").limit(2 * k))
    lead = rank_within(scores.select("qid", "idx", F.round("bm25_score", 9).alias("bm25_score")), "qid", [F.desc("bm25_score"), F.asc("idx")], 2 * k).drop("rank")
    fill = questions.select("qid").join(few, F.lit(True)).join(lead.select("qid", "idx"), ["qid", "idx"], "left_anti").withColumn("bm25_score", F.lit(0.0))
    return rank_within(lead.unionByName(fill), "qid", [F.desc("bm25_score"), F.asc("idx")], k)


def fuse(dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """``(qid, idx, dense_rank, bm25_rank, rrf_score, rank)`` of two ranked pools; ranks count from 0, -1 where absent."""
    d = dense.select("qid", "idx", F.col("rank").alias("dense_rank"))
    b = lexical.select("qid", "idx", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    both = d.join(b, ["qid", "idx"], "full_outer").withColumn("rrf_score", part("dense_rank") + part("bm25_rank"))
    both = both.select("qid", "idx", *[F.coalesce(c, F.lit(-1)).cast("int").alias(c) for c in ("dense_rank", "bm25_rank")], "rrf_score")
    return rank_within(both, "qid", [F.round("rrf_score", 12).desc(), F.asc("idx")], k)


def similarities(pairs: DataFrame, corpus: DataFrame, questions: DataFrame) -> DataFrame:
    """``pairs(qid, idx, ...)`` with the cosine of each pair; only vectors of the pairs are read into products."""
    c = corpus.select("idx", vx.normalize(F.col("vector")).alias("__cv"))
    q = questions.select("qid", vx.normalize(F.col("vector")).alias("__qv"))
    return pairs.join(c, "idx").join(q, "qid").withColumn("similarity", vx.dot(F.col("__cv"), F.col("__qv"))).drop("__cv", "__qv")


def hybrid(corpus: DataFrame, questions: DataFrame, pool: int = 30, k: int = 12, rrf_k: int = 60, index: Index | None = None) -> DataFrame:
    """``(qid, rank, idx, similarity, bm25_score, dense_rank, bm25_rank, rrf_score)`` of the fused pools."""
    scores = staged(bm25_scores(index or build_index(corpus), questions), "scores")
    fused = fuse(dense_topk(corpus, questions, pool), bm25_topk(scores, corpus, questions, pool), k, rrf_k)
    hits = similarities(fused, corpus, questions).join(scores, ["qid", "idx"], "left")
    return hits.select("qid", "rank", "idx", "similarity", F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"), "dense_rank", "bm25_rank", "rrf_score")


def context(hits: DataFrame) -> DataFrame:
    """``(qid, context)``: the texts of ``hits(qid, rank, text, source_file)`` in order, each with its source."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("["), "text", F.lit("]\n(source: "), "source_file", F.lit(")")).alias("b"))))
    return hits.groupBy("qid").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))


def rewrite(questions: DataFrame, cache: DataFrame, provider=None) -> DataFrame:
    """``questions`` with ``retrieval_query``: the cached translation, else the provider's, else the question itself.

    ``cache`` is ``(question, translation)``; ``provider`` maps a column of questions to translations.
    """
    asked = questions.withColumn("__key", F.trim("question"))
    known = cache.select(F.trim("question").alias("__key"), F.col("translation").alias("__known")).dropDuplicates(["__key"])
    made = provider(F.col("__key")) if provider else F.lit(None).cast("string")
    best = F.coalesce("__known", F.when(F.col("__key") != "", made))
    clean = F.regexp_replace(F.trim(best), r"^[\"'“”]+|[\"'“”]+$", "")
    done = asked.join(known, "__key", "left")
    return done.withColumn("retrieval_query", F.when(F.coalesce(clean, F.lit("")) == "", F.col("__key")).otherwise(clean)).drop("__key", "__known")
