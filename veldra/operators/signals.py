"""The fingerprint of a ranked result: 49 features of any method, 14 more of hybrid ones.

Input is a question and its hits in order, at most a dozen; so a question's hits are gathered once into
arrays, and every feature is an expression over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.functions import text as tx
from veldra.functions import vectors as vx

# Feature names in their order.
BASE_FEATURES = (
    "top1_similarity", "top1_gap", "top1_dominance", "std_similarity", "sim_decay_slope", "softmax_entropy_norm", "top3_similarity_mass",
    "sim_gini", "chunk_cohesion", "centroid_concentration", "max_pairwise_distance", "max_statute_share", "statute_switch_rate",
    "n_unique_files", "frac_section_number_present", "total_context_chars", "question_token_count", "n_numbers", "n_conditionals",
    "has_statute_ref", "has_year", "numeric_question", "numeric_hit_coverage", "numeric_overlap_ratio", "statute_ref_alignment",
    "confidence_x_focus", "title_token_jaccard_top1", "title_token_jaccard_topk", "title_token_coverage_topk", "body_content_overlap_top1",
    "body_content_overlap_topk", "rare_term_recall", "near_dup_share", "statute_diversity_norm", "superseded_share", "has_multipart_question",
    "question_char_count", "has_currency_amount", "n_question_marks", "graph_is_graph_mode", "graph_seed_share_in_final",
    "graph_neighbour_share_in_final", "graph_mean_distance", "graph_max_distance", "graph_top1_is_neighbour", "graph_top1_distance",
    "graph_unique_seeds_used", "graph_neighbour_sim_uplift", "graph_neighbour_sim_share",
)
HYBRID_FEATURES = (
    "bm25_top1_score", "bm25_score_gap", "bm25_score_mean_topk", "rrf_top1_score", "rrf_top1_gap", "frac_both_in_topk",
    "frac_bm25_only_in_topk", "frac_dense_only_in_topk", "top1_in_dense_pool", "top1_in_bm25_pool", "top1_both_retrievers",
    "bm25_rank_mean_topk", "dense_rank_mean_topk", "query_num_in_top1_chunk",
)

_CHUNK = ["statute_name", "source_file", "section_title", "section_number", "is_superseded", "text"]
_OPTIONAL = {"bm25_score": "double", "dense_rank": "int", "bm25_rank": "int", "rrf_score": "double", "graph_distance": "int", "graph_seed_origin": "long"}


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def _mean(a: Column) -> Column:
    return F.when(F.size(a) == 0, 0.0).otherwise(_sum(a) / F.size(a))


def _share_of(hits: Column, test) -> Column:
    n = F.size(hits)
    return F.when(n == 0, 0.0).otherwise(F.size(F.filter(hits, test)) / n)


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def fingerprint(questions: DataFrame, hits: DataFrame, chunks: DataFrame, hybrid: bool = False) -> DataFrame:
    """One row for each of ``questions(qid, question)`` with the features of its ``hits(qid, rank, idx, similarity, ...)``.

    A question without hits gets 0 for what depends on them. Optional columns of ``hits`` are read as null.
    """
    present = [F.col(c) if c in hits.columns else F.lit(None).cast(t).alias(c) for c, t in _OPTIONAL.items()]
    full = hits.select("qid", "rank", "idx", F.col("similarity").alias("s"), *present).join(chunks.select("idx", "vector", *_CHUNK), "idx")
    full = full.withColumns({"v": vx.normalize(F.col("vector")), "nums": tx.numeric_tokens(F.col("text")), "tw": tx.content_words(F.col("section_title")), "bw": tx.content_words(F.col("text"))})
    fields = ["rank", "s", "v", "nums", "tw", "bw", *_CHUNK, *_OPTIONAL]
    per = full.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("h"))
    q = F.col("question")
    rows = questions.select("qid", F.coalesce(q, F.lit("")).alias("question")).join(per, "qid", "left")
    rows = rows.withColumn("h", F.coalesce("h", F.array().cast(per.schema["h"].dataType)))
    rows = rows.withColumns({"k": F.size("h"), "qw": tx.content_words(q), "rare": tx.rare_terms(q), "qn": tx.numeric_tokens(q), "s": F.transform("h", lambda x: x["s"])})
    h, k, s, qw, qn = (F.col(c) for c in ("h", "k", "s", "qw", "qn"))
    top = F.array_max(s)
    rows = rows.withColumn("e", F.transform(s, lambda x: F.exp(x - top))).withColumn("p", F.transform("e", lambda x: x / _sum(F.col("e"))))
    p = F.col("p")
    first = F.try_element_at(h, F.lit(1))
    at = lambda a, i: F.coalesce(F.try_element_at(a, F.lit(i)).cast("double"), F.lit(0.0))
    mean_s, several = _mean(s), k > 1
    deviation = _sum(F.transform(s, lambda x: (x - mean_s) * (x - mean_s)))
    mean_r = (k - 1) / 2
    cov = _sum(F.transform(s, lambda x, i: (x - mean_s) * (i - mean_r)))
    var_r = _sum(F.transform(s, lambda x, i: (i - mean_r) * (i - mean_r)))
    entropy = -_sum(F.transform(p, lambda x: x * F.log(x + 1e-12)))
    ordered = F.array_sort(p)
    gini = 2 * _sum(F.transform(ordered, lambda x, i: (i + 1) * x)) / (k * _sum(p)) - (k + 1) / k
    vs = F.transform(h, lambda x: x["v"])
    total = F.aggregate(F.slice(vs, 2, F.greatest(k - 1, F.lit(0))), F.try_element_at(vs, F.lit(1)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    squares = _sum(F.transform(vs, lambda v: vx.dot(v, v)))
    pairs = F.flatten(F.transform(vs, lambda v, i: F.transform(F.slice(vs, i + 2, F.greatest(k - i - 1, F.lit(0))), lambda w: vx.dot(v, w))))
    statutes = F.transform(h, lambda x: F.coalesce(x["statute_name"], F.lit("")))
    named = F.filter(statutes, lambda x: x != "")
    share = F.coalesce(F.array_max(F.transform(F.array_distinct(named), lambda n: F.size(F.filter(named, lambda m: m == n)).cast("double"))), F.lit(0.0)) / k
    switches = F.size(F.filter(F.sequence(F.lit(2), k), lambda i: F.element_at(statutes, i) != F.element_at(statutes, i - 1)))
    files = F.size(F.array_distinct(F.transform(h, lambda x: F.coalesce(x["source_file"], F.lit("")))))
    heads = F.transform(h, lambda x: F.substring(x["text"], 1, 80))
    repeats = F.size(F.filter(F.sequence(F.lit(2), k), lambda i: (F.element_at(heads, i) != "") & F.array_contains(F.slice(heads, F.lit(1), i - 1), F.element_at(heads, i))))
    texts = F.array_join(F.transform(h, lambda x: x["text"]), " ")
    lexical = (k > 0) & (F.size(qw) > 0)
    over = lambda c, f: F.when(c, f).otherwise(0.0)
    cited = q.rlike(tx.STATUTE_REF)
    graph = F.exists(h, lambda x: x["graph_distance"].isNotNull())
    dist = F.transform(h, lambda x: F.coalesce(x["graph_distance"], F.lit(0)))
    near_s = F.transform(F.filter(h, lambda x: F.coalesce(x["graph_distance"], F.lit(0)) > 0), lambda x: x["s"])
    seed_s = F.transform(F.filter(h, lambda x: F.coalesce(x["graph_distance"], F.lit(0)) == 0), lambda x: x["s"])
    sum_s = _sum(s)
    in_dense, in_bm25 = (lambda x: x["dense_rank"] >= 0), (lambda x: x["bm25_rank"] >= 0)
    b25, rrf = F.transform(h, lambda x: x["bm25_score"]), F.transform(h, lambda x: x["rrf_score"])
    gap = lambda a: over(k > 1, at(a, 1) - at(a, 2))
    ranks = lambda c: F.filter(F.transform(h, lambda x: x[c]), lambda r: r >= 0)
    made = {
        "top1_similarity": at(s, 1),
        "top1_gap": gap(s),
        "top1_dominance": over(several, at(s, 1) - (sum_s - at(s, 1)) / (k - 1)),
        "std_similarity": over(k > 0, F.sqrt(deviation / k)),
        "sim_decay_slope": over(several, cov / var_r),
        "softmax_entropy_norm": over(several, entropy / F.log(k)),
        "top3_similarity_mass": over(k > 0, _sum(F.slice(p, 1, 3))),
        "sim_gini": over(k > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), gini))),
        "chunk_cohesion": over(several, (vx.dot(total, total) - squares) / (k * (k - 1))),
        "centroid_concentration": over(several, F.sqrt(vx.dot(total, total)) / k),
        "max_pairwise_distance": over(several, 1 - F.array_min(pairs)),
        "max_statute_share": over(k > 0, share),
        "statute_switch_rate": over(several, switches / (k - 1)),
        "n_unique_files": files,
        "frac_section_number_present": _share_of(h, lambda x: F.coalesce(x["section_number"], F.lit("")) != ""),
        "total_context_chars": _sum(F.transform(h, lambda x: F.length(x["text"]))),
        "question_token_count": F.regexp_count(q, F.lit(r"\S+")),
        "n_numbers": F.regexp_count(q, F.lit(r"\S*\d\S*")),
        "n_conditionals": F.regexp_count(q, F.lit(tx.CONDITIONAL)),
        "has_statute_ref": cited,
        "has_year": q.rlike(tx.YEAR),
        "numeric_question": F.size(qn) > 0,
        "numeric_hit_coverage": _share_of(h, lambda x: F.size(x["nums"]) > 0),
        "numeric_overlap_ratio": tx.share(F.flatten(F.transform(h, lambda x: x["nums"])), qn),
        "statute_ref_alignment": cited & texts.contains("§"),
        "confidence_x_focus": over(k > 0, at(s, 1) * share),
        "title_token_jaccard_top1": over(lexical, tx.jaccard(qw, first["tw"])),
        "title_token_jaccard_topk": over(lexical, F.array_max(F.transform(h, lambda x: tx.jaccard(qw, x["tw"])))),
        "title_token_coverage_topk": over(lexical, tx.share(F.flatten(F.transform(h, lambda x: x["tw"])), qw)),
        "body_content_overlap_top1": over(lexical, tx.share(first["bw"], qw)),
        "body_content_overlap_topk": over(lexical, F.array_max(F.transform(h, lambda x: tx.share(x["bw"], qw)))),
        "rare_term_recall": over(lexical, tx.share(F.flatten(F.transform(h, lambda x: x["bw"])), F.col("rare"))),
        "near_dup_share": over(several, repeats / k),
        "statute_diversity_norm": over(k > 0, files / k),
        "superseded_share": _share_of(h, lambda x: F.coalesce(x["is_superseded"], F.lit(False))),
        "has_multipart_question": q.rlike(tx.MULTIPART) | (F.regexp_count(q, F.lit(r"\?")) > 1),
        "question_char_count": F.length(q),
        "has_currency_amount": q.rlike(tx.CURRENCY),
        "n_question_marks": F.regexp_count(q, F.lit(r"\?")),
        "graph_is_graph_mode": graph,
        "graph_seed_share_in_final": over(graph, F.size(seed_s) / k),
        "graph_neighbour_share_in_final": over(graph, F.size(near_s) / k),
        "graph_mean_distance": over(graph, _mean(dist)),
        "graph_max_distance": over(graph, F.array_max(dist)),
        "graph_top1_is_neighbour": over(graph, (at(dist, 1) > 0).cast("double")),
        "graph_top1_distance": over(graph, at(dist, 1)),
        "graph_unique_seeds_used": over(graph, F.size(F.array_distinct(F.filter(F.transform(h, lambda x: x["graph_seed_origin"]), lambda x: x.isNotNull())))),
        "graph_neighbour_sim_uplift": over(graph & (F.size(near_s) > 0) & (F.size(seed_s) > 0), F.array_max(near_s) - _mean(seed_s)),
        "graph_neighbour_sim_share": over(graph, _sum(near_s) / F.when(sum_s == 0, 1.0).otherwise(sum_s)),
    }
    more = {
        "bm25_top1_score": at(b25, 1),
        "bm25_score_gap": gap(b25),
        "bm25_score_mean_topk": _mean(b25),
        "rrf_top1_score": at(rrf, 1),
        "rrf_top1_gap": gap(rrf),
        "frac_both_in_topk": _share_of(h, lambda x: in_dense(x) & in_bm25(x)),
        "frac_bm25_only_in_topk": _share_of(h, lambda x: in_bm25(x) & ~in_dense(x)),
        "frac_dense_only_in_topk": _share_of(h, lambda x: in_dense(x) & ~in_bm25(x)),
        "top1_in_dense_pool": in_dense(first),
        "top1_in_bm25_pool": in_bm25(first),
        "top1_both_retrievers": in_dense(first) & in_bm25(first),
        "bm25_rank_mean_topk": _mean(ranks("bm25_rank")),
        "dense_rank_mean_topk": _mean(ranks("dense_rank")),
        "query_num_in_top1_chunk": F.arrays_overlap(F.filter(qn, lambda x: F.length(x) >= 3), first["nums"]),
    }
    chosen = made | (more if hybrid else {})
    return rows.select("qid", *[_flag(c).alias(name) for name, c in chosen.items()])
