"""Registered queries of the retrieval engine over the driver's tables, each over whole tables.

Tables stand in for the engine's entities: documents for chunks (with a vector where one exists),
benchmark for questions, labels for judged answers, conversations for files with chapters, pages for
HTML. What the tables lack (sections, parts, standing) is derived from ids by rule, alike in the SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.functions import text as tx
from veldra.functions import vectors as vx
from veldra.operators import chunking, engine, evaluation, expansion, graph, methods, models, reports, sections, signals
from veldra.operators import retrieval as rt
from veldra.plans.sql import ORACLE_SQL  # noqa: F401
from veldra.sources.stores import scratch, staged

R = 6


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _round(df: DataFrame, digits: int = R) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _documents(spark, d):
    return _read(spark, d, "documents")


def _corpus(spark, d):
    return _documents(spark, d).select(F.col("doc_id").alias("idx"), "text")


def _chunks(spark, d):
    """Documents that have a vector, with the fields of section chunks."""
    docs, vecs = _documents(spark, d), _read(spark, d, "embeddings")
    i = F.col("doc_id")
    split = (i % 10).isin(3, 4, 5)
    return docs.join(vecs, docs["doc_id"] == vecs["vec_id"]).select(
        i.alias("idx"), "text", F.col("embedding").alias("vector"), F.col("source").alias("statute_name"),
        F.concat(F.lit("file"), F.floor(i / 10).cast("string")).alias("source_file"),
        F.when(i % 10 < 7, F.col("lang")).otherwise("").alias("chapter"),
        F.when(split, F.concat(F.lit("split section "), F.floor(i / 10).cast("string"))).otherwise(F.substring("text", 1, 60)).alias("section_title"),
        F.when(split, "7").when(i % 3 == 0, "").otherwise((i % 50).cast("string")).alias("section_number"),
        F.when(split, 3).otherwise(1).alias("part_total"), (i % 7 == 0).alias("is_superseded"),
    )


def _questions(spark, d):
    """Benchmark passages that have a vector."""
    bench, vecs = _read(spark, d, "benchmark"), _read(spark, d, "embeddings")
    return bench.join(vecs, bench["item_id"] == vecs["vec_id"]).select(F.col("item_id").alias("qid"), F.col("text").alias("question"), F.col("embedding").alias("vector"))


def _vectors(spark, d):
    return _read(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))


def dense_topk_batch(spark, d):
    return _round(rt.dense_topk(_vectors(spark, d), _questions(spark, d), 5))


def vector_norms(spark, d):
    n = vx.norm(F.col("vector"))
    v = vx.normalize(F.col("vector"))
    return _round(_vectors(spark, d).select("idx", n.alias("norm"), vx.norm(v).alias("unit"), v[0].alias("first")))


def tokenize_counts(spark, d):
    t = tx.tokens(F.col("text"))
    return _corpus(spark, d).select("idx", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def content_words(spark, d):
    w = tx.content_words(F.col("text"))
    return _corpus(spark, d).select("idx", F.size(w).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(w), " ")).alias("digest"))


def rare_terms(spark, d):
    w = tx.rare_terms(F.col("text"))
    return _corpus(spark, d).select("idx", F.size(w).cast("long").alias("n"), F.md5(F.array_join(F.array_sort(w), " ")).alias("digest"))


def numeric_tokens(spark, d):
    return _corpus(spark, d).select("idx", F.array_join(F.array_sort(tx.numeric_tokens(F.col("text"))), " ").alias("numbers"))


def window_chunks(spark, d):
    docs = _documents(spark, d).select("doc_id", F.col("source").alias("source_file"), F.col("lang").alias("publisher"), "text")
    out = chunking.window_chunks(docs)
    return out.select("doc_id", "source_file", "publisher", "part", "n_tokens", F.md5("text").alias("digest"))


def chunk_numbers(spark, d):
    docs = _documents(spark, d).select("doc_id", F.col("lang").alias("publisher"))
    return chunking.number_chunks(docs, ["doc_id"]).select("doc_id", "chunk_id")


def next_chunk_numbers(spark, d):
    docs = _documents(spark, d).select(F.col("lang").alias("publisher"), F.concat("lang", F.lit("_"), F.when(F.col("doc_id") % 97 == 0, "x").otherwise(F.lpad(F.col("doc_id").cast("string"), 7, "0"))).alias("chunk_id"))
    return chunking.next_numbers(docs)


def embedding_preflight(spark, d):
    docs = _documents(spark, d).select(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_tokens"))
    return chunking.preflight(docs)


def paragraph_pack(spark, d):
    packed = chunking.pack_paragraphs(F.substring("text", 1, 60), F.filter(F.split("text", "\n"), lambda p: p != ""))
    sizes = F.transform(packed, lambda p: F.size(p).cast("string"))
    return _documents(spark, d).select("doc_id", F.array_join(sizes, ",").alias("pieces"))


def bm25_idf(spark, d):
    return _round(rt.idf_table(rt.build_index(_corpus(spark, d))))


def bm25_topk(spark, d):
    corpus, questions = _corpus(spark, d), _questions(spark, d)
    return _round(rt.bm25_topk(staged(rt.bm25_scores(rt.build_index(corpus), questions), "scores"), corpus, questions, 30), 5)


def rrf_hybrid(spark, d):
    return _round(rt.hybrid(_chunks(spark, d), _questions(spark, d)), 5)


def context_build(spark, d):
    chunks = _chunks(spark, d)
    hits = rt.dense_topk(chunks, _questions(spark, d), 5).join(chunks.select("idx", "text", "source_file"), "idx")
    return rt.context(hits).select("qid", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("digest"))


def query_rewrite(spark, d):
    questions = _questions(spark, d)
    cache = questions.where("qid % 2 = 0").select("question", F.when(F.col("qid") % 4 == 0, F.concat(F.lit('"'), F.substring("question", 1, 20), F.lit('" '))).otherwise("").alias("translation"))
    return rt.rewrite(questions.select("qid", "question"), cache).select("qid", "retrieval_query")


def graph_edges(spark, d):
    return graph.edges(_talks(spark, d)).groupBy("src", "dst", "etype").agg(F.count(F.lit(1)).alias("n"))


def graph_edge_counts(spark, d):
    return graph.edge_counts(graph.edges(_talks(spark, d)))


def _talks(spark, d):
    c = _read(spark, d, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("conv_id").cast("string").alias("source_file"), F.col("role").alias("chapter"),
        F.lit("t").alias("section_title"), F.lit("1").alias("section_number"), F.when(F.col("turn") < 3, 3).otherwise(1).alias("part_total"),
    )


def graph_adjacency(spark, d):
    return graph.adjacency(graph.edges(_chunks(spark, d)))


def graph_expand(spark, d):
    """Two seeds a question, over the whole range of chunks."""
    chunks = _chunks(spark, d)
    n = max(1, chunks.count())
    seeds = _questions(spark, d).select("qid", F.explode(F.array(F.struct((F.col("qid") * 7 % n).alias("idx"), F.lit(0).alias("ord")), F.struct(((F.col("qid") * 7 + 11) % n).alias("idx"), F.lit(1).alias("ord")))).alias("s")).select("qid", "s.*")
    return graph.expand(seeds, graph.adjacency(graph.edges(chunks)))


def graph_retrieve(spark, d):
    chunks = _chunks(spark, d)
    return _round(graph.retrieve(chunks, _questions(spark, d), graph.adjacency(graph.edges(chunks))))


def hybrid_graph_retrieve(spark, d):
    chunks = _chunks(spark, d)
    return _round(graph.retrieve_hybrid(chunks, _questions(spark, d), graph.adjacency(graph.edges(chunks))), 5)


def fingerprint(spark, d):
    """All 63 features over hybrid graph hits."""
    chunks, questions = _chunks(spark, d), _questions(spark, d)
    hits = graph.retrieve_hybrid(chunks, questions, graph.adjacency(graph.edges(chunks)))
    return _round(signals.fingerprint(questions, hits, chunks, hybrid=True), 5)


def fingerprint_dense(spark, d):
    """The 49 features over dense hits, where nothing is known of a graph."""
    chunks, questions = _chunks(spark, d), _questions(spark, d)
    hits = rt.dense_topk(chunks, questions, methods.SECTION_K)
    return _round(signals.fingerprint(questions, hits, chunks), 5)


def sanitize_paths(spark, d):
    return _read(spark, d, "pages").select("page_id", tx.sanitize_path(F.col("url")).alias("path"))


def case_rescue(spark, d):
    named = F.concat(F.when(F.col("page_id") % 2 == 0, F.upper(F.substring("url", 1, 14))).otherwise(F.substring("url", 1, 14)), F.lit(".html"))
    pages = _read(spark, d, "pages").select(F.col("page_id").alias("pos"), named.alias("path"))
    return expansion.rescue_case(pages).select("pos", "stored")


def corpus_filter(spark, d):
    parts = _read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"), F.when(F.col("p_size") % 2 == 0, "finlex").otherwise("vero").alias("publisher"))
    return parts.where(expansion.relevant(F.col("path"), F.col("publisher"), ["blue", "steel", "almond"], "pale")).groupBy("publisher").agg(F.count(F.lit(1)).alias("kept"))


def _part_files(spark, d):
    return _read(spark, d, "part").select(F.concat("p_name", F.lit("/"), F.translate("p_type", " ", "_"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".html")).alias("path"))


def keyword_promote(spark, d):
    return expansion.promote_keywords(_part_files(spark, d), ["Promo", " ", "economy"]).select("path")


def dir_promote(spark, d):
    return expansion.promote_folders(_read(spark, d, "pages").select(F.col("url").alias("path")), ["en", "de/"])


def anchor_files(spark, d):
    asked = _read(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("qid"), F.array(*[F.lit(a) for a in ("html", "promo", "economy", "standard", "medium")]).alias("all"))
    asked = asked.select("qid", F.slice("all", F.lit(1), (F.col("qid") + 1).cast("int")).alias("anchors"))
    return expansion.promote_failures(asked, _part_files(spark, d), least=2, limit=5)


def question_anchors(spark, d):
    bank = _questions(spark, d).select("qid", F.concat(F.lit("("), "question", F.lit(")")).alias("question"), F.lit("").alias("answer"), F.array().cast("array<string>").alias("answer_key_facts"))
    return expansion.anchors(bank, markers=["ation", "thing"]).select("qid", F.array_join("anchors", " ").alias("anchors"))


def not_indexed(spark, d):
    files = _documents(spark, d).select(F.col("doc_id").cast("string").alias("path"))
    return expansion.not_indexed(files, _read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("source_file")))


def selection_union(spark, d):
    files = _part_files(spark, d)
    return expansion.union_selections(expansion.promote_keywords(files, ["economy"]), expansion.promote_folders(files, ["blue"]))


def _results(spark, d):
    """Judged answers: labels with the tier of their document's language."""
    labels, docs = _read(spark, d, "labels"), _documents(spark, d).select("doc_id", "lang", "source")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("tier"), F.col("source").alias("method"), (F.col("quality") == 1).alias("passed"))


def tier_accuracy(spark, d):
    return _round(evaluation.by_tier(_results(spark, d)))


def overall_accuracy(spark, d):
    return _round(evaluation.overall(_results(spark, d)))


def running_accuracy(spark, d):
    return _round(evaluation.running(_results(spark, d), "id", "method"))


def method_summary(spark, d):
    results = _results(spark, d)
    catalog = results.select(F.col("method").alias("id")).distinct()
    fits = results.groupBy("method", F.col("tier").alias("model")).agg(F.avg(F.col("passed").cast("double")).alias("bal_acc")).where("method <> 'src3'")
    return _round(evaluation.method_summary(catalog, results.where("method <> 'src5'"), fits))


def best_method(spark, d):
    return evaluation.best_method(method_summary(spark, d))


def _predictions(spark, d):
    return _read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), (F.col("doc_id") % 3 != 0).cast("int").alias("prediction"))


def confusion_metrics(spark, d):
    return _round(evaluation.confusion(_predictions(spark, d)))


def majority_baseline(spark, d):
    return _round(evaluation.majority_baseline(_predictions(spark, d)))


def stratified_folds(spark, d):
    return models.stratified_folds(_predictions(spark, d), 5).select("id", "label", "fold")


def fold_metrics(spark, d):
    dealt = models.stratified_folds(_predictions(spark, d), 5)
    return _round(models.fold_summary(models.metrics(dealt, ["fold"]), []))


def resume_antijoin(spark, d):
    return _documents(spark, d).select(F.col("doc_id").alias("id")).join(_read(spark, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_anti")


def id_difference(spark, d):
    return evaluation.id_difference(_documents(spark, d).select(F.col("doc_id").alias("id")), _vectors(spark, d).select(F.col("idx").alias("id")))


def percent_sample(spark, d):
    return evaluation.sample_exact(_documents(spark, d).select("doc_id", "lang"), "doc_id", 12.5)


def answer_judgement(spark, d):
    """Each labelled document's whole text judged against all its lines as facts, by the offline judge."""
    from veldra.sources.providers import offline_judge_of

    docs = _documents(spark, d).join(_read(spark, d, "labels").select("doc_id"), "doc_id")
    facts = F.split("text", "\n")
    answers = docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("tier"), F.col("text").alias("answer_generated"), facts.alias("facts"))
    # Dealing rows out keeps a text's words from being taken again for each fact.
    read = answers.withColumns({"words": tx.content_words(F.col("answer_generated")), "numbers": tx.numeric_tokens(F.col("answer_generated"))}).repartition("id")
    return evaluation.judge(read, lambda fact, _: offline_judge_of(fact, F.col("words"), F.col("numbers"))).select("id", "tier", "n_facts_total", "n_facts_passed", "passed")


def source_previews(spark, d):
    chunks = _chunks(spark, d)
    hits = rt.dense_topk(chunks, _questions(spark, d), 3).join(chunks.drop("vector"), "idx")
    return evaluation.sources(hits).select("qid", "rank", "title", "section", F.length("preview").alias("n_preview"))


def html_text(spark, d):
    t = sections.html_text(F.col("html"))
    return _read(spark, d, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("digest"))


def html_links(spark, d):
    return _read(spark, d, "pages").select("page_id", F.array_join(sections.links(F.col("html")), " ").alias("links"))


def _sections(spark, d):
    kind = F.when(F.col("page_id") % 2 == 0, "vero").otherwise("finlex")
    html = F.when(F.col("page_id") % 2 == 0, F.col("html")).otherwise(F.replace("html", F.lit("<article>"), F.lit("<h3 id=s1>1 a § Kohta</h3>")))
    return sections.sections(_read(spark, d, "pages").select(F.col("page_id").cast("string").alias("source_file"), kind.alias("publisher"), html.alias("html")))


def section_parse(spark, d):
    return _sections(spark, d).select("source_file", "pos", "error", "publisher", "section_title", "section_number", F.size("paragraphs").alias("n_paragraphs"), F.size("cross_refs").alias("n_refs"), F.length("raw_text").alias("n_chars"))


def section_chunks(spark, d):
    return chunking.section_chunks(_sections(spark, d).where("error IS NULL")).select("source_file", "pos", "part_index", "part_total", F.length("text").alias("n_chars"))


def classifier_bench(spark, d):
    """Model selection over features of labelled documents' chunks; a row for each kind of model."""
    chunks = _chunks(spark, d)
    made = chunks.join(_read(spark, d, "labels"), F.col("idx") == F.col("doc_id"))
    size = made.select(F.max(F.size("vector"))).first()[0] or 0
    names = [*(f"v{i}" for i in range(size)), "n_chars"]
    rows = made.select(F.col("idx").alias("id"), F.col("quality").cast("int").alias("label"), *[F.col("vector")[i].cast("double").alias(f"v{i}") for i in range(size)], F.length("text").cast("double").alias("n_chars"))
    found = models.bench(rows.cache(), names)
    out = [(i, b.name, *(round(b.scores[k], R) for k in ("cv_mean_accuracy", "cv_mean_balanced_accuracy", "cv_mean_f1")), b.importances[0][0]) for i, b in enumerate(found)]
    return spark.createDataFrame(out, "place int, model string, accuracy double, balanced_accuracy double, f1 double, first_feature string")


def report_summary(spark, d):
    """Roll-up of reports made of tiers' pass rates: a row for each source and tier."""
    results = _results(spark, d)
    m = results.groupBy("method", F.col("tier").alias("name")).agg(F.avg(F.col("passed").cast("double")).alias("b"), F.count(F.lit(1)).alias("n"))
    kind = spark.createDataFrame([], reports.SCHEMA).schema["models"].dataType
    model = F.struct("name", F.col("b").alias("a"), F.lit(0.0).alias("c"), F.col("b").alias("d"), F.lit(0.0).alias("e"), F.col("b").alias("f"), (F.col("b") - 0.5).alias("g"), F.lit(None).cast("int").alias("h"), F.array(F.struct(F.lit("x"), F.lit(0.5)), F.struct(F.lit("y"), F.lit(0.0))).alias("i"))
    made = m.groupBy("method").agg(F.collect_list(model).cast(kind).alias("models"), F.max_by("name", F.struct("b", "name")).alias("best_model"), F.sum("n").cast("int").alias("n_samples"))
    flat = [F.lit(None).cast(t).alias(c) for c, t in (("baseline_accuracy", "double"), ("cv_mean_accuracy", "double"), ("cv_std_accuracy", "double"), ("cv_mean_balanced_accuracy", "double"), ("cv_std_balanced_accuracy", "double"), ("cv_mean_f1", "double"), ("cv_improvement_over_baseline", "double"), ("nonzero_feature_count", "int"), ("feature_importances", "array<struct<name:string,importance:double>>"))]
    out = reports.summary(made.select("*", *flat), reports.pass_rates(results))
    return _round(out.select("method", "model", "is_best", "n", "pass_rate", "cv_bal_acc", "delta_bal", "nonzero_count", F.array_join("top_features", ",").alias("top")))


def _filtered_parts(spark, d):
    publisher = F.when(F.col("p_size") % 2 == 0, "finlex").otherwise("vero")
    return _read(spark, d, "part").select(F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"), publisher.alias("publisher"))


def corpus_complement(spark, d):
    return expansion.left_out(_filtered_parts(spark, d), keywords=["7", "13"], always="hot").select("path")


def kept_and_total(spark, d):
    return expansion.kept_and_total(_filtered_parts(spark, d), keywords=["7", "13"], always="hot")


def results_with_bank(spark, d):
    bank = _read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"), F.lit(None).cast("int").alias("difficulty"), F.array("text").alias("answer_key_facts"))
    return evaluation.with_bank(_results(spark, d), bank).select("id", "tier", "passed", F.col("answer_key_facts")[0].alias("question"))


def ask(spark, d):
    """Every question answered over the sections that are nearest, by the offline stand-in for a chat model."""
    out = engine.Engine(_chunks(spark, d), "section_v1").ask(_questions(spark, d))
    return out.select("qid", F.size("sources").alias("n_sources"), F.col("sources")[0]["title"].alias("top_title"), F.md5("answer").alias("digest"))


def evaluate_bank(spark, d):
    """Every question evaluated under the hybrid graph method: retrieval, answer and judgement of its facts."""
    bank = _questions(spark, d).select(F.col("qid").alias("id"), F.lit("basic").alias("tier"), "question", F.col("question").alias("answer"), F.split("question", r"(?<=\.) ").alias("answer_key_facts"), "vector")
    path = f"{scratch(spark)}/evaluated-{uuid.uuid4().hex}"
    out = engine.Engine(_chunks(spark, d), "hybrid_graph_section_v1").evaluate(bank, path)
    return out.select("id", "n_facts_total", "n_facts_passed", "passed", F.size("sources").alias("n_sources"))


QUERIES = {
    f.__name__: f
    for f in (
        dense_topk_batch, vector_norms, tokenize_counts, content_words, rare_terms, numeric_tokens, window_chunks, chunk_numbers,
        next_chunk_numbers, embedding_preflight, paragraph_pack, bm25_idf, bm25_topk, rrf_hybrid, context_build, query_rewrite, graph_edges,
        graph_edge_counts, graph_adjacency, graph_expand, graph_retrieve, hybrid_graph_retrieve, fingerprint, fingerprint_dense, sanitize_paths,
        case_rescue, corpus_filter, keyword_promote, dir_promote, anchor_files, question_anchors, not_indexed, selection_union, tier_accuracy,
        overall_accuracy, running_accuracy, method_summary, best_method, confusion_metrics, majority_baseline, stratified_folds, fold_metrics,
        resume_antijoin, id_difference, percent_sample, answer_judgement, source_previews, html_text, html_links, section_parse, section_chunks,
        classifier_bench, report_summary, corpus_complement, kept_and_total, results_with_bank, ask, evaluate_bank,
    )
}
