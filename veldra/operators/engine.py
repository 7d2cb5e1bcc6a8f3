"""Asking and evaluating in batches: retrieval by method name, generation, sources, confidence, judging.

An :class:`Engine` holds what all questions share (chunks with vectors, inverted index, adjacency) as tables,
built once; with a ``store`` they are kept there and found again by the next engine.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.operators import evaluation, graph, methods, models, signals
from veldra.operators import retrieval as rt
from veldra.sources import providers, stores

CHUNK_FIELDS = ("source_file", "statute_name", "section_title")


@dataclass
class Engine:
    """A method over ``chunks(idx, text, vector, source_file, ...)`` with its model services.

    ``scorer`` is a fitted model with the names of its features (:func:`stores.load_model`); without one there
    is no confidence. ``translations(question, translation)`` serves methods that rewrite questions.
    """

    chunks: DataFrame
    method: str = methods.DEFAULT
    embed: Callable[[list[str]], list[list[float]]] = providers.hashed_vectors
    chat: Callable[[list[str]], list[str]] = providers.offline_chat
    scorer: tuple | None = None
    translations: DataFrame | None = None
    store: str | None = None
    spec: methods.Method = field(init=False)

    def __post_init__(self) -> None:
        self.spec = methods.resolve(self.method)

    @cached_property
    def index(self) -> rt.Index:
        return rt.build_index(self.chunks, f"{self.store}/{self.spec.index}/postings" if self.store else None)

    @cached_property
    def adjacency(self) -> DataFrame:
        def build() -> DataFrame:
            return graph.adjacency(graph.edges(self.chunks))

        return stores.reuse_or_build(self.chunks.sparkSession, f"{self.store}/{self.spec.index}/adjacency", build) if self.store else stores.staged(build(), "adjacency")

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Hits of ``questions(qid, question)`` under the method; a ``vector`` column saves the embedding.

        Questions of rewriting methods are retrieved by their translation.
        """
        asked = questions
        if self.spec.rewrites and self.translations is not None:
            asked = rt.rewrite(questions, self.translations).withColumn("question", F.col("retrieval_query")).drop("retrieval_query")
        if "vector" not in asked.columns:
            asked = stores.staged(asked, "asked")
            made = providers.embed(asked.select(F.col("qid").alias("idx"), F.col("question").alias("text")), self.embed)
            asked = asked.join(made.select(F.col("idx").alias("qid"), F.col("embedding").alias("vector")), "qid")
        k = self.spec.top_k
        ways = {
            "dense": lambda: rt.dense_topk(self.chunks, asked, k),
            "hybrid": lambda: rt.hybrid(self.chunks, asked, k=k, index=self.index),
            "graph": lambda: graph.retrieve(self.chunks, asked, self.adjacency, k=k),
            "hybrid_graph": lambda: graph.retrieve_hybrid(self.chunks, asked, self.adjacency, k=k, index=self.index),
        }
        return ways[self.spec.retriever]()

    def answers(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """``(qid, answer, gen_error)``: replies to the original questions over the hits' texts; an error has no answer."""
        shown = hits.select("qid", "rank", "idx").join(self.chunks.select("idx", "text", "source_file"), "idx")
        told = questions.select("qid", "question").join(rt.context(shown), "qid", "left")
        prompt = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.coalesce("question", F.lit("")))
        got = providers.reply(told.select(F.col("qid").cast("string").alias("id"), prompt.alias("prompt")), self.chat)
        return questions.select("qid").join(got, F.col("qid").cast("string") == got["id"], "left").select("qid", F.coalesce("reply", F.lit("")).alias("answer"), F.col("error").alias("gen_error"))

    def confidences(self, questions: DataFrame, hits: DataFrame) -> DataFrame:
        """``(qid, confidence)`` by the scorer over the features of the retrieval."""
        model, names = self.scorer
        made = signals.fingerprint(questions.select("qid", "question"), hits, self.chunks, hybrid=self.spec.hybrid_features)
        scored = models.predict(model, made.select("qid", *names))
        return scored.select("qid", evaluation.confidence(F.col("prediction"), F.col("p_pass")).alias("confidence"))

    def ask(self, questions: DataFrame) -> DataFrame:
        """``(qid, method, answer, sources, confidence, error)`` for each question; an empty one is an error of its own."""
        blank = F.trim(F.coalesce("question", F.lit(""))) == ""
        asked = questions.where(~blank)
        hits = stores.staged(self.retrieve(asked), "hits")
        fields = [c for c in CHUNK_FIELDS if c in self.chunks.columns]
        listed = evaluation.sources(hits.select("qid", "rank", "idx").join(self.chunks.select("idx", "text", *fields), "idx"))
        sources = listed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "section", "preview"))).alias("sources"))
        out = questions.select("qid", blank.alias("blank")).join(sources, "qid", "left").join(self.answers(asked, hits), "qid", "left")
        if self.scorer:
            out = out.join(self.confidences(asked, hits), "qid", "left")
        else:
            out = out.withColumn("confidence", F.lit(None).cast("struct<label:string,score:double,headline:string>"))
        error = F.when(F.col("blank"), "question is required").otherwise(F.col("gen_error"))
        return out.select("qid", F.lit(self.method).alias("method"), F.coalesce("answer", F.lit("")).alias("answer"), "sources", "confidence", error.alias("error"))

    def evaluate(self, bank: DataFrame, path: str, judge: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
        """Results of ``bank(id, tier, question, answer, answer_key_facts)``, appended to the table at ``path`` and returned whole.

        Entries with a result there are passed over, so a run that broke off goes on. A question that cannot be
        answered or judged has its error and no pass; the others are not touched. Every fact is judged by its
        own prompt, against the whole answer.
        """
        spark = self.chunks.sparkSession
        todo = stores.staged(evaluation.key_facts(stores.resume(bank, spark, path)), "entries")
        if not todo.head():
            return spark.read.parquet(path)
        asked = todo.select(F.col("id").alias("qid"), "question", *(["vector"] if "vector" in todo.columns else []))
        hits = stores.staged(self.retrieve(asked), "hits")
        answers = stores.staged(self.answers(asked, hits), "answers")
        graphical = "graph_distance" in hits.columns
        place = F.struct("rank", "source_file", "similarity", *(["graph_distance", "graph_edge", "graph_seed_origin"] if graphical else []))
        found = hits.join(self.chunks.select("idx", "source_file"), "idx").groupBy("qid").agg(F.array_sort(F.collect_list(place)).alias("h"))
        verdicts = self._judged(todo, answers, judge or self.chat)
        said = answers.select(F.col("qid").alias("id"), F.col("answer").alias("answer_generated"), "gen_error")
        out = todo.join(said, "id").join(found.withColumnRenamed("qid", "id"), "id", "left").join(verdicts, "id", "left")
        empty = F.array().cast(verdicts.schema["fact_judgements"].dataType)
        judged = F.coalesce("fact_judgements", empty)
        passed = F.size(F.filter(judged, lambda x: x["passed"]))
        results = out.select(
            "id", "tier", "question", "answer_generated", F.col("answer").alias("answer_expected"), F.transform(F.coalesce("h", F.array().cast(found.schema["h"].dataType)), lambda x: x["source_file"]).alias("sources"),
            F.coalesce(F.get("h", F.lit(0))["similarity"], F.lit(0.0)).alias("top1_similarity"), ((F.size(judged) > 0) & (passed == F.size(judged))).alias("passed"),
            F.size(judged).alias("n_facts_total"), passed.alias("n_facts_passed"), judged.alias("fact_judgements"), "gen_error", "judge_error",
            *([F.struct(F.transform("h", lambda x: x["graph_distance"]).alias("distances"), F.transform("h", lambda x: x["graph_edge"]).alias("edges"), F.transform("h", lambda x: x["graph_seed_origin"]).alias("seed_origins")).alias("graph")] if graphical else []),
        )
        results.write.mode("append").parquet(path)
        return spark.read.parquet(path)

    def _judged(self, entries: DataFrame, answers: DataFrame, judge: Callable[[list[str]], list[str]]) -> DataFrame:
        """``(id, fact_judgements, judge_error)`` of entries that have an answer."""
        each = entries.select("id", F.posexplode("facts").alias("pos", "key_fact")).join(answers.where("answer <> ''").select(F.col("qid").alias("id"), "answer"), "id")
        prompt = F.concat(F.lit(providers.JUDGE), F.lit("\nFact: "), "key_fact", F.lit("\nAnswer: "), "answer")
        each = stores.staged(each.select("id", "pos", "key_fact", F.concat_ws("|", F.col("id").cast("string"), F.col("pos").cast("string")).alias("key"), prompt.alias("prompt")), "facts")
        got = providers.reply(each.select(F.col("key").alias("id"), "prompt"), judge).select(F.col("id").alias("key"), "reply", "error")
        one = F.struct("pos", "key_fact", evaluation.judgement(F.col("reply")).alias("j"))
        per = each.join(got, "key", "left").groupBy("id").agg(F.array_sort(F.collect_list(one)).alias("all"), F.first("error", ignorenulls=True).alias("judge_error"))
        flat = F.transform("all", lambda x: F.struct(x["key_fact"].alias("key_fact"), *[x["j"][c].alias(c) for c in ("core_claim", "present_in_answer", "reasoning", "verdict", "passed", "raw")]))
        return per.select("id", flat.alias("fact_judgements"), "judge_error")
