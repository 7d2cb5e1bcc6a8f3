"""Choosing what to index: relevance by file name, promotion by keyword, folder or failed question, appending."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldra.functions.text import strip_diacritics
from veldra.operators.chunking import number_chunks, preflight
from veldra.sources.stores import back_up, remove, roll_back, staged

# Parts of file names that make a statute relevant, and parts of words that make an anchor.
KEYWORDS = (
    "vero", "verotus", "verosopim", "tulo", "lähde", "arvonlisä", "ennakkop", "kirjanpito", "tilintarkast", "elinkein", "avainhenki", "perintö", "lahja",
    "kiinteistö", "osinko", "luovutus", "palkka", "eläke",
)
ALWAYS = "tuloverosopim"
DOMAIN_MARKERS = (
    "vero", "maksu", "sopim", "pidatys", "pidätys", "paaoma", "pääoma", "elake", "eläke", "perinto", "perintö", "lahja", "kiinteist", "osinko",
    "luovutus", "palkka", "ennakko", "paivaraha", "päiväraha", "vakuutus", "sairaanhoito", "lahde", "lähde", "etuus", "etu", "yleisradio", "verotus",
    "verotett", "asunto", "matka", "tyel", "yel", "ennakkoperin",
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def relevant(path: Column, publisher: Column, keywords=KEYWORDS, always: str = ALWAYS, filtered: str = "finlex") -> Column:
    """Whether a file belongs in the corpus; a predicate on names, so it runs before any file is read."""
    named = F.lower(file_name(path)).rlike("|".join(map(re.escape, keywords)))
    return (publisher != filtered) | path.contains(always) | named


def left_out(files: DataFrame, **rule) -> DataFrame:
    """The files of ``files(path, publisher)`` that :func:`relevant` leaves out."""
    return files.where(~F.coalesce(relevant(F.col("path"), F.col("publisher"), **rule), F.lit(False)))


def kept_and_total(files: DataFrame, **rule) -> DataFrame:
    """``(publisher, kept, total)``: what the filter keeps of each publisher's files."""
    keeps = F.coalesce(relevant(F.col("path"), F.col("publisher"), **rule), F.lit(False))
    return files.groupBy("publisher").agg(F.count_if(keeps).alias("kept"), F.count(F.lit(1)).alias("total"))


def matched_questions(asked: DataFrame, promoted: DataFrame) -> DataFrame:
    """One row: questions of ``asked(qid, ...)`` that ``promoted(qid, ...)`` has a file for, and all."""
    found = promoted.select("qid").distinct().withColumn("hit", F.lit(True))
    return asked.select("qid").distinct().join(found, "qid", "left").agg(F.count_if(F.coalesce("hit", F.lit(False))).alias("matched"), F.count(F.lit(1)).alias("total"))


def promote_keywords(files: DataFrame, needles: list[str]) -> DataFrame:
    """Files whose name holds one of ``needles``; blank ones do not count."""
    wanted = [re.escape(n.strip().lower()) for n in needles if n.strip()]
    return files.where(F.lower(file_name(F.col("path"))).rlike("|".join(wanted))) if wanted else files.where(F.lit(False))


def promote_folders(files: DataFrame, folders: list[str]) -> DataFrame:
    """Files with a path segment that starts with one of ``folders``."""
    wanted = "|".join(re.escape(f) for f in folders if f)
    return files.where(F.col("path").rlike(rf"(^|[/\\])(?:{wanted})")) if wanted else files.where(F.lit(False))


def anchors(bank: DataFrame, markers=DOMAIN_MARKERS, stop=()) -> DataFrame:
    """``(qid, anchors)``: telling words of a question's brackets and of its key facts, without accents, in order."""
    word = F.lit("[A-Za-zÅÄÖåäö-]{5,}")
    spans = F.array_join(F.regexp_extract_all("question", F.lit(r"\(([^)]*)\)"), F.lit(1)), " ")
    facts = F.array_join(F.when(F.size("answer_key_facts") > 0, F.col("answer_key_facts")).otherwise(F.array(F.coalesce("answer", F.lit("")))), " ")
    raw = F.concat(F.regexp_extract_all(spans, word, F.lit(0)), F.regexp_extract_all(facts, word, F.lit(0)))
    plain = lambda w: F.btrim(strip_diacritics(F.lower(w)), F.lit("-_"))
    telling = "|".join(map(re.escape, markers))
    kept = F.filter(raw, lambda w: (F.length(plain(w)) >= 6) & ~plain(w).isin(list(stop) or [""]) & (plain(w).rlike(telling) | ((F.length(w) >= 10) & w.rlike("[ÅÄÖåäö]"))))
    return bank.select("qid", F.array_distinct(F.transform(kept, plain)).alias("anchors"))


def promote_failures(asked: DataFrame, files: DataFrame, least: int = 2, limit: int = 5) -> DataFrame:
    """``(qid, path, hits, rank)``: for each question of ``asked(qid, anchors)`` the files whose names hold its anchors.

    An anchor of 4 characters or more that equals a token of the name is found by an equi-join. Longer ones
    (8 or more) may stand inside a name; those are matched by their first four letters against the name's
    runs of four, so that only names that can hold an anchor are compared with it.
    """
    able = asked.where(F.size("anchors") >= least).select("qid", F.explode("anchors").alias("anchor"))
    name = strip_diacritics(F.lower(file_name(F.col("path"))))
    named = files.select("path", name.alias("name")).withColumn("toks", F.filter(F.split("name", "[^a-z0-9]+"), lambda t: F.length(t) >= 4))
    exact = able.join(named.select("path", "name", F.explode(F.array_union("toks", F.array("name"))).alias("anchor")), "anchor").select("qid", "path", "name", "anchor")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 3, F.lit(1))), lambda i: F.substr(F.col("name"), i, F.lit(4))))
    inside = able.where(F.length("anchor") >= 8).withColumn("gram", F.substring("anchor", 1, 4)).join(named.select("path", "name", F.explode(grams).alias("gram")), "gram")
    inside = inside.where(F.contains("name", "anchor")).select("qid", "path", "name", "anchor")
    hits = exact.union(inside).distinct().groupBy("qid", "path", "name").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= least)
    order = Window.partitionBy("qid").orderBy(F.desc("hits"), F.length(file_name(F.col("path"))), "path")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("qid", "path", "hits", "rank")


def union_selections(*selections: DataFrame) -> DataFrame:
    """Paths in any of the selections."""
    out = selections[0].select("path")
    for more in selections[1:]:
        out = out.union(more.select("path"))
    return out.distinct()


def not_indexed(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files that no chunk comes from yet."""
    return files.join(chunks.select(F.col("source_file").alias("path")).distinct(), "path", "left_anti")


def rescue_case(files: DataFrame) -> DataFrame:
    """Sanitised names made distinct on file systems that ignore case: later ones get ``__case<i>`` before the ending."""
    from veldra.functions.text import sanitize_path

    safe = files.withColumn("safe", sanitize_path(F.col("path")))
    w = Window.partitionBy(F.lower("safe")).orderBy("pos")
    ranked = safe.withColumn("i", F.row_number().over(w) - 1)
    stem, ending = F.regexp_extract("safe", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("safe", r"(\.[^./]*)?$", 1)
    return ranked.withColumn("stored", F.when(F.col("i") > 0, F.concat(stem, F.lit("__case"), F.col("i").cast("string"), ending)).otherwise(F.col("safe"))).drop("i")


def append_files(spark: SparkSession, store: str, files: DataFrame, chunk: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], dim: int, dry_run: bool = False) -> dict:
    """Chunk, number, embed and store the files of ``files(path, publisher, ...)`` that the index lacks; what was done, in counts.

    ``chunk`` gives ``(source_file, publisher, n_tokens, text, ...)`` rows and ``embed`` vectors of
    ``(idx, text)``. Chunks and vectors must agree before, and do so after: both tables are backed up first and
    put back if anything fails. A dry run counts and prices, and writes nothing.
    """
    places = [f"{store}/chunks", f"{store}/vectors"]
    chunks, vectors = (spark.read.parquet(p) for p in places)
    before = chunks.count()
    if (held := vectors.count()) != before:
        raise ValueError(f"the index holds {before} chunks and {held} vectors; build it anew first")
    todo = not_indexed(files, chunks)
    done = {"chunks_before": before, "files": todo.count(), "files_known": files.count(), "chunks_new": 0, "tokens": 0, "usd": 0.0, "written": False}
    done["files_known"] -= done["files"]
    first = (chunks.agg(F.max("idx")).first()[0] or 0) + 1 if before else 0
    ranks = number_chunks(chunk(todo), ["source_file", "part"], first)
    made = staged(ranks.withColumn("idx", F.expr("CAST(substring_index(chunk_id, '_', -1) AS BIGINT)")), "appended")
    plan = preflight(made).first()
    done |= {"chunks_new": plan.chunks, "tokens": plan.tokens, "usd": plan.usd}
    if dry_run or not plan.chunks:
        return done
    copies = [back_up(spark, p) for p in places]
    try:
        embed(made.select("idx", "text")).write.mode("append").parquet(places[1])
        made.select(*[F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in chunks.dtypes]).write.mode("append").parquet(places[0])
        now = [spark.read.parquet(p) for p in places]
        if any(df.count() != before + plan.chunks for df in now) or now[1].where(F.size("embedding") != dim).head():
            raise ValueError("chunks and vectors do not agree after the append")
    except BaseException:
        for place, copy in zip(places, copies, strict=True):
            roll_back(spark, place, copy)
        raise
    for copy in copies:
        remove(spark, copy)
    return done | {"written": True}
