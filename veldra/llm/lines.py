"""Line dedup: drop lines that many documents share, keeping one holder of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import ASCII_SPACE, ascii_lower, kept, key_bitmaps, materialize, may_hold, row_key, tables

MIN_CHARS, MIN_DOCS = 20, 3


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, __v_k1, __v_k2, pos, h1, h2)`` for the lines long enough to count: the row's key, the line's place and hash."""
    text = _text(docs)
    each = docs.where(F.length(text) >= min_chars).select("doc_id", *row_key(F.col("doc_id"), text), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    long = each.where(F.length("line") >= min_chars)
    low = long.select("doc_id", "__v_k1", "__v_k2", "pos", ascii_lower(F.btrim(F.col("line"), F.lit(ASCII_SPACE))).alias("key"))
    return low.where(F.length("key") >= min_chars).select("doc_id", "__v_k1", "__v_k2", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``lines`` (:func:`keyed_lines`) whose hash stands in at least ``min_docs`` lines, as a table.

    Counting combines before its shuffle, so a line that a third of all documents hold sends a row for each
    map task. Both sides of the join come from files: the lines of a hot hash are split over tasks.
    """
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    return materialize(lines.join(materialize(often.select("h1", "h2"), "line-hashes"), ["h1", "h2"]), "repeated-lines")


def common_lines(repeated: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``(h1, h2, keep)``: hashes that at least ``min_docs`` distinct documents hold, and the largest holder."""
    once = repeated.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    docs = once.groupBy("h1", "h2").agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("keep"))
    return docs.where(F.col("docs") >= min_docs).select("h1", "h2", "keep")


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(__v_k1, __v_k2, __v_gone)``: for each row that loses lines their positions, ascending, as a table.

    Texts are read once; what travels after that are hashes and positions.
    """
    with tables():
        lines = materialize(keyed_lines(docs, min_chars), "lines")
        repeated = repeated_lines(lines, min_docs)
        common = materialize(common_lines(repeated, min_docs), "common-lines")
        hit = repeated.join(common, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep")))
        # Rows that are equal share a key, hence the set.
        return kept(hit.groupBy("__v_k1", "__v_k2").agg(F.sort_array(F.collect_set("pos")).alias("__v_gone")), "dropped-lines")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs`` with ``text`` less its shared lines, plus ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` distinct ``doc_id`` lose all their lines but those of
    the largest ``doc_id`` holding them; that document keeps each of its copies.

    Null or empty text is one empty line, which stays. Rows with a null ``doc_id`` count as no document but lose shared lines; repeated rows count once
    and are treated alike. A very long text is one row; only positions of its dropped lines travel between
    rows. Other columns pass through, and extra columns named like the two counters are replaced. An empty
    table gives no rows.
    """
    rows = docs.drop(*[c for c in docs.columns if c in ("n_lines", "n_dropped")])
    text = _text(rows)
    k1, k2 = row_key(F.col("doc_id"), text)
    gone = dropped_lines(docs, min_docs, min_chars)
    # Rows that a fixed-size filter over the keys of all that lose lines lets pass stay where they are; for the
    # others positions are hashed and texts stream past them, so no sort holds texts.
    keyed = rows.withColumns({"text": text, "__v_k1": k1, "__v_k2": k2})
    told = may_hold(keyed, kept(key_bitmaps(gone, "__v_k1"), "filter"), "__v_k1", "__v_may")
    whole = told.where("NOT __v_may").withColumn("__v_gone", F.lit(None).cast("array<int>"))
    some = told.where("__v_may").join(gone.hint("shuffle_hash"), ["__v_k1", "__v_k2"], "left")
    joined = whole.unionByName(some)
    # The split text is a column of its own: read twice below, it is made once a row.
    loses = F.col("__v_gone").isNotNull()
    joined = joined.withColumn("__v_parts", F.when(loses, F.split("text", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__v_parts") - 1), "__v_gone")
    less = F.array_join(F.transform(stay, lambda i: F.element_at("__v_parts", i + 1)), "\n")
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    out = joined.withColumns(
        {"n_lines": n_lines.cast("long"), "n_dropped": F.when(loses, F.size("__v_gone")).otherwise(0).cast("long"), "text": F.when(loses, less).otherwise(F.col("text"))}
    )
    return out.select(*rows.columns, "n_lines", "n_dropped")
