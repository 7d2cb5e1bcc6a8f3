"""From documents and sections to chunks: token windows, merging of short sections, packing of paragraphs.

Folds whose state depends on what was kept so far are written with ``aggregate`` over one document's
array, so they run inside the JVM and need no ordering beyond the array's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldra.functions import text as tx
from veldra.operators.methods import CHUNK_OVERLAP, CHUNK_SIZE
from veldra.sources.stores import staged

SHORT_SECTION = 200
PRICE_PER_MILLION, CHUNKS_PER_SECOND = 0.02, 200


def windows(tokens: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping runs of ``size`` tokens; the last one ends with the text."""
    n, step = F.size(tokens), size - overlap
    count = F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    starts = F.when(count == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step))
    return F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(size)))


def window_chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``(doc_id, source_file, publisher, part, n_tokens, char_offset, text)`` of ``docs(doc_id, source_file, publisher, text)``.

    ``char_offset`` is where a window's first word starts in the text, from the lengths of the gaps and words before.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    taken = docs.select("doc_id", "source_file", "publisher", text.alias("__text"), words.alias("__words"))
    step = size - overlap
    # The text cut before every step-th word: a window starts where its part does.
    gaps = F.regexp_extract_all("__text", F.lit(rf"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]++){{1,{step}}}"), F.lit(0))
    starts = F.aggregate(
        F.col("__gaps"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, g: F.struct((a["at"] + F.length(g)).alias("at"), F.concat(a["out"], F.array((a["at"] + F.length(g) - F.length(F.ltrim(g, F.lit(" \t\n\x0b\x0c\r")))).cast("int"))).alias("out")),
        lambda a: a["out"],
    )
    placed = taken.withColumn("__gaps", gaps).withColumn("__starts", starts)
    each = placed.select("doc_id", "source_file", "publisher", "__starts", F.posexplode(windows(F.col("__words"), size, overlap)).alias("part", "w"))
    return each.select("doc_id", "source_file", "publisher", "part", F.size("w").alias("n_tokens"), F.get("__starts", F.col("part")).alias("char_offset"), F.array_join("w", " ").alias("text"))


def char_offsets(text: Column, pieces: Column, probe: int = 40) -> Column:
    """Where each piece starts in ``text``: its first characters are looked for from behind the previous start."""
    state = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, piece: Column) -> Column:
        found = F.position(F.substring(piece, 1, probe), text, a["cursor"] + 1) - 1
        at = F.when((F.length(piece) < probe) | (found < 0), a["cursor"]).otherwise(found).cast("int")
        return F.struct((at + 1).alias("cursor"), F.concat(a["out"], F.array(at)).alias("out"))

    return F.aggregate(pieces, state, step, lambda a: a["out"])


def number_chunks(chunks: DataFrame, order: list[str], first: int = 0) -> DataFrame:
    """``chunks`` with ``chunk_id``: publisher and a running number over the whole corpus, in ``order``.

    Rows are sorted by range and written once with their range and place; numbers come from the counts of
    ranges, so no task sees all rows and no second sort can cut the ranges elsewhere.
    """
    ranged = chunks.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
    marked = staged(ranged.withColumns({"__part": F.spark_partition_id(), "__n": place}), "numbered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy("__part").agg(F.count(F.lit(1)).alias("__count"))  # a row for each range
    starts = counts.select("__part", (F.coalesce(F.sum("__count").over(before), F.lit(0)) + first).alias("__start"))
    number = F.col("__start") + F.col("__n")
    return marked.join(F.broadcast(starts), "__part").withColumn("chunk_id", F.format_string("%s_%07d", F.col("publisher"), number)).drop("__part", "__n", "__start")


def next_numbers(chunks: DataFrame) -> DataFrame:
    """``(publisher, next_number)``: one more than the largest number of each publisher's well-formed ids."""
    tail = F.expr("try_cast(substring_index(chunk_id, '_', -1) AS BIGINT)")
    return chunks.groupBy("publisher").agg((F.coalesce(F.max(tail), F.lit(-1)) + 1).alias("next_number"))


def preflight(chunks: DataFrame) -> DataFrame:
    """One row: chunks, tokens, price and minutes of embedding them."""
    n = F.count(F.lit(1))
    tokens = F.coalesce(F.sum("n_tokens"), F.lit(0))
    return chunks.agg(n.alias("chunks"), tokens.alias("tokens"), F.round(tokens / 1e6 * PRICE_PER_MILLION, 8).alias("usd"), F.round(n / CHUNKS_PER_SECOND / 60, 6).alias("minutes"))


def raw_text(title: Column, paragraphs: Column) -> Column:
    """A section's text: title and paragraphs, empty ones left out, blank lines between."""
    return F.array_join(F.filter(F.concat(F.array(title), paragraphs), lambda x: x != ""), "\n\n")


def merge_short(sections: Column, limit: int = SHORT_SECTION) -> Column:
    """An array of sections in which each short one is merged into the next of its chapter, type and standing.

    The fold looks at the last section kept; a merged one may be merged again, and a short last one stays.
    """
    empty = F.filter(sections, lambda x: F.lit(False))

    def joined(a: Column, b: Column, mark: str) -> Column:
        return F.when(a == "", b).when(b == "", a).otherwise(F.concat(a, F.lit(mark), b))

    def merged(p: Column, n: Column) -> Column:
        title, paragraphs = joined(p["section_title"], n["section_title"], " + "), F.concat(p["paragraphs"], n["paragraphs"])
        made = n.withField("section_title", title).withField("section_number", joined(p["section_number"], n["section_number"], "+"))
        made = made.withField("section_id", F.when(p["section_id"] != "", p["section_id"]).otherwise(n["section_id"])).withField("paragraphs", paragraphs)
        return made.withField("cross_refs", F.array_distinct(F.concat(p["cross_refs"], n["cross_refs"]))).withField("raw_text", raw_text(title, paragraphs))

    def step(out: Column, n: Column) -> Column:
        p = F.try_element_at(out, F.lit(-1))
        alike = (p["chapter"] == n["chapter"]) & (p["node_type"] == n["node_type"]) & (p["is_superseded"] == n["is_superseded"])
        short = (F.size(out) > 0) & (F.length(p["raw_text"]) < limit) & alike
        kept = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(F.coalesce(short, F.lit(False)), F.concat(kept, F.array(merged(p, n)))).otherwise(F.concat(out, F.array(n)))

    return F.aggregate(sections, empty, step)


def pack_paragraphs(title: Column, paragraphs: Column, limit: int = CHUNK_SIZE) -> Column:
    """Groups of consecutive paragraphs of at most ``limit`` tokens with the title; an oversize one stands alone."""
    count = lambda t: F.size(tx.tokens(t))
    none = F.array().cast("array<array<string>>")
    state = F.struct(none.alias("done"), F.array().cast("array<string>").alias("now"), count(title).alias("n"))

    def step(a: Column, p: Column) -> Column:
        full = (F.size(a["now"]) > 0) & (a["n"] + count(p) > limit)
        return F.when(full, F.struct(F.concat(a["done"], F.array(a["now"])).alias("done"), F.array(p).alias("now"), (count(title) + count(p)).alias("n"))).otherwise(
            F.struct(a["done"].alias("done"), F.concat(a["now"], F.array(p)).alias("now"), (a["n"] + count(p)).alias("n"))
        )

    return F.aggregate(paragraphs, state, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))


def section_chunks(sections: DataFrame, limit: int = CHUNK_SIZE) -> DataFrame:
    """A row for each piece of each section, with ``part_index`` from 1, ``part_total`` and ``text``."""
    packed = sections.withColumn("__p", pack_paragraphs(F.col("section_title"), F.col("paragraphs"), limit)).withColumn("part_total", F.size("__p"))
    each = packed.select(*sections.columns, "part_total", F.posexplode("__p").alias("__i", "__paras"))
    text = raw_text(F.col("section_title"), F.col("__paras"))
    return each.select(*sections.columns, (F.col("__i") + 1).alias("part_index"), "part_total", F.lit(0).alias("char_offset"), text.alias("text"))
