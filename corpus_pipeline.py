"""A training-data pipeline over ``documents``: each stage applies one corpus operator to all that came before.

Stages return the columns of ``documents``, all but the last, which returns the packed pieces; other columns
of their input, whatever their names, are left behind. What is odd has the same meaning throughout: null and
empty texts are texts without words, null and repeated ids are ordinary rows, a very long text is one row, and
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import lines, mixing, near, packing, toxicity
from veldra.llm.common import materialize
from veldra.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain finds toxic go; texts without words stay, and equal rows fare alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score(docs.select(*COLUMNS), labels).where("toxic = 0").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go, except in one document each; null texts become empty. No document goes, also none left empty."""
    return _documents(lines.dedup_lines(docs.select(*COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more.

    The one with the smallest id, of rows that repeat it the one with the least key; texts without words are
    one group, rows without an id stay only where no row of their group has one.
    """
    return near.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, range-sorted by training position; a cut use keeps its first words.

    Texts without words are never used. Ties in a source's stream go by size and by a hash of the text.
    """
    used = mixing.schedule(mixing.mix(docs.select(*COLUMNS)))
    return _documents(used.withColumn("text", mixing.first_words(F.col("text"), F.col("words"), F.col("size"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset; a text without words is one piece, its end."""
    return packing.pack(docs.select("doc_id", "text"), vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", clean), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
