"""Helpers shared by the corpus operators: shared-folder tables, row keys, word rules."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of the contracts: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The ASCII white space that line keys are stripped of.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors see.

    Where the session names none, the warehouse stands in, which a cluster shares as well; a warehouse on a
    local disk will do only while the executors are threads of this process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    own = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master)
    if not local and (own.startswith(("/", "file:")) or ":" not in own):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return own


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes when the driver ends, or with :func:`clear`."""
    path = f"{shared_dir(spark)}/veldra/{spark.sparkContext.applicationId}"
    if path not in _cleared_at_exit:
        _cleared_at_exit.add(path)
        atexit.register(_delete_quietly, spark, path)
    return path


_cleared_at_exit: set[str] = set()


def _delete_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session, its JVM or the store may be gone by then
        delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete every table that this application's operators have written; results computed from them go too."""
    delete(spark, own_dir(spark))


@contextlib.contextmanager
def tables() -> Iterator[None]:
    """Tables written by :func:`materialize` within the block are deleted at its end; nests."""
    made: list[DataFrame] = []
    _owners.append(made)
    try:
        yield
    finally:
        _owners.pop()
        for df in made:
            release(df)


_owners: list[list[DataFrame]] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the application's folder."""
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of whole texts that stand in memory together: in a batch of a scan, and in one sent to a Python worker.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Batches of :data:`BATCH_ROWS` in this session, where it still has Spark's defaults: texts are long rows."""
    for key, usual in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.parquet.columnarReaderBatchSize", "4096")):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, str(BATCH_ROWS))


#: Bits of a filter over keys; a fixed 4 MB, whatever the number of keys.
FILTER_BITS = 1 << 25


def key_bitmaps(keys: DataFrame, name: str) -> DataFrame:
    """``(__v_bucket, __v_bits)``: the filter over the long column ``name`` in up to 1,024 bitmaps of 4 kB."""
    at = F.pmod(F.col(name), F.lit(FILTER_BITS)) + 1  # positions count from 1
    return keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__v_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__v_bits"))


def key_filter(keys: DataFrame, name: str) -> np.ndarray:
    """The filter's bytes for Python workers, lowest bit first."""
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in key_bitmaps(keys, name).toLocalIterator():
        at = (r["__v_bucket"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(r["__v_bits"], dtype=np.uint8)
    return out


def may_hold(rows: DataFrame, bitmaps: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: whether ``key`` may be among the keys of ``bitmaps``; never false for one that is.

    The bitmaps are broadcast, 4 MB at most; a row meets the one that its key would be in.
    """
    at = F.pmod(F.col(key), F.lit(FILTER_BITS))
    with_bits = rows.join(F.broadcast(bitmaps), F.shiftright(at, 15) + 1 == F.col("__v_bucket"), "left")
    byte = F.substr(F.col("__v_bits"), (F.shiftright(at.bitwiseAND(F.lit(32_767)), 3) + 1).cast("int"), F.lit(1))
    bit = F.conv(F.hex(byte), 16, 10).cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int"))) != 0
    return with_bits.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__v_bucket", "__v_bits")


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of that table and no recomputation. The table
    belongs to the innermost :func:`tables` block, else to the application. Partitions are merged up to the
    advised size, so a small table is one file and not one for each core.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, tag)
    with _setting(spark, "spark.sql.adaptive.coalescePartitions.parallelismFirst", "false"):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._veldra_path = path
    if _owners:
        _owners[-1].append(out)
    return out


def kept(df: DataFrame, tag: str) -> DataFrame:
    """:func:`materialize` for a table that outlives the :func:`tables` block it is made in."""
    out = materialize(df, tag)
    if _owners:
        _owners[-1].remove(out)
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table made by :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_veldra_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def n_words(text: Column) -> Column:
    """Number of :data:`WORD_PATTERN` words; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes that together name a row by its content; equal rows share a key."""
    return [F.xxhash64(*cols).alias("__v_k1"), F.xxhash64(F.lit(7), *cols).alias("__v_k2")]


def bucket_count(rows: int, per_bucket: int = 2048, most: int = 65_536) -> int:
    """A power of two of buckets that hold about ``per_bucket`` rows each, up to ``most`` buckets."""
    n = 1
    while n * per_bucket < rows and n < most:
        n *= 2
    return n


#: Bytes of text that a Python worker looks at together.
SLICE = 6 << 20


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """``(from, to)`` of runs of rows that hold about ``most`` bytes; a longer text is a run of its own."""
    size = np.nan_to_num(pc.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
    block = np.cumsum(size) // most
    edges = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(0, int)
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
