"""Near copies by shingle sets: SimHash and MinHash propose pairs, exact Jaccard similarity decides.

SimHash classes (fingerprints that the Gray-order index links within 2 bits) are compared first of all, but
a pair at similarity 0.8 differs in about 10 of 64 bits, too many for any blocks that must agree to tell
texts apart. So bands of MinHash values propose pairs too: a pair at 0.8 shares none of the 32 bands of five
with probability 3e-6, a more similar one more rarely still. No pair is linked without comparing the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldra.llm import simhash
from veldra.llm.common import FILTER_BITS, key_filter, materialize
from veldra.llm.simhash import components_of, row_keys, rows_that_stay

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 32, 5, 42
_CHUNK = 1 << 12
_DRAW = np.random.default_rng(SEED)
_TIMES = _DRAW.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _DRAW.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; fewer words make one run, no words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets; two empty sets are equal."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def bands(hashes: np.ndarray) -> list[int]:
    """A key for each band of MinHash values; an empty set has none."""
    if not len(hashes):
        return []
    least = np.full((BANDS * ROWS, 1), ~np.uint64(0))
    for s in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (_TIMES * hashes[None, s : s + _CHUNK] + _PLUS).min(axis=1, keepdims=True))
    keys = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _name(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).astype(np.int64))


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, fp, sim, bands)`` and the row's key for each row; ``fp`` names the shingle set, ``sim`` is its SimHash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sims, keys = [], [], []
            for text in batch.column(3).cast(pa.binary()):
                hashes = shingles(text.as_py() or b"", width)
                names.append(_name(hashes))
                sims.append(simhash.from_hashes(hashes))
                keys.append(bands(hashes))
            made = [pa.array(names, pa.int64()), pa.array(np.array(sims, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], ["doc_id", "__v_k1", "__v_k2", "fp", "sim", "bands"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *row_keys(docs), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, __v_k1 long, __v_k2 long, fp long, sim long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(fp, hashes)`` for the rows whose keys are ``wanted(__v_k1, __v_k2)``, the set packed.

    A fixed-size filter over the keys picks rows where they are read, so texts are not sent anywhere.
    """
    bits = key_filter(wanted, "__v_k1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy() & np.int64(FILTER_BITS - 1)
            some = np.flatnonzero(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(some):
                kept = batch.take(pa.array(some))
                made = [shingles(text.as_py() or b"", width) for text in kept.column(2).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([*kept.columns[:2], pa.array([_name(x) for x in made], pa.int64()), pa.array([x.tobytes() for x in made], pa.binary())], ["__v_k1", "__v_k2", "fp", "hashes"])

    rows = docs.select(*row_keys(docs), docs["text"].cast("string").alias("text"))
    found = rows.mapInArrow(run, "__v_k1 long, __v_k2 long, fp long, hashes binary")
    return found.join(wanted.hint("shuffle_hash"), ["__v_k1", "__v_k2"], "left_semi").select("fp", "hashes").dropDuplicates(["fp"])


def compare(rows: Iterator[tuple[int, int, bytes]], least: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Links that span the classes of each bucket of ``(bucket, fp, hashes)``, rows of a bucket together.

    A set is compared with the members of each class until one is similar enough, so a bucket of near
    copies costs a comparison or so a row, and no pair of a bucket is passed over.
    """
    bucket, classes = None, []
    for key, fp, packed in rows:
        if key != bucket:
            bucket, classes = key, []
        mine = np.frombuffer(packed, np.uint64)
        joined, others = [], []
        for members in classes:
            for other, theirs in members:
                few, many = sorted((len(mine), len(theirs)))
                if few >= least * many and similarity(mine, theirs) >= least:
                    yield other, fp
                    joined.extend(members)
                    break
            else:
                others.append(members)
        classes = [*others, [*joined, (fp, mine)]]


def links(docs: DataFrame, reps: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` that span every class of the distinct sets ``reps(fp, rep, sim, bands)`` of ``docs``."""
    sims = materialize(reps.select(F.col("sim").alias("fp")).distinct(), "fingerprints")
    stars = materialize(simhash.links(sims), "simhash-links")  # each link's ends are in one star
    places = stars.union(stars.select("b", "b")).union(sims.select("fp", "fp")).toDF("node", "root").distinct()
    alike = reps.select("fp", "sim").join(places, F.col("sim") == F.col("node")).select("fp", F.xxhash64(F.lit("simhash"), "root"))
    buckets = reps.select("fp", F.explode("bands").alias("band")).union(alike)
    members = [F.bit_xor(F.xxhash64(F.lit(i), "fp")).alias(f"x{i}") for i in range(2)]
    sized = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *members).where("n > 1")
    # Bands that hold the same sets are compared once.
    once = materialize(sized.groupBy("n", "x0", "x1").agg(F.min("band").alias("band")).select("band"), "bands")
    asked = materialize(buckets.join(once, "band").select("band", "fp"), "buckets")
    wanted = reps.join(asked.select("fp"), "fp", "left_semi").select("rep.__v_k1", "rep.__v_k2")
    sets = materialize(_sets(docs, materialize(wanted.distinct(), "wanted"), width), "shingle-sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        found = []
        for pair in compare(rows, least):
            found.append(pair)
            if len(found) == _CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    dealt = asked.join(sets, "fp").select("band", "fp", "hashes").repartition("band").sortWithinPartitions("band")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """``(doc_id, fp, component_id, stays)`` and the row's key for each row of ``docs(doc_id, text)``.

    Rows are linked if the sets of their runs of ``width`` words, A-Z lower-cased, have a Jaccard similarity
    of ``least`` or more. Components, ``stays`` and odd rows are as in :func:`simhash.near_duplicates`:
    texts without words are equal, equal sets meet before any search.
    """
    marked = materialize(_marked(docs, width), "shingled")
    return components_of(marked, lambda reps: links(docs, reps, width, least), [F.any_value("sim").alias("sim"), F.any_value("bands").alias("bands")])


def one_of_each(docs: DataFrame, width: int = WIDTH, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that represent their component, one for each; columns are those of ``docs``."""
    return rows_that_stay(docs, near_duplicates(docs, width, least))
