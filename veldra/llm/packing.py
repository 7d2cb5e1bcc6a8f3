"""Packing token streams into training sequences by cutting-stock column generation.

A document's ids are cut into full sequences and a rest; the rest into a multiple of ``STEP`` ids and a
tail below ``STEP``. Piece lengths thus fall into fewer than 100 exact values, so the length histogram
is of fixed size whatever the corpus. A linear program over packing patterns (how many pieces of each
length share a sequence) is solved by column generation: its duals price lengths, and a knapsack
dynamic program finds the pattern worth most. Pattern counts are rounded down, what is left is packed
greedily, and ranked pieces are dealt to the patterns' places.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import bucket_count, materialize, slices

CAPACITY, STEP, END_ID = 2048, 64, 1
END = struct.pack("<I", END_ID)
#: Column generation stops when the linear program is proven within this share of its optimum.
GAP = 1e-4
#: Entries of a worker's tables of stems and of other parts; what is beyond them is encoded again for each slice.
STEMS, OTHERS = 200_000, 50_000
#: Stems that are encoded together.
TOGETHER = 1000

_PLAIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
#: What may follow a stem.
_MARKS = ("", ".", ",")
# The steps of a tokenizer that lower-cases, drops white space and never joins words over it.
_BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordEncoder:
    """Ids of texts as arrays of uint32, each distinct part of a slice of texts encoded once.

    Where the tokenizer's steps are those of :data:`_BY_WORD`, words never join over spaces, so a text's ids
    are those of its space-separated parts in order. Parts of Latin letters with at most one full stop or
    comma are lower-cased stem and mark, and stems are encoded many at a time: the last token of each ends a
    word, and no other does. Other parts go through the tokenizer one by one. With other steps than those,
    whole texts do.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            steps = json.load(f)
        suffix = steps["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix) and all(steps.get(k) == v for k, v in _BY_WORD.items())
        self.stems: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.marks = [self._whole(m) for m in _MARKS]
        if self.by_word:
            ranked = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(ranked.values()) + 1, bool)
            self.ends[[i for t, i in ranked.items() if t.endswith(suffix)]] = True

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts`` (no nulls) one after another, and where each text's start, with the end."""
        if not self.by_word:
            each = [self._whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(each), "<u4"), np.append(0, np.cumsum([len(x) // 4 for x in each])).astype(np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        taken = self._parts(coded.dictionary).take(coded.indices)
        bounds = taken.offsets.to_numpy()
        offsets = split.offsets.to_numpy()
        return taken.flatten().to_numpy(), bounds[offsets - offsets[0]] - bounds[0]

    def _parts(self, parts: pa.Array) -> pa.LargeListArray:
        """The ids of each part: those of a unit (a stem, or the part as it is) and of its mark."""
        plain = pc.match_substring_regex(parts, _PLAIN)
        stems = pc.filter(pc.utf8_lower(pc.utf8_rtrim(parts, ".,")), plain).dictionary_encode()
        whole = [self._other(p) for p in pc.filter(parts, pc.invert(plain)).to_pylist()]
        units = _lists([*self.marks, *self._stems(stems.dictionary.to_pylist()), *whole])
        is_plain = plain.to_numpy(zero_copy_only=False)
        pair = np.zeros((len(parts), 2), np.int64)  # unit 0 is no mark
        pair[is_plain, 0] = len(self.marks) + stems.indices.to_numpy()
        pair[~is_plain, 0] = len(self.marks) + len(stems.dictionary) + np.arange(len(whole))
        ends = [pc.ends_with(parts, mark).to_numpy(zero_copy_only=False) for mark in _MARKS[1:]]
        pair[is_plain, 1] = sum(i * e[is_plain] for i, e in enumerate(ends, 1))
        both = units.take(pa.array(pair.ravel()))
        return pa.LargeListArray.from_arrays(both.offsets[::2], both.flatten())

    def _stems(self, stems: list[str]) -> list[bytes]:
        known = self.stems
        new = [s for s in stems if s not in known]
        found = {}
        for i in range(0, len(new), TOGETHER):
            some = new[i : i + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            raw, edges = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            found.update(zip(some, (raw[a:b] for a, b in zip([0, *edges[:-1]], edges, strict=True)), strict=True))
        out = [known[s] if s in known else found[s] for s in stems]
        for s, got in found.items():
            if len(known) == STEMS:
                break
            if len(s) < 64:
                known[s] = got
        return out

    def _other(self, part: str) -> bytes:
        got = self.others.get(part)
        if got is None:
            got = self._whole(part)
            if len(self.others) < OTHERS and len(part) < 64:
                self.others[part] = got
        return got

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def _lists(packed: list[bytes]) -> pa.LargeListArray:
    """Lists of ids from their little-endian bytes."""
    ends = np.append(0, np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4))
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<u4")))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cut(n: int, capacity: int = CAPACITY, step: int = STEP) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids."""
    pieces = [(s, capacity) for s in range(0, n - n % capacity, capacity)]
    at = n - n % capacity
    for length in ((n - at) // step * step, (n - at) % step):
        if length:
            pieces.append((at, length))
            at += length
    return pieces


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])`` for each piece of ``docs(doc_id, text)``.

    Null text counts as empty: the end id alone. ``ids`` are little-endian uint32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for first, last in slices(texts):
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                ids, offsets = words.encode(texts.slice(first, last - first))
                raw, bounds = memoryview(ids.astype("<u4").tobytes()), (4 * offsets).tolist()
                for k, i in enumerate(batch.column(0).slice(first, last - first).to_pylist()):
                    mine = bytes(raw[bounds[k] : bounds[k + 1]]) + END
                    for start, length in cut(len(mine) // 4, capacity):
                        part = mine[4 * start : 4 * (start + length)]
                        for column, value in zip(rows, (i, start, length, zlib.crc32(part), len(mine) // 4, part if with_ids else None), strict=True):
                            column.append(value)
                arrays = [pa.array(c, pa.int64()) for c in rows[:5]] + [pa.array(rows[5], pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of largest total price that fits: the unbounded knapsack, by dynamic programming."""
    order = np.argsort(lengths)
    size, price = lengths[order], prices[order]
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if fits[c]:
            gain = best[c - size[: fits[c]]] + price[: fits[c]]
            k = gain.argmax()
            if gain[k] > best[c] + 1e-12:
                best[c], last[c] = gain[k], k
    pattern, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[order[last[c]]] += 1
            c -= size[last[c]]
    return float(best[capacity]), pattern


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns with the number of sequences that use each; together they hold exactly ``demand`` pieces.

    Revised simplex over the columns that pricing brings in, then rounding down and a greedy fill.
    """
    columns = np.diag((capacity // lengths).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ demand.astype(float)
    for turn in range(100 * len(lengths)):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(lengths, np.maximum(prices, 0.0), capacity)
        if worth <= 1 + gap:  # the optimum is at least the present total over the best worth
            break
        step = inverse @ pattern
        rows = np.flatnonzero(step > 1e-9)
        ratios = amount[rows] / step[rows]
        leave = rows[ratios.argmin()]
        move = ratios.min()
        amount = np.maximum(amount - move * step, 0.0)
        amount[leave] = move
        columns[:, leave] = pattern
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
        if turn % 100 == 99:
            inverse = np.linalg.inv(columns)
            amount = np.maximum(inverse @ demand, 0.0)
    left, plan = demand.astype(np.int64).copy(), []
    for k in np.argsort(-amount, kind="stable"):
        pattern = columns[:, k].astype(np.int64)
        used = pattern > 0
        times = int(min(np.floor(amount[k] + 1e-6), (left[used] // pattern[used]).min()))
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    for _ in range(int(left.sum())):
        if not left.any():
            break
        pattern, room = np.zeros_like(left), capacity
        for i in np.argsort(-lengths):
            pattern[i] = min(left[i], room // lengths[i])
            room -= pattern[i] * lengths[i]
        plan.append((pattern, 1))
        left -= pattern
    return plan


def places(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, rank_from, rank_to, copies, sequence_from, offset)``: where each rank of a length goes."""
    full = histogram.get(capacity, 0)
    lengths = np.array(sorted(k for k, n in histogram.items() if k < capacity and n), dtype=np.int64)
    out = [(capacity, 0, full, 1, 0, 0)] if full else []
    if not len(lengths):
        return out
    taken, sequence = dict.fromkeys(lengths.tolist(), 0), full
    for pattern, times in solve(lengths, np.array([histogram[k] for k in lengths.tolist()]), capacity):
        offset = 0
        for i in np.argsort(-lengths):
            copies, length = int(pattern[i]), int(lengths[i])
            if copies:
                ranks = taken[length]
                taken[length] = ranks + copies * times
                out.append((length, ranks, taken[length], copies, sequence, offset))
                offset += copies * length
        sequence += times
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with ``sequence_id`` and ``offset``.

    Offsets in a sequence run from 0 without gaps. Pieces of a length are ranked by hash bucket (a range
    of a key over ``doc_id``, ``start`` and checksum) and within it by document, so no task ranks more
    than a bucket. The table of places has a row for each length of each pattern; patterns number at
    most a few hundred whatever the input, so it is broadcast.

    Null and empty texts are the end id alone; null and repeated ``doc_id`` are ordinary rows; very long
    texts make many full pieces. An empty table gives no rows. Extra columns are not carried.
    """
    spark = docs.sparkSession
    cuts = materialize(pieces(docs, vocabulary, capacity), "pieces")
    buckets = bucket_count(cuts.count())
    keyed = cuts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = materialize(keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # under 100 rows
    table = places(histogram, capacity)
    kinds = "p_length long, rank_from long, rank_to long, copies long, sequence_from long, offset_from long"
    where = spark.createDataFrame(table, kinds)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("length").alias("b_length"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("place", F.row_number().over(within) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("b_length")) & (F.col("bucket") == F.col("b_bucket")))
    rank = F.col("base") + F.col("place")
    on = (F.col("length") == F.col("p_length")) & (rank >= F.col("rank_from")) & (rank < F.col("rank_to"))
    nth = rank - F.col("rank_from")
    return ranked.join(F.broadcast(where), on).select(
        *cuts.columns,
        (F.col("sequence_from") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("offset_from") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """``(sequence_id, n_ids, ids)``: each sequence's ids in order, little-endian uint32."""
    parts = pieces(docs, vocabulary, capacity, with_ids=True)
    spots = packed.select(*[F.col(c).alias(f"p_{c}") for c in ("doc_id", "start", "ids_crc32")], "sequence_id", "offset").dropDuplicates(["sequence_id", "offset"])
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("doc_id", "start", "ids_crc32")]
    one = parts.dropDuplicates(["doc_id", "start", "ids_crc32"])
    placed = spots.join(one, same[0] & same[1] & same[2])
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), inside.alias("parts")).select(
        "sequence_id", "n_ids", F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
