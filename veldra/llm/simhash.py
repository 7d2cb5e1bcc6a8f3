"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints are sorted by their rank in Gray order, in which neighbours differ in few bits. Runs of
the sorted list become nodes of a tree: a node keeps the bits on which all fingerprints below it
agree and which no ancestor keeps already (a mask and a pattern). A search walks the tree and adds up
the differences on the way down; a whole group is dropped as soon as the sum exceeds the radius.

Over many executors the top of the tree is cut into ranges of Gray rank. Two fingerprints within ``r`` bits
agree on one of ``r + 1`` blocks of bits, so there is an order for each block, with the fingerprints rotated
until that block leads; fingerprints with equal blocks are neighbours there and a range holds them whole.
Where a fingerprint's block differs from a node's, the node is dropped too: another order has that link.
Fingerprints with one block that number above ``SPLIT`` are split by pairs of blocks of their other bits;
then at most 2^22 distinct fingerprints are searched together, by construction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldra.llm.common import bucket_count, key_bitmaps, materialize, may_hold, row_key
from veldra.llm.components import connected_components

RADIUS, WIDTH, SEED = 2, 3, 42
#: Above so many distinct fingerprints with one block, they are split by further bits.
SPLIT = 16_384
#: Fingerprints of a range of ranks, about.
RANGE = 4096
FANOUT = 8
_CHUNK = 1 << 16


def from_hashes(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of shingle hashes: 0 for none, else bits set in over half of them."""
    count = sum((_bit_counts(hashes[i : i + _CHUNK]) for i in range(0, len(hashes), _CHUNK)), np.zeros(64, np.int64))
    return int(np.packbits(count * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The 64-bit SimHash of ``text``: 0 for no words, else bits set in over half the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    line, ends, at = b" ".join(words), [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    digest, first, last = xxhash.xxh64_intdigest, 0, min(width, len(words)) - 1
    count = np.zeros(64, dtype=np.int64)
    for block in range(0, n, _CHUNK):
        hashes = np.empty(min(_CHUNK, n - block), dtype=np.uint64)
        starts = [first, *(e + 1 for e in ends[block : block + len(hashes) - 1])]
        hashes[:] = [digest(line[s:e], SEED) for s, e in zip(starts, ends[block + last : block + last + len(hashes)], strict=True)]
        first = ends[block + len(hashes) - 1] + 1
        count += _bit_counts(hashes)
    set_bits = count * 2 > n
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def row_keys(docs: DataFrame) -> list[Column]:
    return row_key(docs["doc_id"].cast("long"), F.coalesce(docs["text"].cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` and the row's key for each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.binary())
            got = np.fromiter((fingerprint(t.as_py() or b"", width) for t in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(got.view(np.int64))], ["doc_id", "__v_k1", "__v_k2", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *row_keys(docs), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, __v_k1 long, __v_k2 long, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """Rank of each fingerprint in the order of the reflected binary code."""
    rank = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The tree over the fingerprints of many groups at once; ``groups`` numbers them 0, 1, ... in order.

    Only fingerprints that agree on the bits of ``fixed`` are linked.
    """

    def __init__(self, groups: np.ndarray, fps: np.ndarray, fixed: int = 0) -> None:
        order = np.lexsort((gray_rank(fps), groups))
        self.groups, self.fps, self.fixed = groups[order], fps[order], np.uint64(fixed)
        n_groups = int(self.groups[-1]) + 1 if len(fps) else 0
        level_group, low, high = self.groups, self.fps, self.fps
        ends = np.arange(1, len(fps) + 1)
        #: From the leaves up: common-bit mask, pattern, first child, end of children, end of leaves.
        levels = [(np.full(len(fps), ~np.uint64(0)), self.fps, None, None, ends)]
        while len(level_group) > n_groups:
            first_of_group = np.searchsorted(level_group, np.arange(n_groups))
            place = np.arange(len(level_group)) - first_of_group[level_group]
            starts = np.flatnonzero(place % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, starts), np.bitwise_or.reduceat(high, starts)
            stops = np.append(starts[1:], len(level_group))
            ends = ends[stops - 1]
            mask = ~(low ^ high)
            levels.append((mask, low & mask, starts, stops, ends))
            level_group = level_group[starts]
        self.levels = levels[::-1]
        #: Nodes that searches came to, and groups of two fingerprints or more that they dropped whole.
        self.visited = self.pruned = 0

    def links(self, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs ``i < j`` of leaves of one group that differ in at most ``radius`` bits, block by block."""
        for start in range(0, len(self.fps), _CHUNK):
            leaf = np.arange(start, min(start + _CHUNK, len(self.fps)))
            node = self.groups[leaf].astype(np.int64)
            total = np.zeros(len(leaf), dtype=np.int64)
            above = np.zeros(len(leaf), dtype=np.uint64)
            for mask, pattern, first, stop, ends in self.levels:
                self.visited += len(node)
                differ = (self.fps[leaf] ^ pattern[node]) & mask[node] & ~above
                total = total + np.bitwise_count(differ)
                near = (total <= radius) & (differ & self.fixed == 0)
                if first is not None:
                    self.pruned += int((~near).sum())
                keep = near & (ends[node] > leaf + 1)
                leaf, node, total = leaf[keep], node[keep], total[keep]
                if first is None:
                    later = node > leaf
                    yield leaf[later], node[later]
                    break
                above = mask[node]
                count = stop[node] - first[node]
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                children = np.repeat(first[node], count) + inner
                leaf, total, above = (np.repeat(x, count) for x in (leaf, total, above))
                node = children

    def stars(self, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """Links from each leaf to the first leaf of its class, by leaf: a spanning forest of all links."""
        label = np.arange(len(self.fps))
        for a, b in self.links(radius):
            while True:
                # Lower both ends' roots together until no link joins two classes.
                ra, rb = label[a], label[b]
                low = np.minimum(ra, rb)
                if (ra == rb).all():
                    break
                np.minimum.at(label, ra, low)
                np.minimum.at(label, rb, low)
                while (label[label] != label).any():
                    label = label[label]
        member = np.flatnonzero(label != np.arange(len(label)))
        return member, label[member]


def block_bits(radius: int) -> int:
    """Bits of each of ``radius + 1`` blocks, on one of which fingerprints within ``radius`` agree."""
    if not 0 <= radius <= 7:
        raise ValueError("blocks of fewer than 8 bits tell too little apart")
    return 64 // (radius + 1)


def _rotated(fps: np.ndarray, by: np.ndarray) -> np.ndarray:
    up = by.astype(np.uint64)
    return (fps << up) | (fps >> ((np.uint64(64) - up) & np.uint64(63)))


def _orders(fps: DataFrame, radius: int) -> DataFrame:
    """``(fp, turn, rank)`` once for each block: the rotation that makes it lead, and the Gray rank then."""
    bits, fp = block_bits(radius), F.col("fp")

    def rank(turn: int) -> Column:
        out = F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, 64 - turn)) if turn else fp
        for shift in (1, 2, 4, 8, 16, 32):
            out = out.bitwiseXOR(F.shiftrightunsigned(out, shift))
        return out

    # Each step of the rank is a column of its own: written out in one, it would double with each.
    each = fps.select("fp", F.explode(F.array(*[F.lit(k * bits) for k in range(radius + 1)])).alias("turn"))
    turned = F.when(F.col("turn") == 0, fp).otherwise(F.expr("shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn)"))
    return each.withColumn("rank", F.aggregate(F.array(*[F.lit(s) for s in (1, 2, 4, 8, 16, 32)]), turned, lambda a, s: a.bitwiseXOR(F.call_function("shiftrightunsigned", a, s))))


def _open_masks(radius: int) -> list[int]:
    """Masks of pairs of four blocks of the bits behind a rotated fingerprint's leading block."""
    bits = 64 - block_bits(radius)
    edges = [round(bits * i / 4) for i in range(5)]
    parts = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(4)]
    return [parts[i] | parts[j] for i, j in combinations(range(4), 2)]


def _named(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in found:
        for s in range(0, len(a), _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(x[s : s + _CHUNK].view(np.int64)) for x in (a, b)], ["a", "b"])


def search_ranges(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links among rows ``(fp, turn, rank)`` sorted by turn and rank: a tree for each run of some 2^17 rows.

    Runs end where the leading block changes, and rows of one block number :data:`SPLIT` at most.
    """
    bits = block_bits(radius)
    fixed, shift = ((1 << bits) - 1) << (64 - bits), np.uint64(64 - bits)

    def found(fps: np.ndarray, turn: np.ndarray, _: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        turns, groups = np.unique(turn, return_inverse=True)
        index = GrayIndex(groups, _rotated(fps.view(np.uint64), turn), fixed)
        back = np.uint64(64) - turns.astype(np.uint64)[index.groups]
        a, b = index.stars(radius)
        yield tuple(_rotated(index.fps[x], back[x] & np.uint64(63)) for x in (a, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) >= 2 * _CHUNK:
                lead = held[2].view(np.uint64) >> shift
                last = np.flatnonzero((held[1] != held[1][-1]) | (lead != lead[-1]))
                cut = last[-1] + 1 if len(last) else 0
                yield from _named(found(*(h[:cut] for h in held)))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield from _named(found(*held))

    return run


def search_groups(radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links among rows ``(fp, g1, g2)`` sorted by group; a group is held whole, and its size is bounded."""

    def found(fps: np.ndarray, g1: np.ndarray, g2: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        new = np.append(True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])) if len(g1) else np.zeros(0, bool)
        index = GrayIndex(np.cumsum(new) - 1, fps.view(np.uint64))
        a, b = index.stars(radius)
        yield index.fps[a], index.fps[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if len(held[0]) >= 2 * _CHUNK:
                last = np.flatnonzero((held[1] != held[1][-1]) | (held[2] != held[2][-1]))
                cut = last[-1] + 1 if len(last) else 0
                yield from _named(found(*(h[:cut] for h in held)))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield from _named(found(*held))

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(a, b)`` that span every class of the distinct fingerprints ``fps(fp)`` under ``radius`` bits."""
    bits = block_bits(radius)
    rows = _orders(fps, radius).withColumn("lead", F.shiftrightunsigned("rank", 64 - bits))
    heavy = materialize(rows.groupBy("turn", "lead").count().where(F.col("count") > SPLIT).select("turn", "lead"), "heavy")
    ranges = bucket_count((radius + 1) * fps.count(), RANGE, 1 << min(bits, 20))
    part = F.shiftrightunsigned("lead", max(0, bits - ranges.bit_length() + 1))
    light = rows.join(heavy, ["turn", "lead"], "left_anti").repartition("turn", part).sortWithinPartitions("turn", "rank")
    out = light.select("fp", "turn", "rank").mapInArrow(search_ranges(radius), "a long, b long")
    if heavy.head():
        rest = F.expr("shiftleft(fp, turn) | shiftrightunsigned(fp, 64 - turn)")
        turned = F.when(F.col("turn") == 0, F.col("fp")).otherwise(rest)
        masks = [F.struct(F.lit(i).cast("long").alias("i"), turned.bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(_open_masks(radius))]
        split = rows.join(heavy, ["turn", "lead"], "left_semi").select("fp", "turn", "lead", F.explode(F.array(*masks)).alias("m"))
        # The mask's number and the block's place lead the group's first half, their bits follow.
        g1 = F.shiftleft(F.col("m.i") * 64 + F.col("turn"), bits).bitwiseOR(F.col("lead"))
        groups = split.select("fp", g1.alias("g1"), F.col("m.v").alias("g2")).repartition("g1", "g2").sortWithinPartitions("g1", "g2")
        out = out.unionByName(groups.mapInArrow(search_groups(radius), "a long, b long"))
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id, stays)`` and the row's key for each row of ``docs(doc_id, text)``.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest
    ``doc_id`` reachable. ``stays`` marks the component's representative: the row of that ``doc_id``
    (among several, the least row key; rows equal in both columns share the mark).
    Exact copies meet in one fingerprint before any search, so groups of copies cost one row.
    Null and empty texts have fingerprint 0 and are linked like any other; fewer words than a shingle
    make one shingle; null ``doc_id`` rows are linked too but name a component only if it has no other
    row (then null). Repeated rows each get their row.
    """
    marked = materialize(fingerprints(docs, width), "fingerprints")
    return components_of(marked, lambda reps: links(reps.select("fp"), radius))


def components_of(marked: DataFrame, find: Callable[[DataFrame], DataFrame], carried: Sequence[Column] = ()) -> DataFrame:
    """The rows of :func:`near_duplicates` for ``marked`` rows and the links that ``find`` has for their distinct ``fp``."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__v_k1", "__v_k2")).alias("rep")
    reps = materialize(marked.groupBy("fp").agg(rep, *carried), "distinct-fp")
    labels = connected_components(find(reps))
    joined = reps.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = materialize(joined.groupBy("label").agg(F.min("rep").alias("least")), "classes")
    named = materialize(joined.join(least, "label").select("fp", "least"), "components")
    same = F.struct("__v_k1", "__v_k2") == F.struct("least.__v_k1", "least.__v_k2")
    return marked.join(named, "fp").select(
        "doc_id", "fp", F.col("least.doc_id").alias("component_id"), same.alias("stays"), "__v_k1", "__v_k2"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that represent their component, one for each; columns are those of ``docs``.

    Cases are those of :func:`near_duplicates`; of rows that repeat the representative one stays.
    """
    return rows_that_stay(docs, near_duplicates(docs))


def rows_that_stay(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` marks, one of those that repeat.

    Rows that a fixed-size filter over the keys of all that go lets pass stay where they are; only the others
    are sent to a join, which hashes keys and lets texts stream past them.
    """
    marks = found.groupBy("__v_k1", "__v_k2").agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    marks = materialize(marks.where("NOT stays OR n > 1"), "marks")
    k1, k2 = row_keys(docs)
    rows = may_hold(docs.withColumns({"__v_k1": k1, "__v_k2": k2}), materialize(key_bitmaps(marks, "__v_k1"), "filter"), "__v_k1", "__v_may")
    doubtful = rows.where("__v_may").join(marks.where("NOT stays").select("__v_k1", "__v_k2").hint("shuffle_hash"), ["__v_k1", "__v_k2"], "left_anti")
    if marks.where("stays").head():
        doubtful = doubtful.dropDuplicates(["__v_k1", "__v_k2"])
    return rows.where("NOT __v_may").select(*docs.columns).union(doubtful.select(*docs.columns))
