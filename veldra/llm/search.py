"""Exact top-k BM25 search: block-max WAND over sharded inverted indexes.

Documents are dealt to shards by hash. A shard's index holds, for each term, postings in document order
with the largest contribution of the whole list and of each block, a fixed run of documents. A query takes
its lists by falling maximum until the maxima of the rest cannot reach the k-th best sum so far (the weak-AND
pivot): documents that only the rest holds are never looked at, and of the others only those whose sum and
the rest's block maxima reach the k-th best are scored. Document counts, lengths and frequencies are those
of all documents, so scores compare across shards and the merge of the shards' results is exact.

Terms are named by a 64-bit hash that is checked to tell every query term from every other word of the
corpus. Postings of words that no query asks for are filtered out where documents are read, and a
document's other postings travel together as one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldra.llm.common import FILTER_BITS, WORD_PATTERN, ascii_lower, kept, key_filter, materialize, slices, tables

K1, B, TOP = 1.2, 0.75, 10
#: Query terms stand in so many documents at least: what stands in one finds nothing else.
MIN_DF = 2
#: Documents of a shard, documents of a run (block), queries of a block.
SHARD, RUN, QUERIES = 12_288, 64, 65_536
#: Scores are rounded to so many digits before they are compared, so that ties go by id alone.
DIGITS = 6
#: Sums of floats in another order differ by less than this; bounds give way by as much.
SLACK = 1e-5
#: Lists that hold this share of a shard's documents are long, up to so many; queries that are answered together.
LONG, LONGS, TOGETHER = 1 / 16, 2048, 256
#: Shards that a task searches in turn, each with the best scores of those before.
STRAND = 4


def counted(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``(terms, doc, term, tf)`` of ``texts`` (no nulls): distinct terms, and for each term of each text its count.

    Pairs are in the order of texts. Each distinct term of the texts is held once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    n = max(1, len(coded.dictionary))
    pair, tf = np.unique(doc * n + coded.indices.to_numpy(), return_counts=True)
    doc, term = pair // n, pair % n
    some = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False)[term] > 0  # splitting leaves empty ends
    return coded.dictionary, doc[some], term[some], tf[some]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """``(term, df)``, and the words of all documents as the frequency of a null term; tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        words = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), words], pa.int64())], ["term", "df"])

        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            for first, last in slices(texts):
                terms, _, term, tf = counted(texts.slice(first, last - first))
                words += int(tf.sum())
                held = np.bincount(term, minlength=len(terms))
                for t, n in zip(terms.to_numpy(zero_copy_only=False), held.tolist(), strict=True):
                    if n:
                        counts[t] = counts.get(t, 0) + n
                if len(counts) > 400_000:
                    yield out()
                    counts, words = {}, 0
        yield out()

    return docs.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def term_counts(docs: DataFrame) -> DataFrame:
    """``(doc_id, term, tf)`` for each distinct term of each document, by DataFrame functions."""
    low = ascii_lower(F.coalesce("text", F.lit("")))
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(WORD_PATTERN), F.lit(0))).alias("term"))
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def postings(docs: DataFrame, wanted: np.ndarray, seed: int) -> DataFrame:
    """``(doc_id, dl, tids, tfs)`` for each document: ids and counts of its terms whose filter bit is set, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for first, last in slices(texts):
                terms, doc, term, tf = counted(texts.slice(first, last - first))
                tid = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in terms.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(terms))
                at = tid & np.uint64(FILTER_BITS - 1)
                kept = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)[term]
                dl = np.bincount(doc, weights=tf, minlength=last - first).astype(np.int64)
                doc, tids, tf = doc[kept], tid[term[kept]].tobytes(), tf[kept]
                edge = np.searchsorted(doc, np.arange(last - first + 1))
                some = np.flatnonzero(np.diff(edge))
                # A byte a count where that will do for all of a document.
                size = np.where(np.maximum.reduceat(tf, edge[some]) < 256, 1, 4) if len(some) else some
                raw = {1: tf.astype(np.uint8).tobytes(), 4: tf.astype(np.uint32).tobytes()}
                tids = pa.array([tids[8 * edge[i] : 8 * edge[i + 1]] for i in some], pa.binary())
                tfs = pa.array([raw[n][n * edge[i] : n * edge[i + 1]] for i, n in zip(some.tolist(), size.tolist(), strict=True)], pa.binary())
                ids = batch.column(0).slice(first, last - first).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(dl[some]), tids, tfs], ["doc_id", "dl", "tids", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, dl long, tids binary, tfs binary")


class Shard:
    """The inverted index of one shard: short lists of postings by term, long ones as rows of a matrix for each run of documents.

    A run is a fixed number of neighbouring documents, which are numbered so that those with common words
    alike are neighbours; each run has the maximum of each long list in it.
    """

    def __init__(self, term: np.ndarray, doc: np.ndarray, gain: np.ndarray, docs: np.ndarray | None = None, weights: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """``gain`` is what a posting adds to a score for a query weight of 1, above 0.

        With ``docs`` (rising ids), ``doc`` are positions there, rising, and no document has a term twice. With
        ``weights`` (rising terms, their weights), gains are multiplied by them once, and queries need none.
        """
        if docs is None:
            docs, doc = np.unique(doc, return_inverse=True)
            order = np.lexsort((term, doc))
            term, doc, gain = term[order], doc[order], gain[order]
            if len(term):  # rows that repeat an id are one document
                one = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])))
                term, doc, gain = term[one], doc[one], np.add.reduceat(gain, one)
        self.docs, n = docs, len(docs)
        order = np.argsort(term)
        doc, by_term = doc.astype(np.int32), term[order]
        self.start = np.flatnonzero(np.append(True, by_term[1:] != by_term[:-1])) if len(term) else np.zeros(0, np.int64)
        self.names = by_term[self.start]
        del by_term
        self.size = np.diff(np.append(self.start, len(term)))
        self.by_doc = np.empty(len(term), np.int32)
        self.by_doc[order] = np.repeat(np.arange(len(self.names), dtype=np.int32), self.size)
        asked = np.ones(len(self.names), bool)
        if weights is not None:
            at, asked = places(weights[0], self.names)
            gain = gain * np.where(asked, weights[1][at], 0.0)[self.by_doc] if len(weights[0]) else gain * 0.0
        self.by_doc_gain, self.doc_start = gain, np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
        # Long lists: rows of a matrix.
        long = np.flatnonzero(asked & (self.size >= max(RUN // 8, LONG * n)))
        self.long = np.sort(long[np.argsort(-self.size[long], kind="stable")[:LONGS]])
        self.row = np.full(len(self.names), -1)
        self.row[self.long] = np.arange(len(self.long))
        row = self.row.astype(np.int32)[self.by_doc]
        posting = np.flatnonzero(row >= 0)
        self.runs = -(-n // RUN)
        held = np.zeros((n, len(self.long)), np.float32)
        held[doc[posting], row[posting]] = 1.0
        #: Documents in the order of runs, and where each stands there.
        self.at = _alike(held, np.bincount(doc, weights=gain, minlength=n))
        self.place = np.empty(n, np.int64)
        self.place[self.at] = np.arange(n)
        del held
        local = self.place.astype(np.int32)[doc]
        self.dense = np.zeros((self.runs, len(self.long), RUN), np.float32)
        self.dense[local[posting] // RUN, row[posting], local[posting] % RUN] = gain[posting]
        self.peak = np.ascontiguousarray(self.dense.max(axis=2).T) if n else np.zeros((len(self.long), 0), np.float32)
        self.held = np.count_nonzero(self.dense, axis=2).T.astype(np.float32)
        del row, posting
        self.local, gain = local[order], gain[order]
        self.top = np.maximum.reduceat(gain, self.start) if len(term) else np.zeros(0)
        self.gain = gain.astype(np.float32)
        self.weight, self.wanted = np.zeros(len(self.names)), np.zeros(len(self.names), bool)
        #: Sums in single precision, of terms above 0, are off by this share at most.
        self.off = 2 * (len(self.long) + 8) * 2.0**-24
        #: Postings of the lists that were asked for, those read list by list, and those read by document.
        self.asked = self.read = self.probed = 0

    def search(self, terms: np.ndarray, weights: np.ndarray, skip: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best documents but ``skip``, best first, ties to the smaller id, with rounded scores."""
        at, here = places(self.names, np.asarray(terms))
        return self.search_all(at[here], np.asarray(weights)[here], np.array([0, here.sum()]), [skip], np.array([-np.inf]), k)[0]

    def search_all(self, at: np.ndarray, weights: np.ndarray | None, edge: np.ndarray, skip: list, bars: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """:meth:`search` for queries together; the i-th has the lists ``at`` from ``edge[i]`` to ``edge[i + 1]``.

        A result may lack documents with scores below ``bars``, which are those of the ``k``-th best documents
        elsewhere, if known. Short lists come first, by falling maximum. Where the maxima of those that follow
        stay below the bar (the pivot), a document that only they hold cannot enter; if few others can, those
        are scored by themselves. Long lists are added last, for all queries together, in the runs where the
        best sum and the block maxima reach the bar.
        """
        none = np.zeros(0, np.int64), np.zeros(0)
        out = [none] * len(skip)
        if not len(self.docs):
            return out
        row = self.row[at]
        query = np.repeat(np.arange(len(skip)), np.diff(edge))
        asked = np.zeros((len(skip), len(self.long)), np.float32)
        far = row >= 0
        asked[query[far], row[far]] = 1.0 if weights is None else weights[far]
        bound = asked @ self.peak
        rest = np.bincount(query[far], weights=self.top[at[far]] * (1.0 if weights is None else weights[far]), minlength=len(skip))
        sums = np.full((len(skip), self.runs * RUN), -np.inf, np.float32)
        cuts, open_, whole = np.zeros(len(skip)), [], {}
        for i in range(len(skip)):
            part = slice(edge[i], edge[i + 1])
            mine, w = at[part], None if weights is None else weights[part]
            if not len(mine):
                continue
            self.asked += int(self.size[mine].sum())
            itself = self._itself(skip[i])
            short = self.row[mine] < 0
            lists, by = mine[short], None if w is None else w[short]
            most = self.top[lists] * (1.0 if by is None else by)
            order = np.argsort(-most)
            lists, by, most = lists[order], None if by is None else by[order], most[order]
            cut = self._cut(bars[i])
            whole[i] = mine, w
            behind = np.append(np.cumsum(most[::-1])[::-1], 0.0) + rest[i]
            pivot = int(np.searchsorted(-behind, -cut, side="right")) if cut > 0 else len(lists)
            j = min(pivot, len(lists))
            got, step = self._added(lists[:j], None if by is None else by[:j]), 1
            got[itself] = -np.inf
            while j < len(lists):
                found = np.flatnonzero(got >= max(cut - behind[j], 1e-30))
                if self._few(found, int(self.size[lists[j:]].sum())):
                    break
                before, j, step = j, j + step if 8 * len(found) < len(got) else len(lists), 2 * step
                got += self._added(lists[before:j], None if by is None else by[before:j])
            else:
                found = None
            if found is not None:
                out[i] = self._exact(found, *whole.pop(i), k)
                continue
            sums[i, : len(got)] = got
            cuts[i] = cut
            open_.append(i)
        if not open_:
            return out
        best = sums.reshape(len(skip), self.runs, RUN).max(axis=2)
        if self.runs > k:  # so many runs have a document with that sum
            bars = np.partition(best, -k, axis=1)[:, -k].astype(float)
            cuts = np.maximum(cuts, bars - SLACK - self.off * np.abs(bars), where=bars > 0, out=cuts)
        alive = best + bound >= cuts[:, None]
        for i in open_:
            runs = np.flatnonzero(alive[i])
            if cuts[i] > 0:
                near = sums[i].reshape(self.runs, RUN)[runs]
                r, c = np.nonzero(near >= (cuts[i] - bound[i, runs])[:, None])
                found = runs[r] * RUN + c
                if self._few(found, len(runs) * RUN * len(self.long) // (128 if len(open_) >= 64 else 2)):
                    alive[i] = False
                    sums[i] = -np.inf
                    out[i] = self._exact(found, *whole.pop(i), k)
        self.read += int((((asked > 0).astype(np.float32) @ self.held) * alive).sum())
        for r in range(self.runs):
            rows = np.flatnonzero(alive[:, r])
            if len(rows):
                some = asked if len(rows) == len(asked) else asked[rows]
                sums[rows, r * RUN : (r + 1) * RUN] += some @ self.dense[r]
        for i, (mine, w) in whole.items():
            found = np.flatnonzero(sums[i] >= max(cuts[i], 1e-30))
            if len(found) > k:
                kth = self._cut(float(np.partition(sums[i][found], -k)[-k]))
                found = found[sums[i][found] >= kth]
            out[i] = self._exact(found, mine, w, k)
        return out

    def _itself(self, skip: int | None) -> np.ndarray:
        i = int(np.searchsorted(self.docs, skip)) if skip is not None else len(self.docs)
        return self.place[i : i + 1] if i < len(self.docs) and self.docs[i] == skip else self.place[:0]

    def _cut(self, bar: float) -> float:
        """A sum in single precision below this stands for a score below ``bar``."""
        return bar - SLACK - self.off * abs(bar) if bar > -np.inf else -np.inf

    def _few(self, found: np.ndarray, left: int) -> bool:
        """Whether scoring ``found`` by document costs less than reading ``left`` more postings by list."""
        if 4 * len(found) > left:
            return False
        of = self.at[found]
        return 4 * int((self.doc_start[of + 1] - self.doc_start[of]).sum()) <= left

    def _added(self, lists: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
        """The sums of the postings of short lists, by place."""
        if not len(lists):
            return np.zeros(len(self.docs))
        n, first = self.size[lists], self.start[lists]
        self.read += int(n.sum())
        posting = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        gain = self.gain[posting]
        if weights is not None:
            gain = gain * np.repeat(weights, n)
        return np.bincount(self.local[posting], weights=gain, minlength=len(self.docs))

    def _exact(self, found: np.ndarray, lists: np.ndarray, weights: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of the documents at the places ``found``, by their postings in double precision."""
        found = np.sort(self.at[found])
        size = self.doc_start[found + 1] - self.doc_start[found]
        posting = np.repeat(self.doc_start[found] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.probed += len(posting)
        self.wanted[lists] = True
        posting = posting[self.wanted[self.by_doc[posting]]]
        self.wanted[lists] = False
        gain = self.by_doc_gain[posting]
        if weights is not None:
            self.weight[lists] = weights
            gain = gain * self.weight[self.by_doc[posting]]
        score = np.bincount(np.searchsorted(self.doc_start[found], posting, side="right") - 1, weights=gain, minlength=len(found))
        score = np.round(score, DIGITS)
        best = np.lexsort((self.docs[found], -score))[:k]
        return self.docs[found[best]], score[best]


def places(names: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``terms`` stand among the rising ``names``, and whether they do."""
    at = np.minimum(np.searchsorted(names, terms), max(len(names) - 1, 0))
    return at, names[at] == terms if len(names) else np.zeros(len(terms), bool)


def _alike(held: np.ndarray, total: np.ndarray, groups: int = 8) -> np.ndarray:
    """An order of documents: those with similar rows of ``held`` together, and among these by ``total``."""
    norm = np.sqrt(held.sum(axis=1))
    rows = held / np.maximum(norm, 1)[:, None]
    usual = np.flatnonzero(norm >= np.median(norm)) if len(norm) else np.zeros(0, int)
    if not held.shape[1] or len(usual) < groups:
        return np.argsort(-total, kind="stable")
    usual = usual[:: max(1, len(usual) // 2048)]
    some = rows[usual]
    centres = some[:1]
    while len(centres) < groups:
        centres = np.concatenate([centres, some[[int((some @ centres.T).max(axis=1).argmin())]]])
    for _ in range(4):
        group = (some @ centres.T).argmax(axis=1)
        sums = np.stack([some[group == g].sum(axis=0) for g in range(groups)])
        centres = sums / np.maximum(np.sqrt((sums**2).sum(axis=1)), 1e-9)[:, None]
    return np.lexsort((-total, (rows @ centres.T).argmax(axis=1)))


def _indexed(rows: pa.Table, mean: float, weights: tuple[np.ndarray, np.ndarray]) -> Shard:
    """The index of the rows of :func:`postings`; ``weights`` are terms and their idf."""
    rows = rows.sort_by("doc_id")
    ids, raw = rows["doc_id"].to_numpy(), rows["tfs"].to_pylist()
    term = np.frombuffer(b"".join(rows["tids"].to_pylist()), np.int64)
    size = pc.binary_length(rows["tids"]).to_numpy() // 8
    tf = np.concatenate([np.frombuffer(x, np.uint8 if len(x) == n else np.uint32) for x, n in zip(raw, size.tolist(), strict=True)]).astype(np.float64)
    gain = tf * (K1 + 1) / (tf + np.repeat(K1 * (1 - B + B * rows["dl"].to_numpy() / mean), size))
    if (ids[1:] > ids[:-1]).all():
        return Shard(term, np.repeat(np.arange(len(ids)), size), gain, ids, weights)
    return Shard(term, np.repeat(ids, size), gain, weights=weights)


def queries_of(docs: DataFrame, df: DataFrame, n_docs: int, every: int, terms: int | None) -> tuple[DataFrame, int]:
    """``(query_id, tid, weight)``: the terms of each document whose id divides by ``every``, with their idf.

    Also the seed of the ids. Queried words meet the vocabulary by id; should two words share one, the ids
    are drawn again with another seed, so an id names one word. ``terms`` keeps that many terms of largest
    tf-idf; by default a query has all.
    """
    asked = materialize(term_counts(docs.where(F.col("doc_id") % every == 0).dropDuplicates(["doc_id"])), "asked-terms")
    for draw in range(16):
        named = lambda t: F.xxhash64(F.lit(draw), t)  # noqa: B023, E731
        known = df.select(F.col("term").alias("word"), "df", named(F.col("term")).alias("tid"))
        words = materialize(asked.select("term").distinct().withColumn("tid", named(F.col("term"))).join(known, "tid"), "asked")
        if not words.where("term <> word").head():
            break
    else:
        raise ValueError("no seed tells the words apart")
    seed = docs.sparkSession.range(1).select(F.xxhash64(F.lit(draw)).alias("h")).first().h % (1 << 64)
    weight = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(words.where(F.col("df") >= MIN_DF).select("term", "tid", weight.alias("weight")), "term")
    if terms is not None:
        order = Window.partitionBy("doc_id").orderBy(F.round(F.col("tf") * F.col("weight"), 9).desc(), "term")
        weighed = weighed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= terms)
    return weighed.select(F.col("doc_id").alias("query_id"), "tid", "weight"), seed


def more_like_this(docs: DataFrame, every: int = 100, top: int = TOP, terms: int | None = None) -> DataFrame:
    """``(query_id, rank, doc_id, score)``: the ``top`` other documents by BM25 for each queried document.

    Queries are the rows of ``docs(doc_id, text)`` whose id divides by ``every``; a query's terms are all
    distinct words of its whole text that stand in two documents or more (``terms`` keeps those of largest
    tf-idf). Words are runs of anything but ASCII white space with A-Z lower-cased. Scores are
    ``sum idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))`` with
    ``idf = ln(1 + (N - df + 0.5) / (df + 0.5))``, rounded to 6 digits; ties go to the smaller ``doc_id``.
    Only documents that share a term are found.

    Null and empty texts have no words: they count in N and are never found. Rows with a null ``doc_id``
    count in N, df and lengths, but are neither queries nor found. Rows that repeat an id are found as one
    document with the sum of their scores; a query is one of them. An empty table gives no rows. Extra
    columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = rows.count()
    with tables():
        found = materialize(document_frequencies(rows), "frequencies")
        words = found.where("term IS NULL").agg(F.sum("df")).first()[0] or 0
        asked, seed = queries_of(rows, found.where("term IS NOT NULL"), n, every, terms)
        bags = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("tid", "weight"))).alias("bag"))
        bags = kept(bags.select("query_id", F.col("bag.tid").alias("tid"), F.col("bag.weight").alias("weight")), "queries")
        wanted = key_filter(bags.select(F.explode("tid").alias("tid")), "tid")
    mean = max(float(words), 1.0) / max(n, 1)
    blocks = -(-bags.count() // QUERIES) or 1
    shards = -(-n // SHARD) or 1
    strands = min(shards, max(-(-shards // STRAND), docs.sparkSession.sparkContext.defaultParallelism))
    shards = strands * -(-shards // strands)

    found = postings(rows.where("doc_id IS NOT NULL"), wanted, seed)
    each_block, each_strand = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.explode(F.sequence(F.lit(0), F.lit(strands - 1)))
    sent = found.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    sent = sent.select(each_block.alias("block"), F.pmod("shard", F.lit(strands)).alias("strand"), "shard", "doc_id", "dl", "tids", "tfs")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    questions = bags.select(block.alias("block"), each_strand.alias("strand"), "query_id", "tid", "weight")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        query = right["query_id"].to_numpy()
        edge = np.append(0, np.cumsum(pc.list_value_length(right["tid"]).to_numpy()))
        known, first, number = np.unique(right["tid"].combine_chunks().flatten().to_numpy(), return_index=True, return_inverse=True)
        weights, number = right["weight"].combine_chunks().flatten().to_numpy()[first], number.astype(np.int32)
        best, score = np.zeros((len(query), top), np.int64), np.full((len(query), top), -np.inf)
        piece = left["shard"].to_numpy()
        for p in np.unique(piece):
            shard = _indexed(left.take(pa.array(np.flatnonzero(piece == p))), mean, (known, weights))
            at, here = places(shard.names, known)
            for a in range(0, len(query), TOGETHER):
                b = min(a + TOGETHER, len(query))
                mine = number[edge[a] : edge[b]]
                there = here[mine]
                ends = np.append(0, np.cumsum(there))[edge[a : b + 1] - edge[a]]
                got = shard.search_all(at[mine[there]], None, ends, query[a:b].tolist(), score[a:b, -1], top)
                ids, scores = np.zeros((b - a, 2 * top), np.int64), np.full((b - a, 2 * top), -np.inf)
                ids[:, :top], scores[:, :top] = best[a:b], score[a:b]
                for i, (d, x) in enumerate(got):
                    ids[i, top : top + len(d)], scores[i, top : top + len(d)] = d, x
                order = np.lexsort((ids, -scores), axis=-1)[:, :top]
                best[a:b], score[a:b] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        some = score > -np.inf
        return pa.table({"query_id": np.repeat(query, some.sum(axis=1)), "doc_id": best[some], "score": score[some]})

    near = sent.groupBy("block", "strand").cogroup(questions.groupBy("block", "strand")).applyInArrow(search, "query_id long, doc_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "doc_id", "score")
