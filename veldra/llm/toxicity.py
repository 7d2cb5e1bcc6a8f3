"""Toxicity by a classifier chain.

Categories are predicted in turn. Each link is a logistic regression over features of the text and the
probabilities of the earlier categories. While training, those probabilities are out of fold: each row's
come from a model whose features and weights were chosen without it, so a later link learns how far to
trust them.

Features are word beginnings and whole words, so that inflected or compound forms of a stem share
weight, and a few shares that describe the text as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.llm.common import kept, release, slices, small_batches

CATEGORIES = ("low_quality", "toxic")
#: The chain is fitted on so many labelled rows at most, the first in the order of ``xxhash64(doc_id)``, and on
#: as many of these as hold so many bytes of whole texts (the first, however long, always).
SAMPLE, SAMPLE_BYTES = 6000, 64 << 20
FEATURES, FOLDS, THRESHOLD = 400, 5, 0.3
SHORTEST, LONGEST = 4, 8
#: A form stands in so many texts at least.
MIN_TEXTS = 4
DENSE = 4
_words = re.compile(r"[^\W\d_]+").findall


def forms(word: str) -> list[str]:
    """The features of a lower-cased word: itself and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in range(SHORTEST, LONGEST + 1) if n <= len(word))]


class Selected:
    """The ids of selected forms, looked up by word."""

    def __init__(self, names: list[str]) -> None:
        self.ids = {f: i for i, f in enumerate(names)}
        #: First letters of all forms: most words share none.
        self.heads = {f[1 : 1 + SHORTEST] for f in names}

    def of(self, word: str) -> list[int]:
        low = word.lower()
        return [self.ids[f] for f in forms(low) if f in self.ids] if low[:SHORTEST] in self.heads else []


def featurise(texts: pa.Array, selected: Selected) -> np.ndarray:
    """Logarithms of the counts of selected forms and the shape of each text (no nulls).

    The shape: words (log), and the shares of words in capitals, of distinct ones among the parts between
    spaces, and of letters. Each distinct part of the texts is looked at once.
    """
    n, rows = len(selected.ids), len(texts)
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    coded = split.flatten().dictionary_encode()
    parts = coded.dictionary.to_pylist()
    words, upper, letters = (np.zeros(len(parts)) for _ in range(3))
    hits: list[tuple[int, int]] = []
    for i, part in enumerate(parts):
        for word in _words(part):
            words[i] += 1
            upper[i] += word.isupper()
            letters[i] += len(word)
            hits.extend((i, k) for k in selected.of(word))
    at, offsets = coded.indices.to_numpy(), split.offsets.to_numpy()
    doc = np.repeat(np.arange(rows), np.diff(offsets))
    total = lambda value: np.bincount(doc, weights=value[at], minlength=rows)
    n_words = total(words)
    distinct = np.bincount(np.unique(doc * max(1, len(parts)) + at) // max(1, len(parts)), minlength=rows)
    out = np.zeros((rows, n + DENSE), dtype=np.float32)
    if hits:
        part, form = np.array(hits).T
        first = np.searchsorted(part, np.arange(len(parts) + 1))  # hits are in the order of parts
        some = np.flatnonzero(np.diff(first)[at])
        size = np.diff(first)[at[some]]
        each = np.repeat(first[at[some]] - np.cumsum(size) + size, size) + np.arange(size.sum())
        counts = np.bincount(np.repeat(doc[some], size) * n + form[each], minlength=rows * n)
        out[:, :n] = np.log1p(counts.reshape(rows, n)) / 2
    chars = np.maximum(1, pc.utf8_length(texts).to_numpy())
    parts_of = np.maximum(1, np.diff(offsets))
    out[:, n:] = np.stack([np.log1p(n_words) / 10, total(upper) / np.maximum(1, n_words), distinct / parts_of, total(letters) / chars], axis=1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.03, rounds: int = 12) -> np.ndarray:
    """Weights and intercept (last) by damped Newton steps; labels of one kind give their share alone."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w = np.zeros(x.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return w
    penalty = np.append(np.full(len(w) - 1, ridge), 1e-6)

    def loss(at: np.ndarray) -> float:
        z = x @ at.astype(np.float32)
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (penalty * at**2).sum() / 2)

    now = loss(w)
    for _ in range(rounds):
        p = sigmoid(x @ w.astype(np.float32))
        slope = x.T @ (p - y).astype(np.float32) + penalty * w
        bend = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(penalty + 1e-4)
        move, size = np.linalg.solve(bend.astype(np.float64), slope), 1.0
        while size > 1e-3 and (then := loss(w - size * move)) > now:
            size /= 2
        if size <= 1e-3 or now - then < 1e-3:
            break
        w, now = w - size * move, then
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Forms:
    """Which forms each training text holds, so that any subset of texts can choose among them."""

    def __init__(self, texts: list[str]) -> None:
        # Most forms stand in one text or two: a first pass counts them by hash, and only the others get names.
        often = np.zeros(1 << 22, np.uint16)
        slot = lambda f: xxhash.xxh64_intdigest(f) & (len(often) - 1)
        held = lambda text: {f for w in {w.lower() for w in _words(text)} for f in forms(w)}
        for text in texts:
            often[np.unique(np.fromiter(map(slot, held(text)), np.int64))] += 1
        known: dict[str, int] = {}
        docs, ids = array("I"), array("I")
        for i, text in enumerate(texts):
            mine = [known.setdefault(f, len(known)) for f in held(text) if f in known or often[slot(f)] >= MIN_TEXTS]
            ids.extend(mine)
            docs.extend([i] * len(mine))
        self.names = list(known)
        self.doc, self.form = np.frombuffer(docs, np.uint32), np.frombuffer(ids, np.uint32)

    def select(self, among: np.ndarray, y: np.ndarray, limit: int) -> list[str]:
        """The forms whose share of the texts ``among`` differs most between the labels ``y``, by G.

        Of beginnings of one another with equal counts one is kept. Other texts' labels play no part.
        """
        use, one, m = among[self.doc], (y == 1)[self.doc], len(self.names)
        a, b = (np.bincount(self.form[use & side], minlength=m).astype(float) for side in (one, ~one))
        n0, n1 = max(1, int((y[among] == 0).sum())), max(1, int((y[among] == 1).sum()))
        some = np.flatnonzero((a > 0) & (a + b >= MIN_TEXTS))
        a, b = a[some], b[some]
        expected = (a + b) * n1 / (n0 + n1)
        gain = a * np.log(np.maximum(a, 0.5) / expected) + b * np.log(np.maximum(b, 0.5) / (a + b - expected))
        names = [self.names[i] for i in some]
        kept: list[str] = []
        stems: set[tuple] = set()
        for i in np.lexsort((names, -gain)) if names else ():
            stem = (a[i], b[i], names[i][1 : 1 + SHORTEST])
            if stem not in stems:
                stems.add(stem)
                kept.append(names[i])
            if len(kept) == limit:
                break
        return kept


@dataclass
class Chain:
    """A fitted chain: the ids of its features and, for each category, weights over features and earlier categories."""

    categories: tuple[str, ...]
    names: list[list[str]]
    weights: list[np.ndarray]

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        """A column for each category; each distinct form is counted once for all links."""
        every = list(dict.fromkeys(f for names in self.names for f in names))
        place = {f: i for i, f in enumerate(every)}
        x = featurise(texts, Selected(every))
        got = np.zeros((len(texts), 0))
        for names, w in zip(self.names, self.weights, strict=True):
            own = x[:, [*(place[f] for f in names), *range(len(every), len(every) + DENSE)]]
            got = np.hstack([got, sigmoid(np.hstack([own, got]) @ w[:-1] + w[-1])[:, None]])
        return got


def fit_chain(keys: list[int], texts: list[str], labels: np.ndarray, categories=CATEGORIES, folds: int = FOLDS, features: int = FEATURES) -> Chain:
    """Fit links in the order of ``categories`` on ``labels`` (rows by categories)."""
    fold = np.array([xxhash.xxh64_intdigest(str(k), 1) % folds for k in keys]) if keys else np.zeros(0, int)
    held, packed = Forms(texts), pa.array(texts, pa.string())
    everyone = np.ones(len(texts), bool)
    chosen: dict[tuple[int, int], list[str]] = {}
    for j in range(len(categories)):
        limit = features // (1 if j == len(categories) - 1 else 4)
        for k in range(folds if j + 1 < len(categories) else 0):
            chosen[j, k] = held.select(fold != k, labels[:, j], limit)
        chosen[j, -1] = held.select(everyone, labels[:, j], limit)
    every = list(dict.fromkeys(f for names in chosen.values() for f in names))
    place = {f: i for i, f in enumerate(every)}
    parts = [featurise(packed.slice(a, b - a), Selected(every)) for a, b in slices(packed)]
    x = np.concatenate(parts) if parts else np.zeros((0, len(every) + DENSE), dtype=np.float32)
    of = lambda names: x[:, [*(place[f] for f in names), *range(len(every), len(every) + DENSE)]]
    earlier, weights = np.zeros((len(texts), 0), dtype=np.float32), []
    for j in range(len(categories)):
        y = labels[:, j].astype(float)
        weights.append(logistic(np.hstack([of(chosen[j, -1]), earlier]), y))
        if j + 1 < len(categories):
            unseen = np.zeros(len(y), dtype=np.float32)
            for k in range(folds):
                own, out = np.hstack([of(chosen[j, k]), earlier]), fold == k
                w = logistic(own[~out], y[~out])
                unseen[out] = sigmoid(own[out] @ w[:-1] + w[-1])
            earlier = np.hstack([earlier, unseen[:, None]])
    return Chain(tuple(categories), [chosen[j, -1] for j in range(len(categories))], weights)


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[int], list[str], np.ndarray]:
    """Rows with both labels within the bounds of the sample, ordered by ``doc_id``; a repeated ``doc_id`` gives its least text."""
    low = (1 - F.col("quality")).cast("int").alias("low_quality")
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)")
    known = known.groupBy(F.col("doc_id").alias("l_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    order = F.xxhash64("l_id")
    some = known.orderBy(order, "l_id").limit(sample).select("l_id", low, F.col("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("d_id"), F.coalesce("text", F.lit("")).alias("d_text"))
    # The broadcast is bounded by the sample, and what is collected by its bytes.
    rows = texts.join(F.broadcast(some), F.col("d_id") == F.col("l_id")).groupBy("l_id", "low_quality", "toxic").agg(F.min("d_text").alias("d_text"))
    rows = kept(rows.select("*", F.octet_length("d_text").cast("long").alias("size"), order.alias("place")), "labelled")
    sizes = sorted((r.place, r.l_id, r.size) for r in rows.select("place", "l_id", "size").collect())
    within = np.cumsum([0, *(s for _, _, s in sizes[1:])]) <= sample_bytes
    last = sizes[int(within.sum()) - 1] if sizes else (0, 0, 0)
    got = rows.where((F.col("place") < last[0]) | ((F.col("place") == last[0]) & (F.col("l_id") <= last[1]))).drop("place", "size").collect()
    release(rows)
    got.sort(key=lambda r: r.l_id)
    return [r.l_id for r in got], [r.d_text for r in got], np.array([[r.low_quality, r.toxic] for r in got]).reshape(len(got), 2)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``p_low_quality``, ``p_toxic`` and ``toxic`` (0 or 1: ``p_toxic`` at or above ``threshold``).

    The chain is fitted on a bounded sample of the rows of ``labels`` that have both labels, then scores
    every row over its whole text. Null and empty text are texts without words. With no labelled rows,
    or labels of one kind only, a category's probability is that of its labels, and with no rows at all
    ``toxic`` is 0. Repeated rows are scored alike; repeated labels count as toxic if one says so.
    Other columns pass through; those named like results are replaced.
    """
    made = ["p_low_quality", "p_toxic", "toxic"]
    rows = docs.drop(*[c for c in docs.columns if c in made])
    small_batches(docs.sparkSession)
    keys, texts, y = labelled_sample(docs, labels, sample)
    chain = fit_chain(keys, texts, y)
    known = bool(keys)
    names, at = [*rows.columns, *made], rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(at), "")
            for first, last in slices(texts):
                p = chain.probabilities(texts.slice(first, last - first))
                toxic = (p[:, 1] >= threshold) & known
                extra = [pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(toxic.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, last - first).columns, *extra], names)

    results = [T.StructField("p_low_quality", T.DoubleType()), T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.IntegerType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *results]))
