"""The classifier chain: held-out accuracy, out-of-fold training, odd rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from veldra.llm import toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    keys, texts, y = toxicity.labelled_sample(docs, labels)
    train = np.array([k % 3 != 0 for k in keys])
    pick = lambda xs, m: [x for x, keep in zip(xs, m, strict=True) if keep]
    chain = toxicity.fit_chain(pick(keys, train), pick(texts, train), y[train])
    p, held = chain.probabilities(pa.array(pick(texts, ~train))), y[~train]
    found, toxic, prose = p[:, 1] >= toxicity.THRESHOLD, held[:, 1] == 1, held[:, 0] == 0
    assert found[toxic & prose].mean() > 0.93
    assert found[~toxic].mean() < 0.01
    junk = p[:, 0] >= 0.5
    assert (junk == (held[:, 0] == 1)).mean() > 0.95


def test_later_links_see_out_of_fold_probabilities(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 6)) for _ in range(200)]
    y = np.stack([rng.integers(0, 2, 200), rng.integers(0, 2, 200)], axis=1)
    fits = []
    whole = toxicity.logistic
    monkeypatch.setattr(toxicity, "logistic", lambda x, t, **k: fits.append(x.shape) or whole(x, t, **k))
    chain = toxicity.fit_chain(list(range(200)), texts, y)
    rows = [n for n, _ in fits]
    assert rows[0] == 200 and sum(200 - n for n in rows[1:-1]) == 200 and rows[-1] == 200
    assert fits[-1][1] == len(chain.names[1]) + toxicity.DENSE + 1 == len(chain.weights[1]) - 1


def test_a_fold_chooses_and_fits_without_its_own_labels(monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    y = np.stack([rng.integers(0, 2, 400), rng.integers(0, 2, 400)], axis=1)
    texts = [" ".join(rng.choice(words[150 * a : 150 * a + 200], 30)) for a, _ in y]
    whole, fits = toxicity.logistic, []
    monkeypatch.setattr(toxicity, "logistic", lambda x, t, **k: fits.append((x.tobytes(), t.tobytes())) or whole(x, t, **k))
    toxicity.fit_chain(list(range(400)), texts, y, features=40)
    fold = np.array([xxhash.xxh64_intdigest(str(k), 1) % toxicity.FOLDS for k in range(400)])
    first, fits[:] = list(fits), []
    flipped = y.copy()
    flipped[fold == 2, 0] ^= 1
    toxicity.fit_chain(list(range(400)), texts, flipped, features=40)
    same = [a == b for a, b in zip(first, fits, strict=True)]
    assert same == [False, False, False, True, False, False, False]  # all rows, folds 0 to 4, the next link


def test_features_against_plain_counts():
    texts = ["The ANGRY angrily, angry1 x\nAngry", "", "ab  ANGR _angry_ été", "none"]
    names = ["^angr", "=angry", "^angri", "=ab"]
    got = toxicity.featurise(pa.array(texts), toxicity.Selected(names))
    for row, text in zip(got, texts, strict=True):
        words = re.findall(r"[^\W\d_]+", text)
        parts = re.split(r"[ \n]", text)
        count = [sum(f in toxicity.forms(w.lower()) for w in words) for f in names]
        shape = [np.log1p(len(words)) / 10, sum(w.isupper() for w in words) / max(1, len(words)), len(set(parts)) / len(parts), sum(map(len, words)) / max(1, len(text))]
        assert np.allclose(row, [*(np.log1p(count) / 2), *shape], atol=1e-6)


def test_the_sample_is_bounded_by_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * 100) for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    keys, texts, y = toxicity.labelled_sample(docs, labels, sample=15, sample_bytes=3000)
    assert 6 <= len(keys) <= 7 and len(texts) == len(y) == len(keys) and all(len(t) == 500 for t in texts)
    assert len(toxicity.labelled_sample(docs, labels, sample=15)[0]) == 15


CASES = [(1, None), (2, ""), (None, "you idiot scum"), (3, "word " * 30000), (3, "word " * 30000), (4, "ok")]


@pytest.mark.parametrize("labels", [[], [(1, 1, 1), (1, 0, 0), (2, None, 1), (None, 1, 1)], [(4, 1, 0), (3, 1, 0)]])
def test_odd_rows(spark, labels):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").selectExpr("*", "5 AS toxic", "1 AS l_id", "2 AS quality")
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text")
    out = toxicity.score(docs, frame)
    rows = out.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(CASES, key=repr)
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in rows)
    assert all(r.toxic in (0, 1) for r in rows) and (labels or not any(r.toxic for r in rows))
    assert toxicity.score(docs.limit(0), frame).collect() == []
