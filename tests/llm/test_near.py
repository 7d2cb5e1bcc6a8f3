"""Near copies of the pipeline's stage against Jaccard similarity over every pair."""

import pytest

import corpus_pipeline as pipe
from veldra.llm import near


def slow_keepers(rows: list[tuple]) -> list[int]:
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a) >= 0.8 * len(b) and len(b) >= 0.8 * len(a) and len(a & b) >= 0.8 * len(a | b):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted(least.values())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stage_against_every_pair(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in pipe.near_dedup(spark, docs, "").collect()) == slow_keepers(rows)


def test_near_copies_beyond_two_bits(spark):
    words = [f"w{i}" for i in range(300)]
    close, far = [*words], [*words]
    close[::60] = [f"x{i}" for i in range(5)]  # 5 words changed: similarity 0.85
    far[::20] = [f"y{i}" for i in range(15)]  # 15 words changed: similarity 0.6
    rows = [(1, " ".join(words)), (2, " ".join(close)), (3, " ".join(far)), (4, None), (5, " "), (6, "a b"), (7, "A  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near.one_of_each(docs).collect()) == slow_keepers(rows) == [1, 3, 4, 6]
    assert near.one_of_each(docs.limit(0)).collect() == []
