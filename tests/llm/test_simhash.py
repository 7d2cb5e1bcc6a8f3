"""SimHash against a brute-force version over every pair."""

import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from veldra.llm import simhash


def slow_fingerprint(text: str) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows: list[tuple]) -> list[tuple]:
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                label[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(d)
    least = {r: min((d for d in m if d is not None), default=None) for r, m in ids.items()}
    return sorted(((d, f"{fps[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


@given(st.text(alphabet="AbZé \t\n\x0b\x1c.", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


@pytest.mark.parametrize("spread", [64, 12])
def test_index_finds_every_link(spread):
    rng = np.random.default_rng(1)
    fps = np.unique(rng.integers(0, 1 << spread, 3000, dtype=np.uint64))
    flips = fps[:300] ^ (np.uint64(1) << rng.integers(0, spread, 300, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, flips]))
    groups = rng.integers(0, 3, len(fps))
    groups = np.unique(groups, return_inverse=True)[1]
    index = simhash.GrayIndex(groups, fps)
    got = {frozenset((int(index.fps[i]), int(index.fps[j]))) for a, b in index.links() for i, j in zip(a, b, strict=True)}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = {frozenset((int(fps[i]), int(fps[j]))) for i, j in zip(*np.nonzero(near & (groups[:, None] == groups[None, :])), strict=True) if i < j}
    assert got == want and want


def test_groups_are_dropped_whole():
    # Far groups go by the differences that their upper nodes have added up, long before their leaves.
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    fps = np.unique(np.concatenate([fps, fps[:500] ^ np.uint64(5)]))
    index = simhash.GrayIndex(np.zeros(len(fps), np.int64), fps)
    found = sum(len(a) for a, _ in index.links())
    assert found >= 500 and len(index.levels) > 4
    assert index.pruned > len(fps) and index.visited < 0.1 * len(fps) ** 2 / 2
    # With a leading block that must agree, a search follows one path.
    lead = simhash.GrayIndex(np.zeros(len(fps), np.int64), fps, ((1 << 21) - 1) << 43)
    assert sum(len(a) for a, _ in lead.links()) == found  # the flipped bits stand behind the block
    assert lead.visited < 60 * len(fps)


@pytest.mark.parametrize("radius, split", [(0, 10**6), (1, 10**6), (2, 10**6), (2, 3), (3, 5)])
def test_ranges_hold_every_link(spark, monkeypatch, radius, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    monkeypatch.setattr(simhash, "RANGE", 64)
    rng = np.random.default_rng(7)
    fps = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 1500, dtype=np.uint64)
    for _ in range(3):  # chains of near copies with bits flipped anywhere
        flips = np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64) | np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64)
        fps = np.concatenate([fps, fps[-200:] ^ flips])
    fps = np.unique(np.concatenate([fps, np.uint64(0xABCDEF) << np.uint64(40) | rng.integers(0, 1 << 40, 60, dtype=np.uint64)]))
    got = simhash.links(spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long"), radius).collect()
    label = {int(f): int(f) for f in fps.view(np.int64)}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in got:
        label[root(r.a)] = root(r.b)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    classes = np.arange(len(fps))
    while True:
        least = np.where(near, classes[None, :], len(fps)).min(axis=1)
        if (least == classes).all():
            break
        classes = least
    names = [root(int(f)) for f in fps.view(np.int64)]
    assert len(set(zip(names, classes.tolist(), strict=True))) == len(set(names)) == len(set(classes.tolist()))


def test_documents_against_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    from veldra.llm.queries import op2_simhash

    got = sorted((tuple(r) for r in op2_simhash(spark, sf_dir).collect()), key=repr)
    assert got == slow_components(rows)


CASES = [(5, None), (3, ""), (None, " \n"), (7, "a b c d"), (7, "a b c d"), (None, "lone row"), (9, "word " * 30000), (8, "WORD " * 30000), (2, "x")]


def test_odd_rows_and_split_groups(spark, monkeypatch):
    docs = spark.createDataFrame(CASES, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS gkey")
    for split in (simhash.SPLIT, 0):
        monkeypatch.setattr(simhash, "SPLIT", split)
        out = simhash.near_duplicates(docs).selectExpr("doc_id", "lower(lpad(hex(fp), 16, '0'))", "component_id")
        assert sorted((tuple(r) for r in out.collect()), key=repr) == slow_components(CASES)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 7, None, 8, 2], key=repr)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
    assert simhash.one_of_each(docs.limit(0)).collect() == []
