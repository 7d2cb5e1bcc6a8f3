"""Packing: ids against the tokenizer, exact cover, and little padding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veldra.llm import common, packing
from veldra.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@given(st.text(alphabet="abAÉéßİΣ'’., \n\t\x1c ́1½<|>_it's", max_size=40))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_tokenizers(text):
    ids, at = packing.encoder(PATH).encode(pa.array(["", text, "b " + text], pa.string()))
    assert ids.tolist() == [*ids_of(text), *ids_of("b " + text)]
    assert at.tolist() == [0, 0, len(ids_of(text)), len(ids)]


def test_other_tokenizers_take_whole_texts():
    other = packing.encoder(vocabulary("byte_bpe_50k.json"))
    whole = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["Two  words.", "", "É ́x\n"]
    ids, at = other.encode(pa.array(texts))
    assert not other.by_word and packing.encoder(PATH).by_word
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_cover_all_rows():
    texts = pa.array(["a" * n for n in (0, 5, 0, 30, 2, 2, 9)])
    got = list(common.slices(texts, 10))
    assert [i for a, b in got for i in range(a, b)] == list(range(7)) and len(got) > 2
    assert list(common.slices(pa.array([], pa.string()))) == [] and list(common.slices(pa.array([""]))) == [(0, 1)]


def check(rows, docs):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    copies = Counter(d for d, _ in docs)
    for doc_id, text in docs:
        ids = [*ids_of(text), 1]
        got = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[doc_id])
        at = 0
        for start, length, crc, n in got[:: copies[doc_id]]:
            assert start == at and n == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return sum(r.length for r in rows), len(by_seq)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    used, n = check(packing.pack(docs, PATH).collect(), [tuple(r) for r in docs.collect()])
    assert used > 0.97 * 2048 * (n - 1)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a" * 5000), (4, "word " * 30000), (5, "<|endoftext|> x"), (6, "same"), (6, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS bucket")
    packed = packing.pack(docs, PATH)
    check(packed.collect(), rows)
    made = packing.sequences(docs.where("doc_id < 6"), packing.pack(docs.where("doc_id < 6"), PATH), PATH).collect()
    assert sum(r.n_ids for r in made) == sum(len(ids_of(t)) + 1 for d, t in rows if d < 6)
    assert all(len(r.ids) == 4 * r.n_ids for r in made)
    assert packing.pack(docs.limit(0), PATH).collect() == []


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 400), min_size=1, max_size=12))
@settings(max_examples=25, deadline=None)
def test_patterns_hold_exactly_the_demand(histogram):
    lengths, demand = np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)])
    plan = packing.solve(lengths, demand, 60)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert all((p * lengths).sum() <= 60 for p, _ in plan)


def test_column_generation_meets_a_known_optimum():
    # 40 and 24 pair up to 64; packing each length alone would need 300 sequences.
    plan = packing.solve(np.array([24, 40]), np.array([200, 200]), 64)
    assert sum(t for _, t in plan) == 200


@pytest.mark.parametrize("n", [1, 63, 64, 2047, 2048, 2049, 7000])
def test_cuts_cover(n):
    at = 0
    for start, length in packing.cut(n):
        assert start == at and 0 < length <= 2048
        at += length
    assert at == n
