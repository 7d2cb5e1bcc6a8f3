"""Each stage of the pipeline against a plain version on what the stage before it kept."""

import zlib
from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline as pipe
from tests.llm.test_near import slow_keepers
from tests.llm.test_packing import check, ids_of
from veldra.llm import mixing, packing, queries, toxicity
from veldra.llm.common import materialize


def test_stages(spark, sf_dir):
    names = [n for n, _ in pipe.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [docs]
    for _, stage in pipe.STAGES:
        kept.append(materialize(stage(spark, kept[-1], sf_dir), "test"))
    assert all(df.columns == docs.columns for df in kept[:-1])
    start, clean, lined, single, mixed, packed = ([tuple(r) for r in df.collect()] for df in kept)

    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = {r.doc_id for r in scored.where("toxic = 1").select("doc_id").collect()}
    assert sorted(clean) == sorted(r for r in start if r[0] not in rejected) and rejected

    db = duckdb.connect()
    db.register("documents", kept[1].toPandas())
    want = {r[0]: r[3] for r in db.execute(queries.ORACLE_SQL["op7_line_dedup"]).fetchall()}
    import hashlib

    assert {r[0]: hashlib.sha256(r[1].encode()).hexdigest() for r in lined} == want
    assert all(r[4] == len(r[1]) for r in lined)

    keepers = set(slow_keepers([(r[0], r[1]) for r in lined]))
    assert sorted(single) == sorted(r for r in lined if r[0] in keepers)

    goal = {r.doc_id: r for r in mixing.mix(kept[3]).collect()}
    uses = Counter(r[0] for r in mixed)
    assert uses == Counter({d: len(r.uses) for d, r in goal.items() if r.uses})
    words = Counter()
    for r in mixed:
        words[r[0]] += len(r[1].encode().split())
        assert goal[r[0]].text.startswith(r[1].rstrip())
    assert all(words[d] == r.taken for d, r in goal.items())

    assert Counter(piece(r) for r in kept[5].collect()) == Counter(p for r in mixed for p in pieces(r[0], r[1]))
    check(kept[5].collect(), [])  # offsets without gaps, no sequence too long


def piece(r):
    return r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens


def pieces(doc_id, text):
    """What a document is cut into, with the tokenizer's own ids."""
    ids = [*ids_of(text), 1]
    return [(doc_id, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()), len(ids)) for s, n in packing.cut(len(ids))]


LONG = "A line of more than twenty letters\n" * 3 + "word other " * 20000
ODD = [
    (1, None, "en", "s", 0), (2, "", None, None, None), (None, None, None, None, None), (None, "a text of its own", "en", None, 1), (3, LONG, "en", "s", 5),
    (4, "Repeated rows of one text, five words and more\nA line of more than twenty letters", "en", "t", 9), (4, "Repeated rows of one text, five words and more\nA line of more than twenty letters", "en", "t", 9),
    (5, "repeated ROWS of one text, five words and more", "fr", "s", 9), (5, "the same id with another text\nA line of more than twenty letters", "fr", "s", 9), (6, " \n\t", "en", "u", 3),
]


def test_odd_rows_in_every_stage(spark, sf_dir):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "1 AS toxic", "2 AS n_lines", "3 AS fp", "4 AS size", "5 AS target", "6 AS length", "'x' AS component_id", "7 AS __spare")
    empty = docs.limit(0)
    for name, stage in pipe.STAGES:
        out = [tuple(r) for r in stage(spark, docs, sf_dir).collect()]
        again = [tuple(r) for r in stage(spark, docs, sf_dir).collect()]
        assert sorted(out, key=repr) == sorted(again, key=repr), name
        assert stage(spark, empty, sf_dir).collect() == [], name
        if name != "packing":
            assert stage(spark, docs, sf_dir).columns == pipe.COLUMNS
        ids = Counter(r[0] for r in out)
        if name == "toxicity":  # nothing here is toxic
            assert sorted(out, key=repr) == sorted(ODD, key=repr)
        elif name == "line dedup":
            text = {(r[0], r[1]) for r in out}
            assert len(out) == len(ODD) and (None, "") in text and (5, "the same id with another text\nA line of more than twenty letters") in text
            assert (4, "Repeated rows of one text, five words and more") in text and max(len(r[1]) for r in out) == len("word other " * 20000)
        elif name == "near dedup":  # texts without words are one group, equal rows another
            assert ids == Counter({1: 1, None: 1, 3: 1, 4: 1, 5: 2})
        elif name == "mixing":
            assert max(ids.values()) <= 6 and None in ids
            assert not any(r[1] == "" for r in out)
        else:
            assert ids.keys() == {r[0] for r in ODD}
            check(stage(spark, docs, sf_dir).collect(), [])


def test_run_gives_the_last_stage(spark, sf_dir):
    assert set(pipe.run(spark, sf_dir).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
