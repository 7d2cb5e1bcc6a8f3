"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veldra.functions import text as tx
from veldra.plans.catalogue import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.5g}") + 0.0
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(got.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*cols).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns[:3] == ["qid", "rank", "idx"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_judgement_reads_whole_texts(spark, sf_dir):
    got = {r.id: r for r in QUERIES["answer_judgement"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id").collect()
    assert any(len(d.text) > 600 and d.text.count("\n") > 2 for d in docs)
    assert all(got[d.doc_id].n_facts_total == d.text.count("\n") + 1 for d in docs)
    lines = spark.createDataFrame([(d.doc_id, x) for d in docs for x in d.text.split("\n")], "id long, line string")
    spoken = lines.where(F.size(tx.content_words(F.col("line"))) > 0).groupBy("id").count().collect()
    assert spoken and all(got[r.id].n_facts_passed >= r["count"] for r in spoken)


def test_classifier_bench_searches_the_grids(spark, sf_dir, monkeypatch):
    from veldra.operators import models

    asked = []
    monkeypatch.setattr(models, "bench", lambda rows, names, kinds=None: asked.append((names, kinds or models.GRIDS)) or [])
    QUERIES["classifier_bench"](spark, sf_dir)
    size = len(spark.read.parquet(f"{sf_dir}/embeddings.parquet").first().embedding)
    assert asked == [([*(f"v{i}" for i in range(size)), "n_chars"], models.GRIDS)]
