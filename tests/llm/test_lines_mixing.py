"""Line dedup and source mixing: odd rows, and whole tables against SQL."""

import duckdb
import pytest

from veldra.llm import lines, mixing, queries


def rounded(rows):
    return sorted((tuple(float(f"{v:.8g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["op4_mixing", "op7_line_dedup"])
def test_against_sql(spark, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert rounded(tuple(r) for r in got.select(*cols).collect()) == rounded(want.fetchall())


LINE = "A line of more than twenty letters"


def test_lines_odd_rows(spark):
    rows = [(1, LINE + "\nown one"), (2, f" {LINE.lower()}\r\n\nx\n{LINE}"), (3, LINE), (3, LINE), (None, LINE), (None, None), (4, ""), (5, "é" * 20 + "\nÉ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS key", "1 AS h1", "9 AS n_lines")
    out = lines.dedup_lines(docs)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)
    want = [(1, "own one", 2, 1), (2, "\nx", 4, 2), (3, LINE, 1, 0), (3, LINE, 1, 0), (None, "", 1, 1), (None, "", 1, 0), (4, "", 1, 0), (5, "é" * 20 + "\nÉ", 2, 0)]
    assert got == sorted(want, key=repr)
    assert set(docs.columns) <= set(out.columns)
    assert lines.dedup_lines(docs.limit(0)).collect() == []


def test_only_ascii_letters_are_lowered(spark):
    rows = [(i, t) for i, t in enumerate(["É" + LINE, "é" + LINE, "É" + LINE.upper()])]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert all(r.n_dropped == 0 for r in out.collect())


def test_mixing_odd_rows(spark):
    rows = [(1, "a", "w " * 10), (2, "b", "w " * 100), (3, None, "w w"), (None, "a", None), (4, "c", ""), (5, "b", "w" + " w" * 50000), (5, "b", "w" + " w" * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "1 AS target", "2 AS w", "3 AS cap")
    out = mixing.mix(docs).collect()
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"] and all(0 <= u.position <= 1 for u in r.uses)
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - k) <= 1 for t, k in by.values())
    assert abs(sum(t for t, _ in by.values()) - total) < 1e-6 * total
    assert by["a"][0] == 30 and by[None][0] == 6
    positions = [r.position for r in mixing.schedule(mixing.mix(docs)).collect()]
    assert positions == sorted(positions)
    assert mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize("text, n, want", [("a b c", 2, "a b "), (" a\n b  c", 2, " a\n b  "), ("a b", 2, "a b"), ("é  f g", 1, "é  ")])
def test_first_words(spark, text, n, want):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text, n, len(text.split()))], "t string, n long, s long")
    assert row.select(mixing.first_words(F.col("t"), F.col("n"), F.col("s")).alias("x")).first().x == want
