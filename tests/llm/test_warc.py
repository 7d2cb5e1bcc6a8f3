"""WARC archives: exact round trip, damaged archives, odd pages."""

import base64
import hashlib
import struct

import duckdb
import pytest
import zstandard
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from veldra.llm import queries, warc
from veldra.llm.common import new_path

BIG = "<p>" + "long page " * 200


def test_round_trip_of_odd_pages(spark):
    rows = [(1, "http://a/ b\r\nX: y", BIG), (9, None, BIG), (9, "u", BIG), (None, "n", BIG), (2, "u", "short"), (3, "u", "short"), (4, "é\t", None), (None, None, ""), (5, "u", "\r\n\r\nWARC/1.1\r\n" + "é🙂" * 400000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS size")
    path = new_path(spark, "test")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=repr) == sorted(
        ((i, "revisit" if h == BIG and i != 9 else "response", 9 if h == BIG and i != 9 else None, len((h or "").encode())) for i, _, h in rows), key=repr
    )
    for r in got:
        if r.payload is not None:
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    files = spark.read.format("binaryFile").load(path).where("path LIKE '%part-%'").collect()
    assert files and all(next(zstandard.ZstdDecompressor().read_to_iter(warc.SEPARATOR.encode() + b"", 1), b"") == b"" for _ in files)
    empty = new_path(spark, "test")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).collect() == []


def test_against_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = db.execute(queries.ORACLE_SQL["op9_warc"])
    cols = [c[0] for c in want.description]
    got = queries.op9_warc(spark, sf_dir).select(*cols).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def archive():
    made = [warc.record(i, "u", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), None, "1970-01-01T00:00:00Z") for i in (0, 10, 400_000)]
    return made, warc.SEPARATOR.encode().join(warc.frames(iter(made)))


def test_one_frame_per_record():
    made, data = archive()
    assert list(warc.records(data)) == made
    assert [warc.parse(r)["payload_bytes"] for r in made] == [0, 10, 400_000]


@pytest.mark.parametrize("damage", [lambda d: d[:-3], lambda d: d[:6], lambda d: d + b"12345678", lambda d: d[:-2] + b"??"])
def test_damaged_archives_are_refused(damage):
    with pytest.raises((ValueError, zstandard.ZstdError)):
        [warc.parse(r) for r in warc.records(damage(archive()[1]))]


@pytest.mark.parametrize("old, new", [(b"WARC/1.1", b"HTTP/1.1"), (b"Content-Length: 1", b"Content-Length: 2"), (b"WARC-Date", b"X-Date"), (b"xxxx", b"xxxy"), (b"WARC-Type: response", b"WARC-Type response")])
def test_malformed_records_are_refused(old, new):
    raw = archive()[0][1]
    assert old in raw
    with pytest.raises(ValueError):
        warc.parse(raw.replace(old, new, 1))


def foreign():
    """Records as crawlers write them: ids of other kinds, base-32 digests, no digests, folded headers, chunks."""
    body = b"<p>hello</p>"
    b32 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    make = lambda head, block: ("WARC/1.0\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    ids = ["WARC-Record-ID: <urn:uuid:6ba7b810-9dad-11d1-80b4-00c04fd430c8>", "WARC-Date: 2020-01-01T00:00:00Z"]
    http = "Content-Type: application/http; msgtype=response"
    return [
        make(["WARC-Type: warcinfo", *ids, "Content-Type: application/warc-fields"], b"software: x\r\n"),
        make(["WARC-Type: response", *ids, http, f"WARC-Payload-Digest: sha1:{b32}", "WARC-Target-URI:", "\thttp://a/"], b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + body),
        make(["WARC-Type: response", *ids, http, "WARC-Payload-Digest: sha256:00"], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 3\r\n\r\n" + body),
        make(["WARC-Type: revisit", *ids, http, "WARC-Refers-To: <urn:uuid:0>"], b"HTTP/1.1 304 X\r\n\r\n"),
        make(["WARC-Type: resource", *ids, "Content-Type: text/plain"], b"plain"),
    ]


def test_records_of_other_writers():
    got = [warc.parse(r) for r in foreign()]
    assert [(g["record_type"], g["page_id"], g["payload_bytes"]) for g in got] == [("warcinfo", None, 13), ("response", None, 12), ("response", None, 12), ("revisit", None, None), ("resource", None, 5)]
    assert got[1]["payload_digest"] == hashlib.sha1(b"<p>hello</p>").hexdigest() == got[2]["payload_digest"]
    assert got[1]["url"] == "http://a/" and got[1]["payload"] == b"<p>hello</p>" and got[3]["payload"] is None


def test_archives_of_other_writers(spark):
    # The dictionary is compressed, frames do not say how long they are, and two records are damaged.
    made = foreign()
    words = zstandard.train_dictionary(1024, [r + str(i).encode() for r in made for i in range(60)], k=50, d=8)
    packed = zstandard.ZstdCompressor().compress(words.as_bytes())
    pack = zstandard.ZstdCompressor(dict_data=words, write_content_size=False)
    data = struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed
    data += b"".join(pack.compress(r) for r in [*made, made[1].replace(b"hello", b"hullo"), b"no record", made[4]])
    path = new_path(spark, "foreign")
    spark.createDataFrame([(data,)], "value binary").select(F.col("value").cast("string")).coalesce(1).write.option("lineSep", warc.SEPARATOR).text(path)
    got = warc.read_archives(spark, path, strict=False).collect()
    assert [r.record_type for r in got] == ["warcinfo", "response", "response", "revisit", "resource", None, None, "resource"]
    assert [bool(r.error) for r in got] == [False] * 5 + [True, True, False]
    with pytest.raises(PythonException):
        warc.read_archives(spark, path).collect()


def test_dictionaries_are_used():
    made, data = archive()
    size = struct.unpack_from("<I", data, 4)[0]
    with pytest.raises(zstandard.ZstdError):
        list(warc.records(data[8 + size :]))
    assert list(warc.records(data)) == made
