"""WARC archives in Zstandard: one frame per record, dictionary in a leading skippable frame.

Archives are written and read by Spark's own file sources, so they live wherever Spark can write and
commit with its protocol: a lost executor's half-written archives never appear. The text writer puts
out the bytes of each row followed by a separator; the separator is an empty skippable frame, which
every Zstandard reader passes over, so each part file is a valid ``.warc.zst`` archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm.common import materialize

MIN_REVISIT_BYTES = 1000
FRAME_MAGIC, DICT_MAGIC, SKIP_MASK = 0xFD2FB528, 0x184D2A5D, 0x184D2A50
#: An empty skippable frame; all its bytes are ASCII.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive's dictionary is trained on so many of its first records.
SAMPLE_RECORDS, DICT_BYTES, LEVEL = 128, 16_384, 3


def _safe(value: str | None) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return "".join(c if "!" <= c and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one WARC/1.1 record; a revisit carries the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_safe(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(samples: list[bytes]) -> zstd.ZstdCompressionDict:
    try:
        return zstd.train_dictionary(DICT_BYTES, samples, k=200, d=8)
    except zstd.ZstdError:  # too few or too small to train on
        return zstd.ZstdCompressionDict(b"".join(samples)[:DICT_BYTES] or b"WARC/1.1\r\n", dict_type=zstd.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The dictionary's skippable frame, then a frame for each record."""
    first: list[bytes] = []
    for r in records:
        first.append(r)
        if len(first) == SAMPLE_RECORDS:
            break
    if not first:
        return
    words = _dictionary([r[: 1 << 17] for r in first])
    raw = words.as_bytes()
    yield struct.pack("<II", DICT_MAGIC, len(raw)) + raw
    pack = zstd.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=True, write_content_size=True)
    for r in first:
        yield pack.compress(r)
    for r in records:
        yield pack.compress(r)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends; reads the frame header and block headers."""
    flags = data[at + 4]
    single, sizes = flags >> 5 & 1, flags >> 6
    pos = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0) if sizes == 0 else 1 << sizes)
    while True:
        if pos + 3 > len(data):
            raise ValueError("a frame is cut short")
        head = int.from_bytes(data[pos : pos + 3], "little")
        pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            break
    pos += 4 * (flags >> 2 & 1)
    if pos > len(data):
        raise ValueError("a frame is cut short")
    return pos


def records(archive: bytes) -> Iterator[bytes]:
    """The decoded records of an archive, each from its own frame."""
    data, at, unpack = memoryview(archive), 0, zstd.ZstdDecompressor()
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("an archive ends inside a frame header")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIP_MASK:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut short")
            if at == 0 and magic == DICT_MAGIC:
                words = bytes(data[8 : 8 + size])
                if words[:4] == struct.pack("<I", FRAME_MAGIC):  # a dictionary may be compressed itself
                    words = zstd.ZstdDecompressor().decompressobj().decompress(words)
                unpack = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(words))
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        end = _frame_end(data, at)
        yield unpack.decompressobj().decompress(data[at:end])  # frames need not say how long they are
        at = end


def _number(urn: str | None) -> int | None:
    body = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body.isdecimal() or body[:1] == "-" and body[1:].isdecimal() else None


def _hex(digest: str) -> str | None:
    """The hex form of a labelled SHA-1 digest in hex or base 32; null for another algorithm."""
    label, _, value = digest.strip().partition(":")
    if label.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-cased name; a line that starts with white space goes on with the one before."""
    named: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            named[name] = f"{named[name]} {line.strip()}".strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise ValueError(f"malformed header {line[:40]!r}")
        named[name] = value.strip()
    return named


def parse(raw: bytes) -> dict:
    """The fields of a record of any type, after checks of its version, headers, lengths and digest.

    ``page_id`` and ``refers_to`` are the numbers of record ids as :func:`record` writes them, null for other
    ids. A response's payload is what follows its HTTP head; its length and digest are checked where the head
    and the record name them, but for a body sent in chunks, whose stored form they do not describe.
    """
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode(errors="replace").split("\r\n")
    if not gap or version not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC head")
    named = _fields(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in named:
            raise ValueError(f"no {name} header")
    if not named["content-length"].isdecimal() or int(named["content-length"]) + 4 != len(rest) or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length does not match the block")
    kind, block = named["warc-type"], rest[:-4]
    digest = _hex(named["warc-payload-digest"]) if "warc-payload-digest" in named else None
    payload, size = block, len(block)
    if kind in ("response", "revisit") and named.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        if not gap:
            raise ValueError("no end of the HTTP head")
        told = _fields(http.decode(errors="replace").split("\r\n")[1:])
        length, chunked = told.get("content-length"), "transfer-encoding" in told
        if length is not None and not length.isdecimal():
            raise ValueError("the HTTP Content-Length is no number")
        size = len(payload) if kind == "response" else int(length) if length else None
        if kind == "response" and not chunked:
            if length is not None and int(length) != len(payload):
                raise ValueError("the payload does not match its length")
            if digest is not None and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError("the payload does not match its digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in named and "warc-refers-to-target-uri" not in named):
        raise ValueError("malformed revisit record")
    if kind == "response" and digest is None:
        digest = hashlib.sha1(payload).hexdigest()
    return {
        "record_id": named["warc-record-id"],
        "page_id": _number(named["warc-record-id"]),
        "url": named.get("warc-target-uri"),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _number(named.get("warc-refers-to")),
        "payload": None if kind == "revisit" else payload,
        "error": None,
    }


_KINDS = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64())]
_KINDS += [("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
_SCHEMA = "record_id string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages(page_id, url, html)`` as archives below ``path``, one for each task.

    Of pages with equal payloads of at least ``min_bytes`` bytes, those with the largest ``page_id`` are
    responses and the others revisit it; smaller payloads are all responses. Null html is an empty
    payload, a null url an empty URI. A null ``page_id`` is never the largest; if all are null they are
    all responses. Rows that repeat the largest ``page_id`` are responses as well. An empty table gives
    archives without frames. Other columns are not stored.
    """
    payload = F.coalesce(F.col("html").cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size"))
    largest = (
        rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    )
    repeated = materialize(largest.where("n > 1 AND keep IS NOT NULL").select("digest", "size", "keep"), "repeated")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    joined = rows.join(repeated, ["digest", "size"], "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("keep").isNotNull(), refers).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = (record(*(c[i].as_py() for c in b.columns), date) for b in batches for i in range(b.num_rows))
        held, size = [], 0
        for frame in frames(raw):
            held.append(frame)
            size += len(frame)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], ["frame"])

    out = joined.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    out.write.mode("error").option("lineSep", SEPARATOR).option("compression", "none").text(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, strict: bool = True, pattern: str = "part-*") -> DataFrame:
    """A row for each record of the archives below ``path`` whose names match ``pattern``.

    With ``strict``, a malformed record or archive fails the read with its reason. Without, it is a row that
    has ``error`` alone: the other records of the archive follow, up to where its frames can be told apart.
    An archive is one value to Spark, so it may have 2 GB at most; those of :func:`write_archives` hold what
    one task has read.
    """

    def parsed(raw: bytes) -> dict:
        try:
            return parse(raw)
        except ValueError as bad:
            if strict:
                raise
            return dict.fromkeys(k for k, _ in _KINDS) | {"error": str(bad)}

    def rows_of(archive: bytes) -> Iterator[dict]:
        try:
            for raw in records(archive):
                yield parsed(raw)
        except (ValueError, zstd.ZstdError) as bad:
            if strict:
                raise
            yield dict.fromkeys(k for k, _ in _KINDS) | {"error": str(bad)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_KINDS)
        for batch in batches:
            for archive in batch.column(0):
                rows, size = [], 0
                for row in rows_of(archive.as_py()):
                    rows.append(row if payload else row | {"payload": None})
                    size += 200 + len(rows[-1]["payload"] or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("content")
    return files.mapInArrow(run, _SCHEMA)
