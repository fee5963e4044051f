"""WARC archives compressed record by record with a Zstandard dictionary.

An archive is a leading skippable frame that holds a dictionary built from the archive's own first records,
then one Zstandard frame per record, compressed with that dictionary. Each record can be read alone.

Pages become ``response`` records. Of pages with equal payloads (``least_bytes`` at least) the one with the
smallest id is the response, the others are ``revisit`` records that refer to it and carry no payload.

Equal payloads are found by digest: smallest ids are partial aggregates over narrow rows, and joined back to
the pages, where Spark splits a payload that very many pages share. Spark's text writer commits the archives,
so they can go to any store and a lost executor leaves no half-written file. Its line separator is an empty
skippable frame, which readers of Zstandard skip. A row of the written frame is a piece of an archive of
about ``piece_bytes``, a file takes ``PIECES`` rows: archives are bounded in bytes, tasks hold one piece.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.sinks import materialise

# The formats' magic numbers, field names and profile.
DICTIONARY_MAGIC = 0x184D2A5D
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
PIECES = 32
RECORD_ID = re.compile(r"<urn:x-page:(-?\d+)>")


def _uri(url: str | None) -> str:
    """A URI for a header line: white space and control characters are percent-encoded."""
    return "urn:x-unknown" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _id(page: int | None) -> str:
    return "<urn:x-page:none>" if page is None else f"<urn:x-page:{page}>"


def record(page: int | None, url: str | None, payload: bytes | None, size: int, digest: str,
           first: int | None = None, first_url: str | None = None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or (payload None) a revisit of page ``first``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [("WARC-Type", "response" if payload is not None else "revisit"), ("WARC-Record-ID", _id(page)),
              ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _id(first)), ("WARC-Refers-To-Target-URI", _uri(first_url)), ("WARC-Refers-To-Date", DATE)]
    block = http + (payload or b"")
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def train(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records; None where they are too few or too short to build one."""
    try:
        return zstandard.train_dictionary(size, records, k=1024, d=8)
    except zstandard.ZstdError:
        return None


def _pieces(records, piece_bytes: int, dictionary_bytes: int):
    """Pieces of archives: each archive is its dictionary frame, then PIECES - 1 pieces of compressed records."""
    def full():
        held, size = [], 0
        for r in records:
            held.append(r)
            size += len(r)
            if size >= piece_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    compressor = None
    for n, held in enumerate(full()):
        if n % (PIECES - 1) == 0:
            d = train(held, dictionary_bytes)
            body = d.as_bytes() if d else b""
            compressor = zstandard.ZstdCompressor(level=3, dict_data=d) if d else zstandard.ZstdCompressor(level=3)
            yield struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
        yield b"".join(map(compressor.compress, held))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 100, piece_bytes: int = 4 << 20, dictionary_bytes: int = 1 << 16) -> None:
    """Write one record per row of ``pages``.

    A null payload is an empty one, a null URL becomes ``urn:x-unknown``. A null id is never the smallest: such
    pages revisit a page with an id if there is one and are responses otherwise. Rows that repeat the
    smallest id are responses like it. An empty table writes no record. Other columns are ignored.
    """
    body = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{key}`").cast("bigint").alias("page"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("body"),
                        F.octet_length(body).cast("bigint").alias("size"), F.sha2(body, 256).alias("digest"))
    known = F.when(F.col("page").isNotNull(), F.struct("page", "url"))
    firsts = materialise(rows.filter(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(known).alias("f"), F.count("*").alias("n"))
                         .filter("n > 1 and f is not null").select(F.col("digest").alias("d"), F.col("f.page").alias("first"), F.col("f.url").alias("first_url")), "first-pages")
    placed = rows.join(firsts, rows.digest == firsts.d, "left")
    again = F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    out = placed.select("page", "url", F.when(~again, F.col("body")).alias("body"), "size", "digest", "first", "first_url")

    def run(batches):
        def records():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield record(*(c[i].as_py() for c in batch.columns))

        for piece in _pieces(records(), piece_bytes, dictionary_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], names=["piece"])

    (out.mapInArrow(run, "piece binary").select(F.col("piece").cast("string").alias("value")).write
     .option("lineSep", EMPTY_FRAME.decode("latin-1")).option("maxRecordsPerFile", PIECES).text(path))


def _headers(lines) -> dict[str, str]:
    found = {}
    for line in iter(lines.readline, b""):
        if line == b"\r\n":
            break
        name, _, value = line.decode().partition(":")
        found[name.lower()] = value.strip()
    return found


def records_of(archive: bytes):
    """Records of an archive as (record id, type, target, payload, size, digest, refers to), one at a time."""
    magic, size = struct.unpack_from("<II", archive) if len(archive) >= 8 else (0, 0)
    d = zstandard.ZstdCompressionDict(archive[8:8 + size]) if magic == DICTIONARY_MAGIC and size else None
    decompressor = zstandard.ZstdDecompressor(dict_data=d) if d else zstandard.ZstdDecompressor()
    with decompressor.stream_reader(archive, read_across_frames=True) as raw:
        stream = io.BufferedReader(raw, 1 << 20)
        for version in iter(stream.readline, b""):
            if version != b"WARC/1.1\r\n":
                raise ValueError(f"no WARC record: {version[:40]!r}")
            head = _headers(stream)
            block = stream.read(int(head["content-length"]))
            http, _, payload = block.partition(b"\r\n\r\n")
            if stream.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where its length says")
            full = int(re.search(rb"Content-Length: (\d+)", http)[1])
            digest = head["warc-payload-digest"].removeprefix("sha256:")
            if head["warc-type"] == "response":
                if len(payload) != full or (found := hashlib.sha256(payload).hexdigest()) != digest:
                    raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                digest = found
            yield head["warc-record-id"], head["warc-type"], head["warc-target-uri"], payload, full, digest, head.get("warc-refers-to")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of all archives in a folder: ``record_id, record_type, target_uri, payload_bytes, payload_digest,
    refers_to_id`` and, if asked for, ``payload``. Response payloads are checked against their digests."""
    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for r in records_of(content.as_py()):
                    held.append(r)
                    size += len(r[3]) + 500
                    if size > 8 << 20:
                        yield _batch(held, payloads)
                        held, size = [], 0
                yield _batch(held, payloads)

    schema = "record_id string, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to_id string"
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def _batch(records: list[tuple], payloads: bool) -> pa.RecordBatch:
    ids, kinds, targets, bodies, sizes, digests, refers = zip(*records) if records else [()] * 7
    columns = {"record_id": pa.array(ids, pa.string()), "record_type": pa.array(kinds, pa.string()), "target_uri": pa.array(targets, pa.string()),
               "payload_bytes": pa.array(sizes, pa.int64()), "payload_digest": pa.array(digests, pa.string()), "refers_to_id": pa.array(refers, pa.string())}
    return pa.RecordBatch.from_pydict(columns | ({"payload": pa.array(bodies, pa.binary())} if payloads else {}))


def page_of(record_id: Column) -> Column:
    """The page id in a record id; null for pages without one."""
    return F.nullif(F.regexp_extract(record_id, RECORD_ID.pattern, 1), F.lit("")).cast("bigint")
