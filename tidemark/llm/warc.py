"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the end of a bundle holds the seek table of
the public seekable format, and each bundle comes with an index from record identifiers to frame numbers and offsets
within the decompressed frame. A bundle is one row of a Parquet table, its bytes exactly a ``.warc.zst`` file: the
table goes through Spark's own writers and committers, so it works on any store and survives lost executors.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bounded_batches, hot_join, staged

#: Equal payloads below this many bytes are all stored.
REVISIT_BYTES = 100
#: A frame is closed at so many bytes of records, a bundle at so many compressed bytes.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
# fixed values of the Zstandard seekable format: its skippable frame, and the end of its seek table
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:tidemark:page:"
BUNDLE_SCHEMA = "bundle_id string, n_records long, data binary, index array<struct<record_id:string,frame:int,offset:long,length:long>>"


def record_id(page_id) -> str:
    return f"<{URN}{'null' if page_id is None else page_id}>"


def build_record(page_id, url, payload: bytes, digest: str, kind: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = stop + 4
    end = start + int(headers["Content-Length"])
    return headers, data[start:end], end + 4


class BundleWriter:
    def __init__(self, level: int = 3):
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.index: list[dict] = []
        self.open = bytearray()
        self.bytes = 0

    def add(self, name: str, record: bytes) -> None:
        self.index.append({"record_id": name, "frame": len(self.frames), "offset": len(self.open), "length": len(record)})
        self.open += record
        if len(self.open) >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            self.frames.append(self.pack(bytes(self.open)))
            self.sizes.append(len(self.open))
            self.bytes += len(self.frames[-1])
            self.open = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """Offset, compressed and decompressed size of each frame, read from the end of a bundle."""
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at, out, base = 0, [], len(data) - 9 - count * entry
    for i in range(count):
        packed, plain = struct.unpack_from("<II", data, base + i * entry)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(data: bytes, frame: tuple[int, int, int]) -> bytes:
    at, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=plain)


def _writer(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter()

        def done() -> pa.RecordBatch:
            data = writer.finish()
            row = {"bundle_id": hashlib.sha256(data).hexdigest()[:32], "n_records": len(writer.index), "data": data, "index": writer.index}
            kind = pa.list_(pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            return pa.RecordBatch.from_pylist([row], pa.schema([("bundle_id", pa.string()), ("n_records", pa.int64()), ("data", pa.binary()), ("index", kind)]))

        for batch in batches:
            for page_id, url, html, digest, kind, refers_to in zip(*(batch.column(i) for i in range(6)), strict=True):
                page = page_id.as_py()
                record = build_record(page, url.as_py(), html.as_py().encode(), digest.as_py(), kind.as_py(), refers_to.as_py(), date)
                writer.add(record_id(page), record)
                if writer.bytes >= BUNDLE_BYTES:
                    yield done()
                    writer = BundleWriter()
        if writer.index:
            yield done()

    return run


def _page_of(urn: str) -> int | None:
    value = urn.removeprefix(f"<{URN}").removesuffix(">")
    return None if value == "null" else int(value)


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * with_payload
        for batch in batches:
            for cell in batch.column("data"):
                data = cell.as_py()
                for frame in seek_table(data):
                    plain, at, rows = read_frame(data, frame), 0, []
                    while at < len(plain):
                        headers, block, at = parse_record(plain, at)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = headers["WARC-Type"]
                        if kind == "response":
                            size, digest, other = len(payload), hashlib.sha256(payload).hexdigest(), None
                            if headers["WARC-Payload-Digest"] != f"sha256:{digest}":
                                raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                        else:
                            size = int(http.rpartition(b"Content-Length: ")[2])
                            digest, other = headers["WARC-Payload-Digest"].removeprefix("sha256:"), _page_of(headers["WARC-Refers-To"])
                        row = (_page_of(headers["WARC-Record-ID"]), size, digest, kind, other)
                        rows.append((*row, payload.decode()) if with_payload else row)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def write_bundles(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``pages`` (page_id, url, html) as a table of bundles in the shared folder.

    Null html counts as empty. Of equal payloads of at least 100 bytes the record with the smallest page_id is a
    response and the others revisit it; all other records are responses. Rows that repeat the responding page_id with
    its payload are responses too; a row without page_id only revisits. Other columns are not read.
    """
    bounded_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    keys = staged(rows.select("page_id", "digest", F.octet_length("html").alias("n")).where(F.col("n") >= REVISIT_BYTES), "payloads")
    first = staged(keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1"), "first")
    revisits = staged(
        hot_join(keys, first, "digest", "copies")  # a third of all pages may be copies of one
        .where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "refers_to")
        .distinct(),
        "revisits",
    )
    is_revisit = F.col("refers_to").isNotNull()
    records = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select(
        "page_id", "url", "html", "digest", F.when(is_revisit, "revisit").otherwise("response").alias("kind"), "refers_to"
    )
    return staged(records.mapInArrow(_writer(date), BUNDLE_SCHEMA), "bundles")


def read_bundles(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of a table of bundles: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A response's digest is computed anew from its payload and checked against its header. ``payload`` (of responses;
    empty for revisits) is added if asked for.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload string" * with_payload
    return bundles.select("data").mapInArrow(_reader(with_payload), schema)


def fetch_record(data: bytes, index: list[dict], name: str) -> tuple[dict[str, str], bytes]:
    """One record of a bundle, decompressing only its frame."""
    at = next(i for i in index if i["record_id"] == name)
    headers, block, _ = parse_record(read_frame(data, seek_table(data)[at["frame"]]), at["offset"])
    return headers, block


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """The pages written as bundles and read back; see :func:`write_bundles` and :func:`read_bundles`. No pages, no rows."""
    return read_bundles(write_bundles(pages))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
