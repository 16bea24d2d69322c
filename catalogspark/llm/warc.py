"""WARC records in seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames that each hold whole WARC records, a skippable
frame with the bundle's record index (record id -> frame, offset in the frame, length), and at the
end the seek table of the public seekable format (compressed and decompressed size of each frame).
Any frame can be opened alone, and any Zstandard tool reads the whole file.

Bundles go out through Spark's own file writer (one row and one file per bundle), so that a lost
executor's attempt leaves nothing behind, and any store that Spark can write to will do. They are
read back with the `binaryFile` source.

Defined results: a null payload is an empty one; a null url has no WARC-Target-URI; a null id comes
back null and is never a response that others refer to; rows that repeat an id are each a response if
that id is the smallest of its payload; extra columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 8 << 20, 3
# Fixed values of the public formats.
_SEEK_SKIPPABLE = 0x184D2A5E
_INDEX_SKIPPABLE = 0x184D2A50
_SEEK_MAGIC = b"\xb1\xea\x92\x8f"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:{}>"
RECORD = (
    "record_id string, page_id long, url string, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, payload binary"
)


def plan_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 100
) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): of equal payloads of `least` bytes or more the
    smallest id is the response; `refers_to` is set on the others."""
    body = F.coalesce(F.encode(F.col(body_col).cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "first")
    )
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.expr("if(first is distinct from page_id, first, null)").alias("refers_to")
    )


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_ID.format('' if page_id is None else page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_ID.format(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Bundle:
    def __init__(self, frame_bytes: int, level: int):
        self.pack = zstandard.ZstdCompressor(level=level)
        self.frame_bytes = frame_bytes
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.index: list[list] = []
        self.open: list[bytes] = []
        self.open_bytes = self.bytes = 0

    def add(self, record_id: str, record: bytes) -> None:
        self.index.append([record_id, len(self.frames), self.open_bytes, len(record)])
        self.open.append(record)
        self.open_bytes += len(record)
        if self.open_bytes >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            frame = self.pack.compress(b"".join(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.open_bytes))
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        index = self.pack.compress(json.dumps(self.index, separators=(",", ":")).encode())
        skippable = struct.pack("<II", _INDEX_SKIPPABLE, len(index)) + index
        sizes = [*self.sizes, (len(skippable), 0)]
        table = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IB", len(sizes), 0) + _SEEK_MAGIC
        return b"".join([*self.frames, skippable, struct.pack("<II", _SEEK_SKIPPABLE, len(table)), table])


def write_bundles(
    records: DataFrame,
    path: str,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    level: int = LEVEL,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write the rows of plan_records() as bundles of about `bundle_bytes` under `path`."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Bundle(frame_bytes, level)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                out.add(_ID.format("" if row[0] is None else row[0]), record_bytes(*row, date))
                if out.bytes >= bundle_bytes:
                    yield pa.RecordBatch.from_pydict({"bundle": [out.finish()[:-4]]})
                    out = _Bundle(frame_bytes, level)
        if out.index:
            yield pa.RecordBatch.from_pydict({"bundle": [out.finish()[:-4]]})

    # The text writer ends each row with lineSep: here the seek table's magic number, the file's last bytes.
    (
        records.mapInArrow(bundles, "bundle binary")
        .select(F.col("bundle").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", _SEEK_MAGIC.decode("latin-1"))
        .text(path)
    )


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the bundle's last bytes."""
    if bundle[-4:] != _SEEK_MAGIC:
        raise ValueError("no seek table")
    count = struct.unpack_from("<I", bundle, len(bundle) - 9)[0]
    at = len(bundle) - 9 - 8 * count
    out, offset = [], 0
    for k in range(count):
        packed, size = struct.unpack_from("<II", bundle, at + 8 * k)
        out.append((offset, packed, size))
        offset += packed
    return out


def record_index(bundle: bytes) -> list[list]:
    """[record id, frame, offset in the frame, length] of each record, without opening a data frame."""
    offset, packed, _ = seek_table(bundle)[-1]
    if struct.unpack_from("<I", bundle, offset)[0] != _INDEX_SKIPPABLE:
        raise ValueError("no record index")
    return json.loads(zstandard.ZstdDecompressor().decompress(bundle[offset + 8 : offset + packed]))


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers, by lower-case name, and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def _number(urn: str | None) -> int | None:
    m = re.search(r"urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _row(record: bytes, keep_payload: bool) -> tuple:
    fields, block = parse_record(record)
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    size = int(re.search(rb"(?m)^Content-Length: (\d+)", http)[1])
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    own = fields["warc-record-id"]
    return (
        own,
        _number(own),
        fields.get("warc-target-uri"),
        kind,
        size,
        digest,
        _number(fields.get("warc-refers-to")),
        payload if keep_payload and kind == "response" else None,
    )


_ARROW = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _bundles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_bundles(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """Every record of every bundle; digests of responses are checked against their payloads."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for content in batch.column("content"):
                bundle = content.as_py()
                frames: dict[int, list] = {}
                for _, frame, offset, length in record_index(bundle):
                    frames.setdefault(frame, []).append((offset, length))
                table = seek_table(bundle)
                for frame, parts in frames.items():
                    at, packed, _ = table[frame]
                    data = unpack.decompress(bundle[at : at + packed])
                    found = [_row(data[a : a + n], keep_payload) for a, n in parts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*found), _ARROW)], schema=_ARROW
                    )

    return _bundles(spark, path).mapInArrow(rows, RECORD)


def index_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, bundle, frame, frame_offset, frame_bytes, offset, length) of every record."""
    names = ["record_id", "bundle", "frame", "frame_offset", "frame_bytes", "offset", "length"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                bundle = content.as_py()
                table = seek_table(bundle)
                found = [[i, name, f, *table[f][:2], o, n] for i, f, o, n in record_index(bundle)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names)

    return _bundles(spark, path).mapInArrow(
        rows,
        "record_id string, bundle string, frame long, frame_offset long, frame_bytes long, offset long, length long",
    )


def fetch_records(spark: SparkSession, path: str, record_ids: DataFrame) -> DataFrame:
    """The records whose ids stand in `record_ids` (column record_id), opening only their frames."""
    wanted = (
        index_bundles(spark, path)
        .join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
        .groupBy("bundle", "frame_offset", "frame_bytes")
        .agg(F.collect_list(F.struct("offset", "length")).alias("parts"))
    )
    joined = wanted.join(_bundles(spark, path), F.col("bundle") == F.col("path")).select(
        F.expr("substring(content, int(frame_offset) + 1, int(frame_bytes))").alias("frame"), "parts"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for frame, parts in zip(batch.column("frame").to_pylist(), batch.column("parts").to_pylist()):
                data = unpack.decompress(frame)
                found = [_row(data[p["offset"] : p["offset"] + p["length"]], True) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*found), _ARROW)], schema=_ARROW
                )

    return joined.mapInArrow(rows, RECORD)
