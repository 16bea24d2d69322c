import hashlib
import io

import zstandard
from pyspark.sql import functions as F

from catalogspark.llm import queries
from catalogspark.llm.common import new_path
from catalogspark.llm.warc import (
    fetch_records,
    index_bundles,
    plan_records,
    read_bundles,
    record_index,
    seek_table,
    write_bundles,
)

LONG = "<p>é" + "x" * 200
ROWS = [
    (5, "http://a/1", LONG, "p"),
    (2, None, LONG, "p"),
    (9, "http://b/\r\nX: y", LONG + "!", None),
    (1, "http://c", None, "q"),
    (3, "http://c", "", "q"),
    (4, "http://d", "short", "q"),
    (6, "http://d", "short", "q"),
    (None, "http://e", LONG, "q"),
    (7, "http://e", "y" * 2_000_000 + "\r\n\r\n", "q"),
]


def write(spark, rows, **sizes):
    path = new_path(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)
    write_bundles(plan_records(df), path, **sizes)
    return path


def test_round_trip(spark):
    path = write(spark, ROWS, frame_bytes=300, bundle_bytes=400)
    back = {(r.page_id, r.url): r for r in read_bundles(spark, path).collect()}
    assert len(back) == len(ROWS)
    for page_id, url, html, _ in ROWS:
        body = (html or "").encode()
        row = back[(page_id, url and url.replace("\r\n", "%0D%0A"))]
        assert row.payload_bytes == len(body)
        assert row.payload_digest == hashlib.sha256(body).hexdigest()
        revisit = html == LONG and page_id != 2
        assert (row.record_type, row.refers_to) == (("revisit", 2) if revisit else ("response", None))
        assert row.payload == (None if revisit else body)


def test_frames_open_alone_and_whole_file_reads(spark):
    path = write(spark, ROWS, frame_bytes=300, bundle_bytes=1 << 20)
    for row in spark.read.format("binaryFile").load(path).collect():
        bundle, parts = bytes(row.content), []
        table = seek_table(bundle)
        for at, packed, size in table[:-1]:
            parts.append(zstandard.ZstdDecompressor().decompress(bundle[at : at + packed]))
            assert len(parts[-1]) == size
        whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bundle), read_across_frames=True).read()
        assert whole == b"".join(parts)
        for record_id, frame, offset, length in record_index(bundle):
            record = parts[frame][offset : offset + length]
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record_id.encode() in record


def test_index_and_fetch(spark):
    path = write(spark, ROWS, frame_bytes=300, bundle_bytes=400)
    assert index_bundles(spark, path).count() == len(ROWS)
    ids = spark.createDataFrame([("<urn:page:7>",), ("<urn:page:5>",), ("<urn:page:77>",)], "record_id string")
    found = {r.page_id: r for r in fetch_records(spark, path, ids).collect()}
    assert set(found) == {5, 7} and len(found[7].payload) == 2_000_004 and found[5].refers_to == 2


def test_empty_table(spark):
    path = write(spark, ROWS[:0])
    assert read_bundles(spark, path).count() == 0


def test_query_against_sql_rules(spark, sf):
    got = {tuple(r) for r in queries.op1_warc(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).alias("h")).collect()
    first: dict[str, int] = {}
    for p in pages:
        if len(p.h.encode()) >= 100:
            first[p.h] = min(p.page_id, first.get(p.h, p.page_id))
    want = set()
    for p in pages:
        to = first.get(p.h, p.page_id)
        other = to != p.page_id
        digest = hashlib.sha256(p.h.encode()).hexdigest()
        want.add((p.page_id, len(p.h.encode()), digest, "revisit" if other else "response", to if other else None))
    assert got == want
