import gzip
import hashlib
import io

import pytest
from oracle import difference
from pyspark.sql import functions as F

from rulelake.llm import warc
from rulelake.llm.common import staging_path

LONG = "x" * 150


def run(spark, rows, chunk):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    manifest = warc.write_archives(warc.chunked(warc.with_revisits(df), chunk), staging_path(spark, "warc-test"), archive_bytes=200)
    return manifest, warc.read_archives(manifest, chunk)


def test_edge_cases(spark):
    rows = [
        (5, "http://a", LONG, "clash"), (2, None, LONG, "clash"), (9, "http://c", LONG, None), (None, "u", LONG, None), (7, "u\r\nX: y", "short", ""), (8, "u", "short", ""),
        (1, "u", None, None), (3, "u", "", None), (4, "u", "é" * 1000, None), (6, "u", "z" * 200, None), (6, "u", "z" * 200, None),
    ]
    manifest, chunks = run(spark, rows, 64)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    last = {}
    for r in chunks.where("last").collect():
        last.setdefault(r.page_id, []).append((r.record_type, r.refers_to, r.payload_bytes, r.digest_so_far))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for key in (5, 9, None):
        assert last[key] == [("revisit", 2, 150, digest(LONG))]
    assert last[2] == [("response", None, 150, digest(LONG))]
    assert last[7][0][:2] == last[8][0][:2] == ("response", None)
    assert last[1] == last[3] == [("response", None, 0, digest(""))]
    assert last[4] == [("response", None, 2000, digest("é" * 1000))]
    assert last[6] == [("response", None, 200, digest("z" * 200))] * 2
    parts = sorted((r.chunk_no, bytes(r.data), r.digest_so_far) for r in chunks.where("page_id = 4").collect())
    assert b"".join(p[1] for p in parts).decode() == "é" * 1000 and max(len(p[1]) for p in parts) == 64
    assert parts[0][2] == hashlib.sha256(parts[0][1]).hexdigest()


def test_empty_table(spark):
    manifest, chunks = run(spark, [], 64)
    assert manifest.count() == 0 and chunks.count() == 0


def test_damage_is_noticed():
    row = {"record_id": "urn:a", "page_id": 1, "url": "", "record_type": "response", "refers_to": None, "payload_bytes": 3, "payload_digest": hashlib.sha256(b"abc").hexdigest()}
    whole = warc.record_head(row) + b"abc\r\n\r\n"
    assert [r["data"] for r in warc.read_records(io.BytesIO(gzip.compress(whole)))] == [b"abc"]
    with pytest.raises(ValueError, match="differs"):
        list(warc.read_records(io.BytesIO(gzip.compress(whole.replace(b"\r\n\r\nabc", b"\r\n\r\nabd")))))
    with pytest.raises(ValueError, match="early"):
        list(warc.read_records(io.BytesIO(gzip.compress(whole[:-6]))))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(warc.op4_chunked_warc(spark, sf), warc.OP4_SQL, sf) == ""
