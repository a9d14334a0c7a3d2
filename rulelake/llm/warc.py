"""WARC archives as a chunked record table.

A payload is a run of rows (record, chunk number, bytes), each of at most ``CHUNK`` bytes. The writer streams those rows
into gzip members of an archive, and the reader streams an archive back into such rows; each carries the SHA-256 of the
payload up to its end, so a record is checked and digested without ever being held as a whole in Python.

Records of equal payloads of at least ``REVISIT_BYTES`` bytes are stored once: the one with the smallest id is a
response, the others are revisits that name it and carry its digest. Equal payloads are found by digest with map-side
aggregation, and only digests that occur more than once come back to the pages; up to a counted bound of them are
broadcast, so that no payload is shuffled.

Archives are written into the cluster's shared folder under temporary names and renamed when whole; the manifest names
exactly the archives of the tasks that counted.

Results for odd input: a null payload is an empty one; a null id never is the record that others refer to, and if all
records of a group have null ids all are responses; of repeated rows with the smallest id each is a response, as neither
can name the other; null URLs become empty; an empty table gives no archives and no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import bounded_batches, checkpointed, committed_file, opened, staging_path

CHUNK = 1 << 18
REVISIT_BYTES = 100
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 1 << 18
BATCH_BYTES = 4 << 20
LEVEL = 3
#: Shared digests of so many payloads at most are broadcast (about 100 bytes each); beyond it the join decides by itself.
BROADCAST_DIGESTS = 200_000

CHUNKS_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, n_chunks int, data binary"
READ_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, last boolean, chunk_bytes long, digest_so_far string"


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of each row."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    shared = checkpointed(shared.where("n > 1").drop("n"))  # apart from the join, so that a digest of very many pages can be split there
    few = shared.count() <= BROADCAST_DIGESTS  # then the payloads stay where they are
    rows = rows.join(F.broadcast(shared) if few else shared, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def chunked(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records as chunk rows, in order and side by side; a revisit or an empty payload is one row without bytes."""
    count = F.when(F.col("record_type") == "revisit", F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk))).cast("int")
    record_id = F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.substring("payload_digest", 1, 16))
    rows = records.withColumn("n_chunks", count).withColumn("record_id", record_id)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
    data = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    return rows.select("record_id", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk_no", "n_chunks", data.alias("data"))


def record_head(row: dict) -> bytes:
    """The header block of a record."""
    size = 0 if row["record_type"] == "revisit" else row["payload_bytes"]
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Target-URI: {''.join(row['url'].split())}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}"]
    if row["page_id"] is not None:
        lines.append(f"X-Page-ID: {row['page_id']}")
    if row["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {row['refers_to']}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode()


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Stream chunk rows into .warc.gz files of ``folder``, and return the manifest (archive, records, bytes)."""

    def write(batches):
        rows = (row for batch in batches for row in _rows(batch))
        row = next(rows, None)
        while row is not None:
            uri, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
            with committed_file(uri) as out:
                while row is not None and (size < archive_bytes or row["chunk_no"]):
                    if row["chunk_no"] == 0:
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        size += out.write(pack.compress(record_head(row))) or 0
                        count += 1
                    size += out.write(pack.compress(row["data"])) or 0
                    if row["chunk_no"] == row["n_chunks"] - 1:
                        size += out.write(pack.compress(b"\r\n\r\n") + pack.flush()) or 0
                    row = next(rows, None)
            yield pa.RecordBatch.from_pylist([{"archive": uri, "records": count, "bytes": size}])

    with bounded_batches(chunks.sparkSession):
        return checkpointed(chunks.mapInArrow(write, "archive string, records long, bytes long"))


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = batch.schema.names
    for values in zip(*batch.columns, strict=True):
        yield {name: memoryview(value.as_buffer()) if name == "data" else value.as_py() for name, value in zip(names, values, strict=True)}


def _inflated(stream, piece: int) -> Iterator[bytes]:
    """The plain bytes of a file of gzip members, in pieces of bounded size; None marks the end of a member."""
    unpack = zlib.decompressobj(31)
    data = stream.read(piece)
    while data:
        plain = unpack.decompress(data, piece)
        data = unpack.unconsumed_tail
        if plain:
            yield plain
        if unpack.eof:
            yield None
            data = unpack.unused_data
            unpack = zlib.decompressobj(31)
        if not data:
            data = stream.read(piece)


def read_records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive, with data; digests are checked at the end of each record."""
    held, head, left, number, digest = bytearray(), None, 0, 0, None
    for plain in _inflated(stream, READ_BYTES):
        if plain is None:
            if head is None or left:
                raise ValueError("a record ends early")
            if digest is not None and digest.hexdigest() != head["payload_digest"]:
                raise ValueError(f"payload of {head['record_id']} differs from its digest")
            held, head = bytearray(), None
            continue
        held += plain
        if head is None:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                continue
            head, left = parse_head(bytes(held[:end]))
            del held[: end + 4]
            number, digest = 0, None if head["record_type"] == "revisit" else hashlib.sha256()
            if not left:
                yield head | {"chunk_no": 0, "last": True, "data": b"", "digest_so_far": digest.hexdigest() if digest else head["payload_digest"]}
        while left and (len(held) >= min(chunk, left)):
            data = bytes(held[: min(chunk, left)])
            del held[: len(data)]
            left -= len(data)
            digest.update(data)
            yield head | {"chunk_no": number, "last": not left, "data": data, "digest_so_far": digest.copy().hexdigest()}
            number += 1


def parse_head(block: bytes) -> tuple[dict, int]:
    """Fields of a record's header block, and the length of its content."""
    first, *lines = block.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    number = lambda name: int(fields[name]) if name in fields else None
    row = {"record_id": fields["WARC-Record-ID"][1:-1], "page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page")}
    row |= {"payload_bytes": number("X-Payload-Length"), "payload_digest": fields["WARC-Payload-Digest"].partition(":")[2]}
    return row, int(fields["Content-Length"])


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk rows of the manifest's archives; ``with_data=False`` gives digests and lengths without the bytes."""
    schema = READ_SCHEMA + (", data binary" if with_data else "")
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[part.split()[1]] for part in schema.split(", ")]

    def read(batches):
        held, size = [], 0
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                with opened(uri) as stream:
                    for row in read_records(stream, chunk):
                        row["chunk_bytes"] = len(row["data"])
                        held.append(row)
                        size += len(row["data"]) if with_data else 300
                        if size >= BATCH_BYTES or len(held) >= 10_000:
                            yield _table(held, names, types)
                            held, size = [], 0
        if held:
            yield _table(held, names, types)

    files = manifest.select("archive")
    spread = max(1, min(files.count(), 100_000))
    return files.repartition(spread).mapInArrow(read, schema)


def _table(rows: list[dict], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row[name] for row in rows], kind) for name, kind in zip(names, types, strict=True)], names)


def op4_chunked_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = with_revisits(table(spark, sf_dir, "pages"))
    manifest = write_archives(chunked(records), staging_path(spark, "warc"))
    whole = read_archives(manifest, with_data=False).where("last")
    return whole.select("page_id", "payload_bytes", F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


OP4_SQL = """
WITH rows AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), digests AS (
  SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM rows
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""
