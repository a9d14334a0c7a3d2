"""Token ids as length-delimited binary records with an offset index.

A file starts with a magic string and the width of an id, 2 bytes where the vocabulary allows it and else 4. A record
frames one document's ids (little-endian unsigned numbers of that width):

    length (8 bytes) | masked CRC-32 of the length (4) | ids | masked CRC-32 of the ids (4)

The mask rotates a checksum and adds a constant, so that a checksum of data that holds checksums stays meaningful. Beside
each data file stands an index of fixed-size entries (document id, byte offset, number of ids), through which single
records are read in any order.

Documents are put in the order of their ids by range partitioning of the raw rows, into more partitions the larger the
table; each partition writes files of bounded size under temporary names and renames them when whole. The manifest (one
row per file) gives the running start of each file, and files are read back independently, in file order or, with a
seed, in an order shuffled by the index.

Tokens come from the tokenizers library through ``PieceEncoder``, which gives the ids of whole texts.

Results for odd input: null and empty texts have the end id alone; a null id comes first; rows that repeat an id are
ordered by text; an empty table gives no files; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from .common import bounded_batches, checkpointed, committed_file, opened, staging_path
from .piece_encoder import PieceEncoder

END_ID = 0
FILE_BYTES = 512 << 20
#: Bytes of a table, as its files have them, for each partition at least; and characters of a text that part equal ids.
PART_BYTES, PREFIX = 256 << 20, 48
MAGIC, HEAD_BYTES = b"TOKREC1\0", 12

#: An index entry: document id, byte offset, number of ids.
ENTRY, ENTRY_BYTES = "<qQQ", 24
NULL_ID = -(1 << 63)


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(ids: bytes) -> bytes:
    """A record around serialized ids."""
    head = struct.pack("<Q", len(ids))
    return b"".join((head, struct.pack("<I", masked_crc(head)), ids, struct.pack("<I", masked_crc(ids))))


def unframe(stream, offset: int | None = None) -> bytes | None:
    """The next record's ids (or those at an offset), checked; None at the end of the file."""
    if offset is not None:
        stream.seek(offset)
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("damaged record length")
    size = struct.unpack("<Q", head[:8])[0]
    rest = stream.read(size + 4)
    ids = rest[:size]
    if len(rest) < size + 4 or struct.unpack("<I", rest[size:])[0] != masked_crc(ids):
        raise ValueError("damaged record")
    return ids


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write documents in id order, and return the manifest (file, part, roll, records, ids) as a checkpointed frame.

    ``tokenizer`` is a path on every executor.
    """
    path = tokenizer or default_tokenizer()

    def encoded(batches) -> Iterator[tuple[int | None, bytes]]:
        coder = encoder(path)
        end = np.array([end_id], f"<u{coder.width}").tobytes()
        for batch in batches:
            for k, ids in enumerate(coder.encode(batch.column(1))):
                yield batch.column(0)[k].as_py(), ids.tobytes() + end

    def write(batches):
        from pyspark import TaskContext

        part, roll, width = TaskContext.get().partitionId(), 0, encoder(path).width
        rows = encoded(batches)
        row = next(rows, None)
        while row is not None:
            uri, offset, ids, count = f"{folder}/{part:08d}-{roll:05d}-{uuid.uuid4().hex}", HEAD_BYTES, 0, 0
            with committed_file(f"{uri}.idx") as entries, committed_file(f"{uri}.rec") as out:
                out.write(MAGIC + struct.pack("<I", width))
                while row is not None and offset < file_bytes:
                    n = len(row[1]) // width
                    entries.write(struct.pack(ENTRY, NULL_ID if row[0] is None else row[0], offset, n))
                    record = frame(row[1])
                    out.write(record)
                    offset, ids, count = offset + len(record), ids + n, count + 1
                    row = next(rows, None)
            yield pa.RecordBatch.from_pylist([{"file": uri, "part": part, "roll": roll, "records": count, "ids": ids}])
            roll += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # Spark's estimate, from the files
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known // PART_BYTES) if known < 1 << 60 else 1)
    # the beginnings of texts part the rows of a very frequent id, in the order of the sort
    bounds = [F.col("id").asc_nulls_first(), F.substring("text", 1, PREFIX).asc_nulls_first()]
    ordered = rows.repartitionByRange(parts, *bounds).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    with bounded_batches(docs.sparkSession):
        return checkpointed(ordered.mapInArrow(write, "file string, part long, roll long, records long, ids long"))


def index_entries(uri: str, start: int) -> np.ndarray:
    """The entries of a file's index: (id, offset, ids, start), where start counts the ids before each."""
    with opened(f"{uri}.idx") as stream:
        raw = stream.read()
    if len(raw) % ENTRY_BYTES:
        raise ValueError(f"the index of {uri} ends early")
    entries = np.empty(len(raw) // ENTRY_BYTES, [("id", "<i8"), ("offset", "<u8"), ("n", "<u8"), ("start", "<i8")])
    held = np.frombuffer(raw, [("id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
    for name in held.dtype.names:
        entries[name] = held[name]
    entries["start"] = start + np.cumsum(held["n"].astype(np.int64)) - held["n"].astype(np.int64)
    return entries


def read_token_files(manifest: DataFrame, id_col: str = "doc_id", with_ids: bool = True, shuffle_seed: int | None = None) -> DataFrame:
    """Documents from the files, through their indexes: (id, start, n_tokens, ids_crc32), and the ids as 32-bit numbers.

    With a seed the records of a file are read in a shuffled order that only the seed and the file's place decide; an
    index takes 24 bytes a record.
    """
    ahead = F.coalesce(F.sum("ids").over(W.orderBy("part", "roll").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("file", ahead.cast("long").alias("start"))  # one row per file
    names = ["id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]

    def read(batches):
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size, entries = [], 0, index_entries(uri, start)
                if shuffle_seed is not None:
                    entries = np.random.default_rng([shuffle_seed, start]).permutation(entries)
                with opened(f"{uri}.rec") as stream:
                    head = stream.read(HEAD_BYTES)
                    if head[: len(MAGIC)] != MAGIC:
                        raise ValueError(f"{uri} is not a token file")
                    width, expected = struct.unpack("<I", head[len(MAGIC) :])[0], HEAD_BYTES
                    for entry in entries:
                        key, offset, n, start = map(int, entry)
                        ids = unframe(stream, offset if offset != expected else None)
                        if ids is None or len(ids) != width * n:
                            raise ValueError(f"the index of {uri} differs from its records")
                        expected = offset + len(ids) + 16
                        ids = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
                        row = (None if key == NULL_ID else key, start, n, zlib.crc32(ids))
                        held.append((*row, ids) if with_ids else row)
                        size += len(ids) if with_ids else 64
                        if size >= 4 << 20:
                            yield _batch(held, names, types)
                            held, size = [], 0
                if held:
                    yield _batch(held, names, types)

    spread = max(1, min(manifest.count(), 100_000))
    schema = "id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return files.repartition(spread).mapInArrow(read, schema).withColumnRenamed("id", id_col)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)], names)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), staging_path(spark, "tokens"))
    return read_token_files(manifest, with_ids=False, shuffle_seed=6)
