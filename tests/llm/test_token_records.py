import io
import struct
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rulelake.llm import token_records as tr
from rulelake.llm.common import opened, staging_path

CODER = tr.PieceEncoder(tr.default_tokenizer(), capacity=300)
ALPHABET = " \n\t\r\x0b\x1c\x85\xa0 　abZéñß'.,!—-12²Ⅷжя中ﬁ́𝔘🎉<|endoftext|>_"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=30), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(texts):
    got = CODER.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == [CODER.whole_text(t).tolist() for t in texts]


def test_pieces_on_documents(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for coder in (CODER, tr.PieceEncoder(tr.default_tokenizer())):
        assert all(a.tolist() == coder.whole_text(t).tolist() for a, t in zip(coder.encode(pa.array(texts)), texts, strict=True))


def test_frames_notice_damage():
    data = tr.frame(b"abcd") + tr.frame(b"")
    stream = io.BytesIO(data)
    assert tr.unframe(stream) == b"abcd" and tr.unframe(stream) == b"" and tr.unframe(stream) is None
    for k in range(20):
        broken = bytearray(data)
        broken[k] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            tr.unframe(io.BytesIO(bytes(broken)))


def brute(rows):
    start, out = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = CODER.whole_text(text or "").astype("<u4").tobytes() + struct.pack("<I", 0)
        out.append((key, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    return out


def test_odd_rows_small_files_and_shuffled_reads(spark):
    rows = [(5, "b text"), (None, "no id"), (2, None), (2, ""), (9, "long " * 3000), (5, "a text"), (5, "a text"), (-3, "é")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, id int")
    manifest = tr.write_token_files(df, staging_path(spark, "tokens"), file_bytes=60)
    back = tr.read_token_files(manifest).collect()
    assert sorted((tuple(r)[:4] for r in back), key=lambda r: r[1]) == brute(rows)
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in back)
    file = manifest.orderBy("records", ascending=False).first().file
    with opened(f"{file}.idx") as index, opened(f"{file}.rec") as stream:
        entries = [struct.unpack(tr.ENTRY, e) for e in iter(lambda: index.read(tr.ENTRY_BYTES), b"")]
        assert [len(tr.unframe(stream, offset)) // 2 for _, offset, _ in reversed(entries)] == [n for _, _, n in reversed(entries)]
    for seed in (1, 2):
        again = tr.read_token_files(manifest, shuffle_seed=seed).collect()
        assert sorted(map(tuple, again), key=lambda r: r[1]) == sorted(map(tuple, back), key=lambda r: r[1])
    one = tr.write_token_files(df, staging_path(spark, "tokens")).repartition(1)
    orders = [[r.start for r in tr.read_token_files(one, shuffle_seed=seed).collect()] for seed in (None, 1, 1)]
    assert orders[0] != orders[1] == orders[2] and sorted(orders[0]) == sorted(orders[1])
    empty = tr.write_token_files(df.limit(0), staging_path(spark, "tokens"))
    assert tr.read_token_files(empty).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in tr.op6_token_records(spark, sf).collect()) == sorted(brute(rows))


def test_other_tokenizers_get_whole_texts():
    """A file with another pre-tokenizer, or with a normalizer, gives the ids of the library too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain, coder = Tokenizer.from_file(path), tr.PieceEncoder(path)
    assert not coder.by_pieces and CODER.by_pieces
    texts = ["Some Words, of a text's 1st line", "", None, "a  b\n<|endoftext|>"]
    assert [x.tolist() for x in coder.encode(pa.array(texts))] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_rows_of_one_id_are_dealt_by_their_texts(spark, monkeypatch):
    """A third of all rows with one id: they are spread, and the order is that of (id, text)."""
    rows = [(7 if k % 3 == 0 else k, f"{k * 7919 % 1000:03d} text") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = tr.write_token_files(df, staging_path(spark, "tokens"))
    assert sorted((tuple(r)[:4] for r in tr.read_token_files(manifest).collect()), key=lambda r: r[1]) == brute(rows)
    sizes = [r.records for r in manifest.collect()]
    assert max(sizes) < 200
