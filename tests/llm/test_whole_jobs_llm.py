"""Whole jobs of the training-data operators."""

import corpus_pipeline as cp
import pyarrow as pa
from oracle import rows_of

from rulelake.llm import compaction, telephony
from rulelake.llm import token_records as tr

SF = "/root/testdata/sf0.001"


def test_ids_are_those_of_the_unmodified_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tr.default_tokenizer())
    texts = ["a <|endoftext|> b", "a b", "<|endoftext|>", "x<|endoftext|>y z", "<|endof", "text|>", "", "<|endoftext |>"]
    got = tr.PieceEncoder(tr.default_tokenizer()).encode(pa.array(texts))
    assert [x.tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert got[0].tolist() == [64, 220, 50256, 275]


def test_query_stores_resampled_sound(spark, monkeypatch):
    frames = {}
    monkeypatch.setattr(telephony, "staged", lambda df, name, staged=telephony.staged, **options: frames.setdefault(name, staged(df, name, **options)))
    out = telephony.op2_telephony(spark, SF)
    kept = frames["telephony_pcm"].select("doc_id", "pcm").join(out, "doc_id")
    assert "pcm" not in out.columns and out.count() == kept.count()
    for row in kept.limit(9).collect():
        count = sum(len(x) for x in telephony.pcm_segments(bytes(row.pcm)))
        assert telephony.frame_rate(bytes(row.pcm)) == (telephony.TARGET_RATE, 8000) and f"n={count};" in row.feature


def test_tiers_are_merged(spark, monkeypatch):
    docs, taken = spark.read.parquet(f"{SF}/documents.parquet"), []
    monkeypatch.setattr(compaction.ShardStore, "pending", lambda self, m, pending=compaction.ShardStore.pending: taken.append(pending(self, m)) or taken[-1])
    for run in (lambda: compaction.op3_size_tiered(spark, SF), lambda: cp.shard(spark, docs, SF), lambda: cp.shard(spark, docs.where("doc_id % 2 = 0").repartition(9), SF)):
        taken.clear()
        out = run()
        assert any(len(runs) >= compaction.FAN_IN for runs in taken)
        assert out.count() in (docs.count(), docs.where("doc_id % 2 = 0").count())
    assert rows_of(docs.columns, cp.shard(spark, docs, SF).collect()) == rows_of(docs.columns, docs.collect())


def test_rows_that_repeat_an_id_go_by_their_texts(spark):
    one, two, three = (" ".join(f"{w}{k}" for k in range(40)) for w in "abc")
    rows = [(1, one), (5, one), (5, two), (5, two), (7, three), (7, three), (None, one), (None, one), (9, None), (9, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, cp.drop_near_duplicates(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(1, one), (5, two), (7, three), (None, one), (None, one), (9, None), (8, "")], key=repr)
