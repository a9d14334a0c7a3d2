import math
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from rulelake.llm import toxicity as tx
from rulelake.llm.labelled import training_sample


def test_folding():
    assert tx.fold_text("  1d10T!\n") == " idiot "
    assert tx.fold_text("ｓtupіd Ｍоron") == " stupid moron "
    assert tx.fold_text("") == "  " == tx.fold_text("!?")


def test_exceptions_and_whole_words():
    model = tx.ToxicityModel()
    machine = model.automaton()
    score = lambda t: model.evidence(tx.fold_text(t), machine)
    assert score("such an idiot") == 3.0 and score("idiotic") == 0.0
    assert score("a pathetic fallacy") == 0.0 and score("a pathetic fallacy, pathetic") == 3.0
    assert score("idiot idiot scum") == 6.0


def test_learned_terms_beginnings_and_exceptions():
    toxic = [(f"filler word{k} zorgl{k % 7}an here", 1) for k in range(60)]
    clean = [(f"filler word{k} calm zorglub here", 0) for k in range(60)] + [(f"other text {k}", 0) for k in range(60)]
    model = tx.learn(toxic + clean)
    machine = model.automaton()
    assert model.score("well zorgl3an said", machine) > 0.5 > model.score("a calm text", machine)
    assert "calm zorglub" in model.exceptions or model.score("calm zorglub", machine) < 0.5
    assert tx.learn([("a", 0)]).terms == tx.ToxicityModel().terms


def test_odd_rows(spark):
    rows = [(1, "you idiot"), (1, "you idiot"), (2, None), (3, ""), (None, "scum of the earth idiot"), (4, "x " * 50_000 + "moron")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, toxicity int")
    out = tx.score_toxicity(df, tx.ToxicityModel())
    got = [(r.doc_id, r.toxicity) for r in out.collect()]
    assert len(got) == 6 and all(0 <= s <= 1 for _, s in got) and got[0] == got[1] and got[2][1] == got[3][1]
    assert tx.score_toxicity(df.limit(0), tx.ToxicityModel()).collect() == []


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 2).cast("int").alias("toxic"))
    sample = training_sample(docs, labels, "toxic", rows_per_class=50)
    assert sorted(y for _, y in sample) == [0] * 50 + [1] * 50
    assert all(zlib.crc32(text[1:].encode()) % 5 for text, _ in sample)
    assert sample == training_sample(docs, labels, "toxic", rows_per_class=50)
    again = docs.unionByName(docs.where("doc_id in (7, 8)").crossJoin(spark.range(500).select(F.lit(1).alias("n"))).drop("n"))
    assert sample == training_sample(again, labels, "toxic", rows_per_class=50)
    assert training_sample(docs, labels.limit(0), "toxic") == []


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = tx.op7_lexicon_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    got = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert got[1, 1] >= 0.9 * (got[1, 1] + got.get((1, 0), 0)) and got.get((0, 1), 0) <= 0.01 * got[0, 0]


def naive(model, text):
    """Evidence of a text by trying every term at every word and every exception at every place."""
    folded = tx.fold_text(text)
    words, at, place = folded.split(), [], 0
    for word in words:
        place = folded.index(word, place)
        at.append(place)
        place += len(word)
    covered = set()
    for phrase in {tx.fold_text(p) for p in model.exceptions}:
        place = folded.find(phrase)
        while place >= 0:
            covered.update(range(place + 1, place + len(phrase)))
            place = folded.find(phrase, place + 1)
    best = {}
    for word, start in zip(words, at, strict=True):
        weights = [w for t, w in model.terms.items() if (t == word + " " if t.endswith(" ") else word.startswith(t) and word != t)]
        if weights and start not in covered:
            best[word] = max(max(weights), best.get(word, 0.0))
    return sum(best.values())


def test_evidence_against_a_naive_matcher():
    rng = random.Random(4)
    terms = {"idiot ": 3.0, "idio": 1.0, "scum ": 2.5, "trash ": 1.5, "tra": 0.75, "can ": 0.5, "o ": 0.25}
    model = tx.ToxicityModel(terms, ("trash can", "can trash can", "idiot o", "can", "scum of"))
    machine = model.automaton()
    for _ in range(400):
        text = " ".join(rng.choice(["idiot", "idiots", "1d10t", "trash", "can", "o", "scum", "of", "trance", "x", "tra", "canny"]) for _ in range(rng.randrange(14)))
        assert model.evidence(tx.fold_text(text), machine) == pytest.approx(naive(model, text))


def test_query_against_a_naive_matcher(spark):
    """Every score of the query is the curve of what the naive matcher finds with the learned model."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = tx.toxicity_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    out = tx.op7_lexicon_toxicity(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        found, words = naive(model, texts[r.doc_id]), max(1, len(tx.fold_text(texts[r.doc_id]).split()))
        z = model.curve[0] * math.log1p(found) + model.curve[1] * math.log1p(100 * found / words) + model.curve[2]
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == (r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_very_long_texts_take_time_in_proportion():
    model = tx.ToxicityModel()
    machine = model.automaton()
    text = "you idiot trash can " * 1_000_000  # 20 MB, a million exceptions
    began = time.perf_counter()
    assert model.evidence(tx.fold_text(text), machine) == 3.0
    assert time.perf_counter() - began < 30
