"""Queries over whole tables, against brute force."""

import hashlib
import time

import numpy as np
from pyspark.sql import functions as F

from rulelake.operators import selection as S
from rulelake.operators import ledger_verify as LV
from rulelake.operators import plans as PL
from rulelake.plans import document_queries, selection_queries
from rulelake.streaming import ledger_stream


def test_suggestions_by_packs_keep_ties_and_links_without_a_target(spark):
    rng = np.random.default_rng(3)
    vector = lambda: rng.integers(-2, 3, 4).astype(float).tolist()
    links = [(i, "x" if i % 4 else "y", vector(), None) for i in range(40)] + [(50, "none", vector(), None), (51, None, vector(), None), (52, "x", None, None), (53, "x", vector()[:3], None), (54, "x", vector(), "there")]
    targets = [("x" if i % 3 else "y", f"d{i}", vector()) for i in range(60)] + [("x", "e", None), ("other", "f", vector()), (None, "g", vector())]

    def cosine(a, b):
        if a is None or b is None or len(a) != len(b):
            return 0.0
        size = np.sqrt(sum(v * v for v in a)) * np.sqrt(sum(v * v for v in b))
        return float(sum(v * w for v, w in zip(a, b, strict=True)) / size) if size else 0.0

    one = spark.createDataFrame(links, "id long, block string, embedding array<double>, resolved string")
    two = spark.createDataFrame(targets, "block string, path string, embedding array<double>")
    for k in (1, 3):
        want = [(54, "there", 1.0, 1)]
        for key, block, a, resolved in links:
            ranked = sorted((-cosine(a, b), path) for at, path, b in targets if block is not None and at == block)[:k]
            want += [(key, p, -s, n + 1) for n, (s, p) in enumerate(ranked)] or [(key, None, None, 1)] if resolved is None else []
        for pack in (5, 2048):
            assert sorted(map(tuple, S.suggestions(one, two, "id", k, pack).collect()), key=repr) == sorted(want, key=repr)


def test_terms_with_other_letters_and_texts_with_code(spark, tmp_path):
    spark.createDataFrame([(1, "Ciónñ x ci n. `ci n` [[ci n]]\n```\nci n\n```\nstteä"), (2, "stte")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "ciónñ"), (8, "stteä"), (9, "éç")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in document_queries.term_mentions(spark, str(tmp_path)).select("doc_id", "target", "term", "mentions").collect()}
    assert got == {(1, 7, "ci n", 2), (1, 8, "stte", 1), (2, 8, "stte", 1)}


def test_token_hashes_cover_all_letters(spark, tmp_path):
    rows = {1: ("caf\u00e9\u00a0x_1\u2014\u4e2d\u6587", ["caf\u00e9", "x_1", "\u2014", "\u4e2d\u6587"]), 2: ("caf", ["caf"]), 3: ("\u0915\u093f \u00b2\u3000!", ["\u0915\u093f", "\u00b2", "!"]), 4: ("\U0001f389a", ["\U0001f389", "a"])}
    spark.createDataFrame([(k, t) for k, (t, _) in rows.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.token_sha256 for r in document_queries.chunk_token_hashes(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256("\n".join(words).encode()).hexdigest() for k, (_, words) in rows.items()}


def test_selections_of_documents_have_no_cap(spark, tmp_path):
    spark.range(100_050).selectExpr("id AS doc_id", "'src1' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    assert selection_queries.select_doc_files(spark, str(tmp_path)).count() == 100_050


def test_selections_of_links_have_no_cap(spark, tmp_path):
    spark.range(1, 112_560).selectExpr("id AS event_id", "1L AS user_id", "'click' AS event_type", "60.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert selection_queries.select_unresolved_links(spark, str(tmp_path)).count() == 112_559 - 112_559 // 9


def test_answers_of_plans_are_told_apart_within_the_row(spark):
    texts = [(1, "### 1. A\nanswer:\nx\n---\ny\n### 2. B\nAnswer: here\n### 2. C\nno\n## 3. D\nz\n### 99. E\nq"), (2, None), (3, "### 4. F\r\n\r\nAnswer\r\n<!-- c -->\r\n a b \r\n### 5. G\nanswer:  \n  \n"), (4, "### 1. A\nx"), (4, "### 1. A\ny\n### 6. H\nz")]
    out = PL.answers(spark.createDataFrame(texts, "plan long, text string"))
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    got = {(r["plan"], r.prompt_id): (r.answer, r.problem) for r in rows if r.problem != "missing"}
    assert len(rows) == 5 * len(PL.PROMPTS)
    p = PL.PROMPTS
    assert got == {(1, p[0]): ("x", None), (1, p[1]): (None, "duplicate"), (3, p[3]): ("a b", None), (3, p[4]): (None, "empty"), (4, p[0]): (None, "duplicate"), (4, p[5]): ("z", None)}


def test_risks_of_many_plans(spark):
    """Long plans, whose answers are each read once."""
    text = "".join(f"### {n}. T\nanswer:\n" + "line of words\n" * 150 + "grade 2 governance\n" for n in range(1, 13))
    plans = spark.range(400).selectExpr("id AS plan").withColumn("text", F.lit(text)).repartition(8, "plan")
    began = time.time()
    got = {(r.erasure_grade, r.risk_label, r.invariants, r["count"]) for r in PL.derived_risks(PL.answers(plans)).groupBy("erasure_grade", "risk_label", "invariants").count().collect()}
    assert got == {(2, "mutation_non_destructive", "governance", 400)} and time.time() - began < 60


def test_lifecycles_over_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    kinds = ["declared", "checked", "executed", "odd", None]
    steps = [(int(rng.integers(0, 60)), n, kinds[min(4, int(rng.integers(0, 9)) // 2)]) for n in range(600)]
    kind = "cost_id long, seq long, kind string"
    for part in (steps[:350], steps[350:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ledger_stream.keep_lifecycles(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    reached, want = {}, set()
    for cost, seq, name in steps:
        was, rank = reached.get(cost, 0), kinds.index(name) + 1 if name in kinds[:3] else 0
        fits = rank == was + 1 or rank == was == 2
        reached[cost] = rank if fits else was
        want.add((cost, seq, name, (["none"] + kinds)[reached[cost]], fits))
    out = spark.read.parquet(f"{tmp_path}/out")
    assert {tuple(r) for r in out.select("cost_id", "seq", "kind", "state", "accepted").collect()} == want and out.count() == len(steps)
    assert {r.batch for r in out.select("batch").distinct().collect()} == {0, 1}


def test_events_and_artifacts_are_not_sent_through_the_driver(spark):
    lines = spark.createDataFrame([(1, '{"event_id":"a","event_type":"cost.declared"}')], "line long, raw string")
    artifacts = spark.createDataFrame([], "kind string, sha256 string, actual_sha256 string, bytes long, content string")
    events = LV.kept_events(lines)
    for found in (LV.cross_issues(events), LV.artifact_issues(events, artifacts)):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.issue for r in LV.line_issues(events).collect()} == {"unreadable_event"}
