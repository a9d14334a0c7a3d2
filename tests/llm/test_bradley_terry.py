import functools
import os
import subprocess
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from rulelake.llm import bradley_terry as bt
from rulelake.llm.labelled import training_sample


def sample(n=80):
    rng = np.random.default_rng(5)
    words = [f"w{k}ord" for k in range(300)]
    good = [(" ".join(rng.choice(words, 80)) + ".", 1) for _ in range(n)]
    bad = [(" ".join(np.repeat(rng.choice(words, 8), 10)), 0) for _ in range(n // 2)] + [(" ".join(w + "$$$" for w in rng.choice(words, 60)), 0) for _ in range(n // 2)]
    return good + bad


def test_ranking_and_quantile_cut():
    rows = sample()
    model = bt.learn(rows, 0.5)
    right = [(model.score(t) >= bt.CUT) == bool(y) for t, y in rows]
    assert np.mean(right) > 0.97
    better, worse = model.score(rows[0][0]), model.score(rows[-1][0])
    assert better > worse
    assert np.allclose(bt.learn(rows, 0.5).weights, model.weights)


def test_one_class_and_odd_texts():
    flat = bt.learn([("a b c", 1)], 0.0)
    assert flat.score("x") == 0.5
    for text in ("", " \n ", "é" * 10, "word " * 40_000, "\ud800"):
        x = bt.features(text)
        assert x.shape == (len(bt.FEATURES),) and np.isfinite(x).all()


def test_odd_rows(spark):
    model = bt.learn(sample(), 0.5)
    df = spark.createDataFrame([(1, "a b", 9), (1, "a b", 9), (2, None, 9), (3, "", 9)], "doc_id long, text string, quality_score int")
    got = [r.quality_score for r in bt.score_quality(df, model).orderBy("doc_id").collect()]
    assert len(got) == 4 and got[0] == got[1] and got[2] == got[3] and all(0 <= s <= 1 for s in got)
    assert bt.score_quality(df.limit(0), model).collect() == []


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    out = bt.op9_bradley_terry_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    got = {(r.quality, r.predicted): r["count"] for r in out.groupBy("quality", "predicted").count().collect()}
    assert got[0, 0] >= 0.95 * (got[0, 0] + got.get((0, 1), 0)) and got.get((1, 0), 0) <= 0.02 * got[1, 1]


def by_hand(text):
    """The features by plain Python."""
    raw = text.encode("utf-8", "replace")
    words = raw.lower().split()
    n = max(1, len(words))
    letter = lambda b: b >= 0x80 or chr(b).isalpha()
    prose = b".,;:?'\"()-"
    letters = max(1, sum(map(letter, raw)))
    inked = max(1, sum(len(w) for w in words))
    digits = sum(48 <= b < 58 for b in raw)
    signs = inked - letters - digits - sum(b in prose for b in raw) if raw else 0
    odd = [w for w in words if not letter(w[-1]) and w[-1] not in prose and not 48 <= w[-1] < 58]
    sizes = [len(w) for w in words] or [0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    root = lambda x: max(0.0, x) ** 0.5
    return [
        root(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n), len(set(words)) / n, root(max(map(words.count, words), default=0) / n), root(sum(65 <= b < 91 for b in raw) / letters),
        root(digits / inked), root(signs / inked), root(len(odd) / n), root(sum(len(w) == 1 for w in odd) / n), np.log1p(np.mean(sizes)), np.log1p(np.std(sizes)), np.log1p(n / max(1, len(lines))),
        root(1 - len(set(lines)) / max(1, len(lines))), len(zlib.compress(raw, 1)) / len(raw) if len(raw) > 200 else 0.5, np.log1p(len(words)), float(len(words) < 20), root(1 - len(pairs) / max(1, len(words) - 1)),
    ]


@given(st.text(alphabet="aA bB\n.,$%19é中\t\x0b", max_size=300))
def test_features_by_hand(text):
    assert np.allclose(bt.features(text), by_hand(text), atol=1e-7)


def test_query_against_a_plain_fit(spark, tmp_path):
    """The query's scores are those of a plain gradient fit of the same preferences, cut at the plain quantile."""
    rows = sample(60)
    docs = [(k, t) for k, (t, _) in enumerate(rows)] + [(None, "no id"), (900, None), (901, ""), (3, rows[3][0])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, y, 0) for k, (_, y) in enumerate(rows)] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = bt.op9_bradley_terry_quality(spark, str(tmp_path)).collect()
    train = {k: y for k, (_, y) in enumerate(rows) if zlib.crc32(str(k).encode()) % 5}
    # the sample's order decides which pairs are drawn
    known = training_sample(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"), "quality")
    assert sorted(known) == sorted({(rows[k][0], y) for k, y in train.items()})
    x, y = np.array([by_hand(t) for t, _ in known]), np.array([v for _, v in known])
    mean, spread = x[y == 1].mean(0), x[y == 1].std(0) + 0.02
    scaled = np.clip((x - mean) / spread, -6, 6)
    rng = np.random.default_rng(bt.SEED)
    better, worse = rng.choice(np.flatnonzero(y == 1), bt.PAIRS), rng.choice(np.flatnonzero(y == 0), bt.PAIRS)
    d = scaled[better] - scaled[worse]
    w = np.zeros(d.shape[1])
    for _ in range(3000):  # both sides of a pair pull alike
        w -= 0.5 / (2 * len(d)) * (2 * (-(1 / (1 + np.exp(d @ w))) @ d) + bt.RIDGE * w)
    for _ in range(20):  # and the last digits by Newton's steps
        p = 1 / (1 + np.exp(-(d @ w)))
        w -= np.linalg.solve(2 * (d * (p * (1 - p))[:, None]).T @ d + bt.RIDGE * np.eye(len(w)), 2 * (p - 1) @ d + bt.RIDGE * w)
    share = np.mean([v == 0 for v in train.values()])
    scores = scaled @ w
    order = np.argsort(scores, kind="stable")
    weight = np.where(y == 0, share / np.sum(y == 0), (1 - share) / np.sum(y == 1))[order]
    k = int(np.searchsorted(np.cumsum(weight), share - 1e-9))
    cut = (scores[order][k] + scores[order][k + 1]) / 2
    assert len(out) == len(docs)
    texts = dict(docs)
    for r in out:
        z = np.clip((by_hand(texts[r.doc_id] or "") - mean) / spread, -6, 6) @ w - cut + np.log(0.3 / 0.7)
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-4 and r.predicted == (r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_very_long_texts():
    code = """
import resource
from rulelake.llm import bradley_terry as bt
bt.features("warm up")
text = "".join(f"word{k} of text. " for k in range(1_200_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
bt.features(text)
print(len(text) >> 20, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={**os.environ, "PYTHONPATH": ":".join(sys.path)})
    size, more = map(int, out.stdout.split())
    assert size >= 20 and more < 260


def test_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """More rows of a class than a sample once held, and another class that comes to several blocks."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["the", "sea", "and", "9", "Sky", "$"], 3 + k % 9)) + f" {k}" for k in range(5400)]
    quality = [int(k % 60 != 0) for k in range(5400)]
    docs = spark.createDataFrame([*enumerate(texts), (6000, texts[1])], "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(quality), (6000, 1), (6001, 0)], "doc_id long, quality int")
    train = [k for k in range(5400) if zlib.crc32(str(k).encode()) % 5]
    x, y = np.array([bt.features(texts[k]) for k in train]), np.array([quality[k] for k in train])
    assert np.count_nonzero(y) > 4000
    frames = {}
    monkeypatch.setattr(bt, "staged", lambda df, name, staged=bt.staged, **options: frames.setdefault(name, staged(df, name, **options)))
    model = bt.quality_model(docs, labels)
    assert np.allclose(model.mean, x[y == 1].mean(0)) and np.allclose(model.spread, x[y == 1].std(0) + 0.02)
    # every row is counted in one block, and the weights are where all blocks' preferences pull as much as the penalty
    pull, counted = bt.RIDGE * model.weights, np.zeros(2, int)
    blocks = frames["quality_blocks"].collect()
    assert len(blocks) == blocks[0]["of"] == -(-np.count_nonzero(y) // bt.BLOCK_ROWS)
    for row in blocks:
        better, worse = (np.frombuffer(row[name], "<f8").reshape(-1, len(bt.FEATURES)) for name in ("better", "worse"))
        own = [np.frombuffer(row[name], bool) for name in ("worse_own", "better_own")]
        counted += [np.count_nonzero(v) for v in own]
        block = bt.Block(better, worse, own[1], own[0], row["block"], row["of"])
        first, second = block.drawn(bt.PAIRS, bt.SEED)
        assert set(first) == set(range(len(better))) and set(second) == set(range(len(worse))) and len(worse) >= 8
        d = model.scaled(better)[first] - model.scaled(worse)[second]
        pull += 2 * d.T @ (1 / (1 + np.exp(-(d @ model.weights))) - 1)
    assert counted.tolist() == [np.count_nonzero(y == 0), np.count_nonzero(y == 1)] and np.abs(pull).max() < 1e-5
    labelled = [*enumerate(quality), (6000, 1), (6001, 0)]  # the last has no document, and the one before a text that is known
    share = np.mean([v == 0 for k, v in labelled if zlib.crc32(str(k).encode()) % 5])
    assert abs(np.log(bt.CUT / (1 - bt.CUT)) - model.shift - plain_cut(model.raw(x), y, share)) < 1e-9


def plain_cut(scores, y, share):
    weight = np.where(y == 0, share / np.sum(y == 0), (1 - share) / np.sum(y == 1))
    kinds = np.unique(scores)
    below = np.cumsum([weight[scores == s].sum() for s in kinds])
    k = min(int(np.searchsorted(below, share - 1e-9)), len(kinds) - 1)
    beside = k + 1 if k + 1 < len(kinds) else max(0, k - 1)
    return (kinds[k] + kinds[beside]) / 2


@given(st.lists(st.tuples(st.integers(-40, 40), st.booleans()), min_size=1, max_size=60), st.floats(0, 1), st.integers(1, 5))
def test_cut_is_the_exact_quantile(rows, share, parts):
    """Over blocks, with equal scores and scores that lie near each other."""
    x = np.zeros((len(rows) + 2, len(bt.FEATURES)))
    x[:, 0] = [*(v / 7 if v % 3 else v * 1e-9 for v, _ in rows), 0.5, 0.25]
    y = np.array([*(int(v) for _, v in rows), 0, 1])
    weights = np.zeros(len(bt.FEATURES))
    weights[0] = 0.7
    model = bt.QualityModel(np.zeros(len(weights)), np.ones(len(weights)), weights, 0.0)
    blocks = []
    for k in range(parts):
        a, b = x[k::parts][y[k::parts] == 1], x[k::parts][y[k::parts] == 0]
        blocks.append(bt.Block(a, b, np.ones(len(a), bool), np.ones(len(b), bool), k, parts))
    passes = lambda part, joined: functools.reduce(joined, map(part, blocks))
    got = bt._cut(passes, model, share, int(np.sum(y == 0)), int(np.sum(y == 1)))
    assert abs(got - plain_cut(model.raw(x), y, share)) < 1e-12
