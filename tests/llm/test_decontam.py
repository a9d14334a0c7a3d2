import random
import re

import numpy as np
from oracle import difference

from rulelake.llm import decontam


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            v = words(body)
            runs = [v[k : k + window] for k in range(max(1, len(v) - window + 1))] if v else []
            for run in runs:
                for k in range(len(w) - len(run) + 1):
                    if w[k : k + len(run)] == run:
                        hit |= set(range(k, k + len(run)))
                        found.add(item)
        out.append((key, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


def sample(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c1", "é", "dd", "Ee", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 4, 6, 9]))) for k in range(12)] + [(100, None), (101, "!!"), (None, "dd dd"), (3, text(7))]
    docs = [(k, text(rng.randrange(0, 60))) for k in range(40)] + [(40, None), (41, ""), (41, ""), (None, items[5][1]), (42, "-".join(words(items[6][1])).upper()), (43, "z " * 5000 + items[5][1])]
    return docs, items


def run(spark, docs, items, window, **kw):
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.contamination(d, b, window=window, **kw)
    return sorted(((r[0], r[1], r[2], r[3]) for r in out.select("doc_id", "n_words", decontam.hit_words("spans"), "items").collect()), key=repr)


def test_against_brute_force(spark):
    for seed, window in ((1, 5), (2, 6), (3, 10)):
        docs, items = sample(seed)
        assert run(spark, docs, items, window) == brute(docs, items, window)


def test_several_passes_agree(spark):
    docs, items = sample(4)
    assert run(spark, docs, items, 5, block_words=20) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = sample(5)
    assert run(spark, docs, [], 5) == brute(docs, [], 5)
    assert run(spark, [], items, 5) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(decontam.op8_prefix_decontamination(spark, sf), decontam.OP8_SQL, sf) == ""


def test_equal_hashes_of_other_words_are_no_hit():
    """The letters decide, not the hashes."""
    text, other = b"one two three four five six", b"one two three four five SIV"
    windows = decontam.cut_windows([("i", text.decode())], 6)
    wanted = {size: np.unique(s) for size, (_, s) in decontam._window_shingles(windows).items()}
    index = decontam.prefix_index(windows, {size: np.zeros(len(s), np.int64) for size, s in wanted.items()}, wanted)
    for data, hits in ((text, 6), (other, 0), (text.upper().replace(b" ", b"--"), 6)):
        hit, items = decontam.match(windows.words, np.frombuffer(data, np.uint8), windows, index)
        assert hit.sum() == hits and len(items) == (hits > 0)


def test_repeated_and_blank_items_fill_no_block(spark):
    """Equal texts of many items are dealt over the blocks, equal rows count once, and rows without words take no place."""
    rows = [(k, "same words in all of these items") for k in range(300)] + [(None, None)] * 500 + [(1, "?!")] * 500 + [(5, "same words in all of these items")] * 500
    b = spark.createDataFrame(rows, "item_id long, text string")
    blocks = list(decontam._blocks(b, "item_id", "text", 500))
    assert len(blocks) > 5 and sum(map(len, blocks)) == 300 and max(map(len, blocks)) < 100
    docs = spark.createDataFrame([(1, "x same words in all of these items"), (2, "same words")], "doc_id long, text string")
    got = {r.doc_id: len(r["items"]) for r in decontam.contamination(docs, b, block_words=500).collect()}
    assert got == {1: 300, 2: 0}
    assert [r.doc_id for r in decontam.clean_rows(docs, b, block_words=500).collect()] == [2]
