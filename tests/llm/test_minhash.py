import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from oracle import difference

from rulelake.llm import components, minhash, shingles


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, size=5, percent=75):
    sets = {}
    for key, text in rows:
        w = words(text)
        sets[key] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    above = {k: k for k in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                above[q] = p
    return {k: (len(sets[k]), root(k)) for k in ids}


def corpus(seed):
    rng = random.Random(seed)
    text = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    out = []
    for base in (text(120), text(60), text(300)):
        out.append(base)
        for _ in range(25):  # near copies at all distances around the threshold
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 20))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            out.append(copy)
    chain = text(80)
    for k in range(12):  # each is near the one before, the ends are far apart
        chain = chain[3:] + text(3)
        out.append(list(chain))
    passage = text(40)
    out += [text(rng.randrange(5, 40)) + passage + text(rng.randrange(5, 40)) for _ in range(40)]  # a shared passage
    out += [text(rng.randrange(1, 90)) for _ in range(30)] + [["a", "b"], ["A", "b"], ["a", "b", "c"]]
    rows = [" ".join(w) for w in out] + [None, "", "  \n", "same text here"] + ["SAME text\there"] * 5
    rng.shuffle(rows)
    return list(enumerate(rows, 10))


def got(spark, table, **kw):
    df = spark.createDataFrame([(*r, "x") for r in table], "doc_id long, text string, kept string")
    out = minhash.near_duplicates(df, **kw).collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)
    return out


def test_against_brute_force(spark):
    rows = corpus(1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got(spark, rows)} == brute(rows)


def test_open_buckets_find_every_link(spark):
    """One band row makes buckets of mixed company, which only the prefix-filtered join can resolve."""
    rows = corpus(3)[:110]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got(spark, rows, bands=24, rows=1)} == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F"), (7, None), (7, ""), (8, "one")]
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got(spark, rows)), key=repr)
    assert out == sorted([(None, 2, None, True), (3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (7, 0, 7, True), (7, 0, 7, True), (8, 1, 8, True)], key=repr)
    assert got(spark, []) == []


@given(st.lists(st.text(alphabet="aB \n\té\x0b\x1c\xa0中", max_size=30), max_size=6))
def test_word_hashes_are_those_of_single_words(texts):
    found = []
    for _, _, data, offsets in shingles.text_blocks(pa.array([None, *texts], pa.string()), 16):
        hashes, at = shingles.word_hashes(data, offsets, shingles.SPACED)
        found += [hashes[at[k] : at[k + 1]].tolist() for k in range(len(at) - 1)]
    one = lambda w: shingles.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), shingles.SPACED)[0].tolist()[0]
    assert found == [[one(w) for w in words(t)] for t in (None, *texts)]


def test_very_long_text_in_pieces():
    text = " ".join(f"word{k}" for k in range(400_000)) + " " + "x" * (3 << 20)
    data = np.frombuffer(text.encode(), np.uint8)
    hashes, at = shingles.word_hashes(data, np.array([0, len(data)]), shingles.SPACED)
    assert at.tolist() == [0, 400_001]
    part = np.frombuffer(b"word399999", np.uint8)
    assert hashes[399_999] == shingles.word_hashes(part, np.array([0, len(part)]), shingles.SPACED)[0][0]


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    other = np.concatenate([base[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    same = np.mean(minhash.signature(base, 2048) == minhash.signature(other, 2048))
    assert abs(same - 300 / 500) < 0.06


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.connected_components(links.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(minhash.op5_circulant_minhash(spark, sf), minhash.OP5_SQL, sf) == ""


def test_components_meet_by_their_outermost_members(spark, monkeypatch):
    """Texts that turn into others step by step: few of the members of two components are near enough to link them, and the
    triangle inequality must leave those."""
    rng = random.Random(12)
    ruled_out = []
    monkeypatch.setattr(minhash, "_distances", lambda *a, made=minhash._distances: ruled_out.append(made(*a)) or ruled_out[-1])
    table, key = [], 0
    for family in range(6):
        size = 120
        base, other = ([f"f{family}{side}{k}" for k in range(size)] for side in "xy")
        shared = [f"f{family}shared{k}" for k in range(60)]
        for step in sorted(rng.choice(range(0, size, 2)) for _ in range(26)):
            words = shared + other[:step] + base[step:]
            for _ in range(2):  # a variant of each step, with a word of its own
                place = rng.randrange(len(words))
                table.append((key, " ".join([*words[:place], f"own{key}", *words[place + 1 :]])))
                key += 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got(spark, table, bands=24, rows=1)} == brute(table)
    assert any(r is not None for r in ruled_out)
