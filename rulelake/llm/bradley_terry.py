"""Document quality by Bradley-Terry pairwise ranking.

Pairs of a better and a worse training document are preferences; the chance that the better one wins is the logistic
function of the difference of two scores, and a score is linear in a document's features. So the weights are those of a
logistic fit, without intercept, of feature differences. The cut is a quantile of the training scores: that of the share
of worse documents among all labels, each class weighted to its share. Scores are shifted so that the cut is at ``CUT``
and squeezed between 0 and 1.

Every labelled document outside the held-out fold is learned from, each text once. They are dealt by digests to blocks of
about ``BLOCK_ROWS`` rows of the commoner class; a rarer class comes to several blocks where it is too rare for all. Pairs
are drawn within blocks, ``PAIRS`` in all and ``PAIRS_PER_ROW`` for each row at least, and a row that no draw has met gets a
pair of its own. Means and spreads, each step of the fit and each narrowing of the cut are one pass over all blocks, of which
the driver gets sums only; the cut is an exact quantile of all scores, equal scores taken together.

Features describe the form of the whole text: repeated and adjacent equal words, the share of the most frequent word,
capitals, digits, signs inside and at the end of words, separators that stand alone, word and line lengths, repeated
lines, compressibility, length.

Results for odd input: null and empty texts have the features of a text without words and a score as any other; a null
id is not held out; repeated rows score alike; an empty table gives an empty result; labels that are null or neither 0
nor 1 are ignored; without labels of both classes every document scores 0.5; other columns are no input.
"""

from __future__ import annotations

import hashlib
import io
import pickle
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import bounded_batches, lower_batches, staged
from .labelled import fold, newton, sigmoid
from .shingles import SPACED, long_pieces, shingle_hashes, word_hashes

CUT = 0.3
PAIRS, SEED, RIDGE = 20_000, 11, 5.0
PAIRS_PER_ROW = 5
#: Rows of the commoner class in a block, and rows of each class that a block has at least, on average.
BLOCK_ROWS, LEAST_ROWS = 1000, 32
BINS = 1024
SEGMENT = 1 << 16

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_LETTER[0x80:] = True
_PROSE = np.zeros(256, bool)  # signs of ordinary prose
_PROSE[[ord(c) for c in ".,;:?'\"()-"]] = True
_SIGN = ~(_LETTER | _PROSE | _DIGIT)  # of what ends a word, neither letter, digit nor sign of prose

FEATURES = (
    "adjacent", "distinct", "most_frequent", "upper", "digits", "signs", "odd_endings", "lone_signs", "word_length", "word_spread",
    "line_words", "repeated_lines", "packed", "length", "short", "repeated_pairs",
)


def features(text: str) -> np.ndarray:
    """The form of a text as numbers, each of them bounded or a logarithm. Words count by their hashes, A-Z as a-z; a long
    text takes 8 bytes of memory for each word and a few times that while it sorts them."""
    raw = text.encode("utf-8", "replace")
    data = np.frombuffer(raw, np.uint8)
    seen = np.zeros(256, np.int64)
    for k in range(0, len(data), SEGMENT):
        seen += np.bincount(data[k : k + SEGMENT], minlength=256)
    letters, spaces = int(seen[_LETTER].sum()), int(seen[_SPACE].sum())
    digits, uppers, prose = int(seen[_DIGIT].sum()), int(seen[_UPPER].sum()), int(seen[_PROSE].sum())
    inked = max(1, len(data) - spaces)

    total = squares = endings = lone = 0
    for part in long_pieces(data, SPACED[0]):
        starts, ends = _word_edges(part)
        sizes, last = ends - starts, _SIGN[part[ends - 1]]
        total, squares = total + int(sizes.sum()), squares + int(sizes @ sizes)
        endings, lone = endings + int(np.count_nonzero(last)), lone + int(np.count_nonzero(last & (sizes == 1)))

    words, _ = word_hashes(data, np.array([0, len(data)]), SPACED)
    count, n = len(words), max(1, len(words))
    adjacent = int(np.count_nonzero(words[1:] == words[:-1]))
    pairs = _distinct(shingle_hashes(words, 2))[0]
    distinct, most = _distinct(words)
    mean = total / n
    spread = max(0.0, squares / n - mean * mean) ** 0.5

    lines, kinds = 0, set()
    for line in io.BytesIO(raw):
        if line.strip():
            lines += 1
            kinds.add(hash(line.rstrip(b"\n")))
    packed = sum(len(zlib.compress(raw[k : k + SEGMENT], 1)) for k in range(0, len(raw), SEGMENT))
    root = lambda x: float(np.sqrt(max(0.0, x)))
    return np.array([
        root(adjacent / n), distinct / n, root(most / n), root(uppers / max(1, letters)),
        root(digits / inked), root((inked - max(1, letters) - digits - prose) / inked if len(data) else 0), root(endings / n), root(lone / n), float(np.log1p(mean)),
        float(np.log1p(spread)), float(np.log1p(n / max(1, lines))), root(1 - len(kinds) / max(1, lines)),
        packed / max(1, len(raw)) if len(raw) > 200 else 0.5, float(np.log1p(count)), float(count < 20), root(1 - pairs / max(1, count - 1)),
    ])


def _word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _distinct(hashes: np.ndarray) -> tuple[int, int]:
    """The number of distinct values, and how often the commonest occurs; sorts in place."""
    if not len(hashes):
        return 0, 0
    hashes.sort()
    runs = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1], [True]]))
    return len(runs) - 1, int(np.diff(runs).max())


@dataclass
class QualityModel:
    """Feature means and spreads, weights, and the shift that puts the cut at CUT; no weights: 0.5 for all."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    shift: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -6, 6)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) @ self.weights

    def score_of(self, x: np.ndarray) -> float:
        return float(sigmoid(self.raw(x) + self.shift))

    def score(self, text: str) -> float:
        return self.score_of(features(text))


@dataclass
class Block:
    """Features of better and worse rows, and which of them this block alone counts; ``of`` blocks there are in all."""

    better: np.ndarray
    worse: np.ndarray
    better_own: np.ndarray
    worse_own: np.ndarray
    number: int = 0
    of: int = 1

    def drawn(self, pairs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the better and the worse rows of this block's pairs, among which is every row."""
        m, n = len(self.better), len(self.worse)
        if not m or not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rng, count = np.random.default_rng(seed + self.number), max(-(-pairs // self.of), PAIRS_PER_ROW * max(m, n))
        better, worse = rng.choice(m, count), rng.choice(n, count)
        left, over = np.setdiff1d(np.arange(m), better), np.setdiff1d(np.arange(n), worse)
        return np.concatenate([better, left, np.arange(len(over)) % m]), np.concatenate([worse, np.arange(len(left)) % n, over])


#: Gives what a function makes of every block, joined two by two.
Passes = Callable[[Callable, Callable], tuple]


def _added(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def _bins(block: Block, model: QualityModel, lo: float, hi: float) -> tuple:
    """Worse and better rows, and the least and the greatest score, in each of BINS bins from ``lo`` to ``hi``; ``lo`` has
    one of its own."""
    edges = np.unique(np.linspace(lo, hi, BINS))
    size, counts, least, most = len(edges), [], np.full(len(edges), np.inf), np.full(len(edges), -np.inf)
    for x in (block.worse[block.worse_own], block.better[block.better_own]):
        scores = model.raw(x)
        scores = scores[(scores >= lo) & (scores <= hi)]
        at = np.searchsorted(edges, scores)
        counts.append(np.bincount(at, minlength=size))
        np.minimum.at(least, at, scores)
        np.maximum.at(most, at, scores)
    return *counts, least, most


def _bins_joined(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], np.minimum(a[2], b[2]), np.maximum(a[3], b[3])


def _cut(passes: Passes, model: QualityModel, worse_share: float, worse: int, better: int) -> float:
    """Halfway between the least score up to which lies the share of worse rows, and the next greater one (the next lesser
    where there is none); each class weighs its share. Bins are narrowed until that of the quantile holds one score."""
    hi = 6 * float(np.abs(model.weights).sum()) * (1 + 1e-9)
    lo, under, over, before = -hi, None, None, 0.0
    while True:
        low, high, least, most = passes(lambda block, lo=lo, hi=hi: _bins(block, model, lo, hi), _bins_joined)
        held = np.flatnonzero(low + high)
        if not len(held):  # scores of other machines may differ in their last digit
            break
        below = before + np.cumsum(worse_share / worse * low[held] + (1 - worse_share) / better * high[held])
        k = min(int(np.searchsorted(below, worse_share - 1e-9)), len(held) - 1)
        before = float(below[k - 1]) if k else before
        under = float(most[held[k - 1]]) if k else under
        over = float(least[held[k + 1]]) if k + 1 < len(held) else over
        lo, hi = float(least[held[k]]), float(most[held[k]])
        if lo == hi:
            break
    beside = over if over is not None else under
    return hi if beside is None else (hi + beside) / 2


def _fitted(passes: Passes, worse_share: float, worse: int, better: int, pairs: int, seed: int) -> QualityModel:
    """The model of all rows of all blocks; the fit sees each preference from both sides, so that nothing but the
    difference matters."""
    mean = passes(lambda block: (block.better[block.better_own].sum(0),), _added)[0] / better
    spread = np.sqrt(passes(lambda block: (((block.better[block.better_own] - mean) ** 2).sum(0),), _added)[0] / better) + 0.02
    model = QualityModel(mean, spread, np.zeros(len(FEATURES)), 0.0)

    def pulls(block: Block, w: np.ndarray) -> tuple:
        first, second = block.drawn(pairs, seed)
        difference = model.scaled(block.better)[first] - model.scaled(block.worse)[second]
        p = sigmoid(difference @ w)
        return 2 * (difference.T @ (p - 1)), 2 * ((difference * (p * (1 - p))[:, None]).T @ difference)

    weights = newton(lambda w: passes(lambda block: pulls(block, w), _added), np.full(len(FEATURES), RIDGE))
    model = QualityModel(mean, spread, weights, 0.0)
    model.shift = float(np.log(CUT / (1 - CUT)) - _cut(passes, model, worse_share, worse, better))
    return model


def _unfitted() -> QualityModel:
    size = len(FEATURES)
    return QualityModel(np.zeros(size), np.ones(size), np.zeros(size), 0.0)


def learn(sample: list[tuple[str, int]], worse_share: float, pairs: int = PAIRS, seed: int = SEED) -> QualityModel:
    """A model from (text, label) rows at hand, of which label 1 is the better; ``worse_share`` is that of label 0 at large."""
    y = np.array([label for _, label in sample])
    if not len(y) or y.min() == y.max():
        return _unfitted()
    x = np.array([features(text) for text, _ in sample])
    better, worse = int(np.count_nonzero(y == 1)), int(np.count_nonzero(y == 0))
    block = Block(x[y == 1], x[y == 0], np.ones(better, bool), np.ones(worse, bool))
    return _fitted(lambda part, _: part(block), worse_share, worse, better, pairs, seed)


def text_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The features of each text, and a digest of it: (id, digest, form). The frame is lazy, so the session's Arrow batches
    stay lowered."""
    lower_batches(docs.sparkSession)

    def read(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            digests = [hashlib.sha256(t.encode("utf-8", "replace")).digest() for t in texts]
            forms = pa.array([features(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), forms], [id_col, "digest", "form"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(read, f"`{id_col}` {kind}, digest binary, form array<double>")


def _blocks(rows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Rows (label, rank, id, digest, form) in blocks, a row for each block."""
    of = -(-max(counts.values()) // BLOCK_ROWS)
    parts = []
    for label, count in counts.items():
        copies = min(of, -(-LEAST_ROWS * of // count))
        part = rows.where(F.col("label") == label).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        parts.append(part.withColumn("block", F.col("copy") if copies == of else F.pmod(F.xxhash64("rank", "copy"), F.lit(of)).cast("int")))

    def packed(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rank", "ascending"), ("id", "ascending"), ("digest", "ascending")])
        x = np.array(group.column("form").to_pylist(), "<f8").reshape(group.num_rows, len(FEATURES))
        better, own = np.array(group.column("label")) == 1, np.array(group.column("copy")) == 0
        columns = [pa.array([v.tobytes()], pa.binary()) for v in (x[better], x[~better], own[better], own[~better])]
        return pa.table([pa.array([group.column("block")[0].as_py()], pa.int32()), *columns], names=["block", "better", "worse", "better_own", "worse_own"])

    dealt = parts[0].unionByName(parts[1]).select("block", "rank", "id", "digest", "label", "copy", "form")
    return dealt.groupBy("block").applyInArrow(packed, "block int, better binary, worse binary, better_own binary, worse_own binary").withColumn("of", F.lit(of))


def _over(blocks: DataFrame) -> Passes:
    """Passes over blocks that are stored; each task joins what it makes."""

    def passes(part: Callable, joined: Callable) -> tuple:
        def made(batches):
            got = None
            for batch in batches:
                for number, better, worse, better_own, worse_own, of in zip(*batch.columns, strict=True):
                    x = [np.frombuffer(v.as_py(), "<f8").reshape(-1, len(FEATURES)) for v in (better, worse)]
                    own = [np.frombuffer(v.as_py(), bool) for v in (better_own, worse_own)]
                    one = part(Block(*x, *own, number.as_py(), of.as_py()))
                    got = one if got is None else joined(got, one)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(got)], pa.binary())], ["made"])

        return reduce(joined, (pickle.loads(row.made) for row in blocks.mapInArrow(made, "made binary").collect()))

    return passes


def model_of_forms(forms: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", pairs: int = PAIRS, seed: int = SEED) -> QualityModel:
    """Learn from the rows of ``text_forms`` that have a label outside the held-out fold, each text and label once; the
    share of worse documents is that of all labels outside it. Run it within ``bounded_batches``."""
    shares = labels.where(fold(id_col) != 0).agg(F.avg((F.col(label) == 0).cast("double"))).first()[0]
    known = labels.where(F.col(label).isin(0, 1) & (fold(id_col) != 0)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.withColumn("rank", F.xxhash64("id", "label"))
    rows = forms.withColumnRenamed(id_col, "id").join(known, "id")
    rows = rows.groupBy("digest", "label").agg(F.min(F.struct("rank", "id", "form")).alias("row"))
    rows = staged(rows.select("digest", "label", "row.*"), "quality_known")
    counts = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return _unfitted()
    blocks = staged(_blocks(rows, counts), "quality_blocks")
    return _fitted(_over(blocks), float(shares or 0.0), counts[0], counts[1], pairs, seed)


def quality_model(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id") -> QualityModel:
    """Learn from all labelled documents outside the held-out fold."""
    with bounded_batches(docs.sparkSession):
        labelled = docs.join(labels.select(id_col).distinct(), id_col, "left_semi")
        return model_of_forms(staged(text_forms(labelled, id_col), "quality_forms"), labels, label, id_col)


def score_forms(forms: DataFrame, model: QualityModel, score_col: str = "score") -> DataFrame:
    """Rows of ``text_forms`` with a score in their features' place."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(forms):
        return forms.map(lambda x: model.score_of(x)).astype("float64")

    return forms.withColumn(score_col, score("form")).drop("form", "digest")


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """The documents with a score; the input's columns are kept as they are, but for one of the score's name. The frame is
    lazy, so the session's Arrow batches stay lowered."""
    from pyspark.sql.functions import pandas_udf

    lower_batches(docs.sparkSession)

    @pandas_udf("double")
    def score(texts):
        return texts.map(lambda t: model.score(t if isinstance(t, str) else "")).astype("float64")

    return docs.withColumn(score_col, score(F.col(text_col)))


def op9_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is read once for its features, from which the model is learned and which it scores."""
    with bounded_batches(spark):
        forms = staged(text_forms(table(spark, sf_dir, "documents")), "quality_forms")
        model = model_of_forms(forms, table(spark, sf_dir, "labels"))
        scored = staged(score_forms(forms, model), "quality")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
