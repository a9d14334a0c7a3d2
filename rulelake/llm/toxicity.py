"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, takes compatibility forms (full-width letters and the like) and homoglyphs of other scripts to Latin
letters, undoes digit and sign substitutions (``1d10t``), and turns everything between words into single spaces. A term
is a whole word or a word's beginning; exception phrases (``trash can``) take back the terms inside them.

A document's evidence is the sum over its distinct words of their heaviest term's weight, and its density that sum per
hundred words, which normalises by length; a logistic curve of both gives a score between 0 and 1. Weights and curve are
learned from labelled documents outside the held-out fold: a term is a word, or a beginning of 4 to 10 letters, that is
in at least ``SUPPORT`` of the toxic sample, and its weight is the log of how much commoner it is there than in the clean
sample, less twice the standard error. An exception is a term with one of its neighbours that is common in clean
documents and not in toxic ones. Without labels a small built-in list serves.

Results for odd input: null, empty and blank texts score as texts without terms; a null id is not held out; repeated rows
score alike; an empty table gives an empty result; labels that are null or neither 0 nor 1 are ignored; other columns of
the documents are no input. Texts of any length are matched whole, in one pass.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import bounded_batches, lower_batches, staged
from .labelled import fold, logistic, sigmoid, training_sample

THRESHOLD = 0.5
SUPPORT, LEAST_WEIGHT, MOST_TERMS = 0.01, 0.7, 5_000
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10)

BASE_TERMS = {"idiot": 3.0, "moron": 3.0, "stupid": 3.0, "loser": 3.0, "scum": 3.0, "worthless": 3.0, "pathetic": 3.0, "disgusting": 2.5}
BASE_EXCEPTIONS = ("pathetic fallacy", "trash can", "clown fish", "stupid simple")

_SUBSTITUTES = str.maketrans("013457@$", "oieastas")
# Letters of other scripts that look like Latin ones.
_LOOKALIKES = str.maketrans("абеорсухікѕјԁԛԝһνοαερτυχιкмтнвгіӏ", "abeopcyxiksjdqwhvoaeptuxikmthbril")
_BETWEEN = re.compile(r"[\W_]+")


def fold_text(text: str) -> str:
    """Folded words, each between single spaces."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_LOOKALIKES)
    return f" {_BETWEEN.sub(' ', text.lower().translate(_SUBSTITUTES)).strip()} "


@dataclass
class ToxicityModel:
    """Weights by term (a whole word ends with a space), exception phrases, and the curve (evidence, density, offset)."""

    terms: dict[str, float] = field(default_factory=lambda: {f"{w} ": v for w, v in BASE_TERMS.items()})
    exceptions: tuple[str, ...] = BASE_EXCEPTIONS
    curve: tuple[float, float, float] = (0.8, 0.8, -4.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            machine.add_word(f" {term}", (len(term) + 1, weight))
        for phrase in self.exceptions:
            folded = fold_text(phrase)
            machine.add_word(folded, (len(folded), None))
        machine.make_automaton()
        return machine

    def evidence(self, folded: str, machine) -> float:
        """Sum over the distinct words that carry a term outside exceptions of their heaviest term's weight.

        Hits are kept as arrays of places, and exceptions as the furthest end reached so far, so that a text takes time
        and memory in proportion to its length.
        """
        at, weights, opens, shuts = array("q"), array("d"), array("q"), array("q")
        for end, (size, weight) in machine.iter(folded):
            start = end - size + 1
            if weight is None:
                opens.append(start)
                shuts.append(end)
            # a beginning is no whole word: more of the word must follow
            elif folded[end] == " " or folded[end + 1] != " ":
                at.append(start)
                weights.append(weight)
        if not at:
            return 0.0
        starts, heavy = np.frombuffer(at, np.int64), np.frombuffer(weights, np.float64)
        if opens:
            order = np.argsort(np.frombuffer(opens, np.int64), kind="stable")
            begins, reach = np.frombuffer(opens, np.int64)[order], np.maximum.accumulate(np.frombuffer(shuts, np.int64)[order])
            before = np.searchsorted(begins, starts, "right") - 1
            free = (before < 0) | (reach[np.maximum(before, 0)] <= starts)
            starts, heavy = starts[free], heavy[free]
        best: dict[str, float] = {}
        for start, weight in zip(starts.tolist(), heavy.tolist(), strict=True):
            word = folded[start + 1 : folded.index(" ", start + 1)]
            if weight > best.get(word, 0.0):
                best[word] = weight
        return math.fsum(best.values())

    def features(self, text: str, machine) -> tuple[float, float]:
        return self.folded_features(fold_text(text), machine)

    def folded_features(self, folded: str, machine) -> tuple[float, float]:
        found = self.evidence(folded, machine) if machine is not None and len(machine) else 0.0
        words = max(1, folded.count(" ") - 1)
        return float(np.log1p(found)), float(np.log1p(100 * found / words))

    def score(self, text: str, machine) -> float:
        a, b = self.features(text, machine)
        return float(sigmoid(self.curve[0] * a + self.curve[1] * b + self.curve[2]))


@lru_cache(maxsize=1 << 14)
def _terms_of(word: str) -> tuple[str, ...]:
    """A word itself and its beginnings, as terms."""
    return (word + " ", *(word[:k] for k in BEGINNINGS if len(word) > k))


def _terms(words: Iterable[str]) -> set[str]:
    return {term for word in set(words) for term in _terms_of(word)}


def _weight(toxic: int, all_toxic: int, clean: int, all_clean: int) -> float:
    """The log of the ratio of two rates, less twice its standard error: what the counts make sure of."""
    ratio = np.log((toxic + 0.5) / (all_toxic + 1) / ((clean + 0.5) / (all_clean + 1)))
    return float(ratio - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)))


def learn(sample: list[tuple[str, int]], support: float = SUPPORT, least_weight: float = LEAST_WEIGHT) -> ToxicityModel:
    """A model from (text, label) rows; the built-in one where a class is missing."""
    sides = {1: [fold_text(t) for t, y in sample if y == 1], 0: [fold_text(t) for t, y in sample if y == 0]}
    if not sides[0] or not sides[1]:
        return ToxicityModel()
    toxic, clean = Counter(), Counter()
    for folded in sides[1]:
        toxic.update(_terms(folded.split()))
    enough = max(3, support * len(sides[1]))
    toxic = Counter({term: n for term, n in toxic.items() if n >= enough})
    for folded in sides[0]:
        clean.update(_terms(folded.split()) & toxic.keys())
    weighed = {term: _weight(n, len(sides[1]), clean[term], len(sides[0])) for term, n in toxic.items()}
    chosen: dict[str, float] = {}
    for term in sorted(weighed, key=lambda t: (len(t), t)):
        shorter = max((chosen[term[:k]] for k in BEGINNINGS if len(term.strip()) > k and term[:k] in chosen), default=None)
        if weighed[term] >= least_weight and (shorter is None or weighed[term] > shorter):
            chosen[term] = weighed[term]
    for word, weight in BASE_TERMS.items():
        if f"{word} " not in weighed and clean.get(f"{word} ", 0) == 0 and not any(word[:k] in chosen for k in BEGINNINGS):
            chosen.setdefault(f"{word} ", weight)
    chosen = dict(sorted(chosen.items(), key=lambda kv: (-kv[1], kv[0]))[:MOST_TERMS])
    model = ToxicityModel(chosen, BASE_EXCEPTIONS)
    model.exceptions = (*BASE_EXCEPTIONS, *_learn_exceptions(model, sides))
    machine = model.automaton()
    x = np.array([model.folded_features(folded, machine) for y in (1, 0) for folded in sides[y]])
    y = np.array([1.0] * len(sides[1]) + [0.0] * len(sides[0]))
    model.curve = tuple(float(v) for v in logistic(x, y, ridge=1.0, intercept=True))
    _terms_of.cache_clear()
    return model


def _learn_exceptions(model: ToxicityModel, sides: dict[int, list[str]]) -> list[str]:
    """Two-word phrases around a term that clean documents use and toxic ones do not."""
    counts: dict[int, Counter] = {}
    carries = lru_cache(maxsize=1 << 16)(lambda word: any(term in model.terms for term in _terms_of(word)))
    for y, texts in sides.items():
        counts[y] = Counter()
        for folded in texts:
            words = folded.split()
            hit = [k for k, word in enumerate(words) if carries(word)]
            counts[y].update({" ".join(words[max(0, a) : a + 2]) for k in hit for a in (k - 1, k)})
    least = max(3, 0.002 * len(sides[0]))
    return sorted(p for p, n in counts[0].items() if n >= least and " " in p and counts[1][p] * 20 < n)


def toxicity_model(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Learn from a bounded sample (see ``training_sample``) of the labelled documents outside the held-out fold."""
    return learn(training_sample(docs, labels, label))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """The documents with a score; the input's columns are kept as they are, but for one of the score's name. The frame is
    lazy, so the session's Arrow batches stay lowered."""
    from pyspark.sql.functions import pandas_udf

    lower_batches(docs.sparkSession)
    held = {}

    @pandas_udf("double")
    def score(texts):
        if "machine" not in held:
            held["machine"] = model.automaton()
        return texts.map(lambda t: model.score(t if isinstance(t, str) else "", held["machine"])).astype("float64")

    return docs.withColumn(score_col, score(F.col(text_col)))


def op7_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with bounded_batches(spark):
        model = toxicity_model(docs, table(spark, sf_dir, "labels"))
        scored = staged(score_toxicity(docs.select("doc_id", "text"), model, score_col="score").drop("text"), "toxicity")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
