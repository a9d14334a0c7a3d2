"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Benchmark items are cut into windows of ``WINDOW`` words (an item of fewer words is one window). Each window is a set of
word shingles at known places; a document that contains the window contains them all, so for containment it is enough
to join on any one of them: the window's rarest, its necessary prefix. Rarity is the number of occurrences in all
documents, counted in a first pass with one counter per benchmark shingle.

In the second pass a document's shingles are matched against the prefix shingles; a match at place p of a prefix that
begins at word q of its window puts the window at p - q, which must lie inside the document (length and positional
bounds), and there all words are compared, first by their 64-bit hashes and then letter by letter. The matches are those
of whole texts.

The benchmark side is cut into blocks of at most ``BLOCK_WORDS`` words, which bounds what is sent to the executors and
what the driver holds; a larger benchmark takes several passes, whose hits are merged per document.

Results for odd input: null or blank text has no words and no hits; items without words have no windows; an item shorter
than a shingle is matched as one shingle; items of equal text all count; null item ids are left out of the list of items
but their windows count as hits; repeated documents keep a row each; an empty table on either side gives no hits; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import bounded_batches, checkpointed, lower_batches
from .shingles import ALNUM, shingle_hashes, text_blocks, word_hashes

WINDOW, SHINGLE = 10, 5
BLOCK_WORDS = 2_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@dataclass
class Windows:
    """The windows of a block of items, by the size of their shingles (below SHINGLE only for items shorter than that)."""

    items: list
    words: np.ndarray  # hashes of all items' words, end to end
    start: np.ndarray  # first word of each window in ``words``
    length: np.ndarray
    item: np.ndarray  # number of each window's item
    letters: bytes  # all items' words in lower case, each followed by a space
    edge: np.ndarray  # where each word begins in ``letters``, and the end

    def shingle_sizes(self) -> np.ndarray:
        return np.minimum(self.length, SHINGLE)


def cut_windows(items: list[tuple], window: int) -> Windows:
    """Windows of (item_id, text) rows."""
    texts = pa.array([text for _, text in items], pa.string())
    words, start, length, item, base, letters, edge = [], [], [], [], 0, [], [np.zeros(1, np.int64)]
    for a, b, data, offsets in text_blocks(texts):
        hashes, at = word_hashes(data, offsets, ALNUM)
        words.append(hashes)
        said, ends = plain_words(data, offsets)
        letters.append(said)
        edge.append(edge[-1][-1] + ends)
        for k in range(a, b):
            n = int(at[k - a + 1] - at[k - a])
            if n:
                count = max(1, n - window + 1)
                start.append(base + int(at[k - a]) + np.arange(count))
                length.append(np.full(count, min(n, window)))
                item.append(np.full(count, k))
        base += len(hashes)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Windows([key for key, _ in items], np.concatenate(words) if words else np.zeros(0, np.uint64), join(start), join(length), join(item), b"".join(letters), np.concatenate(edge))


def plain_words(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of texts that lie end to end, in lower case and each followed by a space, and where each of them ends."""
    inside = ALNUM[0][data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    which = np.cumsum(begins)[inside] - 1  # the word of each letter
    sizes = np.bincount(which, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    out[np.arange(len(which)) + which] = _LOWER[data[inside]]
    return out.tobytes(), ends


def _window_shingles(windows: Windows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each shingle size: windows of that size, and their shingles (a row each; short rows are padded by the first)."""
    out = {}
    sizes = windows.shingle_sizes()
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        all_ = shingle_hashes(windows.words, size)
        most = int(windows.length[mine].max()) - size + 1
        place = np.minimum(np.arange(most)[None, :], (windows.length[mine] - size)[:, None])
        out[size] = mine, all_[windows.start[mine][:, None] + place]
    return out


def _document_batches(batches):
    """Each document's word hashes, and its bytes: (words, data)."""
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column("text")):
            hashes, at = word_hashes(data, offsets, ALNUM)
            for k in range(b - a):
                yield hashes[at[k] : at[k + 1]], data[offsets[k] : offsets[k + 1]]


def count_shingles(docs: DataFrame, text_col: str, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Occurrences in all documents of each wanted shingle, by size; one bounded row set per task is combined."""

    def run(batches):
        totals = {size: np.zeros(len(hashes), np.int64) for size, hashes in wanted.items()}
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column("text")):
                words, at = word_hashes(data, offsets, ALNUM)
                for size, hashes in wanted.items():
                    made = shingle_hashes(words, size)
                    # runs that reach over the end of a text are none of it
                    left = at[np.searchsorted(at, np.arange(len(made)), "right")] - np.arange(len(made))
                    found = np.searchsorted(hashes, made)
                    hit = (hashes[np.minimum(found, len(hashes) - 1)] == made) & (left >= size)
                    np.add.at(totals[size], found[hit], 1)
        for size, total in totals.items():
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), size, np.int64)), pa.array(k), pa.array(total[k])], ["size", "k", "n"])

    out = {size: np.zeros(len(hashes), np.int64) for size, hashes in wanted.items()}
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "size long, k long, n long")
    for row in counted.groupBy("size", "k").agg(F.sum("n").alias("n")).toLocalIterator():  # one row per wanted shingle
        out[row["size"]][row["k"]] = row["n"]
    return out


def prefix_index(windows: Windows, counts, wanted) -> dict[int, dict[str, np.ndarray]]:
    """By shingle size: the rarest shingle of each window and its place, ordered by shingle for lookup."""
    out = {}
    for size, (mine, shingles) in _window_shingles(windows).items():
        rarity = counts[size][np.searchsorted(wanted[size], shingles)]
        place = np.argmin(rarity, axis=1)
        token = shingles[np.arange(len(mine)), place]
        order = np.argsort(token, kind="stable")
        out[size] = {"token": token[order], "place": place[order], "window": mine[order]}
    return out


def match(words: np.ndarray, data: np.ndarray, windows: Windows, index: dict[int, dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a document lie in an occurrence of a window, and the numbers of the items that occur."""
    n = len(words)
    edge, items, said = np.zeros(n + 1, np.int64), [], None
    for size, part in index.items():
        made = shingle_hashes(words, size)
        low = np.searchsorted(part["token"], made, "left")
        near = np.flatnonzero(part["token"][np.minimum(low, len(part["token"]) - 1)] == made)
        if not len(near):
            continue
        low = low[near]
        count = np.searchsorted(part["token"], made[near], "right") - low
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        begin = np.repeat(near, count) - part["place"][entry]
        window = part["window"][entry]
        length = windows.length[window]
        inside = (begin >= 0) & (begin + length <= n)
        begin, window, length = begin[inside], window[inside], length[inside]
        for k in range(int(length.max()) if len(length) else 0):
            same = (k >= length) | (words[np.minimum(begin + k, n - 1)] == windows.words[np.minimum(windows.start[window] + k, len(windows.words) - 1)])
            begin, window, length = begin[same], window[same], length[same]
        if not len(begin):
            continue
        if said is None:
            said, ends = plain_words(data, np.array([0, len(data)]))
            ends = np.concatenate([[0], ends])
        theirs = windows.start[window]
        spans = zip(ends[begin].tolist(), ends[begin + length].tolist(), windows.edge[theirs].tolist(), windows.edge[theirs + length].tolist(), strict=True)
        same = np.array([said[a:b] == windows.letters[c:d] for a, b, c, d in spans])
        begin, window, length = begin[same], window[same], length[same]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + length, -1)
        items.append(np.unique(windows.item[window]))
    return np.cumsum(edge[:-1]) > 0, np.unique(np.concatenate(items)) if items else np.zeros(0, np.int64)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: (id, n_words, spans, items); spans are (start, end) word ranges that windows cover, items sorted ids."""
    with bounded_batches(docs.sparkSession):
        made = [checkpointed(_one_pass(docs, rows, id_col, text_col, window)) for rows in _blocks(benchmark, item_col, item_text_col, block_words)]
    blocks = len(made)
    if blocks == 1:
        return made[0].drop("digest").withColumnRenamed("id", id_col)
    # Hits of the passes meet by document; equal documents have equal hits, and each of them keeps its row.
    union = made[0]
    for one in made[1:]:
        union = union.unionByName(one)
    merged = union.groupBy("id", "digest").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        (F.count(F.lit(1)) / blocks).cast("int").alias("copies"),
    )
    return merged.select(F.col("id").alias(id_col), "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def _prepared(docs: DataFrame, items: list[tuple], text_col: str, window: int):
    """A block's windows and their prefix index, sent to the executors; ``block_words`` bounds it."""
    windows = cut_windows(items, window)
    wanted = {size: np.unique(shingles) for size, (_, shingles) in _window_shingles(windows).items()}
    counts = count_shingles(docs, text_col, wanted) if wanted else {}
    return docs.sparkSession.sparkContext.broadcast((windows, prefix_index(windows, counts, wanted)))


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str, block_words: int):
    """The benchmark's (item, text) rows that hold words, in blocks of bounded size; equal texts are dealt by their items,
    and equal rows are one."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    items = items.where(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]|[A-Z]")).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_words)))  # a word has a letter and a space at least
    for k in range(blocks):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toLocalIterator()]


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that contain no window, with all their columns; texts stay where they are. Rarity is counted in all
    documents for every block. The frame is lazy, so the session's Arrow batches stay lowered."""
    from pyspark.sql.functions import pandas_udf

    lower_batches(docs.sparkSession)
    everything = docs
    for items in _blocks(benchmark, item_col, item_text_col, block_words):
        shared = _prepared(everything, items, text_col, window)

        @pandas_udf("boolean")
        def hit(texts, shared=shared):
            import pandas as pd

            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
            return pd.Series([bool(match(words, data, *shared.value)[0].any()) for words, data in _document_batches([batch])], dtype="bool")

        docs = docs.where(~hit(F.col(text_col)))
    return docs


def _one_pass(docs: DataFrame, items: list[tuple], id_col: str, text_col: str, window: int) -> DataFrame:
    shared = _prepared(docs, items, text_col, window)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        windows, index = shared.value
        for batch in batches:
            n_words, spans, found = [], [], []
            for words, data in _document_batches([batch]):
                hit, items = match(words, data, windows, index)
                step = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in step.reshape(-1, 2).tolist()])
                found.append(sorted({windows.items[k] for k in items.tolist() if windows.items[k] is not None}))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(n_words, pa.int64()), pa.array(spans, spans_type), pa.array(found, pa.list_(pa.string()))], ["id", "digest", "n_words", "spans", "items"])

    source = docs.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("digest"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return source.mapInArrow(run, f"id {kind}, digest string, n_words long, spans array<struct<start:int,end:int>>, items array<string>")


def hit_words(spans):
    """Number of words under sorted spans, which may overlap where passes were merged."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("hit"))
    return F.aggregate(spans, zero, step, lambda acc: acc["hit"]).cast("long")


def op8_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hits = hit_words(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hits > 0).alias("contaminated")
    )


OP8_SQL = """
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS s
  FROM item_words WHERE len(w) > 0
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), sizes AS (
  SELECT DISTINCT n FROM windows
), runs AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM doc_words, sizes WHERE len(w) >= n
), hits AS (
  SELECT r.doc_id, r.i, r.n, x.item_id FROM runs r JOIN windows x ON x.n = r.n AND x.s = array_to_string(r.w[r.i:r.i + r.n - 1], ' ')
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""
