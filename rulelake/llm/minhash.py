"""Near-duplicate detection by circulant MinHash, banding and exact Jaccard verification.

Two permutations of the 32-bit numbers give the whole signature: the first scatters a text's shingles, and coordinate k
is the least value of the second one, shifted circularly by k. Bands of ``ROWS`` coordinates are bucket keys.

Texts with equal shingle sets form a class, whose node is its smallest document id; everything after works on classes.
In each bucket all members are first held against one of them, the one that shares buckets with most others (of copies
that derive from one text, that is the text), which takes as many checks as members, not pairs.
Links are confirmed on full shingle sets and joined into components. A bucket whose members then lie in one component is
done. The members of the others take part in a prefix-filtered join of their sets, which finds every pair of different
components that may reach the similarity: large groups of copies close in the first round, passages that many documents
share are last in the order of rarity and bring no pairs, and no cap cuts a bucket short.

A pair at exactly the threshold shares no bucket with a chance of (1 - 0.75^4)^32, about 5 in a million.

Results for odd input: null, empty and blank texts have no shingles and are linked with nothing; texts of fewer words
than a shingle are one shingle; a row without an id is linked with nothing, has no component and is kept; rows that
repeat an id keep a row each (texts that have the same smallest id count as linked); an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import bounded_batches, checkpointed, staged
from .components import connected_components
from .shingles import SPACED, mix64, shingle_set, text_blocks, word_hashes

SHINGLE, BANDS, ROWS, PERCENT = 5, 32, 4, 75
#: A list of so many node ids at most is broadcast; beyond it the join decides by itself.
BROADCAST_NODES = 1_000_000
#: Bins of the shingle counts that order a prefix-filtered join.
BINS = 1 << 18
#: 64-bit words of the one-bit sketches that pairs must pass before their sets are compared.
SKETCH_WORDS = 32
_SLICE = 256


def _mix32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    scratch = x >> np.uint32(16)
    x ^= scratch
    x *= np.uint32(a)
    np.right_shift(x, np.uint32(13), out=scratch)
    x ^= scratch
    x *= np.uint32(b)
    np.right_shift(x, np.uint32(16), out=scratch)
    x ^= scratch
    return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a set of 64-bit shingles; memory does not grow with the set."""
    scattered = _mix32((shingles >> np.uint64(32)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    shifts = np.arange(coordinates, dtype=np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(scattered), _SLICE):
        # x - k modulo 2^32 under the second permutation is x under that permutation shifted by k
        np.minimum(least, _mix32(scattered[k : k + _SLICE, None] - shifts, 0x7FEB352D, 0x846CA68B).min(0), out=least)
    return least


def band_keys(coordinates: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit bucket key per band."""
    rows = coordinates.reshape(bands, -1).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, shingle set) of a batch's second column."""
    for a, b, data, offsets in text_blocks(batch.column(1)):
        words, at = word_hashes(data, offsets, SPACED)
        for k in range(b - a):
            yield a + k, shingle_set(words[at[k] : at[k + 1]], size)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int) -> DataFrame:
    """(id, key, n, bands, text_sha256): digest of the shingle set (null without shingles), its size, its bucket keys, and
    the digest of the text."""

    def run(batches):
        for batch in batches:
            keys, counts, buckets = [], [], []
            for _, shingles in _sets(batch, size):
                counts.append(len(shingles))
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None)
                buckets.append(band_keys(signature(shingles, bands * rows), bands) if len(shingles) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), batch.column(2)], ["id", "key", "n", "bands", "text_sha256"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.sha2(F.col(text_col), 256).alias("text_sha256"))
    return source.mapInArrow(run, "id long, key binary, n long, bands array<long>, text_sha256 string")


def shingle_sets(docs: DataFrame, nodes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the documents that are nodes."""

    def run(batches):
        for batch in batches:
            made = [shingles.tobytes() for _, shingles in _sets(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["node", "shingles"])

    source = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    wanted = F.broadcast(nodes) if nodes.count() <= BROADCAST_NODES else nodes
    return source.join(wanted, "node", "left_semi").mapInArrow(run, "node long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets reach the similarity."""

    def run(batches):
        for batch in batches:
            kept = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(one), len(two)) < percent * max(len(one), len(two)):
                    continue
                both = np.concatenate([one, two])
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * shared >= percent * (len(one) + len(two) - shared):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), batch.column(1).take(pa.array(kept, pa.int64()))], ["a", "b"])

    wide = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
    wide = wide.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
    return checkpointed(wide.select("a", "b", "one", "two").mapInArrow(run, "a long, b long"))


def _labelled(members: DataFrame, components: DataFrame) -> DataFrame:
    joined = members.join(components, "node", "left")
    return joined.withColumn("component", F.coalesce("component", "node"))


def _rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may reach the similarity: a prefix-filtered set join.

    In one order of all shingles, rarest first, two such sets share a shingle among the first n - ceil(t n) + 1 of each.
    The order is by a count of fixed-size bins, so any number of shingles needs the same memory. Components rather than
    their members meet at a shingle. Of those that met only members are expanded that the triangle inequality leaves near
    enough (``_distances``), and pairs are made only where one-bit signatures do not rule the similarity out.
    """
    wide = nodes.join(sets, "node")

    def count(batches):
        total = np.zeros(BINS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_buffer(), np.uint64) & np.uint64(BINS - 1), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bin", "n"])

    frequency = np.zeros(BINS, np.int64)
    counted = wide.select("shingles").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    for row in counted.toLocalIterator():  # at most BINS rows
        frequency[row["bin"]] = row["n"]

    names = [f"w{k}" for k in range(SKETCH_WORDS)]

    def prefixes(batches):
        for batch in batches:
            tokens, words = [], []
            for value in batch.column(0):
                shingles = np.frombuffer(value.as_buffer(), np.uint64)
                n = len(shingles) - -(-percent * len(shingles) // 100) + 1
                order = np.lexsort((shingles, frequency[(shingles & np.uint64(BINS - 1)).astype(np.int64)]))[:n]
                tokens.append(shingles[order].view(np.int64))
                bits = (signature(shingles, 64 * SKETCH_WORDS) & np.uint32(1)).astype(np.uint8)
                words.append(np.packbits(bits).view(np.int64))
            words = np.array(words).reshape(-1, SKETCH_WORDS)
            arrays = [batch.column(1), batch.column(2), batch.column(3), pa.array(tokens, pa.list_(pa.int64())), *[pa.array(words[:, k]) for k in range(SKETCH_WORDS)]]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "n", "component", "tokens", *names])

    schema = "node long, n long, component long, tokens array<long>, " + ", ".join(f"{name} long" for name in names)
    sketched = staged(wide.select("shingles", "node", "n", "component").mapInArrow(prefixes, schema), "prefixes")
    nodes = sketched.drop("tokens")
    rare = sketched.select("node", "component", F.explode("tokens").alias("token"))
    shared = checkpointed(rare.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("token"))
    rare = rare.join(shared, "token").groupBy("token", "component")
    units = rare.agg((F.count(F.lit(1)) > 1).alias("many"), F.min("node").alias("node"))
    units = checkpointed(units.join(nodes.drop("component"), "node"))

    def side(frame, mark):
        return frame.select(*[F.col(c).alias(c if c == "token" else f"{c}_{mark}") for c in frame.columns])

    similar = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    differing = sum((F.bit_count(F.col(f"{name}_a").bitwiseXOR(F.col(f"{name}_b"))) for name in names), F.lit(0))
    similar &= differing <= _most_differing(percent)
    one, two = side(units, "a"), side(units, "b")
    meet = one.join(two, (one.token == two.token) & (F.col("component_a") < F.col("component_b")) & (F.col("many_a") | F.col("many_b") | similar))
    meet = checkpointed(meet.select("component_a", "component_b", "many_a", "many_b", "node_a", "node_b").distinct())
    single = meet.where("not many_a and not many_b").select("node_a", "node_b")
    groups = meet.where("many_a or many_b").select("component_a", "component_b").distinct()
    far = _distances(groups, nodes.select("node", "component"), sets)
    if far is None:
        lots = single.limit(0)
    else:
        apart, away = far
        # Members far enough from their component's first node to be near one of the other component's, and no others.
        most, slack = (100 - percent) / 100, 1e-9
        reach = away.groupBy("component").agg(F.max("away").alias("reach"), F.count(F.lit(1)).alias("size"))
        open_ = apart.join(side(reach, "a"), "component_a").join(side(reach, "b"), "component_b").where(F.col("apart") <= most + slack + F.col("reach_a") + F.col("reach_b"))
        # The component of fewer members is expanded, and pairs are made with the other's members only where all tests hold.
        turn = F.col("size_b") < F.col("size_a")
        either = lambda this, that: F.when(turn, F.col(this)).otherwise(F.col(that))
        open_ = open_.select(either("component_b", "component_a").alias("few"), either("component_a", "component_b").alias("lots"), "apart", either("reach_a", "reach_b").alias("reach"))
        placed = nodes.join(away.drop("component"), "node")
        few = open_.join(side(placed, "a"), (F.col("few") == F.col("component_a")) & (F.col("away_a") >= F.col("apart") - most - slack - F.col("reach")))
        near = F.col("away_a") + F.col("away_b") >= F.col("apart") - most - slack
        lots = few.join(side(placed, "b"), (F.col("lots") == F.col("component_b")) & near & similar).select("node_a", "node_b")
    return single.union(lots).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _distances(groups: DataFrame, nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """How far components that meet are apart, by their first nodes: (component_a, component_b, apart), and how far their members
    are away from their own first node: (node, component, away), as Jaccard distances of full sets; None without groups.

    Jaccard distance obeys the triangle inequality, so members of two components are no nearer to each other than their first
    nodes are apart, less what both are away from those. That rules out whole components, or all but their outermost
    members, at one comparison per member, where pairs of members would be their product.
    """
    groups = checkpointed(groups)
    if not groups.limit(1).count():
        return None
    comps = groups.select(F.col("component_a").alias("component")).union(groups.select("component_b")).distinct()
    members = nodes.join(comps, "component")
    asked = members.select(F.col("node").alias("a"), F.col("component").alias("b"), F.lit(True).alias("member")).union(groups.select("component_a", "component_b", F.lit(False)))

    def run(batches):
        for batch in batches:
            said = []
            for x, y in zip(batch.column("one"), batch.column("two"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                said.append(1 - shared / max(1, len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("member"), pa.array(said, pa.float64())], ["a", "b", "member", "distance"])

    wide = asked.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
    made = checkpointed(wide.select("a", "b", "member", "one", "two").mapInArrow(run, "a long, b long, member boolean, distance double"))
    apart = made.where("not member").select(F.col("a").alias("component_a"), F.col("b").alias("component_b"), F.col("distance").alias("apart"))
    return apart, made.where("member").select(F.col("a").alias("node"), F.col("b").alias("component"), F.col("distance").alias("away"))


def _most_differing(percent: int) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, but for a chance of about 3 in 10 million."""
    bits, expected = 64 * SKETCH_WORDS, (100 - percent) / 200
    return int(bits * expected + 5 * (bits * expected * (1 - expected)) ** 0.5) + 1


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, with_digest: bool = False
) -> DataFrame:
    """Per document: id, n_shingles, component_id (smallest id reachable over links), kept; with the digest of its text where asked."""
    with bounded_batches(docs.sparkSession):  # all that runs in Python is staged
        return _near_duplicates(docs, id_col, text_col, size, bands, rows, percent, with_digest)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, size: int, bands: int, rows: int, percent: int, with_digest: bool) -> DataFrame:
    sketched = staged(sketches(docs, id_col, text_col, size, bands, rows), "sketches")
    classes = sketched.where("key is not null and id is not null").groupBy("key").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = staged(classes, "classes")

    members = classes.select("node", "n", F.explode("bands").alias("bucket"))
    # What is known of buckets is found apart from the joins with their members, which can then split a hot bucket.
    shared = checkpointed(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    members = staged(members.join(shared, "bucket"), "shared")  # of buckets with company only
    company = members.groupBy("node").agg(F.sum("members").alias("company"))
    members = members.join(company, "node")
    centers = members.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("node")).alias("least"))).alias("best"))
    members = members.join(checkpointed(centers.select("bucket", (-F.col("best.least")).alias("center"))), "bucket")
    members = staged(members.select("bucket", "node", "n", "members", "center"), "members")

    nodes = checkpointed(members.select("node").distinct())
    sets = staged(shingle_sets(docs, nodes, size, id_col, text_col), "sets")
    links = confirmed(members.where("node != center").select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct(), sets, percent)
    components = connected_components(links)

    labelled = _labelled(members.where("members > 2").select("bucket", "node", "n"), components)
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("bucket")
    mixed = checkpointed(mixed)
    opened = checkpointed(labelled.join(mixed, "bucket").select("node", "n", "component").distinct())
    late = confirmed(_rare_pairs(opened, sets, percent), sets, percent)
    if late.limit(1).count():
        over = late.join(opened.select(F.col("node").alias("a"), F.col("component").alias("c_a")), "a")
        over = over.join(opened.select(F.col("node").alias("b"), F.col("component").alias("c_b")), "b")
        joined = connected_components(over.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())
        joined = joined.select(F.col("node").alias("root"), F.col("component").alias("above"))
        alone = joined.join(components, joined.root == components.node, "left_anti").select(F.col("root").alias("node"), F.col("above").alias("component"))
        components = components.join(joined, components.component == joined.root, "left").select("node", F.coalesce("above", "component").alias("component")).union(alone)

    node_of = classes.select("key", "node").join(components, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    result = sketched.select("id", "key", "n", *(["text_sha256"] if with_digest else [])).join(node_of, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    result = result.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), *(["text_sha256"] if with_digest else []))
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), raw AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), shingles AS (
  SELECT DISTINCT doc_id, md5_number(s) AS s FROM raw
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), half AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * n_shared >= 75 * (p.n + q.n - n_shared)
), links AS (
  SELECT x, y FROM half UNION ALL SELECT y, x FROM half
), reach AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), least_of AS (
  SELECT x, min(y) AS m FROM reach GROUP BY x
)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_of ON x = d.doc_id
"""
