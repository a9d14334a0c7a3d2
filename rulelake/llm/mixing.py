"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weighted share of all words, held to ``max_repeat`` times its own size. ``target / size`` is
the expected number of copies of its words: the whole part is allocated to every document for certain, the rest is a
fixed-size unequal-probability sample. A document's inclusion odds are those of that rest times its size over the mean
size of its source's documents (and times its ``importance``): a long document is the likelier to be taken once more.
Each document draws a uniform number ``u`` from a digest of its id and gets the rank key ``odds(u) / odds(p)``, where
``p`` is its inclusion probability. The sample is the head of that order, as long as the words still owed to the source.

The plan reads the text once. The head of each order is found without sorting a source: rank keys are mapped
monotonically onto ``slices`` slices, words are summed by source and slice with map-side combining, a running sum over
those bounded rows names the one slice in which the head ends, and only that slice is ranked row by row. What is decided
is one row per source, which any copy of the documents can be held against. Sources themselves may be as many as rows:
they are numbered in range partitions, and the level to which they are filled is found by aggregates of one row.

Results for odd input: null or empty text has size 0, target 0 and takes nothing; a null source is a source of its own
and comes last; rows that repeat an id are documents of their own and share their draw (ties go by size, then by the
text's digest, and equal rows are interchangeable); a row without an id draws by its text; an empty table gives an empty
result; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import table
from .common import checkpointed, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SLICES = 4096
SEED = "mix-1"
#: Decisions of so many sources at most are broadcast; beyond it the join decides by itself.
BROADCAST_SOURCES = 50_000


def _ranked(sizes: DataFrame) -> DataFrame:
    """Rows of (source, source_size) with the source's rank by code point, nulls last. Range partitions are numbered by
    themselves, each after as many as the ones before it hold, of which there is one row per partition."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    placed = checkpointed(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = placed.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(*order)))
    return within.join(F.broadcast(before.select("part", "before")), "part").select("source", "source_size", "docs", (F.col("before") + F.col("place")).alias("rank"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Targets of (source, source_size) rows: water-filling of all words by weight under each source's cap.

    The level rises from an even share of everything: sources whose caps lie below it are full, what they leave is shared
    by the others, which raises it again, until no more are full. Each round is an aggregate of one row.
    """
    sizes = sizes if "docs" in sizes.columns else sizes.withColumn("docs", F.lit(1).cast("long"))
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = checkpointed(_ranked(sizes).withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * max_repeat))
    total, weight = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, heavy, held = int(total), int(weight), -1
    # Whole numbers on both sides: a source is full where its cap lies below its share at the level.
    full = lambda: F.col("cap").cast("decimal(38,0)") * F.lit(heavy) < F.lit(left).cast("decimal(19,0)") * F.col("weight")
    while heavy:
        below = ranked.where(full()).agg(F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if below[0] == held or below[2] == weight:
            break
        held, left, heavy = below[0], int(total - below[1]), int(weight - below[2])
    share = F.lit(left) * F.col("weight") / F.lit(max(1, heavy))
    return ranked.select("source", "source_size", "docs", F.when(full(), F.col("cap").cast("double")).otherwise(share).alias("target"))


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of an MD5 digest: equal on every engine and rerun."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _drawn(docs: DataFrame, id_col: str, text_col: str, source_col: str, importance: str | None, seed: str) -> dict[str, Column]:
    """What the mix needs to know of a row."""
    weight = F.lit(1.0) if importance is None else F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(1.0)), F.lit(1e-9))
    return {
        "mix_id": F.col(id_col),
        "mix_source": F.col(source_col).cast("string"),
        "mix_size": word_count(F.col(text_col)),
        "mix_tie": F.xxhash64(F.col(text_col)),
        "mix_importance": weight,
        "mix_u": uniform(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))), seed),
    }


def _keyed(rows: DataFrame, decisions: DataFrame, slices: int) -> DataFrame:
    """Rows with their source's decisions, rank key and slice."""
    few = decisions.count() <= BROADCAST_SOURCES
    joined = rows.join(F.broadcast(decisions) if few else decisions, F.col("mix_source").eqNullSafe(F.col("at_source")), "left")
    relative = (F.col("mix_size") * F.col("mix_docs")).cast("double") / F.col("source_size").cast("double")
    odds = F.col("mix_p") / (1 - F.col("mix_p")) * F.greatest(relative, F.lit(1e-9)) * F.col("mix_importance")
    joined = joined.withColumn("mix_key", F.when(F.col("mix_p") > 0, F.col("mix_u") / (1 - F.col("mix_u")) / odds))
    return joined.withColumn("mix_slice", F.least(F.floor(F.col("mix_key") / (1 + F.col("mix_key")) * slices), F.lit(slices - 1)))


def decide(docs: DataFrame, *, id_col: str, text_col: str, source_col: str, weights: Sequence[int], max_repeat: int, importance: str | None, slices: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """The narrow rows of all documents, and one row of decisions per source: target, certain copies, and where the
    head of its order ends (the end slice, and the last place taken in it)."""
    rows = checkpointed(docs.select(*[c.alias(name) for name, c in _drawn(docs, id_col, text_col, source_col, importance, seed).items()]))  # the text is read once

    by_source = rows.groupBy(F.col("mix_source").alias("source")).agg(F.sum("mix_size").alias("source_size"), F.count_if(F.col("mix_size") > 0).alias("docs"))
    targets = source_targets(by_source, weights, max_repeat).withColumnRenamed("docs", "mix_docs")
    filled = F.col("source_size") > 0
    targets = targets.withColumn("mix_certain", F.when(filled, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("mix_owed", F.col("target") - (F.col("mix_certain") * F.col("source_size")).cast("double"))
    targets = targets.withColumn("mix_p", F.when(filled, F.least(F.col("mix_owed") / F.col("source_size"), F.lit(1 - 1e-12))).otherwise(F.lit(0.0)))
    targets = checkpointed(targets.withColumnRenamed("source", "at_source"))

    keyed = _keyed(rows, targets, slices)
    sums = keyed.where("mix_key is not null").groupBy("mix_source", "mix_slice").agg(F.sum("mix_size").alias("words"), F.first("mix_owed").alias("owed"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("mix_source").orderBy("mix_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("words_before", before).where("words_before < owed and words_before + words >= owed")
    ends = checkpointed(ends.select(F.col("mix_source").alias("end_source"), F.col("mix_slice").alias("end_slice"), "words_before"))

    at_end = F.col("mix_source").eqNullSafe(F.col("end_source")) & (F.col("mix_slice") == F.col("end_slice"))
    last = keyed.join(ends, at_end)
    head = W.partitionBy("mix_source").orderBy("mix_key", "mix_id", "mix_size", "mix_tie").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("words_before") + F.coalesce(F.sum("mix_size").over(head), F.lit(0))
    # The head goes on while it comes nearer to what is owed.
    last = last.withColumn("ahead", ahead).where(2 * F.col("ahead") + F.col("mix_size") <= 2 * F.col("mix_owed"))
    last = last.groupBy("mix_source").agg(F.max(F.struct("mix_key", "mix_id", "mix_size", "mix_tie")).alias("mix_last")).withColumnRenamed("mix_source", "last_source")

    decisions = targets.join(ends.select("end_source", F.col("end_slice").alias("mix_end")), F.col("at_source").eqNullSafe(F.col("end_source")), "left")
    decisions = decisions.join(last, F.col("at_source").eqNullSafe(F.col("last_source")), "left")
    return rows, checkpointed(decisions.select("at_source", "source_size", "target", "mix_docs", "mix_certain", "mix_p", "mix_end", "mix_last"))


def _copies() -> Column:
    place = F.struct("mix_key", "mix_id", "mix_size", "mix_tie")
    # Only an order that falls short of what is owed (by rounding) has no end slice.
    head = F.when(F.col("mix_end").isNull(), F.lit(True)).when(F.col("mix_slice") == F.col("mix_end"), F.col("mix_last").isNotNull() & (place <= F.col("mix_last"))).otherwise(F.col("mix_slice") < F.col("mix_end"))
    extra = F.when(F.col("mix_key").isNotNull() & head, 1).otherwise(0)
    return F.when(F.col("mix_size") > 0, F.col("mix_certain") + extra).otherwise(F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
    importance: str | None = None,
    slices: int = SLICES,
    seed: str = SEED,
) -> DataFrame:
    """Per document: id, size, source, source_size, target, copies and taken (copies times size)."""
    rows, decisions = decide(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, max_repeat=max_repeat, importance=importance, slices=slices, seed=seed)
    result = _keyed(rows, decisions, slices).withColumn("copies", _copies())
    return result.select(F.col("mix_id").alias(id_col), F.col("mix_size").alias("size"), F.col("mix_source").alias(source_col), "source_size", "target", "copies", (F.col("copies") * F.col("mix_size")).alias("taken"))


def mixed_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT, importance: str | None = None, slices: int = SLICES, seed: str = SEED
) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    A row's copies follow from its draw and its source's decisions, so the texts are not shuffled.
    """
    _, decisions = decide(docs, id_col=id_col, text_col=text_col, source_col=source_col, weights=weights, max_repeat=max_repeat, importance=importance, slices=slices, seed=seed)
    drawn = _drawn(docs, id_col, text_col, source_col, importance, seed)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("mix_row"), *[c.alias(name) for name, c in drawn.items()])
    taken = _keyed(rows, decisions, slices).withColumn("mix_copies", _copies()).where("mix_copies > 0")
    return taken.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("mix_row.*")


def op1_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = """
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) FILTER (size > 0) AS docs FROM rows GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS rank, 3 * source_size AS cap FROM sizes
), weighted AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked
), lefts AS (
  SELECT *, cap::DOUBLE / weight AS height,
         sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS weight_left
  FROM weighted WINDOW f AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT height AS level_height, rank AS level_rank, words_left AS level_words, weight_left AS level_weight FROM lefts
  WHERE words_left * weight <= cap * weight_left ORDER BY height, rank LIMIT 1
), targets AS (
  SELECT source, source_size, docs,
         CASE WHEN level_rank IS NULL OR height < level_height OR (height = level_height AND rank < level_rank) THEN cap::DOUBLE
              ELSE (level_words * weight)::DOUBLE / level_weight::DOUBLE END AS target
  FROM lefts LEFT JOIN levels ON true
), owing AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM targets
), odds AS (
  SELECT *, target - (certain * source_size)::DOUBLE AS owed, least((target - (certain * source_size)::DOUBLE) / source_size, 1 - 1e-12::DOUBLE) AS p FROM owing
), keyed AS (
  SELECT r.doc_id, r.size, o.*, CASE WHEN p > 0 THEN u / (1 - u) / (p / (1 - p) * greatest((r.size * o.docs)::DOUBLE / o.source_size::DOUBLE, 1e-9::DOUBLE)) END AS key
  FROM rows r JOIN odds o ON r.source IS NOT DISTINCT FROM o.source
), ordered AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM keyed
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (certain + CASE WHEN owed > 0 AND 2 * ahead + size <= 2 * owed THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""
