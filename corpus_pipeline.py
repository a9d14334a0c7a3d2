"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, documents that hold benchmark
passages go, sources are mixed to their target weights, and the rest is sharded.

A stage takes (spark, docs, sf_dir) and returns documents with the columns they came with; the last stage adds nothing
either, but has its rows in compacted shards under a manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulelake.llm import compaction, decontam, minhash, mixing, toxicity
from rulelake.llm.common import staged, staging_path
from rulelake.session import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model learned from the labelled ones among them."""
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"))
    score = "toxicity"
    while score in {c.lower() for c in docs.columns}:
        score = f"_{score}"
    scored = toxicity.score_toxicity(docs, model, score_col=score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id; rows without an id stay. Rows that repeat an
    id go by their own texts, and of those that repeat id and text one stays. What goes is broadcast where it is little."""
    groups = minhash.near_duplicates(docs.select("doc_id", "text"), with_digest=True)
    dropped = staged(groups.where("not kept").select(F.col("doc_id").alias("dropped_id"), F.col("text_sha256").alias("dropped_text")).distinct(), "dropped")
    few = dropped.count() <= minhash.BROADCAST_NODES
    dropped = F.broadcast(dropped) if few else dropped
    clean = docs.join(dropped, (docs.doc_id == dropped["dropped_id"]) & (F.sha2(docs.text, 256) == dropped["dropped_text"]), "left_anti").select(docs.columns)
    repeated = staged(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("repeated_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("repeated_id"), "repeated")
    if not repeated.limit(1).count():
        return clean
    again = F.broadcast(repeated) if repeated.count() <= minhash.BROADCAST_NODES else repeated
    of_repeated = clean.doc_id == again["repeated_id"]
    return clean.join(again, of_repeated, "left_anti").unionByName(clean.join(again, of_repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, read back from compacted shards under a committed manifest."""
    store = compaction.ShardStore(spark, staging_path(spark, "corpus"))
    for arrival in compaction.arrivals(spark, docs):
        store.append(arrival)
    store.compact()
    store.vacuum()
    return store.read()


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]

#: Tokens of a learned lexicon decide the first stage, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
