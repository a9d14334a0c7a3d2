"""The ledger as a stream: events once each, and the running latest of each kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_events(events: DataFrame, delay: str = "1 day", key: str = "event_id", time: str = "ts") -> DataFrame:
    """Each event once. On a stream the ids are kept for as long as events may be late, which bounds the state."""
    if events.isStreaming:
        return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def latest_by_type(events: DataFrame, kind: str = "event_type") -> DataFrame:
    """(kind, event_id, n): the newest event of each kind so far, and how many there were."""
    return events.groupBy(kind).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Counts per window and kind (an extra: tumbling, or sliding with ``slide``)."""
    source = events.withWatermark("ts", delay) if events.isStreaming else events
    return source.groupBy(F.window("ts", size, slide or size), "event_type").agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", "event_type", "n")


LIFE_STEPS = ("declared", "checked", "executed")


def followed(steps: DataFrame, known: DataFrame) -> DataFrame:
    """(cost_id, reached, said) of steps (cost_id, seq, kind) that come after those that ``known`` (cost_id, reached) stands for:
    how far a cost is now, and after each step. A step that is not the next one changes nothing; a cost may be checked again."""
    kind = "array<struct<seq:bigint,kind:string,reached:int,accepted:boolean>>"

    def step(so_far, s):
        rank = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LIFE_STEPS]), s["kind"]), F.lit(0)).cast("int")
        fits = ((rank == so_far["reached"] + 1) | ((rank == 2) & (so_far["reached"] == 2)))
        reached = F.when(fits, rank).otherwise(so_far["reached"])
        said = F.struct(s["seq"].cast("long").alias("seq"), s["kind"].alias("kind"), reached.alias("reached"), fits.alias("accepted"))
        return F.struct(reached.alias("reached"), F.concat(so_far["said"], F.array(said)).alias("said"))

    new = steps.groupBy("cost_id").agg(F.array_sort(F.collect_list(F.struct("seq", "kind"))).alias("steps"))
    begin = F.struct(F.coalesce("reached", F.lit(0)).alias("reached"), F.array().cast(kind).alias("said"))
    end = new.join(known.hint("merge"), "cost_id", "left").select("cost_id", F.aggregate("steps", begin, step).alias("end"))
    return end.select("cost_id", "end.reached", "end.said")


def keep_lifecycles(steps: DataFrame, out: str, state: str, checkpoint: str) -> StreamingQuery:
    """Follow a stream of steps (cost_id, seq, kind): Parquet rows (cost_id, seq, kind, state, accepted) in ``out``, the state of
    a cost after each step and whether the step was in order. One small number per cost is kept in ``state``; as it never
    falls, each batch adds the costs that it touched, and a batch that is run again replaces its own files."""
    spark = steps.sparkSession
    kind = f"cost_id {steps.schema['cost_id'].dataType.simpleString()}, reached int"
    spark.createDataFrame([], kind).write.mode("ignore").parquet(f"{state}/batch=-1")

    def keep(rows, batch):
        known = rows.sparkSession.read.schema(f"{kind}, batch long").parquet(state).where(F.col("batch") < batch).groupBy("cost_id").agg(F.max("reached").alias("reached"))
        folder = f"{state}/batch={batch}"
        followed(rows, known).write.mode("overwrite").parquet(folder)
        said = rows.sparkSession.read.parquet(folder).select("cost_id", F.explode("said").alias("s"))
        name = F.when(F.col("s.reached") > 0, F.element_at(F.array(*[F.lit(x) for x in LIFE_STEPS]), F.col("s.reached"))).otherwise("none")
        said.select("cost_id", "s.seq", "s.kind", name.alias("state"), "s.accepted").write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return steps.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_ledger(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def append_to_ledger(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what there is of a deduplicated stream as Parquet, exactly once over restarts."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def maintain_status(stream: DataFrame, apply, checkpoint: str) -> StreamingQuery:
    """Hand each change of the latest-by-kind table to ``apply(rows, batch_id)``."""
    return latest_by_type(stream).writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
