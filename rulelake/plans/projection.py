"""The projection store: run-partitioned result tables, retries, vacuum and saved queries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.dag import cut

RUN = "projection_run_id"


class ProjectionStore:
    """Parquet tables under a root, partitioned by the run that wrote them.

    Writing a run again replaces its partition alone, so a retry of a failed phase never doubles rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._kinds: dict[str, StructType] = {}  # of what was written here, as a table without rows has no files to tell

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, rows: DataFrame, run_id: str) -> None:
        self._kinds[name] = rows.schema
        out = rows.withColumn(RUN, F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(RUN).parquet(self.path(name))

    def read(self, name: str, run_id: str | None = None) -> DataFrame:
        reader = self.spark.read
        if name in self._kinds:
            reader = reader.schema(StructType([*self._kinds[name].fields, StructField(RUN, StringType())]))
        rows = reader.parquet(self.path(name)).withColumn(RUN, F.col(RUN).cast("string"))
        return rows.where(F.col(RUN) == run_id) if run_id else rows

    def latest(self, name: str, keys: list[str]) -> DataFrame:
        """The newest run's row of each key."""
        return latest_rows(self.read(name), keys, F.col(RUN))

    def vacuum(self, names: list[str], run_ids: list[str]) -> int:
        """Drop the partitions of runs from tables; returns how many there were."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        count = 0
        for name in names:
            for run_id in run_ids:
                path = jvm.org.apache.hadoop.fs.Path(f"{self.path(name)}/{RUN}={run_id}")
                count += bool(path.getFileSystem(conf).delete(path, True))
        return count


def latest_rows(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key, the last in order: partial maxima before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*[F.col(c) if c in keys else F.col(f"last.{c}") for c in rows.columns])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows that no new row replaces, and the new rows."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def replace_documents(existing: DataFrame, new: DataFrame, document: str) -> DataFrame:
    """All rows of the documents that come anew are replaced."""
    return upsert(existing, new, [document])


def without_runs(rows: DataFrame, runs: DataFrame, run_col: str) -> DataFrame:
    """Rows of other runs."""
    return rows.join(runs.select(run_col), run_col, "left_anti")


def latest_complete_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the complete run that started last."""
    done = runs.where("status = 'complete'")
    return done.groupBy(*keys).agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))


def batch_digests(rows: DataFrame, phase: str, run: Column, batch: str, item: str) -> DataFrame:
    """(batch, items, batch_hash): a digest of the sorted items of each batch of a phase and run."""
    digest = F.sha2(F.concat_ws("|", F.lit(phase), F.first(run), F.array_join(F.array_sort(F.collect_list(F.col(item).cast("string"))), "")), 256)
    return rows.groupBy(batch).agg(F.count(F.lit(1)).alias("items"), digest.alias("batch_hash"))


def accumulate_batches(rows: DataFrame, key: str, order: str, payload: str, most_items: int, most_bytes: int) -> DataFrame:
    """The rows with the number of their batch within their key, from 0 on. In order, a batch is closed once it holds
    ``most_items`` rows or ``most_bytes`` bytes of payload. Rows of a key stream through one task, which holds two counters."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def number(batches):
        import pyarrow as pa

        now, batch, items, size = None, 0, 0, 0
        for rows_ in batches:
            made = []
            for value, raw in zip(rows_.column(key), rows_.column(payload), strict=True):
                if value != now:
                    now, batch, items, size = value, 0, 0, 0
                elif items >= most_items or size >= most_bytes:
                    batch, items, size = batch + 1, 0, 0
                items, size = items + 1, size + (len((raw.as_py() or "").encode()) if isinstance(raw.as_py(), str) else len(raw.as_py() or b""))
                made.append(batch)
            yield pa.RecordBatch.from_arrays([*rows_.columns, pa.array(made, pa.int64())], [*rows_.schema.names, "batch"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(number, f"{kinds}, batch long")


def phase_results(batches: DataFrame) -> DataFrame:
    """(phase, total, successful, failed, status) of (phase, batch, ok) rows: complete, partial or failed."""
    counted = batches.groupBy("phase").agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failed"))
    return counted.withColumn("status", F.when(F.col("failed") == 0, "complete").when(F.col("successful") == 0, "failed").otherwise("partial"))


def retry_failed(batches: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], *, most_attempts: int = 3, first: int = 100, factor: float = 2.0, most: int = 5000) -> DataFrame:
    """Batches (phase, batch, ok, and whatever ``attempt`` needs) after retries of those that failed: (phase, batch, ok,
    attempts, waited_ms).

    A round hands all failed batches to ``attempt(batches, number)``, which gives (phase, batch, ok) back; each round waits
    longer than the one before, up to ``most``. What has gone well is never tried again.
    """
    state = cut(batches.select("phase", "batch", "ok", F.lit(1).alias("attempts"), F.lit(0).cast("long").alias("waited_ms")))
    for number in range(2, most_attempts + 1):
        left = batches.join(state.where("not ok").select("phase", "batch"), ["phase", "batch"], "left_semi")
        if not left.limit(1).count():
            break
        delay = int(min(most, first * factor ** (number - 2)))
        tried = cut(attempt(left, number).select("phase", "batch", F.col("ok").alias("now_ok")))
        joined = state.join(tried, ["phase", "batch"], "left")
        again = F.col("now_ok").isNotNull()
        state = cut(joined.select("phase", "batch", F.coalesce("now_ok", "ok").alias("ok"), F.when(again, F.lit(number)).otherwise(F.col("attempts")).alias("attempts"), (F.col("waited_ms") + F.when(again, F.lit(delay)).otherwise(F.lit(0))).alias("waited_ms")))
    return state


def identical_run(runs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """For each wanted (keys) row the newest complete run with the same keys, and whether the run can be skipped."""
    found = latest_complete_run(runs, keys)
    return wanted.join(found, keys, "left").withColumn("skip", F.col("run_id").isNotNull())


class SavedQueries:
    """Named queries with language, source and tags, known by the digest of what they say."""

    def __init__(self, spark: SparkSession):
        self.spark, self._by_name = spark, {}

    def register(self, name: str, source: str, lang: str = "sql", tags: tuple[str, ...] = ()) -> str:
        said = json.dumps({"name": name, "lang": lang, "source": source, "tags": sorted(tags)}, sort_keys=True)
        digest = hashlib.sha256(said.encode()).hexdigest()
        if name in self._by_name and self._by_name[name][0] != digest:
            raise ValueError(f"{name} is registered with another source")
        self._by_name[name] = (digest, lang, source, tags)
        return digest

    def run(self, name: str) -> DataFrame:
        digest, lang, source, tags = self._by_name[name]
        if lang != "sql":
            raise ValueError(f"{name} is no SQL")
        return self.spark.sql(source)

    def listing(self) -> DataFrame:
        rows = [(n, d, lang, ",".join(tags)) for n, (d, lang, _, tags) in sorted(self._by_name.items())]
        return self.spark.createDataFrame(rows, "name string, artifact_sha256 string, lang string, tags string")
