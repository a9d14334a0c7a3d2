"""Size-tiered compaction of immutable Parquet runs under a versioned manifest.

An arrival is appended as a run: a folder of small shards, one per task, that never changes. Runs of similar size form a
tier; once a tier holds ``fan_in`` runs they are merged into one run of target-sized files, which may fill the next tier.
A merge reads whole runs and coalesces their partitions, so no row is shuffled. A single run whose files are far below
the target is rewritten too. A run whose files have grown to the target is done and is never rewritten, so the tiers end
at target-sized files and each row is written a bounded number of times.

A version of the store is a small JSON manifest that lists its runs. It is written under a temporary name and renamed to
``v<number>.json`` without overwriting: of two writers of the same version one fails, reads the new version and applies
its change again. A reader of an older version keeps its files until that version is vacuumed. Whatever a lost executor
or driver leaves behind is in no manifest, is never read, and goes with a later vacuum.

All columns and rows are kept as they are: nulls, empty texts, repeated rows and columns of any name (but no two columns
of the same name, which Parquet can't hold). An empty table is a run without rows, and its columns are still known.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import table
from .common import staging_path

TARGET_BYTES = 128 << 20
BASE_BYTES = 1 << 20
TIER_RATIO = 4.0
FAN_IN = 4
GRACE_SECONDS = 86_400


@dataclass(frozen=True)
class Run:
    """A folder of immutable shards."""

    name: str
    rows: int
    bytes: int
    files: int

    def tier(self) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / BASE_BYTES, TIER_RATIO)))


@dataclass(frozen=True)
class Manifest:
    """A version of the store."""

    version: int
    schema: str
    runs: tuple[Run, ...]

    def dump(self) -> bytes:
        return json.dumps({"version": self.version, "schema": json.loads(self.schema) if self.schema else None, "runs": [asdict(r) for r in self.runs]}, sort_keys=True).encode()

    @classmethod
    def load(cls, data: bytes) -> Manifest:
        raw = json.loads(data)
        return cls(raw["version"], json.dumps(raw["schema"]) if raw["schema"] else "", tuple(Run(**r) for r in raw["runs"]))


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class ShardStore:
    """A table of runs in a folder that the whole cluster can reach."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.root, self.target_bytes, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    def _run_path(self, run: Run) -> str:
        return f"{self.root}/runs/{run.name}"

    def versions(self) -> list[int]:
        folder = self._path("manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        versions = self.versions()
        if version is None and not versions:
            return Manifest(0, "", ())
        version = versions[-1] if version is None else version
        if version not in versions:
            raise ValueError(f"no version {version} in {self.root}")
        stream = self._fs.open(self._path(f"manifests/v{version:08d}.json"))
        try:
            return Manifest.load(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def commit(self, manifest: Manifest) -> Manifest:
        """Make a version visible, or raise CommitConflict where it exists."""
        temporary = self._path(f"manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(manifest.dump()))
        out.close()
        context = self._hadoop.FileContext.getFileContext(temporary.toUri(), self._conf)
        keep = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(context.makeQualified(temporary), context.makeQualified(self._path(f"manifests/v{manifest.version:08d}.json")), keep)
        except Exception as error:
            self._fs.delete(temporary, False)
            if "FileAlreadyExistsException" in str(error):
                raise CommitConflict(f"version {manifest.version} exists") from error
            raise
        return manifest

    def _change(self, apply) -> Manifest:
        """Commit ``apply(current)``, again from the newer version after each conflict; None leaves all as it is."""
        while True:
            current = self.manifest()
            wanted = apply(current)
            if wanted is None:
                return current
            try:
                return self.commit(Manifest(current.version + 1, *wanted))
            except CommitConflict:
                continue

    def _write(self, df: DataFrame) -> Run:
        name = uuid.uuid4().hex
        path = f"{self.root}/runs/{name}"
        df.write.option("compression", "zstd").parquet(path)
        sizes = [s.getLen() for s in self._fs.listStatus(self._path(f"runs/{name}")) if s.getPath().getName().startswith("part-")]
        rows = self.spark.read.schema(df.schema).parquet(path).count()  # from the footers
        return Run(name, rows, sum(sizes), len(sizes))

    def append(self, df: DataFrame) -> Manifest:
        """Write an arrival as a run of small shards, and commit it."""
        schema = df.schema.json()
        before = self.manifest()
        if before.schema and _kinds(before.schema) != _kinds(schema):
            raise ValueError("the arrival's columns differ from the store's")
        run = self._write(df)
        return self._change(lambda now: (now.schema or schema, (*now.runs, run)))

    def done(self, run: Run) -> bool:
        """Whether a run's files are of target size: what a merge makes of more than the target's bytes is."""
        return 2 * run.bytes >= run.files * self.target_bytes

    def pending(self, manifest: Manifest) -> list[Run]:
        """The runs that the next merge takes: a full tier, the smallest first, else a run of undersized files."""
        tiers: dict[int, list[Run]] = {}
        for run in manifest.runs:
            if not self.done(run):
                tiers.setdefault(run.tier(), []).append(run)
        for tier in sorted(tiers):
            if len(tiers[tier]) >= self.fan_in:
                return tiers[tier]
        for run in manifest.runs:
            if run.files > 2 * self._files(run.bytes):
                return [run]
        return []

    def _files(self, size: int) -> int:
        return max(1, math.ceil(size / self.target_bytes))

    def compact(self) -> Manifest:
        """Merge until no tier is full."""
        while merged := self.pending(self.manifest()):
            frame = self._frame(merged, self.manifest().schema)
            run = self._write(frame.coalesce(self._files(sum(r.bytes for r in merged))))
            if run.rows != sum(r.rows for r in merged):
                raise RuntimeError("a merge lost rows")
            gone = set(merged)

            def swap(now, gone=gone, run=run):
                if not gone <= set(now.runs):
                    return None  # another writer has merged them
                return now.schema, (*(r for r in now.runs if r not in gone), run)

            self._change(swap)
        return self.manifest()

    def _frame(self, runs, schema: str) -> DataFrame:
        kinds = StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kinds).parquet(*[self._run_path(r) for r in runs])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        manifest = self.manifest(version)
        if not manifest.runs:
            raise ValueError("the store is empty")
        return self._frame(manifest.runs, manifest.schema)

    def vacuum(self, keep: int = 1, grace_seconds: float = GRACE_SECONDS) -> int:
        """Drop all but the newest ``keep`` versions and the runs that only those had; folders in no manifest, left by
        writers that died, go after the grace time. Returns the number of runs deleted."""
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]
        needed = {r.name for v in kept for r in self.manifest(v).runs}
        superseded = {r.name for v in old for r in self.manifest(v).runs} - needed
        for version in old:
            self._fs.delete(self._path(f"manifests/v{version:08d}.json"), False)
        folder, count = self._path("runs"), 0
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            name = status.getPath().getName()
            stale = name not in needed and time.time() - status.getModificationTime() / 1000 > grace_seconds
            if name in superseded or stale:
                count += self._fs.delete(status.getPath(), True)
        return count


def _kinds(schema: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in StructType.fromJson(json.loads(schema)).fields]


def arrivals(spark: SparkSession, df: DataFrame, count: int = 2 * FAN_IN) -> list[DataFrame]:
    """A table as ``count`` frames, so that some tier fills even where they fall into two: whole files where it is read
    from so many, so that each file is read once, else its rows by their digest."""
    scan = df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LogicalRelation"
    files = sorted(df.inputFiles()) if scan else []
    if len(files) >= count:
        return [spark.read.schema(df.schema).parquet(*files[k::count]) for k in range(count)]
    return [df.where(F.pmod(F.xxhash64(*[f"`{c.replace('`', '``')}`" for c in df.columns]), F.lit(count)) == k) for k in range(count)]


def op3_size_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ShardStore(spark, staging_path(spark, "shards"))
    for arrival in arrivals(spark, table(spark, sf_dir, "documents")):
        store.append(arrival)
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", F.col("text"), "lang", "source", "n_chars")


OP3_SQL = "SELECT doc_id, text, lang, source, n_chars FROM documents"
