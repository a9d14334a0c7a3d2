"""File sources: folders, manifests, notes, bundles, artifacts, ledgers."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.canonical import canonical_json, decode_cbor, encode_cbor, json_sha256
from ..operators.dag import cut

# Folders that are never walked into (fixed values); a name that ends with * stands for all that begin so.
SKIPPED_DIRS = (".git", "target", "out", "node_modules", ".venv", ".mypy_cache", "logs", "surrealdb*")


def walk(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), with_content: bool = True) -> DataFrame:
    """(path, size, mtime, content) of the files under a folder, without skipped folders and ignored paths.

    Paths are relative. Spark lists and reads the files, so any file system works and contents stay on the executors;
    without content only the listing is used. The reader gives no rows for files without bytes; those are listed by the
    executors, a folder per row, level by level, so that no listing goes through the driver.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = lambda df: df.withColumn("path", F.regexp_replace("path", r"^\w+:/*", "/"))
    empty = plain(empty_files(spark, root))
    files = plain(files.select("path", "modificationTime", "length", "content")).unionByName(empty.select("path", "modificationTime", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    base = re.sub(r"^\w+:/*", "/", root.rstrip("/")) + "/"
    path = F.regexp_replace("path", "^" + re.escape(base), "")
    out = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if with_content else []))
    return kept_paths(out, ignore)


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime) of the files without bytes under a folder, from listings that executors make."""
    from pyarrow import fs

    def opened(uri: str):
        return fs.FileSystem.from_uri(uri) if re.match(r"\w+:/", uri) else (fs.LocalFileSystem(), uri)

    def listed(batches):
        for batch in batches:
            rows = []
            for uri in batch.column(0).to_pylist():
                system, path = opened(uri)
                prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
                for info in system.get_file_info(fs.FileSelector(path)):
                    folder = info.type == fs.FileType.Directory
                    if folder or (info.type == fs.FileType.File and not info.size):
                        rows.append((prefix + info.path, folder, info.mtime))
            columns = list(zip(*rows, strict=True)) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.timestamp("us", "UTC"))], ["path", "folder", "modificationTime"])

    jvm = spark._jvm.org.apache.hadoop.fs.Path(root)
    front = spark.createDataFrame([(jvm.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm).toString().replace("file:/", "/", 1).replace("//", "/", 1) if root.startswith(("/", "file:")) else root,)], "path string")
    found = None
    while True:
        level = cut(front.repartition(max(1, min(front.count(), 10_000))).mapInArrow(listed, "path string, folder boolean, modificationTime timestamp"))
        empty = level.where("not folder").select("path", "modificationTime")
        found = empty if found is None else found.unionByName(empty)
        front = level.where("folder").select("path")
        if not front.limit(1).count():
            return found


def kept_paths(files: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose relative path lies in no skipped folder and is not ignored."""
    skipped = "|".join(re.escape(d[:-1]) + "[^/]*" if d.endswith("*") else re.escape(d) for d in SKIPPED_DIRS)
    out = files.where(~F.col("path").rlike(rf"(^|/)({skipped})/"))
    for pattern in ignore:
        out = out.where(~F.col("path").rlike(ignore_regex(pattern)))
    return out


def listed_paths(listings: DataFrame, root: str = "") -> DataFrame:
    """(path) of (content) rows that hold what ``git ls-files -co --exclude-standard -z`` says: paths between zero bytes, under a
    root and relative to it, in no skipped folder; paths that are no UTF-8 are left out."""
    rows = listings.select(F.explode(F.split(F.col("content").cast("string"), "\0")).alias("path")).where((F.col("path") != "") & ~F.contains("path", F.lit("\ufffd")))
    if root:
        rows = rows.where(F.startswith("path", F.lit(f"{root}/"))).select(F.substring("path", len(root) + 2, 2**31 - 1).alias("path"))
    return kept_paths(rows.select(T.normalize_path(F.col("path")).alias("path")).distinct())


def ignore_regex(pattern: str) -> str:
    """An expression over relative file paths for an ignore pattern; a folder takes all that is in it."""
    pattern = pattern.strip()
    if not pattern or pattern[0] in "#!":
        return r"\z\A"  # matches nothing
    only_dirs = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    anchored = pattern.startswith("/")
    body = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in pattern.removeprefix("/"))
    start = "^" if anchored or "/" in pattern.strip("/") else "(^|/)"
    return f"{start}{body}" + ("/" if only_dirs else "(/|$)")


def directory_snapshot(files: DataFrame) -> DataFrame:
    """(path, sha256, size) of walked files."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), "size")


def snapshot_hash(snapshot: DataFrame) -> DataFrame:
    """One digest of a snapshot, whatever the order of its rows, and the number of files: rows are digested, then all
    digests that begin with the same three hexadecimal digits in order, then those 4,096 at most."""
    row = F.sha2(F.concat_ws("\0", "path", "sha256"), 256)
    buckets = snapshot.select(row.alias("digest")).groupBy(F.substring("digest", 1, 3).alias("bucket")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("digest")), ""), 256).alias("digest"), F.count(F.lit(1)).alias("files"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda b: b["digest"])
    return buckets.agg(F.sha2(F.array_join(ordered, ""), 256).alias("snapshot_hash"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def file_texts(files: DataFrame) -> DataFrame:
    """(path, text) of walked files, bytes that are no UTF-8 replaced."""
    return files.select("path", F.col("content").cast("string").alias("text"))


DEPENDENCY = "path string, kind string, section string, name string, package_name string, version_req string, source_kind string"
SECTIONS = ("dependencies", "dev-dependencies", "build-dependencies")
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def npm_source(req: str) -> str:
    low = req.lower()
    if low.startswith(("git+", "github:")) or "github.com" in low or "git@" in low:
        return "git"
    if low.startswith(("file:", "link:")):
        return "path"
    return "workspace" if low.startswith("workspace:") else "registry"


def cargo_dependency(name: str, spec: Any) -> tuple[str | None, str | None, str]:
    """(package, version, source) of a dependency's entry."""
    if isinstance(spec, str):
        return None, spec, "registry"
    source = "git" if "git" in spec else "path" if "path" in spec else "workspace" if spec.get("workspace") else "registry"
    return spec.get("package"), spec.get("version"), source


def parse_manifest(path: str, text: str) -> list[tuple]:
    """Dependency rows of a Cargo.toml or package.json; a file that does not parse is one row of section ``invalid``."""
    rows = []
    try:
        if path.endswith("Cargo.toml"):
            raw = tomllib.loads(text)
            tables = [(s, raw.get(s, {})) for s in SECTIONS]
            tables += [("workspace.dependencies", raw.get("workspace", {}).get("dependencies", {}))]
            for name, target in (raw.get("target") or {}).items():
                tables += [(f"target.{name}.{s}", target.get(s, {})) for s in SECTIONS]
            for section, entries in tables:
                rows += [(path, "cargo", section, n, *cargo_dependency(n, spec)) for n, spec in entries.items()]
        else:
            raw = json.loads(text)
            for section in NPM_SECTIONS:
                rows += [(path, "npm", section, n, None, str(req), npm_source(str(req))) for n, req in (raw.get(section) or {}).items()]
    except (ValueError, AttributeError, TypeError):
        return [(path, "cargo" if path.endswith("Cargo.toml") else "npm", "invalid", "", None, None, "unknown")]
    return rows


def parse_cargo_lock(path: str, text: str) -> list[tuple]:
    rows = []
    for entry in tomllib.loads(text).get("package", []):
        source = entry.get("source", "")
        rows.append((path, "cargo", "lock", entry["name"], None, entry.get("version"), "git" if source.startswith("git+") else "registry" if source else "path"))
    return rows


def _by_file(files: DataFrame, parse, schema: str) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [row for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in parse(path, text or "")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[part.split(" ", 1)[1]]) for c, part in zip(columns, schema.split(", "), strict=True)], names)

    return files.select("path", "text").mapInArrow(run, schema)


def dependencies(texts: DataFrame) -> DataFrame:
    """Dependency rows of all manifests among (path, text) rows."""
    return _by_file(texts.where(F.col("path").rlike(r"(^|/)(Cargo\.toml|package\.json)$")), parse_manifest, DEPENDENCY)


def lock_entries(texts: DataFrame) -> DataFrame:
    return _by_file(texts.where(F.col("path").rlike(r"(^|/)Cargo\.lock$")), parse_cargo_lock, DEPENDENCY)


def manifests_and_locks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, kind) of manifests, and of lock files, by name alone."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = F.when(F.startswith(name, F.lit("Cargo")), "cargo").otherwise("npm")
    manifests = files.where(name.isin("Cargo.toml", "package.json")).select("path", kind.alias("kind"))
    locks = files.where(name.isin("Cargo.lock", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock")).select("path", kind.alias("kind"))
    return manifests, locks


def frontmatter(text: str) -> tuple[dict[str, Any], str]:
    """Fields of a ``---`` block at the start of a note, and the rest: scalars, inline and dashed lists."""
    text = text.removeprefix("﻿")
    match = re.match(r"---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text, re.DOTALL)
    if match is None:
        return {}, text
    fields: dict[str, Any] = {}
    key = None
    for line in match[1].splitlines():
        item = re.match(r"\s*-\s+(.*)$", line)
        pair = re.match(r"([A-Za-z_][\w-]*)\s*:\s*(.*)$", line)
        if item and key is not None:
            if not isinstance(fields.get(key), list):
                fields[key] = []
            fields[key].append(_scalar(item[1]))
        elif pair:
            key, value = pair[1], pair[2].strip()
            if value.startswith("[") and value.endswith("]"):
                fields[key] = [_scalar(v) for v in value[1:-1].split(",") if v.strip()]
            else:
                fields[key] = _scalar(value) if value else None
    return fields, text[match.end() :]


def _scalar(raw: str) -> Any:
    raw = raw.strip()
    if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "\"'":
        return raw[1:-1]
    if raw in ("true", "false"):
        return raw == "true"
    return int(raw) if re.fullmatch(r"-?\d+", raw) else raw


NOTE = "path string, name string, role string, type string, title string, layer string, canonical boolean, aliases array<string>, facets array<string>, invariant_id string, body string"


def parse_note(path: str, text: str) -> list[tuple]:
    fields, body = frontmatter(text)
    heading = re.search(r"^\s*#(?!#)\s*(.*?)\s*#*\s*$", body, re.MULTILINE)
    name = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    many = lambda v: [str(x) for x in v] if isinstance(v, list) else [] if v is None else [str(v)]
    one = lambda v: None if v is None else str(v)
    title = fields.get("title") or (heading[1] if heading and heading[1] else name)
    return [(path, name, one(fields.get("role")), one(fields.get("type")), str(title), one(fields.get("layer")), fields.get("canonical") is True, many(fields.get("aliases")), many(fields.get("facets")), one(fields.get("invariant_id")), body)]


def notes(texts: DataFrame) -> DataFrame:
    """Markdown notes with the fields of their frontmatter."""
    return _by_file(texts.where(F.endswith("path", F.lit(".md"))), parse_note, NOTE)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw) of text files, lines counted from 1 within each file.

    Files are read in splits. A split's lines are numbered by themselves, and each split begins after as many lines as the
    splits before it in its file hold, of which there is one row per split.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = rows.withColumn("place", F.row_number().over(W.partitionBy("file", "block").orderBy("at")))
    return within.join(F.broadcast(before.select("file", "block", "before")), ["file", "block"]).select("file", (F.col("before") + F.col("place")).alias("line"), F.col("value").alias("raw"))


def projected_frontmatter(texts: DataFrame) -> DataFrame:
    """(path, fm_title, fm_role, fm_type, fm_canonical, has_frontmatter) of (path, text) rows, by expressions over the block
    alone: single-line values without their quotes, and booleans that are written as such."""
    block = F.regexp_extract("text", r"(?s)\A\ufeff?---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)
    value = lambda key: F.regexp_replace(F.trim(F.regexp_extract("block", rf"(?m)^{key}[ \t]*:[ \t]*(.*?)[ \t]*$", 1)), "^[\"'](.*)[\"']$", "$1")
    field = lambda key: F.when(value(key) != "", value(key))
    rows = texts.select("path", block.alias("block"))
    return rows.select("path", field("title").alias("fm_title"), field("role").alias("fm_role"), field("type").alias("fm_type"), F.when(value("canonical") == "true", True).when(value("canonical") == "false", False).alias("fm_canonical"), (F.col("block") != "").alias("has_frontmatter"))


def bundle_digests(texts: DataFrame) -> DataFrame:
    """The (text, sidecar) rows with the digest of the text's canonical JSON, and whether the sidecar, where there is one,
    begins with it."""
    made = texts.withColumn("sha256", json_sha256(F.col("text")))
    return made.withColumn("sidecar_ok", F.element_at(F.split("sidecar", r"\s+"), 1) == F.col("sha256"))


def ledger_rows(spark: SparkSession, path: str) -> DataFrame:
    """Events of a JSON-lines ledger, which is one file: (line, event_id, event_type, timestamp, payload, raw). Blank lines
    count but hold none; a line that is no JSON has no payload."""
    rows = numbered_lines(spark, path).where(F.col("raw").rlike(r"\S"))
    payload = F.try_parse_json("raw")
    get = lambda key: F.try_variant_get(payload, f"$.{key}", "string")
    return rows.select("line", get("event_id").alias("event_id"), get("event_type").alias("event_type"), get("timestamp").alias("timestamp"), payload.alias("payload"), "raw")


def load_bundle(text: str, sidecar: str | None = None) -> tuple[dict, str]:
    """A JSON bundle and the digest of its canonical form, which the sidecar must name if there is one."""
    value = json.loads(text)
    digest = hashlib.sha256(canonical_json(value).encode()).hexdigest()
    if sidecar is not None and sidecar.split()[0] != digest:
        raise ValueError(f"bundle hash {digest} is not that of its sidecar")
    return value, digest


class ArtifactStore:
    """Artifacts by kind and the digest of their canonical CBOR, each written once, with a JSON view beside it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop.Path(self.root))

    def put(self, kind: str, value: Any) -> str:
        data = encode_cbor(value)
        digest = hashlib.sha256(data).hexdigest()
        for extension, body in (("cbor", data), ("json", canonical_json(value).encode())):
            path = self._hadoop.Path(f"{self.root}/{kind}/{digest}.{extension}")
            if not self._fs.exists(path):
                temporary = self._hadoop.Path(f"{self.root}/{kind}/_{digest}.{extension}")
                out = self._fs.create(temporary, True)
                out.write(bytearray(body))
                out.close()
                self._fs.rename(temporary, path)
        return digest

    def get(self, kind: str, digest: str) -> Any:
        stream = self._fs.open(self._hadoop.Path(f"{self.root}/{kind}/{digest}.cbor"))
        try:
            data = bytes(stream.readAllBytes())
        finally:
            stream.close()
        if hashlib.sha256(data).hexdigest() != digest:
            raise ValueError(f"artifact {digest} does not match its name")
        return decode_cbor(data)

    def listing(self) -> DataFrame:
        """(kind, sha256, extension, bytes), from the listing alone."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        parts = [F.regexp_extract("path", r"([^/]+)/([0-9a-f]+)\.(\w+)$", k) for k in (1, 2, 3)]
        return files.select(*[p.alias(n) for p, n in zip(parts, ("kind", "sha256", "extension"), strict=True)], F.col("length").alias("bytes"))

    def resolve(self, prefix: str) -> DataFrame:
        """Artifacts of any kind whose digest starts so."""
        return self.listing().where(F.startswith("sha256", F.lit(prefix)) & (F.col("extension") == "cbor"))


def observations(texts: DataFrame, patterns: dict[str, str], ignore_case: bool = True) -> DataFrame:
    """(diff, path, line, col) of every occurrence of patterns in (path, text) rows."""
    found = F.array(*[F.struct(F.lit(d).alias("diff"), T.observed_places(F.col("text"), p, ignore_case).alias("places")) for d, p in sorted(patterns.items())])
    rows = texts.select("path", F.explode(found).alias("o")).select("path", "o.diff", F.explode("o.places").alias("at"))
    return rows.select("diff", "path", "at.line", "at.col")


def observe(texts: DataFrame, patterns: dict[str, str], ignore_case: bool = True) -> DataFrame:
    """(diff, value, unit, first_path, first_line, first_col) of patterns counted over (path, text) rows, a row per pattern, with
    the place of its first occurrence in order of paths. Each text gives one count and one place per pattern before the shuffle."""
    found = F.array(*[F.struct(F.lit(d).alias("diff"), T.observed_places(F.col("text"), p, ignore_case).alias("places")) for d, p in sorted(patterns.items())])
    rows = texts.select("path", F.explode(found).alias("o")).select("path", "o.diff", F.coalesce(F.size("o.places"), F.lit(0)).alias("n"), F.try_element_at("o.places", F.lit(1)).alias("at"))
    first = F.min(F.when(F.col("n") > 0, F.struct("path", "at.line", "at.col")))
    counted = rows.groupBy("diff").agg(F.sum("n").alias("value"), first.alias("first"))
    return counted.select("diff", "value", F.lit("count").alias("unit"), F.col("first.path").alias("first_path"), F.col("first.line").alias("first_line"), F.col("first.col").alias("first_col"))
