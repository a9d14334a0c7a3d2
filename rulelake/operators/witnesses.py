"""Records that stand for what was seen or done: git snapshots, diffs and provenance, content ids, cost lifecycles, run events.

Lists of a witness are rows with the witness's key, so that any number of witnesses is normalised, checked and digested at
once. Digests are those of canonical CBOR; ids of events are those of their JSON line without the id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cbor_columns as CB
from ..functions import text as T

#: Kinds of changes in the order of witnesses, by the letter of a name-status line.
CHANGE_KINDS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed", "U": "unmerged"}
OID = r"^([0-9a-f]{40}|[0-9a-f]{64})$"


def tree_files(lines: DataFrame, key: str = "commit") -> DataFrame:
    """(key, path, blob_oid) of lines of ``git ls-tree -r``: ``mode kind oid<tab>path``; only files."""
    fields = r"^\S+ blob ([0-9a-f]+)\t(.*)$"
    rows = lines.where(F.col("line").rlike(r"^\S+ blob "))
    return rows.select(key, T.normalize_path(F.regexp_extract("line", fields, 2)).alias("path"), F.regexp_extract("line", fields, 1).alias("blob_oid"))


def submodules(lines: DataFrame, key: str = "commit") -> DataFrame:
    """(key, path, commit_oid) of lines of ``git submodule status``."""
    parts = F.split(F.trim("line"), r"\s+")
    return lines.where(F.size(parts) >= 2).select(key, T.normalize_path(F.element_at(parts, 2)).alias("path"), F.regexp_replace(F.element_at(parts, 1), r"^[-+U ]+", "").alias("commit_oid"))


def name_status(lines: DataFrame, key: str = "diff") -> DataFrame:
    """(key, path, change_kind, old_path) of lines of ``git diff --name-status``; renames and copies keep where they come from."""
    cols = F.split("line", "\t")
    letter = F.substring(F.element_at(cols, 1), 1, 1)
    moved = letter.isin("R", "C")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CHANGE_KINDS.items() for x in pair]), letter), F.lit("unknown"))
    rows = lines.where(F.col("line").rlike(r"\S"))
    path = F.when(moved, F.try_element_at(cols, F.lit(3))).otherwise(F.try_element_at(cols, F.lit(2)))
    return rows.select(key, T.normalize_path(path).alias("path"), kind.alias("change_kind"), F.when(moved, T.normalize_path(F.element_at(cols, 2))).alias("old_path"))


def manifest_hash(paths: DataFrame, key: str = "commit") -> DataFrame:
    """(key, manifest_sha256): the digest of the CBOR array of all distinct paths of a working tree, in order. The paths of one
    tree are gathered, as the digest is that of one value."""
    listed = F.array_sort(F.collect_set(T.normalize_path(F.col("path"))))
    return paths.groupBy(key).agg(CB.sha256(CB.array(listed)).alias("manifest_sha256"))


def unique_rows(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows, where none repeats the keys of another; else an error that names them."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    named = F.concat_ws(" ", F.lit(f"{what} comes twice:"), *[F.col(k).cast("string") for k in keys])
    checked = rows.join(counts, keys)
    return checked.withColumn(keys[-1], F.when(F.col("__n") > 1, F.raise_error(named).cast(rows.schema[keys[-1]].dataType)).otherwise(F.col(keys[-1]))).drop("__n").select(rows.columns)


def snapshot_records(heads: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """(commit, witness_id, files, submodules) of commits (commit, is_clean, manifest_sha256): the digest of what a snapshot says,
    its files and submodules in order of path, the latter left out where there are none."""
    item = lambda row, name: CB.mapping({"path": CB.text(row["path"]), name: CB.text(row[name])})

    def listed(rows: DataFrame, name: str, out: str) -> DataFrame:
        rows = unique_rows(rows, ["commit", "path"], "path")
        pairs = F.array_sort(F.collect_list(F.struct("path", name)))
        return rows.groupBy("commit").agg(F.aggregate(pairs, CB.head(4, F.size(pairs)), lambda made, row: F.concat(made, item(row, name))).alias(out), F.count(F.lit(1)).alias(f"{out}_n"))

    joined = heads.join(listed(files, "blob_oid", "f"), "commit", "left").join(listed(modules, "commit_oid", "m"), "commit", "left")
    empty = F.lit(b"\x80")
    base = {
        "schema_id": CB.text(F.lit("git-snapshot-witness/0")), "schema_version": CB.integer(F.lit(0)), "head_commit_oid": CB.text(checked_oid(F.col("commit"))), "is_clean": CB.boolean(F.col("is_clean")),
        "tracked_files": F.coalesce("f", empty), "submodules": F.coalesce("m", F.lit(CB.NULL)), "working_tree_manifest_sha256": CB.text(F.col("manifest_sha256")),
    }
    return joined.select("commit", CB.sha256(CB.mapping(base)).alias("witness_id"), F.coalesce("f_n", F.lit(0)).alias("files"), F.coalesce("m_n", F.lit(0)).alias("submodules"))


def checked_oid(oid: Column) -> Column:
    """An object id of 40 or 64 hexadecimal digits; anything else is an error."""
    return F.when(oid.rlike(OID), oid).otherwise(F.raise_error(F.concat(F.lit("no object id: "), F.coalesce(oid, F.lit("null")))))


def kind_order(kind: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(k) for k in CHANGE_KINDS.values()]), kind), F.lit(99))


def diff_records(changes: DataFrame, blobs: DataFrame) -> DataFrame:
    """(diff, place, path, change_kind, old_blob_oid, new_blob_oid) of changes (diff, base, head, path, change_kind, old_path) in
    order of path and kind; blobs are (commit, path, blob_oid). An added file has no old blob, a deleted one no new one; a
    path that comes twice with one kind is an error."""
    rows = unique_rows(changes, ["diff", "path", "change_kind"], "change")
    at = lambda side: blobs.select(F.col("commit").alias(f"{side}_commit"), F.col("path").alias(f"{side}_at"), F.col("blob_oid").alias(f"{side}_blob_oid"))
    rows = rows.withColumn("from_path", F.coalesce("old_path", "path"))
    rows = rows.join(at("old"), (F.col("base") == F.col("old_commit")) & (F.col("from_path") == F.col("old_at")) & (F.col("change_kind") != "added"), "left")
    rows = rows.join(at("new"), (F.col("head") == F.col("new_commit")) & (F.col("path") == F.col("new_at")) & (F.col("change_kind") != "deleted"), "left")
    place = F.row_number().over(W.partitionBy("diff").orderBy(F.col("path").cast("binary"), kind_order(F.col("change_kind"))))
    return rows.select("diff", place.alias("place"), "path", "change_kind", "old_blob_oid", "new_blob_oid")


def provenance_bindings(bindings: DataFrame, keys: list[str], repository: str = "repository_id") -> DataFrame:
    """Bindings of artifacts, registry entries or signatures to commits, numbered in order of their keys within a repository; a
    repository without a name and keys that come twice are errors."""
    named = F.when(F.trim(F.coalesce(repository, F.lit(""))) == "", F.raise_error(F.lit("the repository has no name"))).otherwise(F.col(repository))
    rows = unique_rows(bindings.withColumn(repository, named), [repository, *keys], "binding")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(repository).orderBy(*keys)))


#: Domains of ids of links; who must match the ids of another system passes its own.
LINK_TAG, FILE_LINK_TAG, UNRESOLVED_TAG, FACET_TAG = "link_v1", "file_link_v1", "unresolved_link_v1", "has_facet_v1"


def _said(from_col: str) -> dict[str, Column]:
    """What every id of a link says: where it stands and how it is written."""
    return {"from": CB.text(F.col(from_col)), "target": CB.text(F.col("target")), "alias": CB.text(F.col("alias")), "heading": CB.text(F.col("heading")), "embed": CB.boolean(F.col("embed")), "line": CB.integer(F.col("line"))}


def unresolved_ids(links: DataFrame, from_col: str = "from_path", tag: str = UNRESOLVED_TAG) -> DataFrame:
    """Links (from, target, alias, heading, embed, line) with the digest of what they say."""
    return links.withColumn("unresolved_id", CB.sha256(CB.mapping({"tag": CB.text(F.lit(tag))} | _said(from_col))))


def link_ids(links: DataFrame, to_col: str, from_col: str = "from_path", to_file: bool = False, tag: str | None = None) -> DataFrame:
    """Resolved links (with kind) with the digest of the edge that they are, to a document or to a file."""
    ends = {"to_file_path" if to_file else "to": CB.text(F.col(to_col)), "resolution_kind": CB.text(F.col("kind"))}
    return links.withColumn("edge_id", CB.sha256(CB.mapping({"tag": CB.text(F.lit(tag or (FILE_LINK_TAG if to_file else LINK_TAG)))} | _said(from_col) | ends)))


def facet_ids(facets: DataFrame, path_col: str = "path", facet_col: str = "facet", tag: str = FACET_TAG) -> DataFrame:
    """(path, facet) rows with the id of the facet and that of the edge between both."""
    edge = {"tag": CB.text(F.lit(tag)), "doc_path": CB.text(F.col(path_col)), "facet": CB.text(F.col(facet_col))}
    return facets.withColumn("facet_id", F.sha2(facet_col, 256)).withColumn("edge_id", CB.sha256(CB.mapping(edge)))


def events_with_ids(rows: DataFrame, fields: Mapping[str, Column]) -> DataFrame:
    """Events (event_id, event_type, line) of JSON in the order of ``fields``, without those that are null; an event's id is the
    digest of its line without the id."""
    payload = F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))
    made = rows.select(payload.alias("payload"), fields["event_type"].alias("event_type")).withColumn("event_id", F.sha2("payload", 256))
    head = F.regexp_extract("payload", r'^(\{"event_type":"(?:[^"\\]|\\.)*")', 1)
    line = F.concat(head, F.lit(',"event_id":"'), "event_id", F.lit('"'), F.substring("payload", F.length(head) + 1, F.lit(2**31 - 1)))
    return made.select("event_id", "event_type", line.alias("line"))


def run_events(runs: DataFrame, family: str, id_name: str) -> DataFrame:
    """Events of the life of runs (run_id, started_at, ended_at, status, error, and phases array<struct<phase, status, at>>): one when a run
    starts, one per phase that is completed or skipped, one when it ends. ``family`` is projection or ingest."""
    started = F.array(F.struct(F.lit("run.started").alias("event"), F.col("started_at").alias("at"), F.lit(None).cast("string").alias("phase"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("error")))
    phases = F.transform("phases", lambda p: F.struct(F.when(p["status"] == "skipped", "phase.skipped").otherwise("phase.completed").alias("event"), p["at"].alias("at"), p["phase"].alias("phase"), p["status"].alias("status"), F.lit(None).cast("string").alias("error")))
    ended = F.array(F.struct(F.lit("run.completed").alias("event"), F.col("ended_at").alias("at"), F.lit(None).cast("string").alias("phase"), F.col("status"), F.col("error")))
    steps = F.concat(started, F.coalesce(phases, F.array()), F.when(F.col("ended_at").isNotNull(), ended).otherwise(F.array()))
    rows = runs.select("run_id", F.posexplode(steps).alias("step", "s"))
    fields = {"event_type": F.concat(F.lit(f"{family}."), F.col("s.event")), "timestamp": F.col("s.at"), id_name: F.col("run_id"), "phase": F.col("s.phase"), "status": F.col("s.status"), "error": F.col("s.error")}
    return events_with_ids(rows, fields)


def lifecycle_states(events: DataFrame) -> DataFrame:
    """(cost_id, state, faults) of events (cost_id, seq, kind declared, checked or executed, witness_sha256, snapshot_hash): how far a
    cost has come, and what goes against the order: a check or an execution of nothing, a second declaration, a step without
    a snapshot, one whose witness or snapshot is not that of the step before."""
    order = W.partitionBy("cost_id").orderBy("seq")
    rank = F.array_position(F.array(*[F.lit(k) for k in ("declared", "checked", "executed")]), F.col("kind")).cast("int")
    reached = F.coalesce(F.max(rank).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = lambda c: F.last(c, True).over(order.rowsBetween(W.unboundedPreceding, -1))
    fault = (
        F.when(rank.isNull() | (rank == 0), "unknown_kind").when((rank == 1) & (reached > 0), "declared_again").when((rank > 1) & (reached < rank - 1), F.concat(F.col("kind"), F.lit("_too_early"))).when((rank == 3) & (reached == 3), "executed_again")
        .when(F.col("snapshot_hash").isNull(), "snapshot_missing").when(before("witness_sha256") != F.col("witness_sha256"), "witness_differs").when(before("snapshot_hash") != F.col("snapshot_hash"), "snapshot_differs")
    )
    rows = events.withColumn("rank", rank).withColumn("fault", fault)
    done = rows.groupBy("cost_id").agg(F.max(F.when(F.col("fault").isNull(), F.col("rank"))).alias("r"), F.array_sort(F.collect_set("fault")).alias("faults"))
    state = F.coalesce(F.try_element_at(F.array(*[F.lit(k) for k in ("declared", "checked", "executed")]), F.col("r")), F.lit("none"))
    return done.select("cost_id", state.alias("state"), F.array_join("faults", ",").alias("faults"))


def check_witnesses(artifacts: DataFrame) -> DataFrame:
    """(id, sha256, ok) of witnesses (id, content binary, expected): the digest of their bytes, and whether it is the expected one."""
    digest = F.sha2("content", 256)
    return artifacts.select("id", digest.alias("sha256"), F.coalesce(F.col("expected") == digest, F.col("expected").isNull()).alias("ok"))


def observed_paths(git: DataFrame, pull_request: DataFrame) -> DataFrame:
    """(path) that changed: those of the pull request where it names any, else those of the working tree, each once."""
    named = pull_request.limit(1).agg((F.count(F.lit(1)) > 0).alias("named"))
    rows = git.select("path", F.lit(False).alias("pr")).union(pull_request.select("path", F.lit(True)))
    return rows.crossJoin(F.broadcast(named)).where("pr = named").select("path").distinct()


def bundle_faults(programs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(bundle, fault, module) of program bundles: modules (bundle, module_id, sha256, content) that come twice or whose digest is not
    that of their content, and dependencies (bundle, from, to) that name no module of their bundle."""
    twice = programs.groupBy("bundle", "module_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bundle", F.lit("module_twice").alias("fault"), F.col("module_id").alias("module"))
    wrong = programs.where(F.col("content").isNotNull() & (F.sha2("content", 256) != F.col("sha256"))).select("bundle", F.lit("digest_differs").alias("fault"), F.col("module_id").alias("module"))
    ends = dependencies.select("bundle", F.explode(F.array("from", "to")).alias("module_id")).distinct()
    loose = ends.join(programs.select("bundle", "module_id"), ["bundle", "module_id"], "left_anti").select("bundle", F.lit("unknown_module").alias("fault"), F.col("module_id").alias("module"))
    return twice.unionByName(wrong).unionByName(loose)
