"""Verification of an event ledger as frames: each line by itself, what it refers to, and events against one another.

A ledger is rows (line, raw) of JSON text, as ``sources.files.ledger_rows`` reads them. Artifacts are rows (kind, sha256,
actual_sha256, bytes, content), registries rows (registry_hash, schemas, scopes). The outcome is issues (line, event_id,
event_type, issue, detail). An event's id is the digest of its own line without the id.

Every check is a filter of one row or an equi-join by id or digest, so a ledger of any length is verified in a fixed
number of shuffles. Where an id stands on several lines, its last line is the one that others refer to. Events and
artifacts are joined by sorted partitions: sizes guessed for a few columns of them are far too small, and a broadcast of
such a side would go through the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fresh_folder

REF = "struct<kind:string,schema_id:string,sha256:string,size_bytes:bigint,path:string>"
EVENT = (
    "struct<event_id:string,event_type:string,timestamp:string,cost_declared_event_id:string,admissibility_checked_event_id:string,snapshot_hash:string,facts_bundle_hash:string,lens_id:string,lens_hash:string,"
    "lens_activation_event_id:string,registry_hash:string,scope_id:string,passed:boolean,files_scanned:bigint,violations:bigint,program:struct<module:string,scope:string>,ingest_run_id:string,projection_run_id:string,artifact_kind:string,"
    + ",".join(f"{r}:{REF}" for r in ("witness", "snapshot_ref", "program_bundle_ref", "facts_bundle_ref", "plan_witness", "config", "coverage", "ingest_run", "artifact"))
    + ">"
)
COST, CHECKED, EXECUTED = "cost.declared", "admissibility.checked", "admissibility.executed"
LENS, PLAN, LINT, CHANGE, DELTA = "lens.activated", "plan.created", "rust.ir_lint.completed", "meta.change.checked", "meta.interpretation.delta"
#: Schemas of witnesses that bind a lens, of plans and of lint runs (fixed values).
LENS_WITNESS, PLAN_WITNESSES, LINT_WITNESS = "admissibility-witness/2", ("plan-witness/1", "plan-witness/2"), "rust-ir-lint-witness/1"

#: Fields without which an event of a type can't be read.
REQUIRED = {
    COST: ("timestamp", "witness", "snapshot_ref", "program"),
    CHECKED: ("timestamp", "witness", "snapshot_ref", "program", "cost_declared_event_id"),
    EXECUTED: ("timestamp", "witness", "snapshot_ref", "program", "cost_declared_event_id", "admissibility_checked_event_id"),
    LENS: ("timestamp", "lens_id", "lens_hash", "program"),
    CHANGE: ("timestamp",),
    DELTA: ("timestamp", "witness", "snapshot_hash"),
    PLAN: ("timestamp", "plan_witness"),
    LINT: ("timestamp", "witness", "scope_id", "passed", "files_scanned", "violations"),
    "ingest.": ("timestamp", "ingest_run_id"),
    "projection.": ("timestamp", "projection_run_id"),
    "engine.": ("timestamp", "artifact_kind", "artifact"),
    "court.": ("timestamp", "artifact_kind", "artifact"),
}
#: References whose artifacts are looked up, and those whose schemas the event's registry must know.
HELD = {COST: ("witness", "snapshot_ref", "program_bundle_ref"), CHECKED: ("facts_bundle_ref",), PLAN: ("plan_witness",), LINT: ("witness",), "ingest.": ("config", "coverage", "ingest_run"), "engine.": ("artifact",), "court.": ("artifact",)}
REGISTERED = {COST: ("witness", "snapshot_ref", "program_bundle_ref"), CHECKED: ("witness", "snapshot_ref", "program_bundle_ref", "facts_bundle_ref"), EXECUTED: ("witness", "snapshot_ref", "program_bundle_ref", "facts_bundle_ref"), PLAN: ("plan_witness",), LINT: ("witness",)}
#: What an execution must share with the check that it refers to, and a check with its declaration.
SHARED = {
    CHECKED: {"witness.sha256": "witness", "snapshot_ref.sha256": "snapshot", "program_bundle_ref.sha256": "program_bundle", "snapshot_hash": "snapshot_hash"},
    EXECUTED: {"cost_declared_event_id": "cost", "witness.sha256": "witness", "snapshot_ref.sha256": "snapshot", "program_bundle_ref.sha256": "program_bundle", "snapshot_hash": "snapshot_hash", "facts_bundle_ref.sha256": "facts_bundle", "facts_bundle_hash": "facts_hash"},
}
BASE = ("line", "event_id", "event_type")


def of_type(kind: str, column: str = "event_type") -> Column:
    """Whether an event is of a type, or of a family where the name ends with a dot."""
    return F.startswith(column, F.lit(kind)) if kind.endswith(".") else F.col(column) == kind


def _any(kinds) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(of_type(k), F.lit(False)) for k in kinds])


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with id, type, the event, and the digest of the line without its id; a line that is no JSON has no event."""
    value = F.col("value")
    body = F.regexp_replace("raw", r'"event_id":"(?:[^"\\]|\\.)*",?', "")
    get = lambda key: F.try_variant_get(value, f"$.{key}", "string")
    lines = lines.select("line", "raw", F.try_parse_json("raw").alias("value"))  # once for all that is taken from it
    return lines.select("line", get("event_id").alias("event_id"), get("event_type").alias("event_type"), value.isNotNull().alias("is_json"), F.from_json("raw", EVENT).alias("e"), F.sha2(body, 256).alias("computed_id"))


def _issues(rows: DataFrame, checks: list[tuple[Column, str, Column | None]]) -> DataFrame:
    """An issue for each check that holds of a row: (when, issue, detail)."""
    found = F.array(*[F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(issue).alias("issue"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))) for when, issue, detail in checks])
    return rows.select(*BASE, F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f")).select(*BASE, "f.issue", "f.detail")


def line_issues(events: DataFrame) -> DataFrame:
    """What is wrong with lines by themselves."""
    e = lambda name: F.col(f"e.{name}")
    known = _any(REQUIRED)
    lacking = lambda kind: F.array_join(F.filter(F.array(*[F.when(e(f).isNull(), F.lit(f)) for f in REQUIRED[kind]]), lambda f: f.isNotNull()), ",")
    missing = reduce(lambda made, kind: F.when(of_type(kind), lacking(kind)).otherwise(made), REQUIRED, F.lit(""))
    events = events.withColumn("missing", missing)  # once for all checks
    missing = F.col("missing")
    sound = known & (missing == "")
    deciding = _any((COST, CHECKED, EXECUTED))
    bound = (e("lens_id").isNull() | e("lens_hash").isNull() | e("lens_activation_event_id").isNull()) & (e("witness.schema_id") == LENS_WITNESS)
    return _issues(events, [
        (~F.col("is_json"), "invalid_json", None),
        (F.col("is_json") & F.col("event_id").isNull(), "missing_event_id", None),
        (F.col("is_json") & F.col("event_type").isNull(), "missing_event_type", None),
        (F.col("event_type").isNotNull() & ~known, "unknown_event_type", F.col("event_type")),
        (known & (missing != ""), "unreadable_event", missing),
        (sound & (F.col("event_id") != F.col("computed_id")), "event_id_mismatch", F.col("computed_id")),
        (sound & deciding & e("snapshot_hash").isNull(), "snapshot_hash_missing", None),
        (sound & (F.col("event_type") == COST) & (e("snapshot_hash") != e("snapshot_ref.sha256")), "snapshot_hash_is_not_its_reference", e("snapshot_hash")),
        (sound & (F.col("event_type") == CHECKED) & (e("facts_bundle_hash") != e("facts_bundle_ref.sha256")), "facts_hash_is_not_its_reference", e("facts_bundle_hash")),
        (sound & (F.col("event_type") == CHECKED) & bound, "lens_activation_missing", None),
        (sound & (F.col("event_type") == PLAN) & ~e("plan_witness.schema_id").isin(*PLAN_WITNESSES), "plan_schema_unknown", e("plan_witness.schema_id")),
        (sound & (F.col("event_type") == LINT) & (e("witness.schema_id") != LINT_WITNESS), "lint_schema_unknown", e("witness.schema_id")),
    ])


def _references(events: DataFrame, by_type: dict[str, tuple[str, ...]]) -> DataFrame:
    """A row per reference of the events: label and ref, beside what an event says itself."""
    names = sorted({n for names in by_type.values() for n in names})
    wanted = {n: _any(kind for kind, has in by_type.items() if n in has) for n in names}
    refs = F.filter(F.array(*[F.when(wanted[n] & F.col(f"e.{n}").isNotNull(), F.struct(F.lit(n).alias("label"), F.col(f"e.{n}").alias("ref"))) for n in names]), lambda r: r.isNotNull())
    return events.select(*BASE, "e", F.explode(refs).alias("r")).select(*BASE, "e", "r.label", "r.ref")


def artifact_issues(events: DataFrame, artifacts: DataFrame) -> DataFrame:
    """References whose artifact is missing, is another one, or says something else than the event."""
    held = artifacts.select(F.col("kind").alias("a_kind"), F.col("sha256").alias("a_sha"), "actual_sha256", F.col("bytes").alias("a_bytes"), "content").hint("merge")
    rows = _references(events, HELD).join(held, (F.col("ref.kind") == F.col("a_kind")) & (F.col("ref.sha256") == F.col("a_sha")), "left")
    said = lambda path, kind="string": F.get_json_object("content", f"$.{path}").cast(kind)
    here, witness = F.col("a_sha").isNotNull(), F.col("label") == "witness"
    stem, folder = F.regexp_extract("ref.path", r"([^/]*?)(\.[^./]*)?$", 1), F.regexp_extract("ref.path", r"^(.*)/[^/]*$", 1)
    differs = lambda kind, path, field: (F.col("event_type") == kind) & witness & (said(path, dict(rows.select(f"e.{field}").dtypes)[field.split(".")[-1]]) != F.col(f"e.{field}"))
    return _issues(rows, [
        (F.col("ref.path").isNotNull() & ((stem != F.col("ref.sha256")) | (folder != F.col("ref.kind"))), "artifact_path_mismatch", F.col("label")),
        (~here, "artifact_missing", F.col("label")),
        (F.col("actual_sha256") != F.col("ref.sha256"), "artifact_hash_mismatch", F.col("label")),
        (F.col("a_bytes") != F.col("ref.size_bytes"), "artifact_size_mismatch", F.col("label")),
        (here & F.col("label").isin("witness", "plan_witness") & F.try_parse_json("content").isNull(), "artifact_unreadable", F.col("label")),
        (differs(COST, "program.module", "program.module"), "witness_of_another_module", None),
        (differs(COST, "program.scope", "program.scope"), "witness_of_another_scope", None),
        (differs(COST, "program.snapshot_hash", "snapshot_hash"), "witness_of_another_snapshot", None),
        ((F.col("event_type") == PLAN) & (said("schema_id") != F.col("ref.schema_id")), "plan_schema_is_not_its_reference", said("schema_id")),
        ((F.col("event_type") == LINT) & (said("schema_id") != F.col("ref.schema_id")), "lint_schema_is_not_its_reference", said("schema_id")),
        (differs(LINT, "passed", "passed"), "lint_passed_differs", None),
        (differs(LINT, "files_scanned", "files_scanned"), "lint_files_differ", None),
        ((F.col("event_type") == LINT) & (F.size(F.from_json(F.get_json_object("content", "$.violations"), "array<string>")) != F.col("e.violations")), "lint_violations_differ", None),
    ])


def registry_issues(events: DataFrame, registries: DataFrame) -> DataFrame:
    """Registries that are missing, and schemas and scopes that an event's registry does not know."""
    kept = registries.select(F.col("registry_hash").alias("r_hash"), "schemas", "scopes")
    mine = events.where(F.col("e.registry_hash").isNotNull() & _any(REGISTERED)).join(kept, F.col("e.registry_hash") == F.col("r_hash"), "left")
    scope = F.when(F.col("event_type") == LINT, F.col("e.scope_id")).when(F.col("event_type") != PLAN, F.col("e.program.scope"))
    own = _issues(mine, [(F.col("r_hash").isNull(), "registry_missing", F.col("e.registry_hash")), (~F.array_contains("scopes", scope), "scope_not_registered", scope)])
    refs = _references(events.where(F.col("e.registry_hash").isNotNull()), REGISTERED).join(kept, F.col("e.registry_hash") == F.col("r_hash"))
    schema = F.col("ref.schema_id")
    return own.unionByName(_issues(refs, [(~F.array_contains("schemas", schema), "schema_not_registered", F.concat_ws(":", "label", schema))]))


def cross_issues(events: DataFrame) -> DataFrame:
    """Repeated ids, and references between events: what is missing, stands later, or says something else."""
    named = events.where("event_id is not null")
    places = named.groupBy("event_id").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line")).hint("merge")
    twice = named.join(places, "event_id").where("line > first_line").select(*BASE, F.lit("duplicate_event_id").alias("issue"), F.lit(None).cast("string").alias("detail"))
    last = lambda kind: named.where(F.col("event_type") == kind).groupBy("event_id").agg(F.max_by("e", "line").alias("e"))
    lines = places.select("event_id", F.col("last_line").alias("line")).hint("merge")
    out = [twice]
    for kind, links in ((CHECKED, (("cost", COST, "cost_declared_event_id"), ("lens", LENS, "lens_activation_event_id"))), (EXECUTED, (("check", CHECKED, "admissibility_checked_event_id"), ("cost", COST, "cost_declared_event_id")))):
        mine = last(kind).join(lines, "event_id").withColumn("event_type", F.lit(kind))
        for name, target, field in links:
            wanted = mine.where(F.col("e.witness.schema_id") == LENS_WITNESS).where(F.col(f"e.{field}").isNotNull()) if name == "lens" else mine
            known = last(target).select(F.col("event_id").alias("t_id"), F.col("e").alias("t")) if name == "lens" or SHARED.get(kind) and (kind, name) in ((CHECKED, "cost"), (EXECUTED, "check")) else None
            rows = wanted.join(lines.select(F.col("event_id").alias("l_id"), F.col("line").alias("l_line")).hint("merge"), F.col(f"e.{field}") == F.col("l_id"), "left")
            checks = [(F.col("l_line").isNull(), f"{name}_event_missing", F.col(f"e.{field}")), (F.col("l_line") >= F.col("line"), f"{name}_event_stands_later", F.col(f"e.{field}"))]
            if known is not None:
                rows = rows.join(known.hint("merge"), F.col(f"e.{field}") == F.col("t_id"), "left")
                there = F.col("t_id").isNotNull()
                if name == "lens":
                    checks = [(~there, "lens_event_missing", F.col(f"e.{field}")), (there & (F.col("l_line") >= F.col("line")), "lens_event_stands_later", F.col(f"e.{field}"))]
                else:
                    checks += [(there & ~F.col(f"e.{path}").eqNullSafe(F.col(f"t.{path}")), f"{said}_differs_from_{name}", None) for path, said in SHARED[kind].items()]
                    if kind == EXECUTED:
                        same = reduce(lambda a, b: a & b, [F.col(f"e.{f}").eqNullSafe(F.col(f"t.{f}")) for f in ("lens_id", "lens_hash", "lens_activation_event_id")])
                        checks.append((there & ~same, "lens_differs_from_check", None))
            out.append(_issues(rows, checks))
    return reduce(DataFrame.unionByName, out)


def kept_events(lines: DataFrame) -> DataFrame:
    """The lines parsed once, in Parquet, of which each check reads the columns that it needs."""
    events = parsed(lines)
    folder = fresh_folder(lines.sparkSession, "ledger")
    events.write.option("compression", "zstd").parquet(folder)
    return lines.sparkSession.read.schema(events.schema).parquet(folder)


def event_issues(events: DataFrame, artifacts: DataFrame, registries: DataFrame) -> DataFrame:
    """All issues of parsed events."""
    parts = [line_issues(events), artifact_issues(events, artifacts), registry_issues(events, registries), cross_issues(events)]
    return reduce(DataFrame.unionByName, parts)


def verify_ledger(lines: DataFrame, artifacts: DataFrame, registries: DataFrame) -> DataFrame:
    """All issues of a ledger. Its lines are parsed once."""
    return event_issues(kept_events(lines), artifacts, registries)


def sound_events(lines: DataFrame, artifacts: DataFrame, registries: DataFrame) -> DataFrame:
    """Parsed events of the lines that nothing is wrong with."""
    events = kept_events(lines)
    bad = event_issues(events, artifacts, registries).select("line").distinct()
    return events.join(bad.hint("merge"), "line", "left_anti")
