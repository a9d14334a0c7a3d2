"""The registry of lenses, buckets, schemas, scopes and scope packs, as tables: normal form, problems, scope checks.

A registry is rows (kind, id, version, detail columns) of one table, so that any number of entries is checked by
aggregates and equi-joins. ``entries`` makes the rows of a JSON registry, ``document`` a JSON registry of the rows.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .dag import cut, cycle_residual, within

ENTRY = (
    "kind string, id string, version int, hash string, unit string, encoding string, schema_kind string, phase string, role string, deterministic boolean, foundational boolean, contract_ref string, "
    "snapshot_schema_id string, emits array<string>, consumes array<string>, deps array<string>, predicates array<string>"
)
# Lists of a registry document and the field that names their entries; buckets that every registry has; encodings (fixed values).
LISTS = {"lenses": "lens_id", "meta_change_kinds": "kind_id", "meta_buckets": "bucket_id", "stdlib": "module_id", "schemas": "id", "scopes": "id", "scope_packs": "scope_id"}
CORE_BUCKETS = ("bucket:trust_debt", "bucket:compatibility_debt", "bucket:explanation_debt")
ENCODINGS = ("canonical-cbor", "canonical-json")
META_SCOPE, META_WITNESS = "scope:meta.scope", "scope-addition-witness/0"
_FIELDS = {"hash": ("lens_hash", "provider_pack_hash"), "encoding": ("canonical_encoding",), "schema_kind": ("kind",), "predicates": ("predicate_ids",), "version": ("version", "schema_version")}


def entries(spark: SparkSession, registry: dict[str, Any] | str) -> DataFrame:
    """The rows of a registry document."""
    registry = json.loads(registry) if isinstance(registry, str) else registry
    names = [part.split()[0] for part in ENTRY.split(", ")]
    rows = []
    for kind, key in LISTS.items():
        for raw in registry.get(kind, ()):
            row = {"kind": kind, "id": raw.get(key)} | {n: next((raw[f] for f in _FIELDS.get(n, (n,)) if f in raw), None) for n in names if n not in ("kind", "id")}
            rows.append(tuple(row[n] for n in names))
    return spark.createDataFrame(rows, ENTRY)


def normalized(rows: DataFrame) -> DataFrame:
    """A registry in normal form: core buckets are there where none is, predicates are sorted, equal scope packs are one."""
    spark = rows.sparkSession
    core = spark.createDataFrame([("meta_buckets", b, "risk_points") for b in CORE_BUCKETS], "kind string, id string, unit string")
    none = rows.where("kind = 'meta_buckets'").limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    rows = rows.unionByName(core.crossJoin(F.broadcast(none)).where("none").drop("none"), allowMissingColumns=True)
    rows = rows.withColumn("predicates", F.array_sort("predicates"))
    packs = rows.where("kind = 'scope_packs'").dropDuplicates(["id", "version", "hash", "deterministic", "predicates"])
    return rows.where("kind != 'scope_packs'").unionByName(packs)


def sync_packs(rows: DataFrame, built_in: DataFrame) -> DataFrame:
    """A registry whose scope packs are those of the providers at hand (id, version, hash, ...) wherever they have one."""
    packs = rows.where("kind = 'scope_packs'").join(built_in.select("id", "version"), ["id", "version"], "left_anti").select(rows.columns)
    return rows.where("kind != 'scope_packs'").unionByName(packs).unionByName(built_in.withColumn("kind", F.lit("scope_packs")), allowMissingColumns=True)


def problems(rows: DataFrame, self_schema: str | None = None) -> DataFrame:
    """(problem, kind, id) of a registry: repeated ids and lens hashes, unknown encodings, core buckets and a self schema that
    are missing, digests of packs that are none, repeated predicates, packs of one version that differ."""
    say = lambda df, problem, key="id": df.select(F.lit(problem).alias("problem"), "kind", F.col(key).alias("id"))
    plain = rows.where("kind != 'scope_packs'")
    packs = rows.where("kind = 'scope_packs'")
    twice = plain.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    hashes = rows.where("kind = 'lenses'").groupBy("kind", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    core = rows.sparkSession.createDataFrame([("meta_buckets", b) for b in CORE_BUCKETS], "kind string, id string")
    differing = packs.groupBy("kind", "id", "version").agg(F.countDistinct(F.struct("hash", "deterministic", F.array_sort("predicates"))).alias("n")).where("n > 1")
    out = [
        say(twice, "duplicate_id"), say(hashes, "duplicate_lens_hash", "hash"), say(plain.where((F.col("kind") == "schemas") & ~F.coalesce(F.col("encoding").isin(*ENCODINGS), F.lit(False))), "unknown_encoding"),
        say(core.join(rows.select("kind", "id"), ["kind", "id"], "left_anti"), "missing_core_bucket"), say(packs.where(~F.coalesce(F.col("hash").rlike("^[0-9a-f]{64}$"), F.lit(False))), "pack_hash_malformed"),
        say(packs.where(F.size(F.array_distinct("predicates")) < F.size("predicates")), "duplicate_predicate"), say(differing, "packs_differ"),
    ]
    if self_schema is not None:
        own = rows.sparkSession.createDataFrame([("schemas", self_schema)], "kind string, id string")
        out.append(say(own.join(rows.select("kind", "id"), ["kind", "id"], "left_anti"), "missing_self_schema"))
    return reduce(DataFrame.unionByName, out)


def scope_id_fault(scope_id: Column) -> Column:
    """Why a scope id is malformed, or null."""
    return (
        F.when(F.contains(scope_id, F.lit("@")), "contains a version").when(~F.startswith(scope_id, F.lit("scope:")), "has no scope: before it")
        .when(F.length(scope_id) <= 6, "names nothing").when(~F.substring(scope_id, 7, 2147483647).rlike(r"^[\p{Ll}._]+$"), "has a character that is not allowed")
    )


def dependency_cycles(scopes: DataFrame) -> DataFrame:
    """(id) of scopes that reach themselves over their dependencies. What lies on no cycle and between none is peeled off first;
    in the rest pairs grow by doubling, and a scope that is found on a cycle is expanded no further."""
    edges = scopes.select(F.col("id").alias("src"), F.explode("deps").alias("dst")).distinct()
    reach = cut(within(edges, cycle_residual(edges)).select(F.col("src").alias("id"), F.col("dst").alias("dep")).distinct())
    while True:
        further = reach.where("id != dep").join(reach.where("id != dep").select(F.col("id").alias("dep"), F.col("dep").alias("next")), "dep").select("id", F.col("next").alias("dep"))
        grown = cut(reach.union(further).distinct())
        if grown.count() == reach.count():
            return grown.where("id = dep").select("id").distinct()
        reach = grown


def scope_checks(candidates: DataFrame, registry: DataFrame, *, adding: bool = True, second_phase: bool = False, contracts: DataFrame | None = None) -> DataFrame:
    """(id, check, severity, passed) of scopes (rows of ENTRY) against a registry: the form of the id, repeated ids and
    versions, schemas that they name, dependencies and cycles, completeness of the meta scope, and in the second phase the
    contract's file and recommended fields."""
    scopes = registry.where("kind = 'scopes'")
    schemas = registry.where("kind = 'schemas'").select(F.col("id").alias("schema"), "schema_kind")

    def unknown(column: str) -> DataFrame:
        return candidates.select("id", F.explode(column).alias("schema")).join(schemas, "schema", "left_anti").select("id").distinct()

    snapshot = candidates.where("snapshot_schema_id is not null").select("id", F.col("snapshot_schema_id").alias("schema")).join(schemas, "schema", "left")
    kind = F.coalesce("schema_kind", F.lit(""))
    bad_snapshot = snapshot.where(F.col("schema_kind").isNull() | ((kind != "") & ~kind.contains("snapshot") & (kind != "meta_registry"))).select("id").distinct()
    graph = scopes.join(candidates.select("id"), "id", "left_anti").select("id", "deps").unionByName(candidates.select("id", "deps"))
    no_dep = candidates.select("id", F.explode("deps").alias("dep")).join(scopes.select(F.col("id").alias("dep")), "dep", "left_anti").select("id").distinct()
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("phase", "deterministic", "foundational", "emits", "role", "contract_ref")]) & F.coalesce(F.array_contains("emits", META_WITNESS), F.lit(False))
    fails = {
        "snapshot_schema_exists": bad_snapshot, "emits_schemas_exist": unknown("emits"), "consumes_schemas_exist": unknown("consumes"),
        "dependencies_valid": no_dep.union(dependency_cycles(graph).join(candidates.select("id"), "id", "left_semi")).distinct(),
    }
    if adding:
        fails["no_duplicate_scope"] = candidates.join(scopes.select("id", "version"), ["id", "version"], "left_semi").select("id").distinct()
    if second_phase and contracts is not None:
        fails["contract_file_exists"] = candidates.where("contract_ref is not null").join(contracts.select(F.col("path").alias("contract_ref")), "contract_ref", "left_anti").select("id").distinct()
    rows = candidates
    for name, bad in fails.items():
        rows = rows.join(bad.withColumn(f"bad_{name}", F.lit(True)), "id", "left")
    one = lambda name, passed, severity="error": F.struct(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.coalesce(passed, F.lit(False)).alias("passed"))
    checks = [one("scope_id_format", scope_id_fault(F.col("id")).isNull()), one("meta_scope_completeness", (F.col("id") != META_SCOPE) | complete)]
    checks += [one(name, F.col(f"bad_{name}").isNull()) for name in fails]
    if second_phase:
        lacks = [F.when(F.col(c).isNull() & (F.col("id") != META_SCOPE), one(f"{c}_field_present", F.lit(False), "warn")) for c in ("phase", "deterministic", "role")]
        checks += lacks
    return rows.select("id", F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("c")).select("id", "c.check", "c.severity", "c.passed")


def allows(registry: DataFrame, kind: str, ids: DataFrame) -> DataFrame:
    """(id, allowed) of (id) rows: whether a registry has an entry of a kind for them."""
    return ids.join(registry.where(F.col("kind") == kind).select("id", F.lit(True).alias("there")).distinct(), "id", "left").select("id", F.coalesce("there", F.lit(False)).alias("allowed"))


def document(rows: DataFrame) -> DataFrame:
    """(kind, entries) with one JSON array per kind, entries in order of id and version: lists of a registry are small."""
    rest = [c for c in rows.columns if c != "kind"]
    return rows.groupBy("kind").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rest)))).alias("entries"))
