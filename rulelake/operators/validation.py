"""Validation suites: typed notes, scope packs, formats of witnesses."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_regex
from .findings import findings


@dataclass(frozen=True)
class NoteType:
    """A kind of note: where it may lie, what fields and sections it has.

    Constraints are (kind, value) by field: type (string, bool, int, list), literal, enum, list_enum, pattern.
    """

    type_id: str
    allowed_patterns: tuple[str, ...]
    extension: str = "md"
    required: tuple[str, ...] = ()
    sections: tuple[str, ...] = ()
    constraints: dict[str, tuple[str, Any]] = field(default_factory=dict)


def note_types(toml: str) -> list[NoteType]:
    out = []
    for raw in tomllib.loads(toml).get("types", []):
        rules = {name: (c["kind"], c.get("value", c.get("values"))) for name, c in (raw.get("constraints") or {}).items()}
        out.append(NoteType(raw["type_id"], tuple(raw["allowed_patterns"]), raw.get("extension", "md"), tuple(raw.get("required", ())), tuple(raw.get("sections", ())), rules))
    return out


def specificity(pattern: str) -> int:
    """Path parts without wildcards."""
    return sum(not re.search(r"[*?]", part) for part in pattern.split("/"))


def resolve_type(path: Column, types: list[NoteType]) -> Column:
    """The type whose pattern fits with most literal parts, the first of equals."""
    ranked = sorted(((-specificity(p), k, t.type_id, p) for k, t in enumerate(types) for p in t.allowed_patterns))
    return F.coalesce(*[F.when(path.rlike(glob_regex(p)), F.lit(t)) for _, _, t, p in ranked], F.lit(None).cast("string"))


def validate_notes(notes: DataFrame, types: list[NoteType]) -> DataFrame:
    """Findings over notes: path, body, has_frontmatter and fields map<string, string> (lists are JSON arrays).

    Types are a short literal list, so every check is a filter without a join.
    """
    fields = F.col("fields")
    rows = notes.withColumn("placed_type", resolve_type(F.col("path"), types)).withColumn("said_type", fields["type"])
    rows = rows.withColumn("of_type", F.coalesce("placed_type", "said_type"))
    extension = F.regexp_extract("path", r"\.([^./]*)$", 1)
    out = [
        findings(rows.where("of_type is null"), "vault/untyped-file", path=F.col("path"), message="no type fits this file", severity="warning"),
        findings(rows.where("of_type is not null and not has_frontmatter"), "vault/missing-frontmatter", path=F.col("path"), message="frontmatter is missing"),
    ]
    for t in types:
        mine = rows.where(F.col("of_type") == t.type_id)
        fits = reduce(lambda a, b: a | b, [F.col("path").rlike(glob_regex(p)) for p in t.allowed_patterns], F.lit(False))
        out.append(findings(mine.where(extension != t.extension), "vault/extension-mismatch", path=F.col("path"), message=f"{t.type_id} files end with .{t.extension}"))
        out.append(findings(mine.where(~fits), "vault/forbidden-location", path=F.col("path"), message=f"{t.type_id} does not belong here"))
        headed = mine.where("has_frontmatter")
        for name in t.required:
            out.append(findings(headed.where(fields[name].isNull()), "vault/missing-required-field", path=F.col("path"), message=f"field {name} is missing"))
        for name, (kind, value) in t.constraints.items():
            out += _field_findings(headed.where(fields[name].isNotNull()), fields[name], name, kind, value)
        for title in t.sections:
            has = F.col("body").rlike(rf"(?im)^##\s*{re.escape(title)}\s*#*\s*$")
            out.append(findings(mine.where(~has), "vault/missing-section", path=F.col("path"), message=f"section {title} is missing"))
    return reduce(DataFrame.unionByName, out)


def _field_findings(rows: DataFrame, value: Column, name: str, kind: str, wanted: Any) -> list[DataFrame]:
    found = lambda bad, rule, said: [findings(rows.where(bad), f"vault/{rule}", path=F.col("path"), message=f"field {name} {said}")]
    as_list = F.from_json(value, "array<string>")
    is_list = F.startswith(value, F.lit("["))
    if kind == "type":
        ok = {"string": ~is_list, "bool": value.isin("true", "false"), "int": value.rlike(r"^-?\d+$"), "list": is_list}[wanted]
        return found(~ok, "type-mismatch", f"is no {wanted}")
    if kind == "literal":
        return found(value != str(wanted), "literal-mismatch", f"is not {wanted}")
    if kind == "enum":
        return found(~value.isin(*wanted), "enum-mismatch", f"is none of {', '.join(wanted)}")
    if kind == "pattern":
        return found(~value.rlike(wanted), "type-mismatch", f"does not fit {wanted}")
    if kind == "list_enum":
        allowed = F.array(*[F.lit(v) for v in wanted])
        return found(~is_list, "type-mismatch", "is no list") + found(is_list & (F.size(F.array_except(as_list, allowed)) > 0), "list-item-invalid", "has an item that is not allowed")
    raise ValueError(f"no constraint of kind {kind}")


def taxonomy_drift(notes: DataFrame, known_types: list[str], known_facets: list[str]) -> DataFrame:
    """(path, kind, value) of note types and facets that the taxonomy does not know."""
    types = notes.where(F.col("type").isNotNull() & ~F.col("type").isin(*known_types)).select("path", F.lit("type").alias("kind"), F.col("type").alias("value"))
    facets = notes.select("path", F.explode("facets").alias("value")).where(~F.col("value").isin(*known_facets))
    return types.unionByName(facets.select("path", F.lit("facet").alias("kind"), "value"))


def role_purity(notes: DataFrame, forbidden: dict[str, str]) -> DataFrame:
    """(path, role) of notes whose body has what their role forbids (an expression by role)."""
    bad = reduce(lambda a, b: a | b, [(F.col("role") == r) & F.col("body").rlike(p) for r, p in forbidden.items()], F.lit(False))
    return notes.where(bad).select("path", "role")


def template_leftovers(notes: DataFrame) -> DataFrame:
    """Notes with placeholders that were never filled in."""
    return notes.where(F.col("body").rlike(r"\{\{[^}]*\}\}|<[A-Z][A-Z_ ]+>")).select("path")


def invariant_coverage(notes: DataFrame) -> DataFrame:
    """Invariants, and how many notes and concepts refer to each."""
    defined = notes.where("role = 'invariant' and invariant_id is not null").select("invariant_id")
    used = notes.where("role != 'invariant' and invariant_id is not null").groupBy("invariant_id").agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("role") == "concept").alias("concepts"))
    joined = defined.distinct().join(used, "invariant_id", "left")
    return joined.select("invariant_id", F.coalesce("notes", F.lit(0)).alias("notes"), F.coalesce("concepts", F.lit(0)).alias("concepts"))


def merge_scope_packs(known: DataFrame, new: DataFrame) -> DataFrame:
    """Scope packs once per (scope_id, version), the newer entry first."""
    both = known.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    rest = [c for c in known.columns if c not in ("scope_id", "version")]
    return both.groupBy("scope_id", "version").agg(F.min_by(F.struct(*rest), "age").alias("e")).select("scope_id", "version", *[F.col(f"e.{c}").alias(c) for c in rest]).select(known.columns)


def scope_pack_issues(providers: DataFrame, packs: DataFrame) -> DataFrame:
    """(scope_id, version, issue) of providers (scope_id, version, pack_hash) that have no pack, or another one."""
    joined = providers.join(packs.select("scope_id", "version", F.col("pack_hash").alias("registered")), ["scope_id", "version"], "left")
    issue = F.when(F.col("registered").isNull(), "missing").when(F.col("registered") != F.col("pack_hash"), "mismatch")
    return joined.withColumn("issue", issue).where("issue is not null").select("scope_id", "version", "issue")


HEX64 = r"^[0-9a-f]{64}$"
TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def malformed(rows: DataFrame, key: str, formats: dict[str, str]) -> DataFrame:
    """(key, column, value) of values that are missing or do not fit their expression."""
    parts = [rows.where(F.col(c).isNull() | ~F.col(c).rlike(p)).select(key, F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c, p in formats.items()]
    return reduce(DataFrame.unionByName, parts)


def not_unique(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def plan_hash(message: Column) -> Column:
    """The digest that a commit message's trailer names, if there is exactly one."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(message), F.lit(r"(?m)^plan[- ]?(?:witness|hash)[^:\n]*:\s*(?:sha256:)?([0-9a-f]{64})\s*$"), F.lit(1)))
    return F.when(F.size(found) == 1, F.element_at(found, 1))
