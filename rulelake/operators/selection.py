"""Selections and small summaries over projected tables, runs, registries and delegations."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import cbor_columns as CB
from ..functions import text as T
from .dag import cut

MOST_ROWS = 100_000
#: Rows of links or targets that are scored at once.
PACK = 2048


def has_prefix(path: Column, prefixes: list[str]) -> Column:
    """Whether a path starts with one of a short list of prefixes."""
    out = F.lit(False)
    for prefix in prefixes:
        out = out | F.startswith(path, F.lit(prefix))
    return out


def effective_prefixes(docs: DataFrame, prefixes: list[str], path_col: str = "path") -> list[str]:
    """The configured prefixes, or the empty one where none of them fits any document."""
    fits = docs.agg(F.coalesce(F.bool_or(has_prefix(F.col(path_col), [p for p in prefixes if p])), F.lit(False))).first()[0]
    return [p for p in prefixes if p] if fits else [""]


def select_documents(docs: DataFrame, prefixes: list[str], path_col: str = "path", limit: int | None = MOST_ROWS) -> DataFrame:
    """Documents under any of the prefixes, in order of path; all of them without a limit."""
    rows = docs.where(has_prefix(F.col(path_col), prefixes)).orderBy(path_col)
    return rows if limit is None else rows.limit(limit)


def select_unresolved(links: DataFrame, prefixes: list[str], kinds: list[str], run: str | None = None, limit: int | None = MOST_ROWS) -> DataFrame:
    """Unresolved links (from_path, line, target, kind, run_id) under prefixes and of kinds; rows without keys are left out.

    A limit is held to 1..100000; without one all rows come.
    """
    rows = links.where(has_prefix(F.col("from_path"), prefixes) & F.col("kind").isin(*kinds) & (F.coalesce("from_path", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != ""))
    if run is not None:
        rows = rows.where(F.col("run_id") == run)
    rows = rows.orderBy("from_path", "line", "target")
    return rows if limit is None else rows.limit(min(MOST_ROWS, max(1, limit)))


def search_titles(titles: DataFrame, query: Column, *, prefix: str, model: str, dim: int, k: int) -> DataFrame:
    """The titles (path, model, dim, embedding) of highest cosine under a prefix, for one model and dimension."""
    rows = titles.where(F.startswith("path", F.lit(prefix)) & (F.col("model") == model) & (F.col("dim") == dim))
    return rows.select("path", T.cosine(F.col("embedding"), query).alias("similarity")).orderBy(F.desc("similarity"), "path").limit(min(50, max(1, k)))


def suggestions(links: DataFrame, targets: DataFrame, link_id: str, k: int = 1, pack: int = PACK) -> DataFrame:
    """For each unresolved link (embedding, ``block`` to search in) the k best of all targets of its block; missing vectors
    count as 0. A link that only lacks its heading keeps the document it resolved to; one whose block has no target keeps
    a row without a candidate.

    Links and targets of a block are dealt into packs of about ``pack`` rows, and each pair of packs is scored by itself
    and hands on k rows a link, so that a hot block is spread over tasks and no pair of rows is made in the plan.
    """
    wanted = links.where("resolved is null").select(F.col(link_id).alias("id"), F.col("block").alias("link_block"), F.col("embedding").cast("array<double>").alias("vector"))
    found = targets.where("block is not null").select(F.col("block").alias("target_block"), F.col("path").alias("candidate"), F.col("embedding").cast("array<double>").alias("vector"))
    packs = lambda rows, side: rows.groupBy(F.col(f"{side}_block").alias("block")).agg(F.ceil(F.count(F.lit(1)) / pack).alias(f"{side}_packs"))
    of_links, of_targets = packs(wanted, "link"), packs(found, "target")
    dealt = lambda name, count: F.pmod(F.xxhash64(name, "vector"), F.coalesce(count, F.lit(1)))
    copies = lambda count: F.explode(F.sequence(F.lit(0), (F.coalesce(count, F.lit(1)) - 1).cast("int")))
    sizes = of_links.join(of_targets, "block", "left")
    one = wanted.join(sizes, F.col("link_block") == F.col("block"), "left")
    one = one.select("link_block", "id", "vector", dealt("id", F.col("link_packs")).cast("int").alias("a"), copies(F.col("target_packs")).alias("b"))
    two = found.join(sizes, F.col("target_block") == F.col("block"))
    two = two.select("target_block", "candidate", "vector", copies(F.col("link_packs")).alias("c"), dealt("candidate", F.col("target_packs")).cast("int").alias("d"))
    kinds = f"id {wanted.schema['id'].dataType.simpleString()}, candidate string, similarity double"
    best = one.groupBy("link_block", "a", "b").cogroup(two.groupBy("target_block", "c", "d")).applyInArrow(_best_of_packs(k), kinds)
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "candidate")  # nulls, of packs without a target, come last
    best = best.withColumn("place", F.row_number().over(order)).where((F.col("place") <= k) & (F.col("candidate").isNotNull() | (F.col("place") == 1)))
    best = best.select(F.col("id").alias(link_id), "candidate", "similarity", "place")
    kept = links.where("resolved is not null").select(link_id, F.col("resolved").alias("candidate"), F.lit(1.0).alias("similarity"), F.lit(1).alias("place"))
    return best.unionByName(kept)


def _best_of_packs(k: int):
    """The k best targets of a pack for each link of a pack, with sums in the order of ``text.cosine``."""

    def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
        """Vectors of ``size`` numbers as rows; others, which have no cosine, are zeros."""
        out = np.zeros((len(column), size))
        for i, vector in enumerate(column):
            if vector.is_valid and len(vector.values) == size and not vector.values.null_count:
                out[i] = vector.values.to_numpy()
        return out

    def squares(rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        for d in range(rows.shape[1]):
            total += rows[:, d] * rows[:, d]
        return np.sqrt(total)

    def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dots = np.zeros((len(a), len(b)))
        for d in range(a.shape[1]):
            dots += np.multiply.outer(a[:, d], b[:, d])
        size = np.multiply.outer(squares(a), squares(b))
        return np.where(size == 0, 0.0, dots / np.where(size == 0, 1.0, size))

    def best(links: pa.Table, targets: pa.Table) -> pa.Table:
        ids, names, values = [], [], []
        lengths = pc.list_value_length(links["vector"])
        targets = targets.sort_by("candidate")  # so that the first of equals is the first in order
        for size in set(lengths.to_pylist()):
            some = links.filter(pc.is_null(lengths) if size is None else pc.equal(lengths, size))
            there = matrix(targets["vector"], size or 0)
            for start in range(0, some.num_rows, 128):
                part = some.slice(start, 128)
                score = scores(matrix(part["vector"], size or 0), there)
                top = np.argsort(-np.where(np.isnan(score), np.inf, score), axis=1, kind="stable")[:, :k] if k > 1 else score.argmax(axis=1, keepdims=True) if there.shape[0] else np.zeros((part.num_rows, 0), int)
                if not top.shape[1]:
                    ids, names, values = [*ids, part["id"]], [*names, pa.nulls(part.num_rows, pa.string())], [*values, np.full(part.num_rows, np.nan)]
                    continue
                ids.append(part["id"].take(pa.array(np.repeat(np.arange(part.num_rows), top.shape[1]))))
                names.append(targets["candidate"].take(pa.array(top.ravel())))
                values.append(np.take_along_axis(score, top, axis=1).ravel())
        empty = [pa.chunked_array([], t) for t in (links.schema.field("id").type, pa.string())]
        flat = lambda parts, none: pa.concat_arrays([c for p in parts for c in (p.chunks if isinstance(p, pa.ChunkedArray) else [p])]) if parts else none
        found = flat(names, empty[1])
        score = pa.array(np.concatenate(values) if values else np.zeros(0))
        return pa.table({"id": flat(ids, empty[0]), "candidate": found, "similarity": pc.if_else(pc.is_valid(found), score, None)})

    return best


def ingest_coverage(files: DataFrame, warnings: DataFrame) -> DataFrame:
    """(kind, n): files, bytes, and warnings by kind."""
    totals = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    base = totals.select(F.explode(F.array(F.struct(F.lit("files").alias("kind"), F.col("files").cast("long").alias("n")), F.struct(F.lit("bytes").alias("kind"), F.col("bytes").cast("long").alias("n")))).alias("r")).select("r.*")
    return base.unionByName(warnings.groupBy(F.concat(F.lit("warning:"), "kind").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def trigger_counts(facts: DataFrame) -> DataFrame:
    """Constraints with how often they triggered, and where first."""
    place = F.struct(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("line", F.lit(0)).alias("line"), F.coalesce("col", F.lit(0)).alias("col"))
    return facts.groupBy("constraint_id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")).select("constraint_id", "n", "at.file", "at.line", "at.col")


def top_warnings(findings: DataFrame, n: int = 5) -> DataFrame:
    return findings.where("severity = 'warning'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_id").limit(n)


def combined_snapshot_hash(bundles: DataFrame) -> DataFrame:
    """One digest of the (scope_id, schema_id, snapshot_hash) rows of a run, one per provider scope: that of the canonical
    CBOR of ``{"inputs": [...]}`` in order of scope."""
    one = CB.mapping({name: CB.text(F.col(name)) for name in ("scope_id", "schema_id", "snapshot_hash")})
    rows = F.array_sort(F.collect_list(F.struct("scope_id", one.alias("cbor"))))
    inputs = F.aggregate(rows, CB.head(4, F.size(rows)), lambda made, row: F.concat(made, row["cbor"]))
    return bundles.agg(CB.sha256(CB.mapping({"inputs": inputs})).alias("snapshot_hash"))


def artifact_log(listing: DataFrame, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Artifacts (kind, sha256, bytes) of a kind, the largest first: a page of them."""
    rows = listing if kind is None else listing.where(F.col("kind") == kind)
    return rows.orderBy(F.desc("bytes"), "sha256").limit(limit)


def artifacts_by_prefix(listing: DataFrame, prefix: str) -> DataFrame:
    """(kind, sha256) of the artifacts of any kind whose digest starts so."""
    return listing.where(F.startswith("sha256", F.lit(prefix)) & (F.col("extension") == "cbor")).select("kind", "sha256").distinct()


def since_cutoff(raw: str, now: datetime) -> datetime:
    """The moment that ``3d``, ``12h`` or an RFC 3339 time stands for."""
    match = re.fullmatch(r"(\d+)([smhdw])", raw.strip())
    if match:
        unit = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}[match[2]]
        return now - timedelta(**{unit: int(match[1])})
    moment = datetime.fromisoformat(raw.strip().replace("Z", "+00:00"))
    return moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)


def duration_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)


def utc_time(value: Column) -> Column:
    """Whether a string is a UTC time as witnesses have them: a date, ``T``, a time, ``Z``."""
    return (F.length(value) >= 20) & F.contains(value, F.lit("T")) & F.endswith(value, F.lit("Z"))


def delegation_records(requests: DataFrame) -> DataFrame:
    """Delegations (delegator, delegate, scopes, issued_at, expires_at, and constraints as JSON where the column is there)
    with sorted distinct scopes and an id: the digest of the canonical CBOR of what they say. Malformed ones are an error."""
    scopes = F.array_sort(F.array_distinct("scopes"))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    no_scope = F.exists(scopes, lambda s: ~F.startswith(s, F.lit("scope:")) | (F.length(s) <= 6))
    problem = (
        F.when(blank(F.col("delegator")), "the issuer is empty").when(blank(F.col("delegate")), "the delegate is empty").when(F.coalesce(F.size("scopes"), F.lit(0)) < 1, "there are no scopes")
        .when(~F.coalesce(utc_time(F.col("issued_at")), F.lit(False)), "issued_at is no UTC time").when(F.col("expires_at").isNotNull() & ~utc_time(F.col("expires_at")), "expires_at is no UTC time")
        .when(F.col("expires_at") < F.col("issued_at"), "it expires before it is issued").when(no_scope, "a scope id is malformed")
    )
    constraints = canonical.cbor_bytes(F.col("constraints")) if "constraints" in requests.columns else F.lit(CB.NULL)
    said = {"issuer_id": CB.text(F.col("delegator")), "delegate_id": CB.text(F.col("delegate")), "scope_ids": CB.array(scopes), "issued_at_utc": CB.text(F.col("issued_at")), "expires_at_utc": CB.text(F.col("expires_at")), "constraints": constraints}
    record = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(CB.sha256(CB.mapping(said)))
    return requests.select(record.alias("record_id"), "delegator", "delegate", scopes.alias("scopes"), "issued_at", "expires_at")


def tracked_records(rows: DataFrame, path_col: str = "path") -> DataFrame:
    """Tracked files with normal paths, in order; a path that comes twice is an error."""
    placed = rows.withColumn(path_col, T.normalize_path(F.col(path_col)))
    twice = placed.groupBy(path_col).agg(F.count(F.lit(1)).alias("n"))
    checked = placed.join(twice, path_col).withColumn(path_col, F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("path comes twice: "), F.col(path_col)))).otherwise(F.col(path_col)))
    return checked.drop("n")


def derived_lens_hash(from_hash: Column, kind: Column, payload_ref: Column) -> Column:
    """The hash of the lens that a meta change derives: that of its JSON in order of keys."""
    said = F.to_json(F.struct(from_hash.alias("from_lens_hash"), kind.alias("kind"), payload_ref.alias("payload_ref")))
    return F.sha2(said, 256)


def lens_update(routes: DataFrame, lens_hash: str, kind: str, payload_ref: str) -> DataFrame:
    """Costs of a lens change by bucket and unit, with the hash and id of the lens that it derives."""
    derived = derived_lens_hash(F.lit(lens_hash), F.lit(kind), F.lit(payload_ref))
    total = routes.groupBy("bucket", "unit").agg(F.sum("cost").alias("total"))
    return total.withColumn("derived_hash", derived).withColumn("derived_id", F.concat(F.lit("lens:derived:"), F.substring("derived_hash", 1, 12), F.lit("@0")))


def list_scopes(scopes: DataFrame, phase: str | None = None, role: str | None = None) -> DataFrame:
    """Registered scopes by phase and role, whatever their case."""
    rows = scopes
    for column, wanted in (("phase", phase), ("role", role)):
        if wanted is not None:
            rows = rows.where(F.lower(column) == wanted.lower())
    return rows.orderBy("scope_id")


def report_lines(rows: DataFrame, title: str, order: list[Column | str]) -> DataFrame:
    """(place, line) of a result as a markdown table, all its rows in order: write it with ``write.text`` after a sort by
    place, however long it is."""
    head = rows.sparkSession.createDataFrame([(-4, f"# {title}"), (-3, ""), (-2, "| " + " | ".join(rows.columns) + " |"), (-1, "|" + " --- |" * len(rows.columns))], "place long, line string")
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in rows.columns]), F.lit(" |"))
    return head.unionByName(numbered(rows.withColumn("line", line), order).select((F.col("place") - 1).alias("place"), "line"))


def numbered(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows with their place, from 1 on, in an order over all of them: range partitions are numbered by themselves,
    each after as many as the ones before it hold."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [f"__k{k}" for k in range(len(order))]
    placed = cut(rows.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    within = placed.withColumn("__within", F.row_number().over(W.partitionBy("__part").orderBy(*keys)))
    out = within.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn("place", F.col("__before") + F.col("__within"))
    return out.drop("__part", "__before", "__within", *keys)
