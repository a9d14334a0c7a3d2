"""The append-only event ledger: append, verification, status, log, comparison of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAMILIES = ("admissibility", "cost", "plan", "projection", "ingest", "lens", "meta", "engine", "rust")

def family(event_type: Column) -> Column:
    return F.substring_index(event_type, ".", 1)


def append(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """The ledger with new events; an id that is there, or twice among the new ones, is an error."""
    twice = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    known = ledger.select("event_id", F.lit(True).alias("known")).distinct()
    checked = events.join(twice, "event_id").join(known, "event_id", "left")
    message = F.concat(F.lit("event id is in the ledger: "), F.col("event_id").cast("string"))
    bad = (F.col("n") > 1) | F.coalesce("known", F.lit(False))
    checked = checked.withColumn("event_id", F.when(bad, F.raise_error(message).cast(events.schema["event_id"].dataType)).otherwise(F.col("event_id")))
    return ledger.unionByName(checked.select(ledger.columns))


def duplicate_ids(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def latest_by_family(events: DataFrame, order: Column) -> DataFrame:
    """The newest event of each family: partial maxima before the shuffle."""
    return events.groupBy(family(F.col("event_type")).alias("family")).agg(F.max_by(F.struct("event_id", "event_type"), order).alias("last"), F.count(F.lit(1)).alias("events")).select("family", "events", "last.event_id", "last.event_type")


def log(events: DataFrame, *, since=None, types: list[str] | None = None, verdict: str | None = None, scope: str | None = None, limit: int = 20) -> DataFrame:
    """Events that pass the filters, newest line first."""
    rows = events
    if since is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(since))
    if types:
        rows = rows.where(F.col("event_type").isin(*types))
    if verdict:
        rows = rows.where(F.col("verdict") == verdict)
    if scope:
        rows = rows.where(F.col("scope") == scope)
    return rows.orderBy(F.desc("line")).limit(limit)


def order_violations(events: DataFrame, reference: str) -> DataFrame:
    """(event_id, reference, problem) of events that refer to none, or to one that does not stand before them."""
    target = events.select(F.col("event_id").alias(reference), F.col("line").alias("target_line"))
    joined = events.where(F.col(reference).isNotNull()).join(target, reference, "left")
    problem = F.when(F.col("target_line").isNull(), "missing").when(F.col("target_line") >= F.col("line"), "not_before")
    return joined.withColumn("problem", problem).where("problem is not null").select("event_id", reference, "problem")


def evidence_state(events: DataFrame, key: str) -> DataFrame:
    """Per key: whether the latest check has an execution after it."""
    latest = events.groupBy(key).agg(F.max(F.when(F.col("event_type") == "check", F.col("line"))).alias("checked"), F.max(F.when(F.col("event_type") == "execute", F.col("line"))).alias("executed"))
    state = F.when(F.col("checked").isNull() & F.col("executed").isNull(), "none").when(F.col("checked").isNull(), "executed_unchecked").when(F.col("executed").isNull(), "checked").when(F.col("executed") > F.col("checked"), "current").otherwise("stale")
    return latest.withColumn("state", state)


def lens_delta(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, values before and after, change) of rows that differ between two runs."""
    old = before.select(*keys, *[F.col(v).alias(f"{v}_before") for v in values], F.lit(True).alias("in_before"))
    new = after.select(*keys, *[F.col(v).alias(f"{v}_after") for v in values], F.lit(True).alias("in_after"))
    joined = old.join(new, keys, "full_outer")
    same = reduce(lambda a, b: a & b, [F.col(f"{v}_before").eqNullSafe(F.col(f"{v}_after")) for v in values])
    change = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").when(~same, "changed")
    return joined.withColumn("change", change).where("change is not null").drop("in_before", "in_after")


def path_sets(expected: DataFrame, claimed: DataFrame, observed: DataFrame) -> DataFrame:
    """(kind, path) of the four differences between what was planned, claimed and seen."""
    paths = {"expected": expected.select("path"), "claimed": claimed.select("path"), "observed": observed.select("path")}
    parts = []
    for a, b in (("observed", "claimed"), ("claimed", "observed"), ("observed", "expected"), ("expected", "observed")):
        parts.append(paths[a].subtract(paths[b]).select(F.lit(f"{a}_not_{b}").alias("kind"), "path"))
    return reduce(DataFrame.unionByName, parts)


def delegation_verdicts(requests: DataFrame) -> DataFrame:
    """(request_id, verdict) of requests (request_id, delegate, claimed_delegate or null, scopes, scope, at, issued_at, expires_at) by
    precedence; a delegation holds at the moment it expires. Times compare as strings."""
    verdict = (
        F.when(F.col("claimed_delegate").isNotNull() & (F.col("delegate") != F.col("claimed_delegate")), "delegate_id_mismatch")
        .when(~F.array_contains("scopes", F.col("scope")), "scope_not_delegated")
        .when(F.col("at") < F.col("issued_at"), "verification_before_issue_time")
        .when(F.col("expires_at").isNotNull() & (F.col("at") > F.col("expires_at")), "delegation_expired")
        .otherwise("valid")
    )
    return requests.select("request_id", verdict.alias("verdict"))


def run_status(phases: DataFrame) -> DataFrame:
    """(run_id, status) from phase rows (run_id, phase, status ok, partial or failed)."""
    counted = phases.groupBy("run_id").agg(F.count(F.lit(1)).alias("phases"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"))
    status = F.when(F.col("ok") == F.col("phases"), "complete").when(F.col("failed") == F.col("phases"), "failed").otherwise("partial")
    return counted.withColumn("status", status)
