"""Cost accounting: permissions, erasure rules, scope changes, commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_write_wins(statements: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last statement of each key. One aggregate of (seq, row): partial maxima before the shuffle."""
    rest = [c for c in statements.columns if c != key]
    last = statements.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("last"))
    return last.select(key, "last.*")


def tag_conflicts(tags: DataFrame) -> DataFrame:
    """(id, key, value, seq) rows whose value differs from the one set before."""
    before = F.lag("value").over(W.partitionBy("id", "key").orderBy("seq"))
    return tags.withColumn("was", before).where("was is not null and value != was")


def boundary_name(from_scope: Column, to_scope: Column) -> Column:
    """The difference that a scope change stands for."""
    return F.concat(F.lit("boundary_loss:"), from_scope, F.lit("->"), to_scope)


def contributions(rules: DataFrame, permissions: DataFrame) -> DataFrame:
    """Rules (diff, bucket, cost, unit) of allowed differences; permissions hold one row per difference."""
    return rules.join(permissions.where("kind = 'allow'").select("diff"), "diff", "left_semi")


def totals(rules: DataFrame, permissions: DataFrame) -> DataFrame:
    """Cost by bucket. A bucket of several units is an error."""
    summed = contributions(rules, permissions).groupBy("bucket").agg(F.min("unit").alias("unit"), F.max("unit").alias("other"), F.sum("cost").alias("total"), F.count(F.lit(1)).alias("contributions"))
    message = F.concat(F.lit("units of bucket "), F.col("bucket"), F.lit(" differ"))
    return summed.withColumn("unit", F.when(F.col("unit") == F.col("other"), F.col("unit")).otherwise(F.raise_error(message))).drop("other")


def displaced_over(wanted: DataFrame, rules: DataFrame, permissions: DataFrame) -> DataFrame:
    """(bucket, exceeds) of (bucket, unit, threshold) rows; a bucket without cost has a total of 0."""
    joined = wanted.join(totals(rules, permissions).select("bucket", "total", F.col("unit").alias("of_unit")), "bucket", "left")
    total = F.when(F.col("of_unit").isNull(), F.lit(0.0)).when(F.col("of_unit") == F.col("unit"), F.col("total")).otherwise(F.raise_error(F.lit("unit of the bucket differs")))
    return joined.select("bucket", (total > F.col("threshold")).alias("exceeds"))


def allowed_without_rule(permissions: DataFrame, rules: DataFrame) -> DataFrame:
    """Allowed differences that no rule prices."""
    return permissions.where("kind = 'allow'").select("diff").join(rules.select("diff").distinct(), "diff", "left_anti")


def unaccounted_changes(changes: DataFrame, permissions: DataFrame, rules: DataFrame) -> DataFrame:
    """Scope changes (from_scope, to_scope, mode) whose difference is not both allowed and priced; narrowing is free."""
    accounted = permissions.where("kind = 'allow'").select("diff").distinct().join(rules.select("diff").distinct(), "diff", "left_semi")
    wider = changes.where("mode != 'narrow'").withColumn("diff", boundary_name(F.col("from_scope"), F.col("to_scope")))
    return wider.join(accounted, "diff", "left_anti")


def compare(value: Column, op: str, target: Column, strict_bounds: bool = False) -> Column:
    """A comparison of quantities. ``strict_bounds`` makes gte and lte true only for greater and less."""
    if strict_bounds:
        op = {"gte": "gt", "lte": "lt"}.get(op, op)
    return {"eq": value == target, "neq": value != target, "gt": value > target, "gte": value >= target, "lt": value < target, "lte": value <= target}[op]


def has_commit(targets: DataFrame, commits: DataFrame) -> DataFrame:
    """(diff, has_commit) of (diff) rows."""
    return targets.join(commits.select("diff", F.lit(True).alias("there")), "diff", "left").select("diff", F.coalesce("there", F.lit(False)).alias("has_commit"))


def _committed(targets: DataFrame, commits: DataFrame) -> DataFrame:
    return targets.join(commits.select("diff", "kind", "value", "unit"), "diff", "left")


def commit_equals(targets: DataFrame, commits: DataFrame) -> DataFrame:
    """(diff, equal) of (diff, target_kind, target, target_unit) rows against commits (diff, kind quantity, text or flag,
    value, unit): no commit is unequal; a commit of another kind or unit is an error."""
    joined = _committed(targets, commits)
    other = (F.col("kind") != F.col("target_kind")) | ~F.col("unit").eqNullSafe(F.col("target_unit"))
    equal = F.when(F.col("kind").isNull(), F.lit(False)).when(other, F.raise_error(F.concat(F.lit("commit is of another kind: "), F.col("diff").cast("string"))).cast("boolean")).otherwise(F.col("value").cast("string") == F.col("target").cast("string"))
    number = F.when((F.col("kind") == "quantity") & ~other, F.col("value").cast("double") == F.col("target").cast("double"))
    return joined.select("diff", F.coalesce(number, equal).alias("equal"))


def commit_cmp(targets: DataFrame, commits: DataFrame, op: str, strict_bounds: bool = False) -> DataFrame:
    """(diff, holds) of (diff, target, target_unit) rows: the quantity committed against the target. No commit, one that is
    no quantity and one of another unit are errors."""
    joined = _committed(targets, commits)
    fault = F.when(F.col("kind").isNull(), "no commit of ").when(F.col("kind") != "quantity", "no quantity is committed of ").when(F.col("unit") != F.col("target_unit"), "the commit counts something else: ")
    value = F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.col("diff").cast("string"))).cast("double")).otherwise(F.col("value").cast("double"))
    return joined.select("diff", compare(value, op, F.col("target").cast("double"), strict_bounds).alias("holds"))
