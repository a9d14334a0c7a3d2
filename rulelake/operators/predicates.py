"""Provider predicates as filters and joins over fact tables."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .findings import PredicateResult, Provider, RowFinding, findings


class TextMetrics(Provider):
    """Facts: path, bytes, lines, nonempty_lines, max_line_len, marker_lines (see ``file_metrics``)."""

    scope_id = "text.metrics"

    def predicates(self):
        return {name: self._by_row(name) for name in self.row_predicates()}

    def snapshot(self, spark, source: DataFrame) -> DataFrame:
        """Facts of (path, text) rows."""
        return file_metrics(source, F.col("path"), F.col("text"))

    def param_schemas(self):
        one = lambda name: {"type": "object", "properties": {name: {"type": "integer"}}, "required": [name]}
        return {"lines_exceed": one("max_lines"), "bytes_exceed": one("max_bytes"), "line_length_exceed": one("max_len")}

    def row_predicates(self):
        over = lambda column, parameter: lambda params: self._over_row(column, int(params[parameter]))
        marked = F.concat(F.col("marker_lines").cast("string"), F.lit(" marked lines"))
        marker = RowFinding(F.col("marker_lines") > 0, "text/marker_present", F.col("path"), marked, "warning")
        return {"lines_exceed": over("lines", "max_lines"), "bytes_exceed": over("bytes", "max_bytes"), "line_length_exceed": over("max_line_len", "max_len"), "marker_present": lambda params: marker}

    @staticmethod
    def _over_row(column: str, limit: int) -> RowFinding:
        message = F.concat(F.lit(f"{column} "), F.col(column).cast("string"), F.lit(f" exceeds {limit}"))
        return RowFinding(F.col(column) > limit, f"text/{column}_exceed", F.col("path"), message)

    def _by_row(self, name: str):
        def run(facts: DataFrame, params: dict[str, Any]) -> PredicateResult:
            found = self.row_predicates()[name](params)
            return PredicateResult(facts.where(found.when).select(found.row().alias("f")).select("f.*"))

        return run


def file_metrics(files: DataFrame, path: Column, text: Column, marker: str = "TODO") -> DataFrame:
    """Line and size metrics of each file, by array functions within the row: no shuffle."""
    return files.select(path.cast("string").alias("path"), T.line_metrics(F.coalesce(text, F.lit("")), marker).alias("m")).select("path", "m.*")


#: Manifests and the lock files that go with them.
LOCKS = (("Cargo.toml", "Cargo.lock"), ("package.json", "package-lock.json"), ("package.json", "npm-shrinkwrap.json"), ("package.json", "yarn.lock"))
NPM_LOCKS = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock")


def git_dependencies(deps: DataFrame) -> DataFrame:
    return deps.where("source_kind = 'git'")


def wildcard_versions(deps: DataFrame) -> DataFrame:
    return deps.where(F.trim("version_req").isin("*", "x", "X"))


def unapproved_dependencies(deps: DataFrame, allowed: DataFrame) -> DataFrame:
    """Dependencies whose package (or, without one, name) is not among the allowed (name) rows."""
    named = deps.withColumn("approved_as", F.coalesce("package_name", "name"))
    return named.join(allowed.select(F.col("name").alias("approved_as")).distinct(), "approved_as", "left_anti")


def missing_lockfiles(manifests: DataFrame, locks: DataFrame) -> DataFrame:
    """Manifests (path, kind cargo or npm) without a lock: any Cargo lock serves all Cargo manifests, an npm lock only
    those of its own folder."""
    cargo = manifests.where("kind = 'cargo'").join(locks.where("kind = 'cargo'").select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti")
    placed = manifests.where("kind = 'npm'").withColumn("dir", T.parent_dir(F.col("path")))
    npm = placed.join(locks.where("kind = 'npm'").select(T.parent_dir(F.col("path")).alias("dir")).distinct(), "dir", "left_anti").drop("dir")
    return cargo.unionByName(npm.select(*cargo.columns))


def manifests_without_lock_change(changed: DataFrame) -> DataFrame:
    """Changed manifests (of ``path`` rows) none of whose locks changed in the same folder."""
    spark = changed.sparkSession
    split = changed.select("path", T.parent_dir(F.col("path")).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file")).distinct()
    pairs = spark.createDataFrame(LOCKS, "file string, lock string")
    wanted = split.join(F.broadcast(pairs), "file")
    held = wanted.join(split.select("dir", F.col("file").alias("lock")), ["dir", "lock"]).select("path").distinct()
    return split.where(F.col("file").isin("Cargo.toml", "package.json")).join(held, "path", "left_anti").select("path")


def glob_matches(paths: DataFrame, globs: list[str]) -> DataFrame:
    """A row per (path, glob) that match; the globs are a short literal list."""
    patterns = F.array(*[F.struct(F.lit(g).alias("glob"), F.lit(T.glob_regex(g)).alias("regex")) for g in globs])
    exploded = paths.select("*", F.explode(patterns).alias("p"))
    return exploded.where(F.expr("path rlike p.regex")).withColumn("glob", F.col("p.glob")).drop("p")


def review_summary(reviews: DataFrame, pr: str = "pr") -> DataFrame:
    """Latest review of each reviewer (with a time before without, later rows at equal times), counted by state."""
    latest = reviews.groupBy(pr, "reviewer").agg(F.max_by("state", F.struct(F.col("ts").isNotNull(), F.col("ts"), F.col("idx"))).alias("state"))
    return latest.groupBy(pr).agg(F.count_if(F.col("state") == "APPROVED").alias("approvals"), F.count_if(F.col("state") == "CHANGES_REQUESTED").alias("changes_requested"))


def check_summary(checks: DataFrame, *keys: str) -> DataFrame:
    counted = checks.withColumn("check", T.check_state(F.col("status"), F.col("conclusion")))
    return counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("check") == s).alias(s) for s in ("green", "red", "pending")])


def required_checks(checks: DataFrame, required: list[str]) -> DataFrame:
    """Required checks that are missing or not green; without a list every check that is not green."""
    stated = checks.withColumn("check", T.check_state(F.col("status"), F.col("conclusion")))
    if not required:
        return stated.where("check != 'green'").select("name", "check")
    first = stated.groupBy("name").agg(F.min_by("check", F.struct("status", F.coalesce("conclusion", F.lit("")))).alias("check"))
    wanted = checks.sparkSession.createDataFrame([(n,) for n in required], "name string")
    joined = wanted.join(first, "name", "left")
    return joined.select("name", F.coalesce("check", F.lit("missing")).alias("check")).where("check != 'green'")


def too_few_approvals(summary: DataFrame, least: int = 1) -> DataFrame:
    return summary.where(F.col("approvals") < least)


def workflow_changes_unapproved(files: DataFrame, summary: DataFrame, least: int = 2) -> DataFrame:
    """Pull requests that touch workflows with too few approvals."""
    touched = files.groupBy("pr").agg(F.bool_or(F.startswith("path", F.lit(".github/workflows/"))).alias("touched")).where("touched").drop("touched")
    return touched.join(summary, "pr", "left").where(F.coalesce("approvals", F.lit(0)) < least)


def protected_flow(prs: DataFrame, protected: list[str], allowed_heads: list[str]) -> DataFrame:
    """Pull requests into a protected base from a head that no allowed glob matches."""
    fits = F.lit(False)
    for pattern in allowed_heads:
        fits = fits | F.col("head").rlike(T.glob_regex(pattern))
    return prs.where(F.col("base").isin(*protected) & ~fits)


def missing_paths(required: DataFrame, snapshot: DataFrame) -> DataFrame:
    return required.join(snapshot.select("path").distinct(), "path", "left_anti")


def unjustified(marked: DataFrame, justified: DataFrame) -> DataFrame:
    """Marked (path, line) rows without a justification at the same place; no line counts as line 0."""
    place = lambda df: df.withColumn("line", F.coalesce("line", F.lit(0)))
    return place(marked).join(place(justified).select("path", "line").distinct(), ["path", "line"], "left_anti")


DIRTY_RULES = ("git/untracked_file", "git/staged_file", "git/modified_file", "git/deleted_file", "git/renamed_file", "git/conflicted_file")


def dirty_findings(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("rule_id").isin(*DIRTY_RULES))


class GitWorkingTree(Provider):
    """Facts are findings (rule_id, path, ...) of a status snapshot."""

    scope_id = "git.working_tree"

    def predicates(self):
        kinds = {f"{k}_file": self._of(f"git/{k}_file") for k in ("untracked", "staged", "modified")}
        return kinds | {"dirty_state": self._dirty, "sensitive_path_touched": self._sensitive}

    @staticmethod
    def _of(rule: str):
        return lambda facts, params: PredicateResult(facts.where(F.col("rule_id") == rule))

    @staticmethod
    def _dirty(facts: DataFrame, params: dict[str, Any]) -> PredicateResult:
        found = dirty_findings(facts)
        marker = facts.agg(F.coalesce(F.bool_or((F.col("rule_id") == "git/dirty") | F.col("rule_id").isin(*DIRTY_RULES)), F.lit(False)).alias("triggered"))
        return PredicateResult(found, marker)

    @staticmethod
    def _sensitive(facts: DataFrame, params: dict[str, Any]) -> PredicateResult:
        matched = glob_matches(dirty_findings(facts).select("path").distinct(), list(params["globs"]))
        message = F.concat(F.col("path"), F.lit(" matches "), F.col("glob"))
        return PredicateResult(findings(matched, "git/sensitive_path_touched", path=F.col("path"), message=message))


def scope_unavailable(facts: DataFrame) -> DataFrame:
    """One row (triggered): whether a marker fact says that the scope could not be read."""
    return facts.agg(F.coalesce(F.bool_or(F.endswith("rule_id", F.lit("/scope_unavailable"))), F.lit(False)).alias("triggered"))
