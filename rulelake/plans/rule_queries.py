"""Queries of text metrics, rulesets, dependency, review and cost rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import displacement as D
from ..operators import predicates as P
from ..operators.findings import Binding, ProviderRegistry, RuleSet, evaluate_ruleset, scope_rules, severity_counts
from ..session import table

MARKER = "All rights reserved"
LIMITS = {"lines": 30, "bytes": 8000, "max_line_len": 3000}


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return P.file_metrics(docs, F.col("doc_id"), F.col("text"), MARKER)


METRICS_SQL = f"""
WITH raw AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT doc_id, t, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(CASE WHEN t LIKE '%' || chr(10) THEN t[:-2] ELSE t END, chr(10)),
         lambda l: CASE WHEN l LIKE '%' || chr(13) THEN l[:-2] ELSE l END) END AS l FROM raw
), metrics AS (
  SELECT CAST(doc_id AS VARCHAR) AS path, CAST(strlen(t) AS BIGINT) AS bytes, CAST(len(l) AS BIGINT) AS lines,
         CAST(len(list_filter(l, lambda x: regexp_matches(x, '\\S'))) AS BIGINT) AS nonempty_lines,
         CAST(coalesce(list_max(list_transform(l, lambda x: length(x))), 0) AS BIGINT) AS max_line_len,
         CAST(len(list_filter(l, lambda x: contains(x, '{MARKER}'))) AS BIGINT) AS marker_lines FROM split
)
"""


def text_file_metrics(spark, sf_dir):
    return metrics(spark, sf_dir)


def _text_predicate(name: str, params: dict):
    def run(spark, sf_dir):
        return P.TextMetrics().evaluate(name, metrics(spark, sf_dir), params).findings.select("rule_id", "severity", "path", "message")

    return run


def _over_sql(column: str) -> str:
    return METRICS_SQL + f"SELECT 'text/{column}_exceed' AS rule_id, 'error' AS severity, path, '{column} ' || {column} || ' exceeds {LIMITS[column]}' AS message FROM metrics WHERE {column} > {LIMITS[column]}"


RULESET = RuleSet(
    "text-limits",
    (
        Binding("R-100", "error", "text.metrics", "lines_exceed", {"max_lines": LIMITS["lines"]}),
        Binding("R-110", "error", "text.metrics", "line_length_exceed", {"max_len": LIMITS["max_line_len"]}),
        Binding("R-120", "warning", "text.metrics", "marker_present"),
        Binding("R-130", "warning", "text.metrics", "bytes_exceed", {"max_bytes": 10**9}),
    ),
)


def _outcome(spark, sf_dir):
    return evaluate_ruleset(spark, RULESET, ProviderRegistry([P.TextMetrics()]), {"text.metrics": metrics(spark, sf_dir)})


def ruleset_verdict(spark, sf_dir):
    return _outcome(spark, sf_dir).verdict


def ruleset_rule_results(spark, sf_dir):
    return _outcome(spark, sf_dir).rule_results


def ruleset_severity_counts(spark, sf_dir):
    return severity_counts(_outcome(spark, sf_dir).findings)


RESULTS_SQL = METRICS_SQL + f"""
, counted AS (
  SELECT 'R-100' AS rule_id, 'error' AS severity, 'lines_exceed' AS predicate, count(*) FILTER (lines > {LIMITS["lines"]}) AS n FROM metrics
  UNION ALL SELECT 'R-110', 'error', 'line_length_exceed', count(*) FILTER (max_line_len > {LIMITS["max_line_len"]}) FROM metrics
  UNION ALL SELECT 'R-120', 'warning', 'marker_present', count(*) FILTER (marker_lines > 0) FROM metrics
  UNION ALL SELECT 'R-130', 'warning', 'bytes_exceed', count(*) FILTER (bytes > 1000000000) FROM metrics
)
"""


def scope_rule_bindings(spark, sf_dir):
    more = RuleSet("all", (*RULESET.bindings, Binding("R-200", "error", "git.working_tree", "dirty_state"), Binding("R-100", "error", "deps.manifest", "git_dependency_present")))
    return scope_rules(spark, more).select("scope_id", F.array_join("rules", ",").alias("rules"))


# Costs: line items are rules (difference = part, cost = price, bucket = return flag); an order's status is the permission of its items.


def _costs(spark, sf_dir):
    rules = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("diff"), F.col("l_returnflag").alias("bucket"), F.col("l_extendedprice").alias("cost"), F.lit("usd").alias("unit"))
    permissions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("diff"), F.when(F.col("o_orderstatus") == "F", "allow").otherwise("deny").alias("kind"))
    return rules, permissions


def displacement_totals(spark, sf_dir):
    return D.totals(*_costs(spark, sf_dir)).select("bucket", "unit", F.round("total", 2).alias("total"), "contributions")


def displacement_contributions(spark, sf_dir):
    return D.contributions(*_costs(spark, sf_dir)).groupBy("bucket", "diff").agg(F.round(F.sum("cost"), 2).alias("cost"))


def displaced_total_predicate(spark, sf_dir):
    wanted = spark.createDataFrame([("A", "usd", 1000.0), ("N", "usd", 1e15), ("Z", "usd", 0.5)], "bucket string, unit string, threshold double")
    return D.displaced_over(wanted, *_costs(spark, sf_dir))


def allow_without_rule(spark, sf_dir):
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    permissions = part.select(F.col("p_partkey").alias("diff"), F.when(F.col("p_size") <= 25, "allow").otherwise("deny").alias("kind"))
    rules = lines.where("l_quantity > 45").select(F.col("l_partkey").alias("diff"))
    return D.allowed_without_rule(permissions, rules)


def unaccounted_boundary(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    changes = customer.select(F.col("c_custkey").alias("change_id"), F.concat(F.lit("nation"), "n_nationkey").alias("from_scope"), F.concat(F.lit("region"), "n_regionkey").alias("to_scope"), F.when(F.col("c_custkey") % 3 == 0, "narrow").otherwise("widen").alias("mode"))
    ruled = table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    name = D.boundary_name(F.concat(F.lit("nation"), "n_nationkey"), F.concat(F.lit("region"), "n_regionkey"))
    rules = ruled.where("s_acctbal > 5000").select(name.alias("diff"))
    permissions = ruled.select(name.alias("diff"), F.when(F.col("n_nationkey") % 2 == 0, "allow").otherwise("deny").alias("kind")).distinct()
    return D.unaccounted_changes(changes, permissions, rules).select("change_id", "from_scope", "to_scope")


def latest_review_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    state = F.when(F.length("text") % 3 == 0, "APPROVED").when(F.length("text") % 3 == 1, "CHANGES_REQUESTED").otherwise("COMMENTED")
    reviews = rows.select(F.col("conv_id").alias("pr"), F.col("role").alias("reviewer"), state.alias("state"), F.col("turn").alias("ts"), F.col("turn").alias("idx"))
    return P.review_summary(reviews)


_CHECKS = "SELECT event_type AS name, CASE WHEN value < 20 THEN 'IN_PROGRESS' ELSE 'COMPLETED' END AS status, CASE WHEN value >= 60 THEN 'SUCCESS' WHEN value >= 20 THEN 'FAILURE' END AS conclusion FROM events"


def _checks(spark, sf_dir):
    value = F.col("value")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.when(value < 20, "IN_PROGRESS").otherwise("COMPLETED").alias("status"), F.when(value >= 60, "SUCCESS").when(value >= 20, "FAILURE").alias("conclusion"))


def checks_summary(spark, sf_dir):
    return P.check_summary(_checks(spark, sf_dir), "name")


def required_checks(spark, sf_dir):
    latest = _checks(spark, sf_dir).where("status = 'COMPLETED'").groupBy("name").agg(F.max("status").alias("status"), F.when(F.count_if(F.col("conclusion") == "FAILURE") > F.count_if(F.col("conclusion") == "SUCCESS"), "FAILURE").otherwise("SUCCESS").alias("conclusion"))
    return P.required_checks(latest, ["click", "error", "signup", "deploy"])


def unapproved_dependency(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    deps = part.select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("package_name"))
    allowed = part.where("p_retailprice > 1000").select(F.col("p_brand").alias("name"))
    return P.unapproved_dependencies(deps, allowed).select("p_partkey", "approved_as")


def _manifests(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    folder = F.concat(F.lit("pkg"), F.col("s_nationkey").cast("string"))
    npm = rows.select(F.concat(folder, F.lit("/package.json")).alias("path"), F.lit("npm").alias("kind"), F.col("s_suppkey"))
    cargo = rows.select(F.concat(F.lit("crate"), F.col("s_suppkey").cast("string"), F.lit("/Cargo.toml")).alias("path"), F.lit("cargo").alias("kind"), F.col("s_suppkey"))
    locks = rows.where("s_acctbal > 8000").select(F.concat(folder, F.lit("/yarn.lock")).alias("path"), F.lit("npm").alias("kind"))
    return npm.unionByName(cargo), locks


def lockfile_missing(spark, sf_dir):
    manifests, locks = _manifests(spark, sf_dir)
    return P.missing_lockfiles(manifests, locks).select("path", "kind", "s_suppkey")


def manifest_changed_without_lockfile(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    folder = F.concat(F.lit("d"), (F.col("o_custkey") % 500).cast("string"))
    file = F.when(F.col("o_orderkey") % 7 == 0, "Cargo.toml").when(F.col("o_orderkey") % 7 == 1, "Cargo.lock").when(F.col("o_orderkey") % 7 == 2, "package.json").when(F.col("o_orderkey") % 11 == 3, "yarn.lock").otherwise("src.rs")
    return P.manifests_without_lock_change(orders.select(F.concat(folder, F.lit("/"), file).alias("path")))


GLOBS = ["http://*", "*/fr/*", "*page=?&*"]


def sensitive_path_touched(spark, sf_dir):
    return P.glob_matches(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path")), GLOBS).select("page_id", "glob")


def unsafe_without_justification(spark, sf_dir):
    marked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.when(F.col("n_chars") % 2 == 0, F.col("n_chars") % 3).alias("line"))
    justified = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), F.when(F.col("quality") == 1, F.col("toxic").cast("long")).alias("line"))
    return P.unjustified(marked, justified).select("path", "line")


def min_approvals_met(spark, sf_dir):
    return P.too_few_approvals(latest_review_summary(spark, sf_dir), 2).select("pr", "approvals")


def protected_branch_flow(spark, sf_dir):
    prs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.when(F.col("o_orderstatus") == "F", "main").otherwise("dev").alias("base"), F.concat("o_orderpriority", F.lit("/x")).alias("head"))
    return P.protected_flow(prs, ["main"], ["1-*", "?-HIGH/*"]).select("number", "head")


def required_path_missing(spark, sf_dir):
    required = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    return P.missing_paths(required, table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("path")))


def commit_lww(spark, sf_dir):
    statements = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), "event_type", "value")
    return D.last_write_wins(statements).select(F.col("key").alias("user_id"), "event_type", F.round("value", 6).alias("value"))


def meta_conflicts(spark, sf_dir):
    tags = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("key"), F.floor("value").cast("long").alias("value"), F.struct("ts", "event_id").alias("seq"))
    return D.tag_conflicts(tags).groupBy("id", "key").agg(F.count(F.lit(1)).alias("conflicts"))


def commit_predicates(spark, sf_dir):
    """has_commit and commit_equals of each order against its items' total quantity, and commit_cmp of those that have one."""
    commits = table(spark, sf_dir, "lineitem").where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("diff")).agg(F.sum("l_quantity").alias("value"))
    commits = commits.select("diff", F.lit("quantity").alias("kind"), "value", F.lit("items").alias("unit"))
    targets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("diff"), F.lit("quantity").alias("target_kind"), F.lit(50.0).alias("target"), F.lit("items").alias("target_unit"))
    out = D.has_commit(targets, commits).join(D.commit_equals(targets, commits).withColumnRenamed("equal", "commit_equals"), "diff")
    there = targets.join(commits.select("diff"), "diff", "left_semi")
    for name, op, strict in (("commit_gt", "gt", False), ("commit_gte", "gte", False), ("commit_gte_strict", "gte", True), ("commit_lte_strict", "lte", True)):
        out = out.join(D.commit_cmp(there, commits, op, strict).withColumnRenamed("holds", name), "diff", "left")
    return out


def severity_window(spark, sf_dir):
    """The first finding of each rule in reporting order."""
    found = _outcome(spark, sf_dir).findings
    order = W.partitionBy("rule_id").orderBy(T.severity_rank(F.col("severity")), F.col("path").cast("long"))
    return found.withColumn("k", F.row_number().over(order)).where("k = 1").select("rule_id", "path")


QUERIES = {
    "text_file_metrics": text_file_metrics,
    "text_lines_exceed": _text_predicate("lines_exceed", {"max_lines": LIMITS["lines"]}),
    "text_bytes_exceed": _text_predicate("bytes_exceed", {"max_bytes": LIMITS["bytes"]}),
    "text_line_length_exceed": _text_predicate("line_length_exceed", {"max_len": LIMITS["max_line_len"]}),
    "text_marker_present": _text_predicate("marker_present", {}),
    "ruleset_verdict": ruleset_verdict,
    "ruleset_rule_results": ruleset_rule_results,
    "ruleset_severity_counts": ruleset_severity_counts,
    "finding_order_first": severity_window,
    "scope_rule_bindings": scope_rule_bindings,
    "displacement_totals": displacement_totals,
    "displacement_contributions": displacement_contributions,
    "displaced_total_predicate": displaced_total_predicate,
    "allow_without_rule": allow_without_rule,
    "unaccounted_boundary": unaccounted_boundary,
    "latest_review_summary": latest_review_summary,
    "min_approvals_met": min_approvals_met,
    "checks_summary": checks_summary,
    "required_checks_left_join": required_checks,
    "unapproved_dependency": unapproved_dependency,
    "lockfile_missing": lockfile_missing,
    "manifest_changed_without_lockfile": manifest_changed_without_lockfile,
    "sensitive_path_touched": sensitive_path_touched,
    "unsafe_without_justification": unsafe_without_justification,
    "protected_branch_flow": protected_branch_flow,
    "required_path_missing": required_path_missing,
    "commit_lww": commit_lww,
    "meta_conflicts": meta_conflicts,
    "commit_predicates": commit_predicates,
}

_COSTS_SQL = "WITH c AS (SELECT l_returnflag AS bucket, l_orderkey AS diff, l_extendedprice AS cost FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')"
_REVIEWS_SQL = """
WITH latest AS (
  SELECT conv_id AS pr, role, arg_max(CASE length(text) % 3 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END, turn) AS state FROM conversations GROUP BY ALL
), summary AS (
  SELECT pr, count(*) FILTER (state = 'APPROVED') AS approvals, count(*) FILTER (state = 'CHANGES_REQUESTED') AS changes_requested FROM latest GROUP BY pr
)
"""

ORACLE_SQL = {
    "text_file_metrics": METRICS_SQL + "SELECT * FROM metrics",
    "text_lines_exceed": _over_sql("lines"),
    "text_bytes_exceed": _over_sql("bytes"),
    "text_line_length_exceed": _over_sql("max_line_len"),
    "text_marker_present": METRICS_SQL + "SELECT 'text/marker_present' AS rule_id, 'warning' AS severity, path, marker_lines || ' marked lines' AS message FROM metrics WHERE marker_lines > 0",
    "ruleset_verdict": RESULTS_SQL + """
        , v AS (SELECT bool_or(n > 0 AND (severity = 'error' OR predicate = 'bytes_exceed')) AS failed, CAST(sum(n) AS BIGINT) AS findings FROM counted)
        SELECT 'text-limits' AS ruleset_id, CASE WHEN failed THEN 'inadmissible' ELSE 'admissible' END AS verdict,
               'ruleset text-limits ' || CASE WHEN failed THEN 'failed' ELSE 'passed' END AS reason, findings FROM v""",
    "ruleset_rule_results": RESULTS_SQL + "SELECT rule_id, severity, n > 0 AS triggered, n AS findings_count, 'text.metrics' AS scope_id, predicate FROM counted",
    "ruleset_severity_counts": RESULTS_SQL + "SELECT CAST(0 AS BIGINT) AS info_count, CAST(sum(n) FILTER (predicate = 'marker_present') AS BIGINT) AS warning_count, CAST(sum(n) FILTER (predicate <> 'marker_present') AS BIGINT) AS error_count FROM counted",
    "finding_order_first": METRICS_SQL + f"""
        , f AS (SELECT 'text/lines_exceed' AS rule_id, path FROM metrics WHERE lines > {LIMITS["lines"]}
                UNION ALL SELECT 'text/max_line_len_exceed', path FROM metrics WHERE max_line_len > {LIMITS["max_line_len"]}
                UNION ALL SELECT 'text/marker_present', path FROM metrics WHERE marker_lines > 0)
        SELECT rule_id, arg_min(path, CAST(path AS BIGINT)) AS path FROM f GROUP BY rule_id""",
    "scope_rule_bindings": "SELECT * FROM (VALUES ('text.metrics', 'R-100,R-110,R-120,R-130'), ('git.working_tree', 'R-200'), ('deps.manifest', 'R-100')) t(scope_id, rules)",
    "displacement_totals": _COSTS_SQL + " SELECT bucket, 'usd' AS unit, round(sum(cost), 2) AS total, count(*) AS contributions FROM c GROUP BY bucket",
    "displacement_contributions": _COSTS_SQL + " SELECT bucket, diff, round(sum(cost), 2) AS cost FROM c GROUP BY ALL",
    "displaced_total_predicate": _COSTS_SQL + """, w AS (SELECT * FROM (VALUES ('A', 1000.0), ('N', 1e15), ('Z', 0.5)) t(bucket, threshold)),
        s AS (SELECT bucket, sum(cost) AS total FROM c GROUP BY bucket)
        SELECT w.bucket, coalesce(total, 0) > threshold AS exceeds FROM w LEFT JOIN s USING (bucket)""",
    "allow_without_rule": "SELECT p_partkey AS diff FROM part WHERE p_size <= 25 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "unaccounted_boundary": """
        WITH ok AS (SELECT DISTINCT n_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 5000 AND n_nationkey % 2 = 0)
        SELECT c_custkey AS change_id, 'nation' || n_nationkey AS from_scope, 'region' || n_regionkey AS to_scope
        FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0 AND n_nationkey NOT IN (SELECT n_nationkey FROM ok)""",
    "latest_review_summary": _REVIEWS_SQL + "SELECT * FROM summary",
    "min_approvals_met": _REVIEWS_SQL + "SELECT pr, approvals FROM summary WHERE approvals < 2",
    "checks_summary": f"""
        WITH c AS ({_CHECKS}), s AS (SELECT name, CASE WHEN conclusion = 'SUCCESS' THEN 'green' WHEN status = 'COMPLETED' THEN 'red' ELSE 'pending' END AS k FROM c)
        SELECT name, count(*) AS total, count(*) FILTER (k = 'green') AS green, count(*) FILTER (k = 'red') AS red, count(*) FILTER (k = 'pending') AS pending FROM s GROUP BY name""",
    "required_checks_left_join": f"""
        WITH c AS ({_CHECKS}), latest AS (SELECT name, count(*) FILTER (conclusion = 'FAILURE') > count(*) FILTER (conclusion = 'SUCCESS') AS bad FROM c WHERE status = 'COMPLETED' GROUP BY name),
        w AS (SELECT unnest(['click', 'error', 'signup', 'deploy']) AS name)
        SELECT name, CASE WHEN bad IS NULL THEN 'missing' ELSE 'red' END AS "check" FROM w LEFT JOIN latest USING (name) WHERE bad IS NULL OR bad""",
    "unapproved_dependency": """
        WITH a AS (SELECT DISTINCT p_brand AS name FROM part WHERE p_retailprice > 1000),
        d AS (SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN p_brand END, p_name) AS approved_as FROM part)
        SELECT p_partkey, approved_as FROM d WHERE approved_as NOT IN (SELECT name FROM a)""",
    "lockfile_missing": """
        WITH locks AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 8000)
        SELECT 'pkg' || s_nationkey || '/package.json' AS path, 'npm' AS kind, s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT s_nationkey FROM locks)
        UNION ALL SELECT 'crate' || s_suppkey || '/Cargo.toml', 'cargo', s_suppkey FROM supplier""",
    "manifest_changed_without_lockfile": """
        WITH p AS (SELECT DISTINCT 'd' || (o_custkey % 500) AS dir, CASE WHEN o_orderkey % 7 = 0 THEN 'Cargo.toml' WHEN o_orderkey % 7 = 1 THEN 'Cargo.lock' WHEN o_orderkey % 7 = 2 THEN 'package.json'
                          WHEN o_orderkey % 11 = 3 THEN 'yarn.lock' ELSE 'src.rs' END AS file FROM orders)
        SELECT m.dir || '/' || m.file AS path FROM p m WHERE m.file IN ('Cargo.toml', 'package.json')
          AND NOT EXISTS (SELECT 1 FROM p l WHERE l.dir = m.dir AND l.file = CASE m.file WHEN 'Cargo.toml' THEN 'Cargo.lock' ELSE 'yarn.lock' END)""",
    "sensitive_path_touched": """
        SELECT page_id, 'http://*' AS glob FROM pages WHERE url LIKE 'http://%'
        UNION ALL SELECT page_id, '*/fr/*' FROM pages WHERE url LIKE '%/fr/%'
        UNION ALL SELECT page_id, '*page=?&*' FROM pages WHERE url LIKE '%page=_&%'""",
    "unsafe_without_justification": """
        WITH m AS (SELECT doc_id AS path, coalesce(CASE WHEN n_chars % 2 = 0 THEN n_chars % 3 END, 0) AS line FROM documents),
        j AS (SELECT doc_id AS path, coalesce(CASE WHEN quality = 1 THEN toxic END, 0) AS line FROM labels)
        SELECT path, line FROM m WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.path = m.path AND j.line = m.line)""",
    "protected_branch_flow": "SELECT o_orderkey AS number, o_orderpriority || '/x' AS head FROM orders WHERE o_orderstatus = 'F' AND NOT (o_orderpriority || '/x' LIKE '1-%' OR o_orderpriority || '/x' LIKE '_-HIGH/%')",
    "required_path_missing": "SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)",
    "commit_lww": "SELECT user_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "meta_conflicts": """
        WITH t AS (SELECT user_id AS id, event_type AS key, CAST(floor(value) AS BIGINT) AS v, lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS was FROM events)
        SELECT id, key, count(*) AS conflicts FROM t WHERE was IS NOT NULL AND v <> was GROUP BY ALL""",
    "commit_predicates": """
        WITH c AS (SELECT l_orderkey AS diff, sum(l_quantity) AS v FROM lineitem WHERE l_linenumber > 1 GROUP BY 1)
        SELECT o_orderkey AS diff, v IS NOT NULL AS has_commit, coalesce(v = 50, false) AS commit_equals, v > 50 AS commit_gt, v >= 50 AS commit_gte, v > 50 AS commit_gte_strict, v < 50 AS commit_lte_strict FROM orders LEFT JOIN c ON diff = o_orderkey""",
}
