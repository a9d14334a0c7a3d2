"""Queries of graphs, the ledger, projections and exact numbers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, exact
from ..functions import text as T
from ..operators import dag, ledger
from ..session import table
from . import cbor_sql as C
from . import projection


def _graph(spark, sf_dir):
    """Regions, nations, customers (of no debt) and orders as nodes, and what belongs to what as edges."""
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    node = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    edges = nation.select(node("r", F.col("n_regionkey")).alias("src"), node("n", F.col("n_nationkey")).alias("dst"))
    edges = edges.unionByName(customer.where("c_acctbal >= 0").select(node("n", F.col("c_nationkey")).alias("src"), node("c", F.col("c_custkey")).alias("dst")))
    edges = edges.unionByName(orders.select(node("c", F.col("o_custkey")).alias("src"), node("o", F.col("o_orderkey")).alias("dst")))
    return edges


def dependency_closure(spark, sf_dir):
    roots = spark.createDataFrame([("r0",), ("r3",)], "id string")
    return dag.reachable(roots, _graph(spark, sf_dir))


def authority_reachability(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    nodes = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("scope:fs.write").alias("scope"), (F.col("n_regionkey") == 1).alias("is_root"))
    scope = F.when(F.col("c_custkey") % 3 == 0, "scope:core.pure").otherwise("scope:external.mail")
    nodes = nodes.unionByName(customer.select(F.concat(F.lit("c"), "c_custkey").alias("id"), scope.alias("scope"), F.lit(False).alias("is_root")))
    edges = customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("authority_depends").alias("kind"))
    return dag.authority_violations(nodes, edges)


def dag_missing_refs(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") + 2).alias("witness_ref"))
    return dag.missing_references(nodes, edges).groupBy("missing").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def dag_cycle_residual(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    edges = part.select(F.col("p_partkey").alias("src"), (F.pmod(F.col("p_partkey") * 3 + 1, F.lit(97)) + 1).alias("dst"))
    return dag.cycle_residual(edges)


def first_rule_match_edges(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    scopes = F.element_at(F.array(*[F.lit(s) for s in ("scope:core.pure", "scope:fs.write", "scope:external.api", "scope:meta.x")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    nodes = customer.select(F.col("c_custkey").alias("id"), scopes.alias("scope"))
    kinds = F.element_at(F.array(*[F.lit(k) for k in dag.EDGE_KINDS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    risks = F.element_at(F.array(*[F.lit(r) for r in dag.RISKS]), (F.floor(F.col("o_orderkey") / 5) % 5 + 1).cast("int"))
    edges = orders.select(F.col("o_custkey").alias("src"), (F.col("o_custkey") % 100 + 1).alias("dst"), kinds.alias("kind"), risks.alias("risk"), F.when(F.col("o_orderkey") % 3 == 0, "w").alias("witness_ref"))
    return dag.scope_violations(nodes, edges).groupBy("rule", "violation", "severity").agg(F.count(F.lit(1)).alias("n"))


def link_two_hop(spark, sf_dir):
    edges = _graph(spark, sf_dir)
    a, b = edges.alias("a"), edges.alias("b")
    return a.join(b, F.col("a.dst") == F.col("b.src")).groupBy(F.col("a.src").alias("src")).agg(F.countDistinct("b.dst").alias("two_hop"))


def _events(spark, sf_dir):
    """Events as a ledger: numbered in order of time, some referring to an event before or after them."""
    events = table(spark, sf_dir, "events")
    kind = F.concat(F.col("event_type"), F.lit("."), F.when(F.col("value") > 50, "checked").otherwise("executed"))
    return events.select("event_id", F.col("ts").alias("timestamp"), F.col("event_id").alias("line"), kind.alias("event_type"), "user_id", F.col("value"), (F.floor("value").cast("long") * 200).alias("reference_id"))


def ledger_status_latest(spark, sf_dir):
    return ledger.latest_by_family(_events(spark, sf_dir), F.struct("timestamp", "event_id"))


def ledger_log_filter(spark, sf_dir):
    rows = ledger.log(_events(spark, sf_dir), types=["click.checked", "error.executed"], limit=40)
    return rows.select("event_id", "event_type")


def ledger_log_window(spark, sf_dir):
    """The lines of the last week of the ledger, counted by family."""
    rows = _events(spark, sf_dir)
    last = rows.agg((F.max("timestamp") - F.expr("interval 7 days")).alias("since"))
    return rows.crossJoin(F.broadcast(last)).where("timestamp >= since").groupBy(ledger.family(F.col("event_type")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def ledger_duplicate_ids(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.concat_ws("|", "user_id", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("event_id"))
    return ledger.duplicate_ids(events)


def ledger_order_violations(spark, sf_dir):
    return ledger.order_violations(_events(spark, sf_dir), "reference_id")


def evidence_state(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "check").when(F.col("event_type") == "error", "execute").otherwise("other")
    return ledger.evidence_state(events.select("user_id", kind.alias("event_type"), F.col("event_id").alias("line")), "user_id").select("user_id", "state")


def _month(spark, sf_dir, month):
    events = table(spark, sf_dir, "events").where(F.date_format("ts", "dd") <= "15" if month == 1 else F.date_format("ts", "dd") > "15")
    return events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def lens_delta(spark, sf_dir):
    return ledger.lens_delta(_month(spark, sf_dir, 1), _month(spark, sf_dir, 2), ["user_id", "event_type"], ["n"])


def plan_path_sets(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    expected = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("path"))
    claimed = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    observed = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"))
    return ledger.path_sets(expected, claimed, observed).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("least"), F.sum("path").alias("total"))


def delegation_verdict(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    requests = orders.select(
        F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 10).alias("delegate"), F.when(F.col("o_orderkey") % 9 == 0, F.lit(-1)).otherwise(F.col("o_custkey") % 10).alias("claimed_delegate"),
        F.array("o_orderpriority").alias("scopes"), F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("o_orderpriority")).alias("scope"), day.alias("at"), F.lit("1995-01-01").alias("issued_at"), F.when(F.col("o_custkey") % 2 == 0, "1997-01-01").alias("expires_at"),
    )
    return ledger.delegation_verdicts(requests)


def _phases(spark, sf_dir):
    status = F.when(F.col("value") > 30, "ok").when(F.col("value") > 10, "partial").otherwise("failed")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"), status.alias("status"), "ts", "event_id")


def run_status(spark, sf_dir):
    return ledger.run_status(_phases(spark, sf_dir)).select("run_id", "status", "phases")


def latest_complete_run(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("trace"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.when(F.col("value") > 50, "complete").otherwise("failed").alias("status"))
    return projection.latest_complete_run(rows, ["trace"])


def projection_vacuum(spark, sf_dir):
    rows = _phases(spark, sf_dir)
    old = ledger.run_status(rows).where("status = 'failed'").select("run_id")
    return projection.without_runs(rows, old, "run_id").groupBy("phase").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("run_id").alias("runs"))


def projection_latest_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return projection.latest_rows(rows, ["user_id", "event_type"], F.col("event_id")).select("user_id", "event_type", "event_id")


def projection_upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new = orders.where("o_totalprice > 100000").withColumn("o_totalprice", F.lit(0.0))
    return projection.upsert(orders, new, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") == 0).alias("zero"))


def run_scoped_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    run = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("run"), "c_nationkey"))
    return rows.select("c_custkey", T.run_scoped_id(F.sha2(F.col("c_name"), 256), run).alias("id"))


def batch_hashes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("batch", F.floor(F.col("c_custkey") / 64))
    return projection.batch_digests(rows, "nodes", F.lit("run-1"), "batch", "c_custkey")


def retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", T.retry_delay_ms(F.col("r_regionkey") * 2).alias("delay_ms"))


def json_select_path(spark, sf_dir):
    """A key, an item of a list, and paths that select nothing, with code and segment of the fault."""
    events = table(spark, sf_dir, "events")
    said = F.concat(F.lit('{"props":'), "props", F.lit(',"list":[{"a b":'), "event_id", F.lit("}]}"))
    out = events.select("event_id", said.alias("j"))
    for name, path in (("k", ".props.k"), ("item", '.list[0]["a b"]'), ("missing", ".props.none"), ("past", ".list[1]"), ("kind", ".props[0]"), ("bad", ".list[x]")):
        out = out.withColumn(name, canonical.selected("j", path))
    faults = ("missing", "past", "kind", "bad")
    return out.select("event_id", F.col("k.value").alias("k"), F.col("item.value").alias("item"), *[F.concat_ws(":", f"{c}.error", f"{c}.segment").alias(c) for c in faults])


def exact_calc(spark, sf_dir):
    """(quantity / 4 + line number / 6) in lowest terms, and whether it exceeds 5."""
    lines = table(spark, sf_dir, "lineitem")
    q = exact.rational(F.col("l_quantity").cast("long"), F.lit(4))
    n = exact.rational(F.col("l_linenumber").cast("long"), F.lit(6))
    tree = {"op": "add", "left": {"op": "input_ref", "name": "q"}, "right": {"op": "input_ref", "name": "n"}}
    over = {"op": "compare", "cmp": "gt", "left": tree, "right": {"op": "literal", "value": 5}}
    rows = lines.select("l_orderkey", "l_linenumber", q.alias("q"), n.alias("n"))
    total = exact.compiled(tree, {"q": F.col("q"), "n": F.col("n")})
    rows = rows.select("l_orderkey", "l_linenumber", total.alias("t"), exact.compiled(over, {"q": F.col("q"), "n": F.col("n")}).alias("over"))
    return rows.select("l_orderkey", "l_linenumber", F.col("t.num").cast("long").alias("num"), F.col("t.den").cast("long").alias("den"), "over")


def unit_convert(spark, sf_dir):
    """Sizes in inches as exact millimetres."""
    size = exact.rational(F.col("p_size").cast("long"), F.lit(1))
    rate = exact.rational(F.lit(254), F.lit(10))
    rows = table(spark, sf_dir, "part").select("p_partkey", exact.multiply(size, rate).alias("mm"))
    return rows.select("p_partkey", F.col("mm.num").cast("long").alias("num"), F.col("mm.den").cast("long").alias("den"))


def canonical_cbor_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    said = F.to_json(F.struct("doc_id", "lang", "source", F.col("n_chars").alias("size")))
    return docs.select("doc_id", canonical.cbor_sha256(said).alias("cbor_sha256"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

_EDGES_SQL = """
WITH RECURSIVE edges AS (
  SELECT * FROM (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer WHERE c_acctbal >= 0
                 UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)
)
"""
_LEDGER_SQL = """
WITH e AS (
  SELECT event_id, ts AS timestamp, event_id AS line, event_type || '.' || CASE WHEN value > 50 THEN 'checked' ELSE 'executed' END AS event_type, user_id, value,
         CAST(floor(value) AS BIGINT) * 200 AS reference_id FROM events
)
"""
_PHASES_SQL = """
WITH p AS (
  SELECT user_id AS run_id, event_type AS phase, CASE WHEN value > 30 THEN 'ok' WHEN value > 10 THEN 'partial' ELSE 'failed' END AS status FROM events
), s AS (
  SELECT run_id, count(*) AS phases, CASE WHEN count(*) FILTER (status = 'ok') = count(*) THEN 'complete' WHEN count(*) FILTER (status = 'failed') = count(*) THEN 'failed' ELSE 'partial' END AS status FROM p GROUP BY run_id
)
"""
ORACLE_SQL = {
    "dependency_closure": _EDGES_SQL + """
        , reach AS (SELECT id, 0 AS depth FROM (VALUES ('r0'), ('r3')) t(id) UNION SELECT dst, depth + 1 FROM reach JOIN edges ON src = id)
        SELECT id, min(depth) AS depth FROM reach GROUP BY id""",
    "authority_reachability": """
        SELECT 'n' || n_nationkey AS id, 'scope:fs.write' AS scope FROM nation WHERE n_regionkey <> 1
        UNION ALL SELECT 'c' || c_custkey, 'scope:external.mail' FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 <> 0 AND n_regionkey <> 1""",
    "dag_missing_refs": """
        WITH n AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 0),
        e AS (SELECT o_custkey AS src, o_custkey + 1 AS dst, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 2 END AS w FROM orders),
        r AS (SELECT 'src' AS missing, src AS id FROM e UNION ALL SELECT 'dst', dst FROM e UNION ALL SELECT 'witness_ref', w FROM e WHERE w IS NOT NULL)
        SELECT missing, count(*) AS n, count(DISTINCT id) AS ids FROM r WHERE id NOT IN (SELECT id FROM n) GROUP BY missing""",
    "dag_cycle_residual": """
        WITH RECURSIVE e AS (SELECT p_partkey AS src, (p_partkey * 3 + 1) % 97 + 1 AS dst FROM part),
        reach AS (SELECT src, dst FROM e UNION SELECT reach.src, e.dst FROM reach JOIN e ON e.src = reach.dst)
        SELECT DISTINCT src AS id FROM reach WHERE src = dst""",
    "first_rule_match_edges": """
        WITH n AS (SELECT c_custkey AS id, ['scope:core.pure', 'scope:fs.write', 'scope:external.api', 'scope:meta.x'][c_custkey % 4 + 1] AS scope FROM customer),
        e AS (SELECT o_custkey AS src, o_custkey % 100 + 1 AS dst, o_orderkey % 5 AS k, (o_orderkey // 5) % 5 AS risk, o_orderkey % 3 = 0 AS witness FROM orders),
        r AS (SELECT e.*, CASE WHEN a.scope LIKE 'scope:core.pure%' AND b.scope LIKE 'scope:core.pure%' AND k = 0 THEN 0
                               WHEN a.scope LIKE 'scope:core.pure%' AND b.scope LIKE 'scope:fs.write%' AND k = 3 AND risk >= 2 THEN 1
                               WHEN a.scope LIKE 'scope:fs.write%' AND b.scope LIKE 'scope:external.%' AND k = 3 THEN 2
                               WHEN a.scope LIKE 'scope:external.%' AND k = 3 THEN 3 WHEN k = 1 THEN 4 WHEN k = 4 THEN 5 END AS rule
              FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst)
        SELECT rule, CASE WHEN rule IS NULL THEN 'undefined' ELSE 'missing_witness' END AS violation, CASE WHEN rule IS NULL THEN 'warning' ELSE 'error' END AS severity, count(*) AS n
        FROM r WHERE rule IS NULL OR (rule IN (1, 2, 3) AND NOT witness) GROUP BY ALL""",
    "link_two_hop": _EDGES_SQL + "SELECT a.src, count(DISTINCT b.dst) AS two_hop FROM edges a JOIN edges b ON a.dst = b.src GROUP BY a.src",
    "ledger_status_latest": _LEDGER_SQL + """
        , f AS (SELECT *, split_part(event_type, '.', 1) AS family FROM e)
        SELECT family, count(*) OVER (PARTITION BY family) AS events, event_id, event_type FROM f QUALIFY row_number() OVER (PARTITION BY family ORDER BY timestamp DESC, event_id DESC) = 1""",
    "ledger_log_filter": _LEDGER_SQL + "SELECT event_id, event_type FROM e WHERE event_type IN ('click.checked', 'error.executed') ORDER BY line DESC LIMIT 40",
    "ledger_log_window": _LEDGER_SQL + "SELECT split_part(event_type, '.', 1) AS family, count(*) AS n FROM e WHERE timestamp >= (SELECT max(timestamp) - INTERVAL 7 DAY FROM e) GROUP BY 1",
    "ledger_duplicate_ids": "SELECT user_id || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d') AS event_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1",
    "ledger_order_violations": _LEDGER_SQL + """
        SELECT a.event_id, a.reference_id, CASE WHEN b.line IS NULL THEN 'missing' ELSE 'not_before' END AS problem FROM e a LEFT JOIN e b ON b.event_id = a.reference_id
        WHERE a.reference_id IS NOT NULL AND (b.line IS NULL OR b.line >= a.line)""",
    "evidence_state": """
        WITH l AS (SELECT user_id, max(event_id) FILTER (event_type = 'click') AS c, max(event_id) FILTER (event_type = 'error') AS x FROM events GROUP BY user_id)
        SELECT user_id, CASE WHEN c IS NULL AND x IS NULL THEN 'none' WHEN c IS NULL THEN 'executed_unchecked' WHEN x IS NULL THEN 'checked' WHEN x > c THEN 'current' ELSE 'stale' END AS state FROM l""",
    "lens_delta": """
        WITH a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE day(ts) <= 15 GROUP BY ALL), b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE day(ts) > 15 GROUP BY ALL)
        SELECT user_id, event_type, a.n AS n_before, b.n AS n_after, CASE WHEN a.n IS NULL THEN 'added' WHEN b.n IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL JOIN b USING (user_id, event_type) WHERE a.n IS DISTINCT FROM b.n""",
    "plan_path_sets": """
        WITH e AS (SELECT o_orderkey AS p FROM orders WHERE o_orderpriority = '1-URGENT'), c AS (SELECT o_orderkey AS p FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT l_orderkey AS p FROM lineitem WHERE l_returnflag = 'R'),
        d AS (SELECT 'observed_not_claimed' AS kind, p FROM (FROM o EXCEPT FROM c) UNION ALL SELECT 'claimed_not_observed', p FROM (FROM c EXCEPT FROM o)
              UNION ALL SELECT 'observed_not_expected', p FROM (FROM o EXCEPT FROM e) UNION ALL SELECT 'expected_not_observed', p FROM (FROM e EXCEPT FROM o))
        SELECT kind, count(*) AS n, min(p) AS least, CAST(sum(p) AS BIGINT) AS total FROM d GROUP BY kind""",
    "delegation_verdict": """
        WITH r AS (SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)
        SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 9 = 0 THEN 'delegate_id_mismatch' WHEN o_orderkey % 7 = 0 THEN 'scope_not_delegated' WHEN day < '1995-01-01' THEN 'verification_before_issue_time'
               WHEN o_custkey % 2 = 0 AND day > '1997-01-01' THEN 'delegation_expired' ELSE 'valid' END AS verdict FROM r""",
    "run_status": _PHASES_SQL + "SELECT run_id, status, phases FROM s",
    "latest_complete_run": "SELECT event_type AS trace, event_id AS run_id FROM events WHERE value > 50 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "projection_vacuum": _PHASES_SQL + "SELECT phase, count(*) AS rows, count(DISTINCT run_id) AS runs FROM p WHERE run_id NOT IN (SELECT run_id FROM s WHERE status = 'failed') GROUP BY phase",
    "projection_latest_rows": "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL",
    "projection_upsert": "SELECT count(*) AS n, count(*) FILTER (o_totalprice > 100000 OR o_totalprice = 0) AS zero FROM orders",
    "run_scoped_ids": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN sha256('run' || c_nationkey || '|' || sha256(c_name)) ELSE sha256(c_name) END AS id FROM customer",
    "batch_hashes": "SELECT c_custkey // 64 AS batch, count(*) AS items, sha256('nodes|run-1|' || string_agg(CAST(c_custkey AS VARCHAR), '' ORDER BY CAST(c_custkey AS VARCHAR))) AS batch_hash FROM customer GROUP BY 1",
    "retry_backoff": "SELECT r_regionkey, CAST(CASE WHEN r_regionkey = 0 THEN 0 ELSE least(5000, 100 * pow(2, r_regionkey * 2 - 1)) END AS BIGINT) AS delay_ms FROM region",
    "json_select_path": "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(event_id AS VARCHAR) AS item, 'missing_key:1' AS missing, 'index_out_of_range:1' AS past, 'type_mismatch:1' AS kind, 'invalid_path:1' AS bad FROM events",
    "canonical_cbor_hash": f"SELECT doc_id, {C.sha256(C.mapping({'doc_id': C.integer('doc_id'), 'lang': C.text('lang'), 'source': C.text('source'), 'size': C.integer('n_chars')}))} AS cbor_sha256 FROM documents",
    "exact_calc": """
        WITH x AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 3 + l_linenumber * 2 AS n FROM lineitem)
        SELECT l_orderkey, l_linenumber, n // gcd(n, 12) AS num, 12 // gcd(n, 12) AS den, n > 60 AS over FROM x""",
    "unit_convert": "SELECT p_partkey, CAST(p_size * 254 // gcd(p_size * 254, 10) AS BIGINT) AS num, CAST(10 // gcd(p_size * 254, 10) AS BIGINT) AS den FROM part",
}
