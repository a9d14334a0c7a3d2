"""Queries of the validation suites, registries, plans, ledgers' life, batches and the extension surface over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..operators import dag, findings, ledger, predicates
from ..operators import plans as PL
from ..operators import registry as R
from ..operators import selection as S
from ..operators import validation as V
from ..operators import witnesses as WI
from ..session import fresh_folder, table
from ..streaming import ledger_stream
from . import cbor_sql as C
from . import projection
from .source_queries import TYPES_TOML, _pick, _sql_pick


def vault_schema_findings(spark, sf_dir):
    """Notes per document in and out of place, with and without fields, against two types of notes."""
    k = F.col("doc_id")
    path = F.concat(_pick(("vault/n", "concepts/", "else/"), k), k, _pick((".md", ".md", ".txt", ".md"), k))
    fields = F.map_filter(F.create_map(F.lit("type"), F.when(k % 7 != 0, F.lit("concept")), F.lit("role"), _pick(("concept", "other", None), k), F.lit("status"), F.when(k % 2 == 0, F.lit("x"))), lambda _, v: v.isNotNull())
    notes = table(spark, sf_dir, "documents").select(path.alias("path"), F.concat(F.when(k % 4 == 0, F.lit("## Summary\n")).otherwise(F.lit("")), F.coalesce("text", F.lit(""))).alias("body"), (k % 6 != 0).alias("has_frontmatter"), fields.alias("fields"))
    return V.validate_notes(notes, V.note_types(TYPES_TOML)[:1]).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


def vault_invariant_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 3 == 0, "invariant").when(F.col("doc_id") % 3 == 1, "concept").otherwise("plan").alias("role"), F.when(F.col("doc_id") % 5 != 4, F.concat("source", F.lit("-"), "lang")).alias("invariant_id"))
    return V.invariant_coverage(rows)


def taxonomy_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("type"), F.array("source", F.lit("known")).alias("facets"))
    return V.taxonomy_drift(rows, ["en", "fr"], ["known", "src1", "web"]).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def role_purity(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("lang").alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    return V.role_purity(rows, {"en": r"\bthe\b", "fr": "eau"})


def template_leftovers(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("path"), F.concat(F.translate(F.coalesce("text", F.lit("")), "<>{}", "    "), F.when(k % 5 == 0, " {{name}}").when(k % 5 == 1, " <TODO ITEM>").otherwise(" <todo> {x}")).alias("body"))
    return V.template_leftovers(rows)


def scope_pack_issues(spark, sf_dir):
    """Providers per supplier against the registered packs of some."""
    rows = table(spark, sf_dir, "supplier")
    digest = F.sha2("s_name", 256)
    providers = rows.select(F.concat(F.lit("scope:s"), "s_suppkey").alias("scope_id"), (F.col("s_suppkey") % 2).alias("version"), digest.alias("pack_hash"))
    packs = rows.where("s_suppkey % 3 != 0").select(F.concat(F.lit("scope:s"), "s_suppkey").alias("scope_id"), (F.col("s_suppkey") % 2).alias("version"), F.when(F.col("s_suppkey") % 3 == 1, digest).otherwise("old").alias("pack_hash"))
    return V.scope_pack_issues(providers, packs)


def witness_formats(spark, sf_dir):
    """Fields of witnesses that do not have their format, by column."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 0, "short").when(k % 4 == 1, None).otherwise(F.sha2(k.cast("string"), 256)).alias("sha256"), F.when(k % 3 == 0, "2024-01-01").otherwise("2024-01-01T00:00:00Z").alias("created_at"))
    return V.malformed(rows, "id", {"sha256": V.HEX64, "created_at": V.TIME}).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("values"))


def witness_digests(spark, sf_dir):
    """Bytes of witnesses held against the digests that were expected of them."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(k.alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), F.when(k % 3 == 0, F.sha2(F.coalesce("text", F.lit("")), 256)).when(k % 3 == 1, "0").alias("expected"))
    return WI.check_witnesses(rows)


def hash_value_cbor(spark, sf_dir):
    """The digest of any JSON value's canonical CBOR."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('{"b":['), "c_nationkey", F.lit(',null,true,-7],"a":"'), "c_name", F.lit('"}')).alias("j"))
    return rows.select("c_custkey", canonical.cbor_sha256(F.col("j")).alias("sha256"))


def hash_bytes(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


def witness_lifecycle(spark, sf_dir):
    """Costs per order and the items of it as steps, in and out of order."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(k.alias("cost_id"), n.alias("seq")).distinct()
    k, n = F.col("cost_id"), F.col("seq")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("declared", "checked", "executed")]), ((n - 1 + F.when(k % 5 == 0, 1).otherwise(0)) % 3 + 1).cast("int"))
    steps = rows.select("cost_id", "seq", kind.alias("kind"), F.when((k % 7 == 0) & (n == 2), "w2").otherwise("w1").alias("witness_sha256"), F.when((k % 11 == 0) & (n == 3), None).otherwise("s").alias("snapshot_hash"))
    return WI.lifecycle_states(steps.where("seq <= 3"))


def ledger_append(spark, sf_dir):
    """The events of the second half of a month appended to those of the first."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    early = F.dayofmonth("ts") <= 15
    return ledger.append(events.where(early), events.where(~early)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


def run_lifecycle_events(spark, sf_dir):
    """Events of a projection run per user, of three phases, with ids from their own lines."""
    events = table(spark, sf_dir, "events").select("user_id").distinct()
    k = F.col("user_id")
    phase = lambda name, status: F.struct(F.lit(name).alias("phase"), status.alias("status"), F.lit("2024-01-01T00:00:01Z").alias("at"))
    runs = events.select(k.cast("string").alias("run_id"), F.lit("2024-01-01T00:00:00Z").alias("started_at"), F.when(k % 3 != 0, "2024-01-01T00:00:02Z").alias("ended_at"), F.when(k % 3 == 1, "failed").otherwise("complete").alias("status"), F.when(k % 3 == 1, 'say "no"').alias("error"), F.array(phase("nodes", F.lit("complete")), phase("edges", F.when(k % 2 == 0, "skipped").otherwise("complete"))).alias("phases"))
    return WI.run_events(runs, "projection", "projection_run_id")


def skip_identical_run(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"), F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.when(F.col("value") > 80, "complete").otherwise("failed").alias("status"))
    return projection.identical_run(runs, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trace")), ["trace"]).select("trace", "run_id", "skip")


def batch_accumulator(spark, sf_dir):
    """Customers of a nation in batches of 5 rows or 120 bytes."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.concat("c_name", F.repeat(F.lit("x"), (F.col("c_custkey") % 40).cast("int"))).alias("payload"))
    return projection.accumulate_batches(rows, "c_nationkey", "c_custkey", "payload", 5, 120).select("c_nationkey", "c_custkey", "batch")


def _attempts(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_mktsegment").alias("phase"), F.col("c_custkey").alias("batch"), (F.col("c_custkey") % 4 == 0).alias("ok"), (F.col("c_custkey") % 4 + 1).alias("good_at"))


def failed_batch_retry(spark, sf_dir):
    """Batches that go well at their first to fourth attempt, of three that are made."""
    return projection.retry_failed(_attempts(spark, sf_dir), lambda left, number: left.withColumn("ok", F.col("good_at") <= number))


def phase_results(spark, sf_dir):
    after = projection.retry_failed(_attempts(spark, sf_dir), lambda left, number: left.withColumn("ok", F.col("good_at") <= number))
    return projection.phase_results(after)


def saved_query(spark, sf_dir):
    """A query that is registered by name, run over a view, and listed with its digest."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("saved_nation")
    saved = projection.SavedQueries(spark)
    saved.register("by_region", "SELECT n_regionkey, count(*) AS n FROM saved_nation GROUP BY n_regionkey", tags=("b", "a"))
    return saved.run("by_region").join(saved.listing().select("name", "lang", "tags"), F.lit(True))


def projection_select(spark, sf_dir):
    """Rows written by two runs to a store of tables and read by run."""
    store = projection.ProjectionStore(spark, fresh_folder(spark, "store"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    store.write("parts", rows, "run1")
    store.write("parts", rows.where("p_size > 25"), "run2")
    return store.read("parts", "run2").select("p_partkey", "p_size", projection.RUN)


def _registry(spark, sf_dir):
    """A registry of the tables: nations are schemas, suppliers lenses, parts scopes and customers scope packs."""
    nation, supplier, part, customer = (table(spark, sf_dir, t) for t in ("nation", "supplier", "part", "customer"))
    rows = nation.select(F.lit("schemas").alias("kind"), F.concat(F.lit("schema/"), F.col("n_nationkey") % 23).alias("id"), F.when(F.col("n_nationkey") % 5 == 0, "plain").otherwise("canonical-cbor").alias("encoding"), F.when(F.col("n_nationkey") % 2 == 0, "snapshot").otherwise("witness").alias("schema_kind"))
    rows = rows.unionByName(supplier.select(F.lit("lenses").alias("kind"), F.concat(F.lit("lens:"), "s_suppkey").alias("id"), F.concat(F.lit("h"), F.col("s_suppkey") % 9).alias("hash")), allowMissingColumns=True)
    k = F.col("p_partkey")
    letters = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    of = lambda c: F.concat(F.lit("scope:p"), F.translate(c.cast("string"), "0123456789", "abcdefghij"))
    rows = rows.unionByName(part.select(F.lit("scopes").alias("kind"), F.concat(F.when(k % 50 == 7, F.lit("Scope:")).otherwise(F.lit("scope:p")), letters).alias("id"), F.lit(1).alias("version"), F.concat(F.lit("schema/"), F.col("p_size") % 30).alias("snapshot_schema_id"), F.array(F.concat(F.lit("schema/"), k % 24)).alias("emits"), F.array().cast("array<string>").alias("consumes"), F.array(F.when(k % 3 == 1, of(k - 1)).when(k % 3 == 2, of(k - 1)).otherwise(of(k + F.when(k % 9 == 0, 2).otherwise(3)))).alias("deps"), F.when(k % 2 == 0, "P1").alias("phase")), allowMissingColumns=True)
    packs = customer.select(F.lit("scope_packs").alias("kind"), F.concat(F.lit("scope:c"), F.col("c_custkey") % 100).alias("id"), F.lit(1).alias("version"), F.when(F.col("c_custkey") % 10 == 3, F.lit("bad")).otherwise(F.sha2((F.col("c_custkey") % 100 + F.when(F.col("c_custkey") % 20 == 5, F.col("c_custkey")).otherwise(0)).cast("string"), 256)).alias("hash"), F.array(F.lit("b"), F.lit("a"), F.when(F.col("c_custkey") % 10 == 4, "b").otherwise("c")).alias("predicates"))
    return rows.unionByName(packs, allowMissingColumns=True).select(*[(F.col(n) if n in {"kind", "id", "version", "hash", "encoding", "schema_kind", "phase", "snapshot_schema_id", "emits", "consumes", "deps", "predicates"} else F.lit(None)).cast(t).alias(n) for n, t in (p.split() for p in R.ENTRY.split(", "))])


def registry_problems(spark, sf_dir):
    return R.problems(_registry(spark, sf_dir), "schema/self").groupBy("problem", "kind").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


def registry_normalized(spark, sf_dir):
    """The normal form, counted: core buckets come in where none are, equal packs become one, predicates are sorted."""
    rows = R.normalized(_registry(spark, sf_dir))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.element_at("predicates", 1) == "a").alias("sorted"))


def registry_migrated(spark, sf_dir):
    """A registry document of the first version as entries in normal form."""
    old = {"schema_id": "meta-registry/0", "schemas": [{"id": "s/1", "canonical_encoding": "canonical-json", "schema_version": 1}], "scopes": [{"id": "scope:a", "version": 1}], "stdlib": [{"module_id": "module:std@1"}]}
    return R.normalized(R.entries(spark, old)).select("kind", "id", "version", "encoding", "unit")


def registry_pack_sync(spark, sf_dir):
    """Packs of the providers at hand replace those that are registered."""
    rows = _registry(spark, sf_dir)
    built_in = table(spark, sf_dir, "supplier").select(F.concat(F.lit("scope:c"), "s_suppkey").alias("id"), F.lit(1).alias("version"), F.lit("new").alias("hash"))
    return R.sync_packs(rows, built_in).where("kind = 'scope_packs'").groupBy(F.col("hash").eqNullSafe("new").alias("is_new")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def scope_addition_checks(spark, sf_dir):
    """Every scope of the registry as if it were added to it."""
    rows = _registry(spark, sf_dir)
    checks = R.scope_checks(rows.where("kind = 'scopes'"), rows, adding=True, second_phase=True)
    return checks.groupBy("check", "severity", "passed").agg(F.count(F.lit(1)).alias("n"))


def scope_dependency_cycles(spark, sf_dir):
    return R.dependency_cycles(_registry(spark, sf_dir).where("kind = 'scopes'"))


def scope_references(spark, sf_dir):
    """Schemas that scopes emit and the registry does not know."""
    rows = _registry(spark, sf_dir)
    wanted = rows.where("kind = 'scopes'").select(F.explode("emits").alias("id")).distinct()
    return R.allows(rows, "schemas", wanted)


PLAN_KEYS = 40


def _contracts(spark, sf_dir):
    """A plan, a proposal and observed changes per customer, with a fault for some remainders."""
    k = F.col("c_custkey")
    paths = lambda *p: F.concat(F.lit('["'), F.concat_ws('","', *p), F.lit('"]'))
    a, b = F.concat(F.lit("src/a"), k), F.concat(F.lit("src/b"), k)
    plan_body = F.concat(F.lit('"schema_id":"'), F.when(k % 10 == 1, "plan-artifact/9").otherwise("plan-artifact/0"), F.lit('","intent":"'), F.when(k % 10 == 2, " ").otherwise("do"), F.lit('","scope_targets":["src/*"],"expected_changed_paths":'), paths(a, b), F.lit(',"stop_conditions":["x"],"validation_steps":[],"risk_routes":[],"confidence":0.5,"generated_by":{"provider":"p","model":"m","surface":"s","timestamp":"t"}'))
    keys = table(spark, sf_dir, "customer").select(k.alias("key"), plan_body.alias("body"), F.when(k % 10 == 3, paths(a, F.lit("action.yml"))).otherwise(paths(a, b)).alias("claims"))
    plan_hash = canonical.identity_sha256(F.concat(F.lit("{"), "body", F.lit("}")), "plan_id")
    plans = keys.select("key", "claims", F.concat(F.lit('{"plan_id":"plan:'), F.when(F.col("key") % 10 == 4, "0").otherwise(plan_hash), F.lit('",'), "body", F.lit("}")).alias("json"))
    pid = F.get_json_object("json", "$.plan_id")
    body = F.concat(F.lit('"schema_id":"proposal-manifest/0","plan_id":"'), F.when(F.col("key") % 10 == 5, "plan:other").otherwise(pid), F.lit('","base_sha":"b","head_sha":"h","changed_paths":'), "claims", F.lit(',"commands_run":["c"],"test_results":[]'))
    manifests = plans.select("key", body.alias("body"))
    manifest_hash = canonical.identity_sha256(F.concat(F.lit("{"), "body", F.lit("}")), "manifest_id")
    manifests = manifests.select("key", F.concat(F.lit('{"manifest_id":"manifest:'), manifest_hash, F.lit('",'), "body", F.lit("}")).alias("json"))
    key = F.col("key")
    observed = plans.select("key", F.explode(F.array(F.concat(F.lit("./src/a"), key), F.when(key % 10 == 6, F.lit("deploy/secrets/k")).when(key % 10 == 7, F.lit(".github/workflows/x.yml")).otherwise(F.concat(F.lit("src\\b"), key)))).alias("path"))
    return plans.where("key % 10 != 8").select("key", "json"), manifests.where("key % 10 != 9"), observed


def plan_contract_issues(spark, sf_dir):
    plans, manifests, observed = _contracts(spark, sf_dir)
    return PL.contract_issues(plans, manifests, observed, enforce=True).select("key", "level", "issue", "detail")


def plan_contract_outcomes(spark, sf_dir):
    plans, manifests, observed = _contracts(spark, sf_dir)
    issues = PL.contract_issues(plans, manifests, observed, enforce=True)
    return PL.contract_outcomes(issues, observed, enforce=True)


def _plan_texts(spark, sf_dir):
    """The plan of each customer in markdown: some sections inline, some missing, empty or twice."""
    k = F.col("c_custkey")
    parts = []
    for n, prompt in enumerate(PL.PROMPTS, 1):
        body = F.concat(F.lit(f"Guidance: x\nPrompt ID: `{prompt}`\nAnswer: "), "c_name", F.lit("\n\n")) if n % 3 == 0 else F.concat(F.lit("<!-- c -->\nanswer:\n\n  line "), k, F.lit(" Governance\n---\nnot this\n"))
        if n == 4:
            body = F.concat(F.lit("Answer:\nsome Grade "), k % 5, F.lit(", downgrade 3\n"))
        body = F.when(k % 12 == n - 1, F.lit("Answer:\n\n")).otherwise(body)
        head = F.lit(f"### {n}. Title\n")
        parts.append(F.when(k % 13 == n, F.lit("")).when(k % 17 == n, F.concat(head, body, head, body)).otherwise(F.concat(head, body)))
    parts_of_keys = int(spark.conf.get("spark.sql.shuffle.partitions"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(parts_of_keys, "c_custkey")  # texts are made of keys, of which a few splits hold all
    return customers.select(k.alias("plan"), F.concat(F.lit("# Plan\n"), *parts, F.lit("### 99. Other\nanswer: x\n")).alias("text"))


def plan_answers(spark, sf_dir):
    return PL.answers(_plan_texts(spark, sf_dir))


def plan_risks(spark, sf_dir):
    return PL.derived_risks(PL.answers(_plan_texts(spark, sf_dir)))


def plan_hash_of_message(spark, sf_dir):
    k = F.col("c_custkey")
    trailer = F.concat(F.when(k % 3 == 0, F.lit("Plan-Hash: sha256:")).otherwise(F.lit("plan-witness: ")), F.sha2("c_name", 256))
    message = F.concat(F.lit("fix\n\n"), trailer, F.when(k % 4 == 0, F.concat(F.lit("\n"), F.lit("Plan-Hash: "), F.repeat(F.lit("a"), 64))).otherwise(F.lit("")), F.when(k % 5 == 0, F.lit(" and more")).otherwise(F.lit("")))
    return table(spark, sf_dir, "customer").select("c_custkey", V.plan_hash(message).alias("plan_hash"))


STOPS = ("a/b.pem", "x/.env", "conf/.env.local", "src/main.rs", "action.yml", ".github/workflows/a.yml", "ctl/schemas/a", "ctl/prompts/p", "ctl/other", "a/secrets/b", "SERVER.KEY", "monkey")
_STOPS = ("secrets_detected", "secrets_detected", "secrets_detected", "", "touches_action_definition", "touches_github_workflows", "meta_schema_change", "meta_prompt_change", "meta_registry_change", "secrets_detected", "secrets_detected", "")


def path_stop_reasons(spark, sf_dir):
    path = _pick(STOPS, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(PL.stop_reasons(path, "ctl"), ",").alias("reasons"), PL.secret_like(path).alias("secret"), PL.sensitive(path, "ctl").alias("sensitive"))


def invariant_profile(spark, sf_dir):
    k = F.col("o_orderkey")
    facts = table(spark, sf_dir, "orders").select(F.when(k % 6 != 0, F.concat(F.lit(" "), _pick(("Data Loss", "trust", "DATA loss"), k))).alias("invariant"), F.when(k % 2 == 0, F.concat(F.lit("c"), k % 4)).alias("constraint_id"))
    return findings.invariant_profile(facts).select("invariant", "triggered_count", "finding_count", F.array_join("constraint_ids", ",").alias("constraint_ids"))


def findings_by_file(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.when(F.col("l_quantity") > 45, "error").when(F.col("l_quantity") > 25, "warning").otherwise("info").alias("severity"))
    return findings.by_file(rows)


def finding_order_full(spark, sf_dir):
    """Findings numbered in reporting order."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("rule_id"), _pick(("error", "info", "warning"), F.col("p_partkey")).alias("severity"), F.col("p_type").alias("path"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("line"), F.lit(None).cast("int").alias("col"), F.col("p_partkey").cast("string").alias("message"))
    return S.numbered(rows, findings.finding_order()).select("rule_id", "message", "place")


class _Parts(findings.Provider):
    """A provider over parts, for the extension surface: one predicate with a schema of its parameters."""

    scope_id = "parts.size"
    version = 2

    def param_schemas(self):
        return {"larger": {"type": "object", "properties": {"size": {"type": "integer"}}, "required": ["size"], "additionalProperties": False}}

    def predicates(self):
        return {"larger": lambda facts, params: findings.PredicateResult(findings.findings(facts.where(F.col("p_size") > params["size"]), "parts/larger", path=F.col("p_partkey"), message="large"))}

    def snapshot(self, spark, source):
        return table(spark, source, "part").select("p_partkey", "p_size")


def provider_surface(spark, sf_dir):
    """What providers offer, can't do, and refuse."""
    registry = findings.ProviderRegistry([predicates.TextMetrics(), _Parts()])
    provider = registry.get("parts.size")
    facts = provider.snapshot(spark, sf_dir)
    said = [("scopes", ",".join(registry.scopes())), ("order", str(registry.pack_hash() == findings.ProviderRegistry([_Parts(), predicates.TextMetrics()]).pack_hash()))]
    for what, call in (("plan", lambda: provider.plan({}, [])), ("execute", lambda: provider.execute("h")), ("params", lambda: provider.evaluate("larger", facts, {"size": "x"})), ("unknown", lambda: provider.evaluate("none", facts, {}))):
        try:
            call()
        except findings.ProviderError as error:
            said.append((what, str(error)))
    found = provider.evaluate("larger", facts, {"size": 40}).findings
    return spark.createDataFrame(said, "what string, said string").unionByName(found.agg(F.lit("findings").alias("what"), F.count(F.lit(1)).cast("string").alias("said")))


def provider_verify(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(F.lit("text").alias("kind"), F.when(k % 4 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha256"), F.col("text").alias("content"))
    return _Parts().verify(rows).groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


def ruleset_overlays(spark, sf_dir):
    """A ruleset whose bindings are switched off, overlaid with other parameters, and ordered."""
    facts = _Parts().snapshot(spark, sf_dir)
    bindings = (findings.Binding("B-2", "warning", "parts.size", "larger", {"size": 45}), findings.Binding("B-1", "error", "parts.size", "larger", {"size": 10}), findings.Binding("B-0", "error", "parts.size", "larger", {"size": 0}))
    ruleset = findings.RuleSet("sizes", bindings, enabled_rules=("B-1", "B-2"), fail_on="error")
    out = findings.evaluate_ruleset(spark, ruleset, findings.ProviderRegistry([_Parts()]), {"parts.size": facts}, overlays={"B-1": {"size": 1000}})
    return out.rule_results.select("rule_id", "severity", "triggered", "findings_count")


def since_cutoffs(spark, sf_dir):
    """Cutoffs for durations and times, counted over the events."""
    from datetime import datetime, timezone

    now = datetime(2024, 1, 20, tzinfo=timezone.utc)
    rows = [(raw, S.since_cutoff(raw, now).astimezone(timezone.utc).replace(tzinfo=None)) for raw in ("3d", "12h", "2w", "90m", "2024-01-10T00:00:00Z", "2024-01-10T02:00:00+02:00")]
    cutoffs = spark.createDataFrame(rows, "raw string, since timestamp")
    events = table(spark, sf_dir, "events").groupBy(F.date_trunc("minute", F.col("ts")).alias("minute")).agg(F.count(F.lit(1)).alias("c"))
    return cutoffs.join(events, F.col("minute") >= F.col("since"), "left").groupBy("raw").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"))


def ledger_rows_by_family(spark, sf_dir):
    """Status of a ledger: events by family, the newest event, and how much of it is new since a moment."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(ledger.family(F.concat("event_type", F.lit(".x"))).alias("family")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("newest"), F.count_if(F.col("value") > 50).alias("large")).select("family", "events", F.date_format("newest", "yyyy-MM-dd HH:mm").alias("newest"), "large")


def artifact_log(spark, sf_dir):
    """Artifacts of a kind, the largest first, a page of them; and one that is found by the start of its digest."""
    docs = table(spark, sf_dir, "documents")
    listing = docs.select(_pick(("witness", "snapshot"), F.col("doc_id")).alias("kind"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes")).distinct()
    return S.artifact_log(listing, kind="witness", limit=25).select("kind", "sha256", "bytes")


def artifact_resolve(spark, sf_dir):
    listing = table(spark, sf_dir, "documents").select(_pick(("witness", "snapshot"), F.col("doc_id")).alias("kind"), F.sha2("text", 256).alias("sha256"), F.lit("cbor").alias("extension"))
    return S.artifacts_by_prefix(listing, "a")


def tracked_records(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit(".\\src/"), "p_partkey").alias("path"), F.sha2("p_name", 256).alias("blob_oid"))
    return S.tracked_records(rows)


def incremental_resolution(spark, sf_dir):
    """Documents to resolve again once files were added, changed or removed, whose keys are their names."""
    from ..operators import documents as D

    orders = table(spark, sf_dir, "orders")
    state = lambda rows: rows.select(F.col("o_orderkey").cast("string").alias("path"), F.length("o_orderpriority").alias("size"), F.col("o_custkey").alias("mtime"))
    before, now = state(orders.where("o_orderkey % 5 != 0")), state(orders.where("o_orderkey % 7 != 0").withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, -1).otherwise(F.col("o_custkey"))))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_orderkey").cast("string").alias("key"))
    return D.incremental_update(now, before, links, F.col("path"))


def _stream(spark, sf_dir, name):
    """The events as a stream of the files of a folder that they were written to."""
    folder = fresh_folder(spark, name)
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    again = events.where("event_id % 4 = 0")  # some events come twice
    events.unionByName(again).repartition(4).write.parquet(folder)
    return ledger_stream.read_ledger(spark, folder, events.schema)


def stream_dedup_events(spark, sf_dir):
    """A deduplicated ledger, written by a stream that ends once all there is has been read."""
    out = fresh_folder(spark, "stream-out")
    stream = ledger_stream.first_events(_stream(spark, sf_dir, "stream-in"), "3650 days")
    ledger_stream.append_to_ledger(stream, out, fresh_folder(spark, "stream-cp")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_latest_status(spark, sf_dir):
    """The newest event of each kind, kept by a stream in update mode: the last state that it wrote."""
    out = fresh_folder(spark, "status")

    def keep(rows, batch):
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

    ledger_stream.maintain_status(_stream(spark, sf_dir, "status-in"), keep, fresh_folder(spark, "status-cp")).awaitTermination()
    return projection.latest_rows(spark.read.parquet(out), ["event_type"], F.col("batch")).select("event_type", "event_id")


def stream_lifecycle(spark, sf_dir):
    """Costs' states kept by a stream: the furthest step per cost, and steps that came too early."""
    folder, out = fresh_folder(spark, "life-in"), fresh_folder(spark, "life-out")
    steps = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(F.col("l_orderkey").alias("cost_id"), F.col("l_linenumber").cast("long").alias("seq"), F.element_at(F.array(F.lit("declared"), F.lit("checked"), F.lit("executed")), F.col("l_linenumber")).alias("kind")).distinct()
    steps.write.parquet(folder)
    stream = spark.readStream.schema(steps.schema).parquet(folder)
    ledger_stream.keep_lifecycles(stream, out, fresh_folder(spark, "life-state"), fresh_folder(spark, "life-cp")).awaitTermination()
    last = projection.latest_rows(spark.read.parquet(out), ["cost_id"], F.col("seq"))
    return last.groupBy("state", "accepted").agg(F.count(F.lit(1)).alias("n"))


def dag_node_ids(spark, sf_dir):
    """Content ids of nodes of a kind, from their digests, inputs and parameters."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.lit("file_at_path").alias("type"), F.concat(F.lit("src/"), k).alias("p"), F.sha2("p_name", 256).alias("c"), F.array(F.sha2("p_brand", 256), F.sha2("p_type", 256)).alias("inputs"), F.concat(F.lit("p"), F.col("p_size")).cast("binary").alias("params"))
    return dag.node_ids(rows, {"path": "p", "content_sha256": "c"}).select("p_partkey", "node_id")


def dag_ensure_nodes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("scope:s").alias("scope"))
    known = rows.where("id % 3 = 0")
    return dag.ensure_nodes(known, rows.unionByName(rows)).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def _edges(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t"), F.col("o_custkey") % 7).alias("timeline"), (k % 5).alias("seq"), F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("o"), k % 300).alias("dst"), _pick(dag.EDGE_KINDS, k).alias("kind"),
        F.col("o_orderstatus").alias("detail"), F.concat(F.lit("scope:"), "o_orderpriority").alias("scope"), F.when((k % 2 == 0) & (k % 5 != 1), F.concat(F.lit("w"), k)).alias("witness_ref"), _pick(dag.RISKS, F.floor(k / 5)).alias("risk"),
    )


def dag_add_edges(spark, sf_dir):
    """Edges are related once, however often they come."""
    edges = _edges(spark, sf_dir)
    return dag.add_edges(edges.where("seq < 2").distinct(), edges.unionByName(edges)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def dag_edge_views(spark, sf_dir):
    """The five partial orders of a graph as views by kind."""
    edges, out = _edges(spark, sf_dir), None
    for kind in dag.EDGE_KINDS:
        view = dag.of_kind(edges, kind).agg(F.lit(kind).alias("view"), F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"))
        out = view if out is None else out.unionByName(view)
    return out


def dag_checked_edges(spark, sf_dir):
    """Edges as constructors allow them, and mutations that lack their witness."""
    edges = _edges(spark, sf_dir)
    lacking = dag.unwitnessed_mutations(edges)
    sound = edges.join(lacking.select("timeline", "seq", "src", "dst", "detail", "scope", "kind").distinct(), ["timeline", "seq", "src", "dst", "detail", "scope", "kind"], "left_anti")
    return dag.checked_edges(sound).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).unionByName(lacking.agg(F.lit("lacking").alias("kind"), F.count(F.lit(1)).alias("n")))


def mutation_timeline_order(spark, sf_dir):
    return dag.mutation_order(_edges(spark, sf_dir).distinct().where("kind = 'mutation_commitment'").select("timeline", "seq", "src", "dst", "kind").distinct()).select("timeline", "seq", "src", "dst", "place")


def canonical_edge_order(spark, sf_dir):
    """All edges numbered in their canonical order of seven keys."""
    edges = _edges(spark, sf_dir).drop("risk").distinct()
    return S.numbered(edges, dag.edge_order()).select("timeline", "seq", "src", "dst", "kind", "detail", "scope", "witness_ref", "place")


def _tree(spark, sf_dir):
    """What depends on what: a part on the part of half its key, and on the one before it where that is even."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").where("p_partkey > 0")
    return part.select(F.floor(k / 2).cast("long").alias("src"), k.alias("dst")).unionByName(part.where("p_partkey % 2 = 1").select((k - 1).alias("src"), k.alias("dst"))).where("src != dst").distinct()


def topological_levels(spark, sf_dir):
    return dag.topological_levels(_tree(spark, sf_dir))


def cycle_paths(spark, sf_dir):
    """A cycle of each component of a graph in which parts of one size form a ring."""
    k = F.col("p_size")
    sizes = table(spark, sf_dir, "part").select("p_size").distinct()
    ring = sizes.select(F.format_string("%02d", k).alias("src"), F.when(k % 5 == 4, F.format_string("%02d", k - 4)).otherwise(F.format_string("%02d", k + 1)).alias("dst"))
    whole = ring.join(ring.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
    return dag.cycle_paths(whole).select(F.array_join("path", ">").alias("path"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name.islower()}

_TYPED = f"SELECT doc_id AS k, doc_id % 3 AS place, {_sql_pick(('.md', '.md', '.txt', '.md'), 'doc_id')} AS ext FROM documents"
_REG = """
WITH sc AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 7 THEN 'Scope:' ELSE 'scope:p' END || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') AS id, 'schema/' || (p_size % 30) AS snap, 'schema/' || (p_partkey % 24) AS emits,
            'scope:p' || translate(CAST(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey - 1 WHEN p_partkey % 9 = 0 THEN p_partkey + 2 ELSE p_partkey + 3 END AS VARCHAR), '0123456789', 'abcdefghij') AS dep, p_partkey % 2 = 0 AS phase FROM part),
sm AS (SELECT 'schema/' || (n_nationkey % 23) AS id, n_nationkey % 2 = 0 AS snapshot, n_nationkey % 5 = 0 AS bad FROM nation),
pk AS (SELECT 'scope:c' || (c_custkey % 100) AS id, CASE WHEN c_custkey % 10 = 3 THEN 'bad' ELSE sha256(CAST(c_custkey % 100 + CASE WHEN c_custkey % 20 = 5 THEN c_custkey ELSE 0 END AS VARCHAR)) END AS hash, c_custkey % 10 = 4 AS twice FROM customer)
"""
_CYCLES = ", ring AS (SELECT a.id FROM sc a JOIN sc b ON b.id = a.dep JOIN sc c ON c.id = b.dep WHERE c.dep = a.id)"
_LIFE = """
WITH r AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber <= 3),
s AS (SELECT k, n, (n - 1 + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END) % 3 + 1 AS rank, CASE WHEN k % 7 = 0 AND n = 2 THEN 'w2' ELSE 'w1' END AS w, CASE WHEN k % 11 = 0 AND n = 3 THEN NULL ELSE 's' END AS snap FROM r),
b AS (SELECT *, coalesce(max(rank) OVER o, 0) AS reached, last_value(w IGNORE NULLS) OVER o AS bw, last_value(snap IGNORE NULLS) OVER o AS bs FROM s WINDOW o AS (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN rank = 1 AND reached > 0 THEN 'declared_again' WHEN rank > 1 AND reached < rank - 1 THEN ['declared', 'checked', 'executed'][rank] || '_too_early' WHEN rank = 3 AND reached = 3 THEN 'executed_again'
             WHEN snap IS NULL THEN 'snapshot_missing' WHEN bw <> w THEN 'witness_differs' WHEN bs <> snap THEN 'snapshot_differs' END AS fault FROM b)
"""
_RETRY = "WITH b AS (SELECT c_mktsegment AS phase, c_custkey AS batch, c_custkey % 4 AS r FROM customer), t AS (SELECT *, r <> 3 AS ok, CASE r WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS attempts, CASE r WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 300 END AS waited_ms FROM b)"
_EDGES = f"""
WITH e AS (SELECT 't' || (o_custkey % 7) AS timeline, o_orderkey % 5 AS seq, 'c' || o_custkey AS src, 'o' || (o_orderkey % 300) AS dst, {_sql_pick(dag.EDGE_KINDS, "o_orderkey")} AS kind, o_orderkey % 5 AS kind_rank, o_orderstatus AS detail, 'scope:' || o_orderpriority AS scope,
           CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 1 THEN 'w' || o_orderkey END AS witness_ref, {_sql_pick(dag.RISKS, "o_orderkey // 5")} AS risk FROM orders)
"""
_CONTRACT = """
WITH c AS (SELECT c_custkey AS key, c_custkey % 10 AS r, 'src/a' || c_custkey AS a, 'src/b' || c_custkey AS b FROM customer),
i AS (
  SELECT key, 'error' AS level, unnest(CASE r WHEN 1 THEN ['plan_schema_mismatch'] WHEN 2 THEN ['plan_without_intent'] WHEN 4 THEN ['plan_id_mismatch'] WHEN 5 THEN ['manifest_of_another_plan'] WHEN 8 THEN ['plan_missing'] WHEN 9 THEN ['manifest_missing'] ELSE [] END) AS issue, CAST(NULL AS VARCHAR) AS detail FROM c
  UNION ALL SELECT key, 'warning', unnest(CASE r WHEN 3 THEN ['observed_not_claimed'] WHEN 6 THEN ['observed_not_claimed', 'observed_not_expected'] WHEN 7 THEN ['observed_not_claimed', 'observed_not_expected'] WHEN 9 THEN ['observed_not_claimed'] ELSE [] END), CASE r WHEN 3 THEN b WHEN 6 THEN 'deploy/secrets/k' WHEN 7 THEN '.github/workflows/x.yml' WHEN 9 THEN b END FROM c
  UNION ALL SELECT key, 'warning', 'observed_not_claimed', a FROM c WHERE r = 9
  UNION ALL SELECT key, 'warning', unnest(['claimed_not_observed', 'expected_not_observed']), b FROM c WHERE r IN (6, 7)
  UNION ALL SELECT key, 'warning', 'claimed_not_observed', 'action.yml' FROM c WHERE r = 3
  UNION ALL SELECT key, 'stop', unnest(['claimed_sensitive_path_unverified', 'touches_action_definition']), 'action.yml' FROM c WHERE r = 3
  UNION ALL SELECT key, 'stop', 'secrets_detected', 'deploy/secrets/k' FROM c WHERE r = 6
  UNION ALL SELECT key, 'stop', 'touches_github_workflows', '.github/workflows/x.yml' FROM c WHERE r = 7
)
"""
_ANSWERS = f"""
WITH c AS (SELECT c_custkey AS k, c_name, unnest(range(1, 13)) AS n FROM customer),
s AS (SELECT k, n, {"[" + ", ".join(repr(p) for p in PL.PROMPTS) + "]"}[n] AS prompt_id, CASE WHEN k % 13 = n THEN 'missing' WHEN k % 17 = n THEN 'duplicate' WHEN k % 12 = n - 1 THEN 'empty' END AS problem,
             CASE WHEN n = 4 THEN 'some Grade ' || (k % 5) || ', downgrade 3' WHEN n % 3 = 0 THEN c_name ELSE 'line ' || k || ' Governance' END AS said FROM c),
a AS (SELECT k AS plan, prompt_id, CASE WHEN problem IS NULL THEN said END AS answer, problem FROM s)
"""

ORACLE_SQL = {
    "vault_schema_findings": f"""
        WITH n AS ({_TYPED}), t AS (SELECT *, place <> 2 AS placed, k % 7 <> 0 AS typed, k % 6 <> 0 AS head, k % 3 AS r FROM n), m AS (SELECT *, (placed AND NOT (place = 0 AND ext = '.txt')) AS fits FROM t), o AS (SELECT *, fits OR typed AS mine FROM m)
        SELECT rule_id, n FROM (SELECT 'vault/untyped-file' AS rule_id, count(*) FILTER (NOT mine) AS n FROM o
        UNION ALL SELECT 'vault/missing-frontmatter', count(*) FILTER (mine AND NOT head) FROM o UNION ALL SELECT 'vault/extension-mismatch', count(*) FILTER (mine AND ext <> '.md') FROM o
        UNION ALL SELECT 'vault/forbidden-location', count(*) FILTER (mine AND NOT fits) FROM o
        UNION ALL SELECT 'vault/missing-required-field', count(*) FILTER (mine AND head AND r = 2) + count(*) FILTER (mine AND head AND k % 2 <> 0) FROM o
        UNION ALL SELECT 'vault/enum-mismatch', count(*) FILTER (mine AND head AND r = 1) FROM o UNION ALL SELECT 'vault/missing-section', count(*) FILTER (mine AND k % 4 <> 0) FROM o) WHERE n > 0""",
    "vault_invariant_coverage": """
        WITH r AS (SELECT doc_id % 3 AS role, CASE WHEN doc_id % 5 <> 4 THEN source || '-' || lang END AS i FROM documents)
        SELECT d.i AS invariant_id, count(u.i) AS notes, count(u.i) FILTER (u.role = 1) AS concepts FROM (SELECT DISTINCT i FROM r WHERE role = 0 AND i IS NOT NULL) d LEFT JOIN (SELECT * FROM r WHERE role <> 0) u USING (i) GROUP BY d.i""",
    "taxonomy_drift": "SELECT 'type' AS kind, lang AS value, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'fr') GROUP BY ALL UNION ALL SELECT 'facet', source, count(*) FROM documents WHERE source NOT IN ('known', 'src1', 'web') GROUP BY ALL",
    "role_purity": "SELECT doc_id AS path, lang AS role FROM documents WHERE (lang = 'en' AND regexp_matches(text, '\\bthe\\b')) OR (lang = 'fr' AND contains(text, 'eau'))",
    "template_leftovers": "SELECT doc_id AS path FROM documents WHERE doc_id % 5 < 2",
    "scope_pack_issues": "SELECT 'scope:s' || s_suppkey AS scope_id, s_suppkey % 2 AS version, CASE s_suppkey % 3 WHEN 0 THEN 'missing' ELSE 'mismatch' END AS issue FROM supplier WHERE s_suppkey % 3 <> 1",
    "witness_formats": """SELECT 'sha256' AS "column", count(*) AS n, CAST(1 AS BIGINT) AS "values" FROM orders WHERE o_orderkey % 4 < 2 UNION ALL SELECT 'created_at', count(*), 1 FROM orders WHERE o_orderkey % 3 = 0""",
    "witness_digests": "SELECT doc_id AS id, sha256(coalesce(text, '')) AS sha256, doc_id % 3 <> 1 AS ok FROM documents",
    "hash_value_cbor": f"SELECT c_custkey, {C.sha256(C.mapping({'b': chr(39) + '84' + chr(39) + ' || ' + C.integer('c_nationkey') + ' || ' + chr(39) + 'f6f526' + chr(39), 'a': C.text('c_name')}))} AS sha256 FROM customer",
    "hash_bytes": "SELECT page_id, sha256(html) AS sha256 FROM pages",
    "witness_lifecycle": _LIFE + "SELECT k AS cost_id, coalesce(['declared', 'checked', 'executed'][max(rank) FILTER (fault IS NULL)], 'none') AS state, coalesce(string_agg(DISTINCT fault, ',' ORDER BY fault), '') AS faults FROM f GROUP BY k",
    "ledger_append": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
    "run_lifecycle_events": """
        WITH u AS (SELECT DISTINCT user_id AS k FROM events),
        s AS (SELECT k, 'run.started' AS e, '{"event_type":"projection.run.started","timestamp":"2024-01-01T00:00:00Z","projection_run_id":"' || k || '"}' AS j FROM u
              UNION ALL SELECT k, 'phase.completed', '{"event_type":"projection.phase.completed","timestamp":"2024-01-01T00:00:01Z","projection_run_id":"' || k || '","phase":"nodes","status":"complete"}' FROM u
              UNION ALL SELECT k, 'phase.' || CASE WHEN k % 2 = 0 THEN 'skipped' ELSE 'completed' END, '{"event_type":"projection.phase.' || CASE WHEN k % 2 = 0 THEN 'skipped' ELSE 'completed' END || '","timestamp":"2024-01-01T00:00:01Z","projection_run_id":"' || k || '","phase":"edges","status":"' || CASE WHEN k % 2 = 0 THEN 'skipped' ELSE 'complete' END || '"}' FROM u
              UNION ALL SELECT k, 'run.completed', '{"event_type":"projection.run.completed","timestamp":"2024-01-01T00:00:02Z","projection_run_id":"' || k || '","status":"' || CASE WHEN k % 3 = 1 THEN 'failed","error":"say \\"no\\""}' ELSE 'complete"}' END FROM u WHERE k % 3 <> 0)
        SELECT sha256(j) AS event_id, 'projection.' || e AS event_type, regexp_replace(j, '^(\\{"event_type":"[^"]*")', '\\1,"event_id":"' || sha256(j) || '"') AS line FROM s""",
    "skip_identical_run": "WITH l AS (SELECT user_id, arg_max(event_id, (ts, event_id)) AS run_id FROM events WHERE value > 80 GROUP BY user_id) SELECT c_custkey AS trace, run_id, run_id IS NOT NULL AS skip FROM customer LEFT JOIN l ON user_id = c_custkey",
    "batch_accumulator": """
        WITH RECURSIVE o AS (SELECT c_nationkey AS g, c_custkey AS k, strlen(c_name) + c_custkey % 40 AS b, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer),
        w AS (SELECT g, k, rn, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, CAST(b AS BIGINT) AS bytes FROM o WHERE rn = 1
              UNION ALL SELECT o.g, o.k, o.rn, CASE WHEN w.n >= 5 OR w.bytes >= 120 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.n >= 5 OR w.bytes >= 120 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 5 OR w.bytes >= 120 THEN CAST(o.b AS BIGINT) ELSE w.bytes + o.b END FROM w JOIN o ON o.g = w.g AND o.rn = w.rn + 1)
        SELECT g AS c_nationkey, k AS c_custkey, batch FROM w""",
    "failed_batch_retry": _RETRY + " SELECT phase, batch, ok, CAST(attempts AS INT) AS attempts, CAST(waited_ms AS BIGINT) AS waited_ms FROM t",
    "phase_results": _RETRY + " SELECT phase, count(*) AS total, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, CASE WHEN bool_and(ok) THEN 'complete' WHEN NOT bool_or(ok) THEN 'failed' ELSE 'partial' END AS status FROM t GROUP BY phase",
    "saved_query": "SELECT n_regionkey, count(*) AS n, 'by_region' AS name, 'sql' AS lang, 'b,a' AS tags FROM nation GROUP BY 1",
    "projection_select": "SELECT p_partkey, p_size, 'run2' AS projection_run_id FROM part WHERE p_size > 25",
    "registry_problems": _REG + """
        SELECT 'duplicate_id' AS problem, 'schemas' AS kind, count(*) AS n, min(id) AS first FROM (SELECT id FROM sm GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0
        UNION ALL SELECT 'duplicate_lens_hash', 'lenses', count(*), min(h) FROM (SELECT 'h' || (s_suppkey % 9) AS h FROM supplier GROUP BY 1 HAVING count(*) > 1) HAVING count(*) > 0
        UNION ALL SELECT 'unknown_encoding', 'schemas', count(*), min(id) FROM sm WHERE bad HAVING count(*) > 0 UNION ALL SELECT 'missing_core_bucket', 'meta_buckets', 3, 'bucket:compatibility_debt'
        UNION ALL SELECT 'pack_hash_malformed', 'scope_packs', count(*), min(id) FROM pk WHERE hash = 'bad' HAVING count(*) > 0 UNION ALL SELECT 'duplicate_predicate', 'scope_packs', count(*), min(id) FROM pk WHERE twice HAVING count(*) > 0
        UNION ALL SELECT 'packs_differ', 'scope_packs', count(*), min(id) FROM (SELECT id FROM pk GROUP BY id HAVING count(DISTINCT (hash, twice)) > 1) HAVING count(*) > 0 UNION ALL SELECT 'missing_self_schema', 'schemas', 1, 'schema/self'""",
    "registry_normalized": _REG + """
        SELECT 'scopes' AS kind, count(*) AS n, CAST(0 AS BIGINT) AS sorted FROM sc UNION ALL SELECT 'schemas', count(*), 0 FROM sm UNION ALL SELECT 'lenses', count(*), 0 FROM supplier UNION ALL SELECT 'meta_buckets', 3, 0
        UNION ALL SELECT 'scope_packs', count(*), count(*) FROM (SELECT DISTINCT id, hash, twice FROM pk)""",
    "registry_migrated": """SELECT * FROM (VALUES ('schemas', 's/1', CAST(1 AS INT), 'canonical-json', CAST(NULL AS VARCHAR)), ('scopes', 'scope:a', 1, NULL, NULL), ('stdlib', 'module:std@1', NULL, NULL, NULL),
        ('meta_buckets', 'bucket:trust_debt', NULL, NULL, 'risk_points'), ('meta_buckets', 'bucket:compatibility_debt', NULL, NULL, 'risk_points'), ('meta_buckets', 'bucket:explanation_debt', NULL, NULL, 'risk_points')) t(kind, id, version, encoding, unit)""",
    "registry_pack_sync": _REG + ", b AS (SELECT 'scope:c' || s_suppkey AS id FROM supplier) SELECT false AS is_new, count(*) AS n, count(DISTINCT id) AS ids FROM pk WHERE id NOT IN (FROM b) HAVING count(*) > 0 UNION ALL SELECT true, count(*), count(DISTINCT id) FROM b",
    "scope_addition_checks": _REG + _CYCLES + """
        , k AS (SELECT *, regexp_matches(id, '^scope:p') AS good_id, EXISTS (SELECT 1 FROM sm WHERE sm.id = snap) AND (SELECT bool_and(snapshot) FROM sm WHERE sm.id = snap) AS good_snap, emits IN (SELECT id FROM sm) AS good_emits, dep IN (SELECT id FROM sc) AND id NOT IN (FROM ring) AS good_deps FROM sc),
        c AS (SELECT unnest(['scope_id_format', 'meta_scope_completeness', 'snapshot_schema_exists', 'emits_schemas_exist', 'consumes_schemas_exist', 'dependencies_valid', 'no_duplicate_scope']) AS name, unnest([good_id, true, good_snap, good_emits, true, good_deps, false]) AS passed FROM k)
        SELECT name AS "check", 'error' AS severity, passed, count(*) AS n FROM c GROUP BY ALL
        UNION ALL SELECT 'phase_field_present', 'warn', false, count(*) FROM sc WHERE NOT phase UNION ALL SELECT unnest(['deterministic_field_present', 'role_field_present']), 'warn', false, (SELECT count(*) FROM sc)""",
    "scope_dependency_cycles": _REG + _CYCLES + " SELECT DISTINCT id FROM ring",
    "scope_references": _REG + " SELECT DISTINCT emits AS id, emits IN (SELECT id FROM sm) AS allowed FROM sc",
    "plan_contract_issues": _CONTRACT + "SELECT * FROM i",
    "plan_contract_outcomes": _CONTRACT + """
        , n AS (SELECT key, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings, count(*) FILTER (level = 'stop') AS stops, coalesce(bool_or(level = 'error' AND regexp_matches(issue, 'schema|unreadable|mismatch|another')), false) AS mech FROM i GROUP BY key)
        SELECT c.key, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(stops, 0) AS stops, coalesce(stops, 0) > 0 AS manual, CASE WHEN coalesce(errors, 0) + coalesce(stops, 0) = 0 THEN 'none' WHEN mech THEN 'mechanical' ELSE 'unknown' END AS failure,
               CAST(CASE WHEN coalesce(errors, 0) + coalesce(stops, 0) > 0 THEN 2 ELSE 0 END AS INT) AS exit_code FROM c LEFT JOIN n USING (key)""",
    "plan_answers": _ANSWERS + "SELECT * FROM a",
    "plan_risks": _ANSWERS + """
        , g AS (SELECT plan, coalesce(max(CASE WHEN prompt_id = 'erasure_cost' AND answer IS NOT NULL AND plan % 5 <= 3 THEN plan % 5 END), 0) AS grade, coalesce(bool_or(contains(lower(answer), 'governance')), false) AS gov FROM a GROUP BY plan)
        SELECT plan, CAST(grade AS INT) AS erasure_grade, CASE WHEN grade = 3 THEN 'mutation_destructive' WHEN grade > 0 THEN 'mutation_non_destructive' ELSE 'none' END AS risk_label, CASE WHEN gov THEN 'governance' ELSE '' END AS invariants FROM g""",
    "plan_hash_of_message": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 5 <> 0 THEN NULL ELSE sha256(c_name) END WHEN c_custkey % 5 <> 0 THEN sha256(c_name) END AS plan_hash FROM customer",
    "path_stop_reasons": f"""SELECT o_orderkey, {_sql_pick(_STOPS, "o_orderkey")} AS reasons, {_sql_pick(_STOPS, "o_orderkey")} = 'secrets_detected' AS secret, regexp_matches({_sql_pick(_STOPS, "o_orderkey")}, '^(touches|meta)') AS sensitive FROM orders""",
    "invariant_profile": """
        WITH f AS (SELECT CASE WHEN o_orderkey % 6 <> 0 THEN ['data_loss', 'trust', 'data_loss'][o_orderkey % 3 + 1] END AS i, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || (o_orderkey % 4) END AS c FROM orders)
        SELECT i AS invariant, count(c) AS triggered_count, count(*) - count(c) AS finding_count, coalesce(string_agg(DISTINCT c, ',' ORDER BY c), '') AS constraint_ids FROM f WHERE i IS NOT NULL GROUP BY i""",
    "findings_by_file": "SELECT l_partkey AS path, count(*) AS findings, CAST(max(CASE WHEN l_quantity > 45 THEN 2 WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS INT) AS worst FROM lineitem GROUP BY 1",
    "finding_order_full": """
        SELECT p_brand AS rule_id, CAST(p_partkey AS VARCHAR) AS message, row_number() OVER (ORDER BY p_brand, [2, 0, 1][p_partkey % 3 + 1], p_type, CASE WHEN p_size % 3 <> 0 THEN p_size ELSE 0 END, CAST(p_partkey AS VARCHAR)) AS place FROM part""",
    "provider_surface": """
        SELECT * FROM (VALUES ('scopes', 'parts.size,text.metrics'), ('order', 'True'), ('plan', 'parts.size (plan): plan not supported'), ('execute', 'parts.size (execute): execute not supported'), ('params', 'parts.size (snapshot): larger: size is no integer'),
        ('unknown', 'parts.size (snapshot): predicate ''none'' not supported')) t(what, said) UNION ALL SELECT 'findings', CAST(count(*) AS VARCHAR) FROM part WHERE p_size > 40""",
    "provider_verify": "SELECT doc_id % 4 <> 0 AS ok, count(*) AS n FROM documents GROUP BY 1",
    "ruleset_overlays": "SELECT 'B-1' AS rule_id, 'error' AS severity, false AS triggered, CAST(0 AS BIGINT) AS findings_count UNION ALL SELECT 'B-2', 'warning', count(*) > 0, count(*) FROM part WHERE p_size > 45",
    "since_cutoffs": """
        WITH c AS (SELECT * FROM (VALUES ('3d', TIMESTAMP '2024-01-17'), ('12h', TIMESTAMP '2024-01-19 12:00:00'), ('2w', TIMESTAMP '2024-01-06'), ('90m', TIMESTAMP '2024-01-19 22:30:00'), ('2024-01-10T00:00:00Z', TIMESTAMP '2024-01-10'), ('2024-01-10T02:00:00+02:00', TIMESTAMP '2024-01-10')) t(raw, since))
        SELECT raw, (SELECT count(*) FROM events WHERE ts >= since) AS n FROM c""",
    "ledger_rows_by_family": "SELECT event_type AS family, count(*) AS events, strftime(max(ts), '%Y-%m-%d %H:%M') AS newest, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1",
    "artifact_log": "SELECT DISTINCT 'witness' AS kind, sha256(text) AS sha256, strlen(text)::INT AS bytes FROM documents WHERE doc_id % 2 = 0 ORDER BY bytes DESC, sha256 LIMIT 25",
    "artifact_resolve": f"SELECT DISTINCT {_sql_pick(('witness', 'snapshot'), 'doc_id')} AS kind, sha256(text) AS sha256 FROM documents WHERE starts_with(sha256(text), 'a')",
    "tracked_records": "SELECT 'src/' || p_partkey AS path, sha256(p_name) AS blob_oid FROM part",
    "incremental_resolution": """
        WITH c AS (SELECT o_orderkey AS k, o_orderkey % 5 <> 0 AS old, o_orderkey % 7 <> 0 AS new, o_orderkey % 11 = 0 AS moved FROM orders), d AS (SELECT k FROM c WHERE old <> new OR (old AND new AND moved))
        SELECT DISTINCT l_partkey AS path FROM lineitem WHERE l_orderkey IN (FROM d)""",
    "stream_dedup_events": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "stream_latest_status": "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type",
    "stream_lifecycle": """
        WITH r AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber <= 3), h AS (SELECT k, bool_or(n = 1) AS a, bool_or(n = 2) AS b, bool_or(n = 3) AS c, max(n) AS m FROM r GROUP BY k),
        s AS (SELECT CASE WHEN a AND b AND c THEN 'executed' WHEN a AND b THEN 'checked' WHEN a THEN 'declared' ELSE 'none' END AS state, CASE m WHEN 1 THEN a WHEN 2 THEN a ELSE a AND b END AS accepted FROM h)
        SELECT state, accepted, count(*) AS n FROM s GROUP BY ALL""",
    "dag_node_ids": f"""
        WITH p AS (SELECT p_partkey, 'src/' || p_partkey AS path, sha256(p_name) AS c, list_sort([sha256(p_brand), sha256(p_type)]) AS i, lower(hex(encode('p' || p_size))) AS params FROM part)
        SELECT p_partkey, {C.sha256(C.mapping({"tag": C.text("'dag_node_v1'"), "kind": C.mapping({"type": C.text("'file_at_path'"), "path": C.text("path"), "content_sha256": C.text("c")}), "inputs": "('82' || " + C.text("i[1]") + " || " + C.text("i[2]") + ")", "params": C.text("params")}))} AS node_id FROM p""",
    "dag_ensure_nodes": "SELECT count(*) AS n, count(*) AS ids FROM customer",
    "dag_add_edges": _EDGES + "SELECT kind, count(*) AS n FROM (SELECT DISTINCT * FROM e) GROUP BY kind",
    "dag_edge_views": _EDGES + "SELECT k AS view, count(src) AS edges, count(DISTINCT src) AS sources FROM (SELECT unnest(['build_depends', 'witness_of', 'authority_depends', 'mutation_commitment', 'cost_displacement']) AS k) LEFT JOIN e ON kind = k GROUP BY k",
    "dag_checked_edges": _EDGES + """
        , l AS (SELECT * FROM e WHERE kind = 'mutation_commitment' AND risk NOT IN ('read_only', 'local_ephemeral') AND witness_ref IS NULL), s AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM l WHERE (l.timeline, l.seq, l.src, l.dst, l.detail, l.scope, l.kind) = (e.timeline, e.seq, e.src, e.dst, e.detail, e.scope, e.kind)))
        SELECT kind, count(*) AS n FROM s GROUP BY kind UNION ALL SELECT 'lacking', count(*) FROM l""",
    "mutation_timeline_order": _EDGES + ", m AS (SELECT DISTINCT timeline, seq, src, dst FROM e WHERE kind = 'mutation_commitment') SELECT *, CAST(row_number() OVER (PARTITION BY timeline ORDER BY seq, src, dst) AS INT) AS place FROM m",
    "canonical_edge_order": _EDGES + """
        , d AS (SELECT DISTINCT timeline, seq, src, dst, kind, kind_rank, detail, scope, witness_ref FROM e)
        SELECT timeline, seq, src, dst, kind, detail, scope, witness_ref, row_number() OVER (ORDER BY timeline, seq, src, dst, kind_rank, detail, scope, witness_ref NULLS FIRST) AS place FROM d""",
    "topological_levels": """
        WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT p_partkey // 2 AS src, p_partkey AS dst FROM part WHERE p_partkey > 0 UNION ALL SELECT p_partkey - 1, p_partkey FROM part WHERE p_partkey % 2 = 1) WHERE src <> dst),
        w AS (SELECT 0 AS id, 0 AS level UNION SELECT dst, level + 1 FROM w JOIN e ON src = id) SELECT CAST(id AS BIGINT) AS id, CAST(max(level) AS INT) AS level FROM w GROUP BY id""",
    "cycle_paths": """
        WITH s AS (SELECT DISTINCT p_size AS k FROM part), r AS (SELECT k // 5 AS g FROM s GROUP BY 1 HAVING count(*) = 5)
        SELECT string_agg(printf('%02d', CAST(g * 5 + i AS INT)), '>' ORDER BY i) || '>' || printf('%02d', CAST(any_value(g) * 5 AS INT)) AS path FROM r, range(5) t(i) GROUP BY g""",
}
