import hashlib
import json
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulelake.functions import canonical, exact
from rulelake.functions import cbor_columns as CB
from rulelake.functions import text as T
from rulelake.operators import dag, displacement, documents, ledger, ledger_verify, selection, validation, witnesses
from rulelake.operators.findings import Binding, PredicateResult, Provider, ProviderRegistry, RuleSet, evaluate_ruleset, findings
from rulelake.plans import projection
from rulelake.streaming import ledger_stream


def test_canonical_cbor_vectors_and_round_trip():
    # examples of RFC 8949, Appendix A
    for value, encoded in ((0, "00"), (10, "0a"), (23, "17"), (24, "1818"), (100, "1864"), (1000, "1903e8"), (1000000, "1a000f4240"), (1000000000000, "1b000000e8d4a51000"), (-1, "20"), (-100, "3863"), (-1000, "3903e7"), (False, "f4"), (True, "f5"), (None, "f6"),
                           (b"\x01\x02\x03\x04", "4401020304"), ("", "60"), ("IETF", "6449455446"), ("\u00fc", "62c3bc"), ("\u6c34", "63e6b0b4"), ([], "80"), ([1, [2, 3], [4, 5]], "8301820203820405"), ({}, "a0"), ({"a": 1, "b": [2, 3]}, "a26161016162820203"),
                           ({"a": "A", "b": "B", "c": "C", "d": "D", "e": "E"}, "a56161614161626142616361436164614461656145")):
        assert canonical.encode_cbor(value).hex() == encoded
    assert canonical.encode_cbor({"zz": 1, "aaa": 2, "b": 3}) == canonical.encode_cbor({"b": 3, "zz": 1, "aaa": 2}) and canonical.encode_cbor({"zz": 1, "b": 2}).hex().startswith("a26162")
    assert canonical.encode_cbor(2.0) == canonical.encode_cbor(2)
    with pytest.raises(canonical.EncodingError):
        canonical.encode_cbor(0.5)


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12))
def test_cbor_round_trip(value):
    assert canonical.decode_cbor(canonical.encode_cbor(value)) == value


def test_select_path(spark):
    doc = {"a": [{"b c": 1}]}
    assert canonical.select_path(doc, '.a[0]["b c"]') == 1
    for path, code, segment in ((".x", "missing_key", 0), (".a[3]", "index_out_of_range", 1), (".a.b", "type_mismatch", 1), (".a[x]", "invalid_path", 1), ("a", "invalid_path", 0)):
        with pytest.raises(canonical.PathError) as error:
            canonical.select_path(doc, path)
        assert (error.value.code, error.value.segment) == (code, segment)
    rows = spark.createDataFrame([(json.dumps(doc),), ('{"a": []}',), (None,)], "j string").select(canonical.selected(F.col("j"), ".a[0]").alias("s")).collect()
    assert [(r.s.error, r.s.segment) for r in rows] == [(None, None), ("index_out_of_range", 1), ("no_value", 0)]


def test_exact_amounts_and_columns(spark):
    a = exact.Amount(Fraction(1, 3), "kg")
    assert (a + a).value == Fraction(2, 3) and (a * exact.Amount(Fraction(3))).unit == "kg"
    for bad in (lambda: a + exact.Amount(Fraction(1)), lambda: a * a, lambda: a / a, lambda: a / exact.Amount(Fraction(0)), lambda: exact.Amount(Fraction(2**62)) * exact.Amount(Fraction(4))):
        with pytest.raises(exact.CalcError):
            bad()
    trace = []
    tree = {"op": "divide", "left": {"op": "convert_unit", "to": "g", "value": {"op": "input_ref", "name": "x"}}, "right": {"op": "literal", "value": "4"}}
    assert exact.evaluate(tree, {"x": a}, {("kg", "g"): Fraction(1000)}, trace) == exact.Amount(Fraction(250, 3), "g")
    assert [t[0] for t in trace] == ["input_ref", "convert_unit", "literal", "divide"]
    df = spark.createDataFrame([(6, -4, 10, 15), (0, 5, 7, 1)], "a long, b long, c long, d long")
    x, y = exact.rational(F.col("a"), F.col("b")), exact.rational(F.col("c"), F.col("d"))
    rows = df.select(exact.add(x, y).alias("s"), exact.divide(x, y).alias("q"), exact.compare(x, y).alias("c")).collect()
    assert [(int(r.s.num), int(r.s.den)) for r in rows] == [(-5, 6), (7, 1)] and [(int(r.q.num), int(r.q.den)) for r in rows] == [(-9, 4), (0, 1)] and [r.c for r in rows] == [-1, -1]
    with pytest.raises(Exception, match="division by zero"):
        df.select(exact.rational(F.col("a"), F.lit(0)).alias("r")).collect()


def test_graphs(spark):
    frame = dag.graph_frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "a")])
    assert {r.id for r in dag.cycle_residual(frame).collect()} == {"a", "b", "c"}
    assert dag.first_cycle([("b", "c"), ("c", "a"), ("a", "b")]) == ["a", "b", "c", "a"] and dag.first_cycle([("a", "b")]) == []
    assert {(r.id, r.depth) for r in dag.reachable(spark.createDataFrame([("a",)], "id string"), frame).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    levels = dag.topological_levels(dag.graph_frame(spark, [("a", "b"), ("b", "c"), ("a", "c")]))
    assert {(r.id, r.level) for r in levels.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError, match="cycle"):
        dag.topological_levels(frame)
    assert dag.topological_order([("b", "a"), ("c", "a")], ["a", "b", "c", "d"]) == ["b", "c", "a", "d"]
    nodes = spark.createDataFrame([("p", "scope:core.pure"), ("w", "scope:fs.write"), ("e", "scope:external.api")], "id string, scope string")
    edges = spark.createDataFrame(
        [("p", "w", "mutation_commitment", "local_ephemeral", None), ("p", "w", "mutation_commitment", "local_persistent", None), ("p", "w", "mutation_commitment", "local_persistent", "x"), ("w", "e", "mutation_commitment", "read_only", None), ("p", "e", "witness_of", None, None)],
        "src string, dst string, kind string, risk string, witness_ref string",
    )
    assert sorted((r.rule if r.rule is not None else -1, r.violation) for r in dag.scope_violations(nodes, edges).collect()) == [(-1, "undefined"), (1, "missing_witness"), (2, "missing_witness")]
    assert dag.unwitnessed_mutations(edges).count() == 1
    assert dag.ensure_nodes(nodes, nodes.unionByName(spark.createDataFrame([("n", "s"), ("n", "s")], "id string, scope string"))).count() == 4


class Fixed(Provider):
    scope_id = "fixed"

    def predicates(self):
        def run(facts, params):
            return PredicateResult(findings(facts, "f", path=F.col("path"), message="m", severity=params["severity"]), params.get("frame"))

        return {"all": run}


def test_ruleset_verdicts(spark):
    facts = spark.createDataFrame([("a",), ("b",)], "path string")
    quiet = spark.createDataFrame([(False,)], "triggered boolean")
    run = lambda binding, fail_on="error", **kw: evaluate_ruleset(spark, RuleSet("r", (binding,), fail_on=fail_on), ProviderRegistry([Fixed()]), {"fixed": facts}, **kw)
    # a finding's own severity fails the ruleset even where its predicate says that it did not trigger
    assert run(Binding("R", "info", "fixed", "all", {"severity": "error", "frame": quiet})).verdict.first().verdict == "inadmissible"
    assert run(Binding("R", "error", "fixed", "all", {"severity": "info", "frame": quiet})).verdict.first().verdict == "admissible"
    assert run(Binding("R", "error", "fixed", "all", {"severity": "info"})).verdict.first().verdict == "inadmissible"
    assert run(Binding("R", "info", "fixed", "all", {"severity": "info"}), fail_on="info").verdict.first().verdict == "inadmissible"
    assert run(Binding("R", "info", "fixed", "all", {"severity": "info"}), overlays={"R": {"severity": "error"}}).verdict.first().verdict == "inadmissible"
    assert evaluate_ruleset(spark, RuleSet("r", (Binding("R", "error", "fixed", "all", {"severity": "error"}),), enabled_rules=("other",)), ProviderRegistry([Fixed()]), {"fixed": facts}).verdict.first().verdict == "admissible"
    with pytest.raises(KeyError):
        evaluate_ruleset(spark, RuleSet("r", (Binding("R", "error", "none", "all"),)), ProviderRegistry(), {})
    with pytest.raises(ValueError, match="registered"):
        ProviderRegistry([Fixed(), Fixed()])
    loaded = RuleSet.from_json(json.dumps({"ruleset_id": "x", "enabled_rules": [], "fail_on": "warning", "bindings": [{"rule_id": "R", "severity": "error", "when": {"scope_id": "fixed", "predicate": "all", "params": {"severity": "info"}}}]}))
    assert loaded.fail_on == "warning" and loaded.selected()[0].params == {"severity": "info"}


def test_commits_are_compared_or_are_errors(spark):
    commits = spark.createDataFrame([("a", "quantity", "5", "u"), ("b", "text", "x", None), ("c", "flag", "true", None)], "diff string, kind string, value string, unit string")
    ask = lambda diff, kind, value, unit: spark.createDataFrame([(diff, kind, value, unit)], "diff string, target_kind string, target string, target_unit string")
    equal = lambda *a: displacement.commit_equals(ask(*a), commits).first().equal
    assert equal("a", "quantity", "5.0", "u") and not equal("a", "quantity", "6", "u") and equal("b", "text", "x", None) and not equal("z", "text", "x", None)
    assert displacement.commit_cmp(ask("a", "quantity", "5", "u"), commits, "gte").first().holds and not displacement.commit_cmp(ask("a", "quantity", "5", "u"), commits, "gte", True).first().holds
    for bad in (("a", "text", "5", None), ("a", "quantity", "5", "v")):
        with pytest.raises(Exception, match="another kind"):
            displacement.commit_equals(ask(*bad), commits).collect()
    for diff, unit, said in (("z", "u", "no commit"), ("b", None, "no quantity"), ("a", "v", "something else")):
        with pytest.raises(Exception, match=said):
            displacement.commit_cmp(ask(diff, "quantity", "1", unit), commits, "gt").collect()


def test_delegations_are_checked(spark):
    schema = "delegator string, delegate string, scopes array<string>, issued_at string, expires_at string, constraints string"
    good = ("a", "b", ["scope:y", "scope:x", "scope:y"], "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", '{"z": 1}')
    row = selection.delegation_records(spark.createDataFrame([good], schema)).first()
    said = {"issuer_id": "a", "delegate_id": "b", "scope_ids": ["scope:x", "scope:y"], "issued_at_utc": good[3], "expires_at_utc": good[4], "constraints": {"z": 1}}
    assert row.record_id == hashlib.sha256(canonical.encode_cbor(said)).hexdigest() and row.scopes == ["scope:x", "scope:y"]
    for at, value, match in ((0, " ", "issuer"), (1, "", "delegate"), (2, [], "no scopes"), (2, ["x"], "malformed"), (3, "2024-01-01", "UTC"), (4, "2023-01-01T00:00:00Z", "expires")):
        bad = list(good)
        bad[at] = value
        with pytest.raises(Exception, match=match):
            selection.delegation_records(spark.createDataFrame([tuple(bad)], schema)).collect()


def test_records_reject_what_comes_twice(spark):
    files = spark.createDataFrame([("c" * 40, "a", "1" * 40), ("c" * 40, "a", "2" * 40)], "commit string, path string, blob_oid string")
    heads = spark.createDataFrame([("c" * 40, True, None)], "commit string, is_clean boolean, manifest_sha256 string")
    modules = spark.createDataFrame([], "commit string, path string, commit_oid string")
    with pytest.raises(Exception, match="comes twice"):
        witnesses.snapshot_records(heads, files, modules).collect()
    value = {"schema_id": "git-snapshot-witness/0", "schema_version": 0, "head_commit_oid": "c" * 40, "is_clean": True, "tracked_files": [{"path": "a", "blob_oid": "1" * 40}], "submodules": None, "working_tree_manifest_sha256": None}
    assert witnesses.snapshot_records(heads, files.limit(1), modules).first().witness_id == hashlib.sha256(canonical.encode_cbor(value)).hexdigest()
    with pytest.raises(Exception, match="no name"):
        witnesses.provenance_bindings(spark.createDataFrame([(" ", "k")], "repository_id string, kind string"), ["kind"]).collect()
    edges = spark.createDataFrame([("a", "b", "mutation_commitment", "local_persistent", None)], "src string, dst string, kind string, risk string, witness_ref string")
    with pytest.raises(Exception, match="needs a witness"):
        dag.checked_edges(edges).collect()


def test_numbered_rows_over_many_partitions(spark):
    rows = spark.range(1000).selectExpr("id", "id % 7 AS a", "CAST(NULL AS INT) AS place_of").repartition(11)
    got = [r.id for r in selection.numbered(rows, ["a", "id"]).orderBy("place").collect()]
    assert got == sorted(range(1000), key=lambda k: (k % 7, k))
    assert selection.numbered(rows.limit(0), ["a"]).collect() == []


def test_cbor_columns_are_the_encoder(spark):
    rows = [(0, "", None, []), (23, "é" * 11, True, ["x"]), (24, "a" * 24, False, ["b"] * 30), (-1, "a" * 255, None, []), (-300, "a" * 256, True, ["é", ""]), (2**31, "a" * 70_000, True, []), (2**40, None, True, None), (None, "x", True, [])]
    df = spark.createDataFrame(rows, "n long, t string, f boolean, l array<string>")
    made = df.select(CB.mapping({"number": CB.integer(F.col("n")), "t": CB.text(F.col("t")), "flag": CB.boolean(F.col("f")), "list": CB.array(F.col("l")), "a_very_long_key_that_needs_two_bytes": CB.text(F.lit("v"))}).alias("c")).collect()
    for row, (n, t, f, l) in zip(made, rows, strict=True):
        assert bytes(row.c) == canonical.encode_cbor({"number": n, "t": t, "flag": f, "list": l, "a_very_long_key_that_needs_two_bytes": "v"})


def test_units_must_agree(spark):
    rules = spark.createDataFrame([("a", "b", 1.0, "u"), ("c", "b", 1.0, "v")], "diff string, bucket string, cost double, unit string")
    allow = lambda *k: spark.createDataFrame([(x, "allow") for x in k], "diff string, kind string")
    assert displacement.totals(rules, allow("a")).first().total == 1.0
    with pytest.raises(Exception, match="differ"):
        displacement.totals(rules, allow("a", "c")).collect()


def test_ledger_append(spark):
    rows = lambda *ids: spark.createDataFrame([(i, "a.b") for i in ids], "event_id string, event_type string")
    assert ledger.append(rows("a", "b"), rows("c")).count() == 3
    for new in (("a",), ("c", "c")):
        with pytest.raises(Exception, match="in the ledger"):
            ledger.append(rows("a", "b"), rows(*new)).collect()


def test_ledger_verification_of_odd_lines(spark):
    """Lines of every kind of event that nothing can be read from, lens activations, plans, lint runs, ingests and engines."""
    ref = {"kind": "k", "schema_id": "s", "sha256": "x", "size_bytes": 1, "path": "k/y.json"}
    program = {"module": "m", "scope": "s"}
    base = {"timestamp": "t", "witness": ref | {"schema_id": "admissibility-witness/2"}, "snapshot_ref": ref, "snapshot_hash": "x", "program": program}
    bodies = [
        {"event_type": "cost.declared"}, {"event_type": "lens.activated", "timestamp": "t", "lens_id": "l", "lens_hash": "h", "program": program},
        {"event_type": "admissibility.checked", "cost_declared_event_id": "none", **base}, {"event_type": "admissibility.checked", "cost_declared_event_id": "none", **base, "lens_id": "l", "lens_hash": "h", "lens_activation_event_id": "gone"},
        {"event_type": "plan.created", "timestamp": "t", "plan_witness": ref}, {"event_type": "rust.ir_lint.completed", "timestamp": "t", "witness": ref, "scope_id": "s", "passed": True, "files_scanned": 2, "violations": 1},
        {"event_type": "ingest.run.completed", "timestamp": "t", "ingest_run_id": "r", "config": ref}, {"event_type": "engine.query.registered", "timestamp": "t", "artifact_kind": "q", "artifact": ref}, {"event_type": "projection.run.started", "timestamp": "t"},
    ]
    lines = []
    for k, body in enumerate(bodies, 1):
        raw = json.dumps(body, separators=(",", ":"))
        digest = hashlib.sha256(raw.encode()).hexdigest()
        lines.append((k, f'{{"event_id":"{digest}",{raw[1:]}'))
    content = json.dumps({"schema_id": "other", "passed": False, "files_scanned": 2, "violations": []})
    artifacts = spark.createDataFrame([("k", "x", "z", 1, content)], "kind string, sha256 string, actual_sha256 string, bytes long, content string")
    registries = spark.createDataFrame([], "registry_hash string, schemas array<string>, scopes array<string>")
    got = {(r.line, r.issue) for r in ledger_verify.verify_ledger(spark.createDataFrame(lines, "line int, raw string"), artifacts, registries).collect()}
    assert not any(issue == "event_id_mismatch" for _, issue in got)
    expected = {(1, "unreadable_event"), (3, "cost_event_missing"), (3, "lens_activation_missing"), (4, "cost_event_missing"), (4, "lens_event_missing"), (5, "plan_schema_unknown"), (5, "plan_schema_is_not_its_reference"), (6, "lint_schema_unknown"), (6, "lint_schema_is_not_its_reference"), (6, "lint_passed_differs"), (6, "lint_violations_differ"), (9, "unreadable_event")}
    assert expected <= got and not {issue for line, issue in got if line == 2}
    assert {line for line, issue in got if issue == "artifact_hash_mismatch"} == {5, 6, 7, 8} == {line for line, issue in got if issue == "artifact_path_mismatch"}
    assert ledger_verify.verify_ledger(spark.createDataFrame([], "line int, raw string"), artifacts, registries).collect() == []


def test_validation(spark):
    types = validation.note_types('[[types]]\ntype_id="concept"\nallowed_patterns=["c/*.md"]\nrequired=["role"]\nsections=["Rules"]\n[types.constraints.role]\nkind="enum"\nvalues=["x"]\n[types.constraints.tags]\nkind="list_enum"\nvalues=["a"]\n[types.constraints.n]\nkind="type"\nvalue="int"\n[[types]]\ntype_id="any"\nallowed_patterns=["*"]\n')
    schema = "path string, body string, has_frontmatter boolean, fields map<string,string>"
    notes = spark.createDataFrame([("c/ok.md", "## Rules\n", True, {"role": "x", "tags": '["a"]', "n": "3"}), ("c/bad.txt", "", True, {"type": "concept", "role": "y", "tags": '["b"]', "n": "z"}), ("c/bare.md", "## rules ##", False, {}), ("z.md", "", True, {"type": "concept"})], schema)
    got = {(r.rule_id, r.path) for r in validation.validate_notes(notes, types).collect()}
    assert not any(p == "c/ok.md" for _, p in got) and ("vault/missing-frontmatter", "c/bare.md") in got
    only = validation.validate_notes(notes, types[:1])
    rules = {r.rule_id for r in only.where("path in ('c/bad.txt', 'z.md')").collect()}
    assert rules == {"vault/extension-mismatch", "vault/forbidden-location", "vault/enum-mismatch", "vault/list-item-invalid", "vault/type-mismatch", "vault/missing-required-field", "vault/missing-section"}
    assert [r.t for r in notes.select(validation.resolve_type(F.col("path"), types).alias("t")).collect()] == ["concept", "any", "concept", "any"]
    message = spark.createDataFrame([("x\n\nPlan-Hash: sha256:" + "a" * 64,), ("none",)], "m string")
    assert [r.h for r in message.select(validation.plan_hash(F.col("m")).alias("h")).collect()] == ["a" * 64, None]


def test_links_and_headings(spark):
    docs = spark.createDataFrame([("v/concepts/One.md", "One"), ("v/meta/One.md", "One"), ("v/Two.md", "Two"), ("w/three.md", "THREE")], "path string, title string")
    links = spark.createDataFrame([("v/concepts/x.md", t, h) for t, h in (("v/Two", None), ("./v/Two.md", "Big  Head"), ("Two", "Gone"), ("three", None), ("One", None), ("no/path", None), ("", None), ("Two.md", "big-head"))], "from_path string, target string, heading string")
    got = documents.resolve_links(links, docs)
    assert [(r.target, r.kind) for r in got.collect()] == [(r.target, r.kind) for r in got.collect()] and {(r.target, r.kind) for r in got.collect()} == {("v/Two", "exact_path"), ("./v/Two.md", "exact_path"), ("Two", "exact_title"), ("three", "casefold_title"), ("One", "ambiguous"), ("no/path", "missing"), ("", "missing"), ("Two.md", "exact_title")}
    assert [(r.target, r.chosen) for r in documents.choose_ambiguous(got, docs, ["v/"]).collect()] == [("One", "v/concepts/One.md")]
    assert documents.choose_ambiguous(got, docs, ["w/"]).first().chosen is None
    headings = spark.createDataFrame([("v/Two.md", " big HEAD ")], "path string, heading string")
    assert [r.heading for r in documents.resolve_headings(got, headings).collect()] == ["Gone"]
    assets = documents.resolve_assets(spark.createDataFrame([("v/a.md", "img.png"), ("v/a.md", "v/img.png"), ("v/a.md", "none.png")], "from_path string, target string"), spark.createDataFrame([("v/img.png",)], "path string"), ["v/"])
    assert [(r.target, r.file_kind) for r in assets.orderBy("target").collect()] == [("img.png", "prefix_join"), ("none.png", "missing"), ("v/img.png", "exact_path")]
    texts = spark.createDataFrame([("a [[T#H|x]] ![[ E ]] [[]] [[|y]]\n[[open",)], "t string").withColumn("id", F.lit(1))
    assert [(r.target, r.heading, r.alias, r.embed, r.line) for r in documents.wiki_links(texts, "id", F.col("t")).collect()] == [("T", "H", "x", False, 1), ("E", None, None, True, 1)]
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, size int, mtime int")
    new = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, size int, mtime int")
    assert {(r.path, r.change) for r in documents.classify_files(new, old).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")}


def test_text_functions(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first().r
    assert one("a\r\nb\n\n", T.lines) == ["a", "b", ""] and one("", T.lines) == [] and one("\n", T.lines) == [""]
    assert one("aaaa", lambda c: T.observed(c, "aa")) == 3 and one("The other THE", lambda c: T.observed(c, r"\bthe\b")) == 2
    assert one("a a b a", lambda c: T.term_count(c, F.lit("a"))) == 3 and one("aa a", lambda c: T.term_count(c, F.lit("a"))) == 1 and one("x", lambda c: T.term_count(c, F.lit(""))) == 0
    assert one("ÀB x", T.ascii_lower) == "Àb x" and one(" A  Big-- Head! ", T.heading_slug) == "a-big-head"
    assert one("##No space ##", T.heading_level) == 2 and one("##No space ##", T.heading_title) == "No space" and one("#######x", T.heading_level) is None and one("# ", T.heading_level) is None
    assert one("x.y", lambda c: c.rlike(T.glob_regex("*.?"))) and not one("x.yz", lambda c: c.rlike(T.glob_regex("*.?")))
    assert one("a.b*?c", lambda c: F.rlike(F.lit("a.bXYZ1c"), T.glob_regex_column(c)))
    assert T.ignored_by("build/", "build", "build", True) and not T.ignored_by("build/", "build", "build", False) and T.ignored_by("/a", "a", "a", False) and not T.ignored_by("/a", "x/a", "a", False) and T.ignored_by("*.o", "x/a.o", "a.o", False)
    assert one("a `x` [[L]] [t](u) <!-- no -->\n```\ncode\n```\nB", T.mention_text) == "a t b"
    assert spark.range(5).select(T.retry_delay_ms(F.col("id")).alias("d")).agg(F.collect_list("d")).first()[0] == [0, 100, 200, 400, 800]


def test_projection_store(spark, tmp_path):
    store = projection.ProjectionStore(spark, f"{tmp_path}/p")
    rows = lambda *r: spark.createDataFrame(r, "id int, v string")
    store.write("t", rows((1, "a"), (2, "b")), "run1")
    store.write("t", rows((1, "c")), "run2")
    store.write("t", rows((1, "d")), "run2")
    assert store.read("t").count() == 3 and store.read("t", "run2").first().v == "d"
    assert {(r.id, r.v) for r in store.latest("t", ["id"]).collect()} == {(1, "d"), (2, "b")}
    assert store.vacuum(["t"], ["run1", "none"]) == 1 and spark.read.parquet(store.path("t")).count() == 1
    saved = projection.SavedQueries(spark)
    digest = saved.register("one", "SELECT 1 AS x", tags=("t",))
    assert saved.register("one", "SELECT 1 AS x", tags=("t",)) == digest and saved.run("one").first().x == 1 and saved.listing().first().artifact_sha256 == digest
    with pytest.raises(ValueError):
        saved.register("one", "SELECT 2 AS x")


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, None, "a", 1.0), (2, None, "b", 2.0), (1, None, "a", 1.0)], schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).coalesce(1).write.parquet(source)
    run = lambda: ledger_stream.append_to_ledger(ledger_stream.first_events(ledger_stream.read_ledger(spark, source, schema)), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    spark.createDataFrame([(2, None, "b", 2.0), (3, None, "a", 3.0)], schema).withColumn("ts", F.lit("2024-01-01 01:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    run()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2, 3]
    seen = []
    ledger_stream.maintain_status(ledger_stream.read_ledger(spark, source, schema), lambda df, batch: seen.extend(df.collect()), f"{tmp_path}/cp2").awaitTermination()
    assert {(r.event_type, r.event_id) for r in seen} == {("a", 3), ("b", 2)}
    assert ledger_stream.windowed_counts(spark.read.parquet(source)).count() == 4
