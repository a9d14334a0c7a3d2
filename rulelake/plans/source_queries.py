"""Queries of the sources: folders, manifests, repositories, notes, ledgers, artifacts, built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical
from ..functions import text as T
from ..operators import ledger_verify as LV
from ..operators import predicates as P
from ..operators import selection as S
from ..operators import validation as V
from ..operators import witnesses as WI
from ..session import fresh_folder, table
from ..sources import files as SF
from ..sources import repositories as SR
from ..sources import rust_syntax as RS
from . import cbor_sql as C


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def _sql_pick(values, at):
    return f"([{', '.join(repr(v) for v in values)}][({at}) % {len(values)} + 1])"


FOLDERS = ("src", "target", "src/node_modules", "docs/logs", "logs", ".git", "lib/outer", "out", "surrealdb-data", "deep/.venv/lib")


def _paths(spark, sf_dir):
    """A path per document, some of them in folders that are never walked into."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(_pick(FOLDERS, F.col("doc_id")), F.lit("/f"), "doc_id", _pick((".md", ".rs", ".tmp"), F.col("doc_id"))).alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("size"))


_PATHS = f"SELECT doc_id, {_sql_pick(FOLDERS, 'doc_id')} || '/f' || doc_id || {_sql_pick(('.md', '.rs', '.tmp'), 'doc_id')} AS path, text FROM documents"


def walk_skipped_dirs(spark, sf_dir):
    return SF.kept_paths(_paths(spark, sf_dir)).select("path", "size")


def gitignore_match(spark, sf_dir):
    return SF.kept_paths(_paths(spark, sf_dir), ("*.tmp", "/lib/outer/", "src/f?.md", "# no pattern", "")).select("path")


def git_listed_paths(spark, sf_dir):
    """Paths of a listing between zero bytes, one listing per language, under a root."""
    paths = _paths(spark, sf_dir).select((F.col("doc_id") % 3).alias("g"), F.concat(F.lit("repo/"), "path").alias("path"))
    listings = paths.groupBy("g").agg(F.concat_ws("\0", F.collect_list("path")).cast("binary").alias("content"))  # what git would say, in one text
    return SF.listed_paths(listings, "repo")


def directory_snapshot(spark, sf_dir):
    return SF.directory_snapshot(_paths(spark, sf_dir)).select("path", "sha256", "size")


def directory_snapshot_hash(spark, sf_dir):
    return SF.snapshot_hash(SF.directory_snapshot(_paths(spark, sf_dir)))


def walk_folder(spark, sf_dir):
    """Documents written as files of a folder, walked, and held against what was written: nothing is lost or changed."""
    folder = fresh_folder(spark, "walk")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id") % 7, F.lit("\t"), F.coalesce("text", F.lit(""))).alias("value"), (F.col("doc_id") % 4).alias("part"))
    docs.select("value", F.when(F.col("part") == 3, "logs").otherwise(F.concat(F.lit("p"), "part")).alias("dir")).write.partitionBy("dir").option("lineSep", "\x1e").text(folder)
    walked = SF.walk(spark, folder).where(F.endswith("path", F.lit(".txt")))
    rows = SF.file_texts(walked).select(F.regexp_extract("path", r"dir=([^/]*)/", 1).alias("dir"), F.explode(F.split("text", "\x1e")).alias("value")).where("value != ''")
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes"))


def _npm(spark, sf_dir):
    req = _pick(("^1.0.0", "*", "git+https://x/y.git", "file:../z", "workspace:*", "github:a/b"), F.col("p_partkey"))
    section = _pick(("dependencies", "devDependencies"), F.col("p_size"))
    text = F.concat(F.lit('{"name":"n'), "p_partkey", F.lit('","'), section, F.lit('":{"d'), "p_size", F.lit('":"'), req, F.lit('"}}'))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("web/"), "p_partkey", F.lit("/package.json")).alias("path"), F.when(F.col("p_partkey") % 10 == 9, "{broken").otherwise(text).alias("text"))


_NPM = f"""
WITH m AS (
  SELECT 'web/' || p_partkey || '/package.json' AS path, p_partkey % 10 = 9 AS broken, {_sql_pick(("dependencies", "devDependencies"), "p_size")} AS section, 'd' || p_size AS name,
         {_sql_pick(("^1.0.0", "*", "git+https://x/y.git", "file:../z", "workspace:*", "github:a/b"), "p_partkey")} AS req, {_sql_pick(("registry", "registry", "git", "path", "workspace", "git"), "p_partkey")} AS source FROM part
)
"""


def npm_dependencies(spark, sf_dir):
    return SF.dependencies(_npm(spark, sf_dir))


def git_dependency_present(spark, sf_dir):
    return P.git_dependencies(SF.dependencies(_npm(spark, sf_dir))).select("path", "name")


def wildcard_version_present(spark, sf_dir):
    return P.wildcard_versions(SF.dependencies(_npm(spark, sf_dir))).select("path", "name")


def _cargo(spark, sf_dir):
    spec = _pick(('"1.2"', '{ git = "https://x/y" }', '{ path = "../z", version = "0.1" }', "{ workspace = true }", '{ version = "2", package = "real" }'), F.col("p_partkey"))
    head = _pick(("[dependencies]", "[dev-dependencies]", "[target.'cfg(unix)'.dependencies]", "[workspace.dependencies]"), F.col("p_size"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("c"), "p_partkey", F.lit("/Cargo.toml")).alias("path"), F.concat(F.lit('[package]\nname = "c"\n'), head, F.lit("\nd"), "p_size", F.lit(" = "), spec, F.lit("\n")).alias("text"))


def cargo_dependencies(spark, sf_dir):
    return SF.dependencies(_cargo(spark, sf_dir)).select("path", "section", "name", "package_name", "version_req", "source_kind")


def cargo_lock_entries(spark, sf_dir):
    source = _pick(("", 'source = "registry+https://r"\n', 'source = "git+https://g#1"\n'), F.col("p_partkey"))
    texts = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), "p_partkey", F.lit("/Cargo.lock")).alias("path"), F.concat(F.lit('version = 4\n[[package]]\nname = "p'), "p_size", F.lit('"\nversion = "'), "p_size", F.lit('.0.1"\n'), source).alias("text"))
    return SF.lock_entries(texts).select("path", "name", "version_req", "source_kind")


def manifests_by_name(spark, sf_dir):
    names = _pick(("Cargo.toml", "Cargo.lock", "package.json", "yarn.lock", "npm-shrinkwrap.json", "other.json"), F.col("p_partkey"))
    manifests, locks = SF.manifests_and_locks(table(spark, sf_dir, "part").select(F.concat(F.lit("d"), "p_size", F.lit("/"), names).alias("path")))
    return manifests.withColumn("what", F.lit("manifest")).unionByName(locks.withColumn("what", F.lit("lock"))).groupBy("what", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"))


XY = ("M.", ".M", "MM", "A.", ".D", "D.", "R.")


def _status(spark, sf_dir):
    """A line of porcelain status per order: ordinary, renamed, conflicted and untracked entries."""
    k = F.col("o_orderkey")
    path = F.concat(F.lit("dir "), F.col("o_custkey") % 50, F.lit("/f"), k)
    xy = _pick(XY, k)
    oid = F.repeat(F.lit("a"), 40)
    line = (
        F.when(k % 11 == 0, F.concat(F.lit("? "), path))
        .when(k % 11 == 1, F.concat(F.lit("u UU N... 100644 100644 100644 100644 "), oid, F.lit(" "), oid, F.lit(" "), oid, F.lit(" "), path))
        .when(k % 11 == 2, F.concat(F.lit("2 R. N... 100644 100644 100644 "), oid, F.lit(" "), oid, F.lit(" R100 "), path, F.lit("\told/"), k))
        .otherwise(F.concat(F.lit("1 "), xy, F.lit(" N... 100644 100644 100644 "), oid, F.lit(" "), oid, F.lit(" "), path))
    )
    return table(spark, sf_dir, "orders").select(line.alias("line"))


_STATUS = f"""
WITH s AS (
  SELECT 'dir ' || (o_custkey % 50) || '/f' || o_orderkey AS path, o_orderkey % 11 AS r, CASE o_orderkey % 11 WHEN 0 THEN '??' WHEN 1 THEN 'UU' WHEN 2 THEN 'R.' ELSE {_sql_pick(XY, "o_orderkey")} END AS xy,
         CASE WHEN o_orderkey % 11 = 2 THEN 'old/' || o_orderkey END AS old_path, CASE o_orderkey % 11 WHEN 0 THEN '?' WHEN 1 THEN 'u' WHEN 2 THEN '2' ELSE '1' END AS kind FROM orders
), f AS (
  SELECT path, unnest(list_filter([CASE WHEN kind = '?' THEN 'untracked' END, CASE WHEN kind <> '?' AND xy[1] <> '.' THEN 'staged' END, CASE WHEN kind <> '?' AND xy[2] = 'M' THEN 'modified' END,
         CASE WHEN kind <> '?' AND (xy[1] = 'D' OR xy[2] = 'D') THEN 'deleted' END, CASE WHEN kind = '2' THEN 'renamed' END, CASE WHEN kind = 'u' THEN 'conflicted' END], lambda x: x IS NOT NULL)) AS state FROM s
)
"""


def git_status_paths(spark, sf_dir):
    return SR.changed_paths(_status(spark, sf_dir))


def git_status_findings(spark, sf_dir):
    return SR.status_findings(SR.changed_paths(_status(spark, sf_dir))).select("rule_id", "path", "message")


def git_dirty_predicates(spark, sf_dir):
    """Each predicate of the working tree: whether it triggers, and its findings."""
    facts, provider = SR.status_findings(SR.changed_paths(_status(spark, sf_dir))), P.GitWorkingTree()
    out = None
    for name, params in (("untracked_file", {}), ("staged_file", {}), ("modified_file", {}), ("dirty_state", {}), ("sensitive_path_touched", {"globs": ["dir 1*/f*7"]})):
        found = provider.evaluate(name, facts, params).findings.agg(F.lit(name).alias("predicate"), F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("paths"))
        out = found if out is None else out.unionByName(found)
    return out


def git_branch_status(spark, sf_dir):
    """The head of a status per nation: on a branch, detached or not born."""
    rows = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return rows.select("n_nationkey", SR.head_state(F.when(k % 3 == 0, "(detached)").otherwise("main"), F.when(k % 3 == 1, "(initial)").otherwise("abc")).alias("head_state"))


def git_head_of_status(spark, sf_dir):
    """A whole status text, among lines of other kinds."""
    lines = table(spark, sf_dir, "region").select(F.explode(F.array(F.lit("# branch.oid abc123"), F.lit("# branch.head main"), F.lit("# branch.upstream origin/main"), F.concat(F.lit("# branch.ab +"), F.lit(4), F.lit(" -2")), F.concat(F.lit("? x"), "r_regionkey"))).alias("line")).distinct()
    return SR.branch_status(lines)


def _prs(spark, sf_dir):
    """A pull request of the viewer per customer, as JSON."""
    k = F.col("c_custkey")
    review = lambda who, state, at: F.concat(F.lit('{"author":{"login":"'), who, F.lit('"},"state":"'), state, F.lit('","submittedAt":"2024-01-0'), at, F.lit('T00:00:00Z"}'))
    reviews = F.concat(review(F.lit("ann"), _pick(("APPROVED", "CHANGES_REQUESTED"), k), F.lit("1")), F.lit(","), review(F.lit("ann"), _pick(("COMMENTED", "APPROVED", "DISMISSED"), k), F.lit("2")), F.lit(","), review(F.lit("bob"), F.lit("APPROVED"), F.lit("3")))
    checks = F.concat(F.lit('{"name":"build","status":"COMPLETED","conclusion":"'), _pick(("SUCCESS", "FAILURE"), k), F.lit('"},{"context":"lint","state":"'), _pick(("SUCCESS", "PENDING"), k), F.lit('"}'))
    files = F.concat(F.lit('{"path":"'), _pick((".github/workflows/ci.yml", "src/a.rs", "README.md"), k), F.lit('"},{"path":"f'), k, F.lit('"},{"path":"f'), k, F.lit('"}'))
    text = F.concat(
        F.lit('{"number":'), k, F.lit(',"title":"t","state":"OPEN","baseRefName":"main","headRefName":"h'), k, F.lit('","headRefOid":"'), F.sha2(k.cast("string"), 256),
        F.lit('","labels":[{"name":"z"},{"name":"a"},{"name":"z"}],"files":['), files, F.lit('],"reviews":['), reviews, F.lit('],"statusCheckRollup":['), checks, F.lit("]}"),
    )
    return SR.pull_requests(table(spark, sf_dir, "customer").select(text.alias("value")))


def pr_state(spark, sf_dir):
    return SR.pr_state(_prs(spark, sf_dir)).select("pr", "base", "head", "sha", F.array_join("labels", ",").alias("labels"))


def pr_reviews_summary(spark, sf_dir):
    return P.review_summary(SR.pr_reviews(_prs(spark, sf_dir)))


def pr_checks_summary(spark, sf_dir):
    return P.check_summary(SR.pr_checks(_prs(spark, sf_dir)), "pr")


def pr_files(spark, sf_dir):
    return SR.pr_files(_prs(spark, sf_dir))


def workflow_change_requires_extra_approval(spark, sf_dir):
    prs = _prs(spark, sf_dir)
    return P.workflow_changes_unapproved(SR.pr_files(prs), P.review_summary(SR.pr_reviews(prs)), 2).select("pr", "approvals")


def changed_paths_union(spark, sf_dir):
    """Paths of a pull request win over those of the working tree."""
    git = SR.changed_paths(_status(spark, sf_dir)).select("path")
    named = WI.observed_paths(git, SR.pr_files(_prs(spark, sf_dir)).select("path")).agg(F.lit("pull request").alias("source"), F.count(F.lit(1)).alias("n"))
    alone = WI.observed_paths(git, SR.pr_files(_prs(spark, sf_dir)).where("pr < 0").select("path")).agg(F.lit("working tree").alias("source"), F.count(F.lit(1)).alias("n"))
    return named.unionByName(alone)


def _rust(spark, sf_dir):
    """A Rust source per part."""
    k = F.col("p_partkey")
    safety = F.when(k % 2 == 0, F.lit("    // SAFETY: checked\n")).otherwise(F.lit("    // because\n"))
    text = F.concat(F.lit("use std::fmt;\n\npub struct S"), k, F.lit(" {\n    a: u8,\n}\n\n"), F.when(k % 3 == 0, F.lit("pub(crate) enum E { A }\n")).otherwise(F.lit("")), F.lit("pub fn f"), k, F.lit("() {\n"), safety, F.lit("    unsafe { g() }\n}\n// fn not_this() {}\nimpl S"), k, F.lit(" {}\n"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/m"), k, F.lit(".rs")).alias("path"), text.alias("text"))


def rust_item_counts(spark, sf_dir):
    return SR.rust_item_counts(_rust(spark, sf_dir))


def rust_ast_summaries(spark, sf_dir):
    """Top-level items by a scanner that strings, comments and nested items do not mislead."""
    k = F.col("p_partkey")
    text = F.concat(F.lit('//! fn no() {}\n#![a]\nuse std::{x, y};\n/* enum /* E */ {} */\nstatic S: &str = "struct X {";\npub fn f'), k, F.lit("<'a>(c: &'a str) { let b = '}'; struct In; }\n"), F.when(k % 2 == 0, F.lit('impl T for S { fn g() { r#"}"#; } }\n')).otherwise(F.lit("mod m { fn h() {} }\nmacro_rules! q { () => {} }\n")), F.when(k % 10 == 9, F.lit("fn broken( {")).otherwise(F.lit("")))
    return RS.summaries(table(spark, sf_dir, "part").select(k.alias("path"), text.alias("text")))


def rust_structure(spark, sf_dir):
    return RS.structure(_rust(spark, sf_dir)).select("path", "kind", "name", "public", "start_line", "end_line")


def rust_unsafe_unjustified(spark, sf_dir):
    texts = _rust(spark, sf_dir)
    return P.unjustified(SR.rust_items(texts).where("kind = 'unsafe_block'").select("path", "line"), SR.safety_comments(texts)).select("path", "line")


def rust_lint_findings(spark, sf_dir):
    """One source per rule of the lint, by part."""
    k = F.col("p_partkey")
    text = _pick(('let q = "delete from t";', "let m: HashMap<u8, u8>;", "let n = rand::random();", 'let q = "insert into t";', "struct RunWitness { schema_id: String }", "let t = Utc::now();", "let batch_hash = h(batch_index);", "fn fine() {}"), k)
    path = F.concat(_pick(("store/a", "engine/a", "engine/b", "store/b", "lib/w", "plan/c", "projection/d", "store/e"), k), k, F.lit(".rs"))
    return SR.rust_lints(table(spark, sf_dir, "part").select(path.alias("path"), text.alias("text"))).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("path").alias("paths"))


def _notes(spark, sf_dir):
    """A markdown note per document: frontmatter in both styles of lists, a heading and the whole text."""
    k = F.col("doc_id")
    head = F.concat(F.lit("---\ntype: "), _pick(("concept", "invariant", "plan"), k), F.lit("\nrole: '"), _pick(("concept", "invariant"), k), F.lit("'\ncanonical: "), _pick(("true", "false", "yes"), k), F.lit("\naliases: [a"), k, F.lit(", \"b c\"]\nfacets:\n  - x\n  - y"), k % 5, F.lit("\ninvariant_id: "), k % 20, F.lit("\n---\n"))
    text = F.concat(F.when(k % 4 == 3, F.lit("")).otherwise(head), F.lit("# Title "), k, F.lit(" #\n\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("vault/n"), k, F.lit(".md")).alias("path"), text.alias("text"))


def vault_notes(spark, sf_dir):
    rows = SF.notes(_notes(spark, sf_dir))
    return rows.select("path", "name", "role", "type", "title", "canonical", F.array_join("aliases", "|").alias("aliases"), F.array_join("facets", "|").alias("facets"), "invariant_id", F.sha2("body", 256).alias("body_sha256"))


def frontmatter_projection(spark, sf_dir):
    """What a projected document keeps of its frontmatter, whatever the extension of its path."""
    return SF.projected_frontmatter(_notes(spark, sf_dir).withColumn("path", F.replace("path", F.lit(".md"), F.lit(".markdown")))).select("path", "fm_title", "fm_role", "fm_type", "fm_canonical", "has_frontmatter")


TYPES_TOML = """
[[types]]
type_id = "concept"
allowed_patterns = ["vault/n*.md", "concepts/*"]
required = ["role", "status"]
sections = ["Summary"]
[types.constraints.role]
kind = "enum"
values = ["concept"]
[[types]]
type_id = "invariant"
allowed_patterns = ["vault/n1*.md"]
extension = "txt"
[types.constraints.canonical]
kind = "type"
value = "bool"
"""


def note_type_registry(spark, sf_dir):
    rows = [(t.type_id, ",".join(t.allowed_patterns), t.extension, ",".join(t.required), ",".join(t.sections), ",".join(f"{k}:{v[0]}" for k, v in sorted(t.constraints.items()))) for t in V.note_types(TYPES_TOML)]
    return spark.createDataFrame(rows, "type_id string, patterns string, extension string, required string, sections string, constraints string")


def note_type_resolution(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.resolve_type(F.concat(_pick(("vault/n", "concepts/", "else/"), F.col("doc_id") % 3), "doc_id", F.lit(".md")), V.note_types(TYPES_TOML)).alias("type_id"))


def ledger_lines(spark, sf_dir):
    """Events written as one file of JSON lines, some blank or broken, and read back with their line numbers."""
    folder = fresh_folder(spark, "ledger")
    k = F.col("event_id")
    line = F.when(k % 10 == 3, F.lit("")).when(k % 10 == 4, F.lit("{broken")).otherwise(F.to_json(F.struct(k.cast("string").alias("event_id"), "event_type", F.date_format("ts", "yyyy-MM-dd").alias("timestamp"))))
    table(spark, sf_dir, "events").select("event_id", line.alias("value")).repartition(1).sortWithinPartitions("event_id").select("value").write.text(folder)
    return SF.ledger_rows(spark, folder).select("line", "event_id", "event_type", "timestamp", F.col("payload").isNotNull().alias("is_json"))


def bundle_digests(spark, sf_dir):
    """Digests of bundles' canonical JSON, and whether their sidecars name them."""
    rows = table(spark, sf_dir, "customer")
    text = F.concat(F.lit('{ "z": ['), "c_nationkey", F.lit(', 1],  "a": "'), "c_name", F.lit('" }'))
    compact = F.concat(F.lit('{"a":"'), "c_name", F.lit('","z":['), "c_nationkey", F.lit(",1]}"))
    return SF.bundle_digests(rows.select("c_custkey", text.alias("text"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.sha2(compact, 256), F.lit("  bundle.json"))).when(F.col("c_custkey") % 3 == 1, "0000").alias("sidecar"))).select("c_custkey", "sha256", "sidecar_ok")


def artifact_store(spark, sf_dir):
    """Artifacts of regions, each put twice and written once, listed and read back."""
    store = SF.ArtifactStore(spark, fresh_folder(spark, "artifacts"))
    for row in table(spark, sf_dir, "region").orderBy("r_regionkey").toLocalIterator():  # a table of five rows
        for _ in range(2):
            digest = store.put("region", {"name": row["r_name"], "key": row["r_regionkey"]})
        if store.get("region", digest) != {"name": row["r_name"], "key": row["r_regionkey"]}:
            raise ValueError("an artifact was changed")
    return store.listing()


def cbor_decode(spark, sf_dir):
    """Records encoded as CBOR and decoded again as canonical JSON."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct("o_orderpriority", "o_custkey", F.array("o_orderstatus", F.lit("é")).alias("list"))).alias("j"))
    return rows.select("o_orderkey", canonical.decoded(canonical.cbor_bytes(F.col("j"))).alias("json"))


def text_metrics_provider(spark, sf_dir):
    """The text provider end to end: snapshot of files, then its facts counted."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), "text")
    facts = P.TextMetrics().snapshot(spark, docs)
    return facts.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def observed_places(spark, sf_dir):
    """Every occurrence of patterns in whole texts, by line and column: their number and a digest of their places."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x09\x0A\x20-\x7E]", "~").alias("text"))
    places = T.observed_places(F.col("text"), r"\bthe\b|aa")
    rows = docs.select("doc_id", F.explode(places).alias("at"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("at.line").alias("lines"), F.sum("at.col").alias("cols"))


def _ledger(spark, sf_dir):
    """Three events per order, with a fault for most remainders of its key: lines, artifacts and registries."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").repartition(parts, "o_orderkey")  # lines are made of keys, of which a few splits hold all
    k, f = F.col("k"), F.col("f")
    rows = orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 18).alias("f"), F.col("o_orderkey").alias("r"))
    snapshot = F.concat(F.lit('{"snapshot":'), k, F.lit("}"))
    witness = F.concat(F.lit('{"program":{"module":"m@1","scope":"scope:s","snapshot_hash":"'), F.sha2(snapshot, 256), F.lit('"}}'))
    ref = lambda kind, schema, sha, size: F.struct(F.lit(kind).alias("kind"), F.lit(schema).alias("schema_id"), sha.alias("sha256"), size.cast("long").alias("size_bytes"))
    w_sha = F.when(f == 2, F.sha2(F.concat(F.lit("gone"), k), 256)).otherwise(F.sha2(witness, 256))
    w_size = F.when(f == 3, F.lit(1)).otherwise(F.octet_length(witness))
    w = ref("witness", "admissibility-witness/1", w_sha, w_size)
    other = ref("witness", "admissibility-witness/1", F.sha2(F.concat(F.lit("other"), k), 256), F.lit(5))
    s = ref("snapshot", "vault-snapshot/0", F.sha2(snapshot, 256), F.octet_length(snapshot))
    facts_text = F.concat(F.lit('{"facts":'), k, F.lit("}"))
    facts = F.when(f.isin(15, 16), ref("facts_bundle", "facts-bundle/1", F.sha2(facts_text, 256), F.octet_length(facts_text)))
    s_hash = F.when(f != 4, F.sha2(snapshot, 256))
    program = F.struct(F.lit("m@1").alias("module"), F.lit("scope:s").alias("scope"))
    registry = F.when(f == 12, F.lit("nowhere")).when(f == 13, F.lit("narrow")).when(f == 17, F.lit("bare")).otherwise(F.lit("wide"))
    at = F.lit("2024-01-01T00:00:00Z")

    def line(event_id, kind, fields, altered=None):
        nonlocal rows
        rows = rows.withColumn("body", F.to_json(F.struct(kind.alias("event_type"), *[c.alias(n) for n, c in fields.items()])))
        digest = F.sha2("body", 256)
        rows = rows.withColumn(f"{event_id}_id", digest if altered is None else F.coalesce(altered, digest))
        rows = rows.withColumn(f"{event_id}_line", F.concat(F.lit('{"event_id":"'), f"{event_id}_id", F.lit('",'), F.substring("body", F.lit(2), F.length("body")))).drop("body")

    base = {"timestamp": at, "witness": w, "snapshot_ref": s, "snapshot_hash": s_hash, "program": program, "registry_hash": registry}
    line("cost", F.lit(LV.COST), base, F.when(f == 1, F.concat(F.lit("x"), k)))
    named = F.when(f == 5, F.lit("no such event")).otherwise(F.col("cost_id"))
    facts_hash = F.when(f == 15, F.lit("ffff")).when(f == 16, F.sha2(facts_text, 256))
    checked = {"timestamp": at, "cost_declared_event_id": named, "witness": F.when(f == 7, other).otherwise(w), "snapshot_ref": s, "snapshot_hash": s_hash, "facts_bundle_ref": facts, "facts_bundle_hash": facts_hash, "program": program, "registry_hash": registry}
    line("check", F.lit(LV.CHECKED), checked)
    executed = {"timestamp": at, "cost_declared_event_id": named, "admissibility_checked_event_id": F.col("check_id")} | {n: c for n, c in checked.items() if n not in ("timestamp", "cost_declared_event_id")}
    executed |= {"lens_id": F.when(f == 14, F.lit("lens:other")), "facts_bundle_hash": F.when(f == 16, F.lit("eeee")).otherwise(facts_hash)}
    kind = F.when(f == 9, F.lit("admissibility.paused")).when(f != 10, F.lit(LV.EXECUTED))
    line("exec", kind, executed, F.when(f == 8, F.col("check_id")))
    rows = rows.withColumn("exec_line", F.when(f == 11, F.lit("{broken")).when(f == 10, F.regexp_replace("exec_line", '"event_type":null,', "")).otherwise(F.col("exec_line")))
    second, third = F.when(f == 6, F.lit(3)).otherwise(F.lit(2)), F.when(f == 6, F.lit(2)).otherwise(F.lit(3))
    at_line = lambda n: F.col("r") * 3 + n
    lines = rows.select(F.explode(F.array(*[F.struct(at_line(n).alias("line"), F.col(c).alias("raw")) for n, c in ((F.lit(1), "cost_line"), (second, "check_line"), (third, "exec_line"))])).alias("l")).select("l.line", "l.raw")
    texts = orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 18).alias("f"))
    held = texts.select(F.explode(F.array(F.struct(F.lit("witness").alias("kind"), witness.alias("content")), F.struct(F.lit("snapshot").alias("kind"), snapshot.alias("content")), F.struct(F.lit("facts_bundle").alias("kind"), facts_text.alias("content")))).alias("a")).select("a.kind", "a.content")
    artifacts = held.select("kind", F.sha2("content", 256).alias("sha256"), F.sha2("content", 256).alias("actual_sha256"), F.octet_length("content").cast("long").alias("bytes"), "content")
    everything = ["admissibility-witness/1", "vault-snapshot/0", "facts-bundle/1"]
    registries = spark.createDataFrame([("wide", everything, ["scope:s"]), ("narrow", everything, ["scope:t"]), ("bare", everything[1:], ["scope:s"])], "registry_hash string, schemas array<string>, scopes array<string>")
    return lines, artifacts, registries


#: Issues of the ledger above by remainder: (remainder, line within the order, issue).
LEDGER_FAULTS = [
    (1, 1, "event_id_mismatch"), (2, 1, "artifact_missing"), (3, 1, "artifact_size_mismatch"), (4, 1, "snapshot_hash_missing"), (4, 2, "snapshot_hash_missing"), (4, 3, "snapshot_hash_missing"),
    (5, 2, "cost_event_missing"), (5, 3, "cost_event_missing"), (6, 2, "check_event_stands_later"), (7, 2, "witness_differs_from_cost"), (8, 3, "duplicate_event_id"), (8, 3, "event_id_mismatch"), (8, 3, "check_event_stands_later"),
    (9, 3, "unknown_event_type"), (10, 3, "missing_event_type"), (11, 3, "invalid_json"), (12, 1, "registry_missing"), (12, 2, "registry_missing"), (12, 3, "registry_missing"),
    (13, 1, "scope_not_registered"), (13, 2, "scope_not_registered"), (13, 3, "scope_not_registered"), (14, 3, "lens_differs_from_check"), (15, 2, "facts_hash_is_not_its_reference"), (16, 3, "facts_hash_differs_from_check"),
    (17, 1, "schema_not_registered"), (17, 2, "schema_not_registered"), (17, 3, "schema_not_registered"),
]


def ledger_verify_issues(spark, sf_dir):
    lines, artifacts, registries = _ledger(spark, sf_dir)
    return LV.verify_ledger(lines, artifacts, registries).select("line", "issue")


def ledger_sound_events(spark, sf_dir):
    """Lines of the same ledger that nothing is wrong with."""
    lines, artifacts, registries = _ledger(spark, sf_dir)
    return LV.sound_events(lines, artifacts, registries).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def findings_report(spark, sf_dir):
    """A table of markdown with a line per supplier, all of them in order."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 != 0, F.concat("s_name", F.lit("|x"))).alias("s_name"))
    return S.report_lines(rows, "Suppliers", ["s_suppkey"])


def git_snapshot_witness(spark, sf_dir):
    """A snapshot per nation: its customers are tracked files, its suppliers submodules."""
    oid = lambda c: F.substring(F.sha2(c.cast("string"), 256), 1, 40)
    commit = lambda c: oid(F.concat(F.lit("nation"), c.cast("string")))
    heads = table(spark, sf_dir, "nation").select(commit(F.col("n_nationkey")).alias("commit"), (F.col("n_nationkey") % 2 == 0).alias("is_clean"))
    tree = table(spark, sf_dir, "customer").select(commit(F.col("c_nationkey")).alias("commit"), F.concat(F.lit("100644 "), F.when(F.col("c_custkey") % 9 == 0, "tree").otherwise("blob"), F.lit(" "), oid(F.col("c_custkey")), F.lit("\t./src\\"), "c_custkey").alias("line"))
    modules = table(spark, sf_dir, "supplier").select(commit(F.col("s_nationkey")).alias("commit"), F.concat(F.lit("+"), oid(F.col("s_suppkey")), F.lit(" libs/"), "s_suppkey", F.lit(" (heads/main)")).alias("line"))
    files = WI.tree_files(tree)
    heads = heads.join(WI.manifest_hash(files), "commit", "left")
    return WI.snapshot_records(heads, files, WI.submodules(modules))


def git_diff_witness(spark, sf_dir):
    """A diff per customer: its orders are changes of every kind."""
    k = F.col("o_orderkey")
    letter = _pick(("A", "M", "D", "R100", "C75", "T"), k)
    line = F.concat(letter, F.lit("\t"), F.when(letter.isin("R100", "C75"), F.concat(F.lit("old/"), k, F.lit("\t"))).otherwise(F.lit("")), F.lit("new/"), k)
    rows = table(spark, sf_dir, "orders").select(F.struct("o_custkey").alias("diff"), line.alias("line"))
    changes = WI.name_status(rows).select(F.col("diff.o_custkey").alias("diff"), F.lit("base").alias("base"), F.lit("head").alias("head"), "path", "change_kind", "old_path")
    blobs = table(spark, sf_dir, "orders").select(F.explode(F.array(F.struct(F.lit("base").alias("commit"), F.concat(F.when(letter.isin("R100", "C75"), F.lit("old/")).otherwise(F.lit("new/")), k).alias("path"), F.concat(F.lit("b"), k).alias("blob_oid")), F.struct(F.lit("head").alias("commit"), F.concat(F.lit("new/"), k).alias("path"), F.concat(F.lit("h"), k).alias("blob_oid")))).alias("x")).select("x.*")
    return WI.diff_records(changes, blobs)


def git_provenance_bindings(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("repo:"), "l_suppkey").alias("repository_id"), F.col("l_returnflag").alias("artifact_kind"), F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"), 256).alias("artifact_sha256"), F.lit("c").alias("commit_oid")).distinct()
    return WI.provenance_bindings(rows, ["artifact_kind", "artifact_sha256", "commit_oid"]).select("repository_id", "artifact_kind", "artifact_sha256", "place")


def program_bundle_faults(spark, sf_dir):
    """Bundles per nation: customers are modules, orders dependencies between customers."""
    customer = table(spark, sf_dir, "customer")
    content = F.concat(F.lit("module "), F.col("c_custkey") % 40)
    programs = customer.select(F.col("c_nationkey").alias("bundle"), (F.col("c_custkey") % 40).alias("module_id"), F.when(F.col("c_custkey") % 13 == 0, "0").otherwise(F.sha2(content, 256)).alias("sha256"), content.alias("content"))
    deps = customer.select(F.col("c_nationkey").alias("bundle"), (F.col("c_custkey") % 40).alias("from"), (F.col("c_custkey") % 60).alias("to"))
    return WI.bundle_faults(programs, deps).distinct()


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

_SKIPPED = "regexp_matches(path, '(^|/)(\\.git|target|out|node_modules|\\.venv|\\.mypy_cache|logs|surrealdb[^/]*)/')"
_PR = f"""
WITH p AS (
  SELECT c_custkey AS pr, {_sql_pick(("APPROVED", "CHANGES_REQUESTED"), "c_custkey")} AS r1, {_sql_pick(("COMMENTED", "APPROVED", "DISMISSED"), "c_custkey")} AS r2, c_custkey % 2 = 0 AS green, {_sql_pick((".github/workflows/ci.yml", "src/a.rs", "README.md"), "c_custkey")} AS file FROM customer
), s AS (
  SELECT *, 1 + (r2 = 'APPROVED')::INT AS approvals, (r2 = 'CHANGES_REQUESTED')::INT AS changes_requested FROM p
)
"""
_ITEM = lambda path, name, value: C.mapping({"path": C.text(path), name: C.text(value)})
_OID = lambda c: f"substr(sha256(CAST({c} AS VARCHAR)), 1, 40)"
_LEDGER_SQL = "WITH f AS (SELECT * FROM (VALUES " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in LEDGER_FAULTS) + ") t(r, n, issue)), i AS (SELECT o_orderkey * 3 + n AS line, issue FROM orders JOIN f ON o_orderkey % 18 = r)"

ORACLE_SQL = {
    "walk_skipped_dirs": f"SELECT path, strlen(text)::BIGINT AS size FROM ({_PATHS}) WHERE NOT {_SKIPPED}",
    "gitignore_match": f"SELECT path FROM ({_PATHS}) WHERE NOT {_SKIPPED} AND path NOT LIKE '%.tmp' AND path NOT LIKE 'lib/outer/%' AND path NOT LIKE 'src/f_.md'",
    "git_listed_paths": f"SELECT path FROM ({_PATHS}) WHERE NOT {_SKIPPED}",
    "directory_snapshot": f"SELECT path, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM ({_PATHS})",
    "directory_snapshot_hash": f"""
        WITH d AS (SELECT sha256(path || chr(0) || sha256(text)) AS d FROM ({_PATHS})), b AS (SELECT d[1:3] AS b, sha256(string_agg(d, '' ORDER BY d)) AS h, count(*) AS n FROM d GROUP BY 1)
        SELECT sha256(string_agg(h, '' ORDER BY b)) AS snapshot_hash, CAST(sum(n) AS BIGINT) AS files FROM b""",
    "walk_folder": "SELECT 'p' || (doc_id % 4) AS dir, count(*) AS rows, CAST(sum(2 + strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents WHERE doc_id % 4 <> 3 GROUP BY 1 UNION ALL SELECT 'logs', count(*), CAST(sum(2 + strlen(coalesce(text, ''))) AS BIGINT) FROM documents WHERE doc_id % 4 = 3 HAVING count(*) > 0",
    "npm_dependencies": _NPM + "SELECT path, 'npm' AS kind, CASE WHEN broken THEN 'invalid' ELSE section END AS section, CASE WHEN broken THEN '' ELSE name END AS name, CAST(NULL AS VARCHAR) AS package_name, CASE WHEN NOT broken THEN req END AS version_req, CASE WHEN broken THEN 'unknown' ELSE source END AS source_kind FROM m",
    "git_dependency_present": _NPM + "SELECT path, name FROM m WHERE NOT broken AND source = 'git'",
    "wildcard_version_present": _NPM + "SELECT path, name FROM m WHERE NOT broken AND req = '*'",
    "cargo_dependencies": f"""
        SELECT 'c' || p_partkey || '/Cargo.toml' AS path, {_sql_pick(("dependencies", "dev-dependencies", "target.cfg(unix).dependencies", "workspace.dependencies"), "p_size")} AS section, 'd' || p_size AS name, CASE WHEN p_partkey % 5 = 4 THEN 'real' END AS package_name,
               CASE p_partkey % 5 WHEN 0 THEN '1.2' WHEN 2 THEN '0.1' WHEN 4 THEN '2' END AS version_req, {_sql_pick(("registry", "git", "path", "workspace", "registry"), "p_partkey")} AS source_kind FROM part""",
    "cargo_lock_entries": f"SELECT 'c' || p_partkey || '/Cargo.lock' AS path, 'p' || p_size AS name, p_size || '.0.1' AS version_req, {_sql_pick(('path', 'registry', 'git'), 'p_partkey')} AS source_kind FROM part",
    "manifests_by_name": f"""
        WITH p AS (SELECT 'd' || p_size || '/' AS d, {_sql_pick(("Cargo.toml", "Cargo.lock", "package.json", "yarn.lock", "npm-shrinkwrap.json", "other.json"), "p_partkey")} AS f FROM part)
        SELECT CASE WHEN f IN ('Cargo.toml', 'package.json') THEN 'manifest' ELSE 'lock' END AS what, CASE WHEN f LIKE 'Cargo%' THEN 'cargo' ELSE 'npm' END AS kind, count(*) AS n, count(DISTINCT d || f) AS paths FROM p WHERE f <> 'other.json' GROUP BY ALL""",
    "git_status_paths": _STATUS + "SELECT path, old_path, xy, kind FROM s",
    "git_status_findings": _STATUS + "SELECT 'git/' || state || '_file' AS rule_id, path, state || ' ' || path AS message FROM f",
    "git_dirty_predicates": _STATUS + """
        SELECT k AS predicate, count(*) FILTER (state || '_file' = k) AS findings, count(DISTINCT CASE WHEN state || '_file' = k THEN path END) AS paths FROM f, (SELECT unnest(['untracked_file', 'staged_file', 'modified_file']) AS k) GROUP BY k
        UNION ALL SELECT 'dirty_state', count(*), count(DISTINCT path) FROM f
        UNION ALL SELECT 'sensitive_path_touched', count(DISTINCT path), count(DISTINCT path) FROM f WHERE path LIKE 'dir 1%/f%7'""",
    "git_branch_status": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'detached' WHEN 1 THEN 'unborn' ELSE 'branch' END AS head_state FROM nation",
    "git_head_of_status": 'SELECT \'main\' AS branch, \'abc123\' AS "commit", \'origin/main\' AS upstream, CAST(4 AS INT) AS ahead, CAST(2 AS INT) AS behind, \'branch\' AS head_state',
    "pr_state": "SELECT c_custkey AS pr, 'main' AS base, 'h' || c_custkey AS head, sha256(CAST(c_custkey AS VARCHAR)) AS sha, 'a,z' AS labels FROM customer",
    "pr_reviews_summary": _PR + "SELECT pr, CAST(approvals AS BIGINT) AS approvals, CAST(changes_requested AS BIGINT) AS changes_requested FROM s",
    "pr_checks_summary": _PR + "SELECT pr, CAST(2 AS BIGINT) AS total, CAST(CASE WHEN green THEN 2 ELSE 0 END AS BIGINT) AS green, CAST(CASE WHEN green THEN 0 ELSE 1 END AS BIGINT) AS red, CAST(CASE WHEN green THEN 0 ELSE 1 END AS BIGINT) AS pending FROM p",
    "pr_files": _PR + "SELECT pr, file AS path FROM p UNION ALL SELECT pr, 'f' || pr FROM p",
    "workflow_change_requires_extra_approval": _PR + "SELECT pr, CAST(approvals AS BIGINT) AS approvals FROM s WHERE file LIKE '.github/workflows/%' AND approvals < 2",
    "changed_paths_union": "SELECT 'pull request' AS source, count(*) + least(count(*), 3) AS n FROM customer UNION ALL SELECT 'working tree', count(*) FROM orders",
    "rust_item_counts": """
        WITH p AS (SELECT 'src/m' || p_partkey || '.rs' AS path, p_partkey AS k FROM part)
        SELECT path, kind, CAST(1 AS BIGINT) AS n FROM p, (SELECT unnest(['use', 'struct', 'function', 'unsafe_block', 'impl']) AS kind) UNION ALL SELECT path, 'enum', 1 FROM p WHERE k % 3 = 0""",
    "rust_ast_summaries": """SELECT p_partkey AS path, CASE WHEN p_partkey % 10 <> 9 THEN '{"counts":{"fn":1' || CASE WHEN p_partkey % 2 = 0 THEN ',"impl":1,"static":1,"use":1}' ELSE ',"macro":1,"mod":1,"static":1,"use":1}' END || ',"summary_type":"rust_ast_item_counts"}' END AS ast_summary FROM part""",
    "rust_structure": """
        WITH p AS (SELECT 'src/m' || p_partkey || '.rs' AS path, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS e FROM part)
        SELECT path, 'use' AS kind, 'std' AS name, false AS public, CAST(1 AS INT) AS start_line, CAST(1 AS INT) AS end_line FROM p UNION ALL SELECT path, 'struct', 'S' || k, true, 3, 5 FROM p UNION ALL SELECT path, 'enum', 'E', true, 7, 7 FROM p WHERE e = 1
        UNION ALL SELECT path, 'fn', 'f' || k, true, 7 + e, 10 + e FROM p UNION ALL SELECT path, 'impl', '', false, 12 + e, 12 + e FROM p""",
    "rust_unsafe_unjustified": "SELECT 'src/m' || p_partkey || '.rs' AS path, CAST(CASE WHEN p_partkey % 3 = 0 THEN 10 ELSE 9 END AS INT) AS line FROM part WHERE p_partkey % 2 <> 0",
    "rust_lint_findings": """
        WITH r AS (SELECT p_partkey % 8 AS r FROM part), n AS (SELECT CASE r WHEN 0 THEN 'IR-RS-02' WHEN 1 THEN 'IR-RS-04' WHEN 2 THEN 'IR-RS-04' WHEN 3 THEN 'IR-RS-03' WHEN 4 THEN 'IR-RS-05' WHEN 5 THEN 'IR-RS-04' WHEN 6 THEN 'IR-RS-08' END AS rule_id FROM r)
        SELECT rule_id, count(*) AS n, count(*) AS paths FROM n WHERE rule_id IS NOT NULL GROUP BY 1""",
    "vault_notes": f"""
        WITH d AS (SELECT *, doc_id % 4 <> 3 AS h FROM documents)
        SELECT 'vault/n' || doc_id || '.md' AS path, 'n' || doc_id AS name, CASE WHEN h THEN {_sql_pick(("concept", "invariant"), "doc_id")} END AS role, CASE WHEN h THEN {_sql_pick(("concept", "invariant", "plan"), "doc_id")} END AS type, 'Title ' || doc_id AS title,
               h AND doc_id % 3 = 0 AS canonical, CASE WHEN h THEN 'a' || doc_id || '|b c' ELSE '' END AS aliases, CASE WHEN h THEN 'x|y' || (doc_id % 5) ELSE '' END AS facets, CASE WHEN h THEN CAST(doc_id % 20 AS VARCHAR) END AS invariant_id,
               sha256('# Title ' || doc_id || ' #' || chr(10) || chr(10) || coalesce(text, '')) AS body_sha256 FROM d""",
    "frontmatter_projection": f"""
        SELECT 'vault/n' || doc_id || '.markdown' AS path, CAST(NULL AS VARCHAR) AS fm_title, CASE WHEN doc_id % 4 <> 3 THEN {_sql_pick(("concept", "invariant"), "doc_id")} END AS fm_role, CASE WHEN doc_id % 4 <> 3 THEN {_sql_pick(("concept", "invariant", "plan"), "doc_id")} END AS fm_type,
               CASE WHEN doc_id % 4 <> 3 THEN CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END END AS fm_canonical, doc_id % 4 <> 3 AS has_frontmatter FROM documents""",
    "note_type_registry": "SELECT * FROM (VALUES ('concept', 'vault/n*.md,concepts/*', 'md', 'role,status', 'Summary', 'role:enum'), ('invariant', 'vault/n1*.md', 'txt', '', '', 'canonical:type')) t(type_id, patterns, extension, required, sections, constraints)",
    "note_type_resolution": "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN NULL ELSE 'concept' END AS type_id FROM documents",
    "ledger_lines": """
        WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS line, event_id % 10 AS r FROM events)
        SELECT line, CASE WHEN r <> 4 THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN r <> 4 THEN event_type END AS event_type, CASE WHEN r <> 4 THEN strftime(ts, '%Y-%m-%d') END AS timestamp, r <> 4 AS is_json FROM e WHERE r <> 3""",
    "bundle_digests": """SELECT c_custkey, sha256('{"a":"' || c_name || '","z":[' || c_nationkey || ',1]}') AS sha256, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sidecar_ok FROM customer""",
    "artifact_store": f"""
        WITH a AS (SELECT {C.mapping({"name": C.text("r_name"), "key": C.integer("r_regionkey")})} AS h, strlen('{{"key":' || r_regionkey || ',"name":"' || r_name || '"}}') AS j FROM region)
        SELECT 'region' AS kind, sha256(unhex(h)) AS sha256, 'cbor' AS extension, CAST(length(h) // 2 AS BIGINT) AS bytes FROM a UNION ALL SELECT 'region', sha256(unhex(h)), 'json', CAST(j AS BIGINT) FROM a""",
    "cbor_decode": """SELECT o_orderkey, '{"list":["' || o_orderstatus || '","é"],"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '"}' AS json FROM orders""",
    "text_metrics_provider": "SELECT count(*) AS files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes FROM documents",
    "observed_places": """
        WITH t AS (SELECT doc_id, lower(regexp_replace(text, '[^\\x09\\x0A\\x20-\\x7E]', '~', 'g')) AS t FROM documents),
        l AS (SELECT doc_id, i AS line, l[i] AS s FROM (SELECT doc_id, string_split(t, chr(10)) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM t)),
        p AS (SELECT doc_id, line, unnest(list_filter(range(1, length(s) + 1), lambda i: s[i:i + 1] = 'aa' OR (s[i:i + 2] = 'the' AND NOT regexp_matches(coalesce(s[i - 1:i - 1], ''), '[a-z0-9_]') AND NOT regexp_matches(s[i + 3:i + 3], '[a-z0-9_]')))) AS col FROM l)
        SELECT doc_id, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines, CAST(sum(col) AS BIGINT) AS cols FROM p GROUP BY doc_id""",
    "ledger_verify_issues": _LEDGER_SQL + " SELECT line, issue FROM i",
    "ledger_sound_events": _LEDGER_SQL + """
        , e AS (SELECT o_orderkey AS k, unnest([1, 2, 3]) AS n FROM orders), good AS (SELECT CASE WHEN n = 1 THEN 'cost.declared' WHEN (n = 2) <> (k % 18 = 6) THEN 'admissibility.checked' ELSE 'admissibility.executed' END AS event_type FROM e WHERE k * 3 + n NOT IN (SELECT line FROM i))
        SELECT event_type, count(*) AS n FROM good GROUP BY 1""",
    "findings_report": """
        SELECT * FROM (VALUES (-4, '# Suppliers'), (-3, ''), (-2, '| s_suppkey | s_name |'), (-1, '| --- | --- |')) t(place, line)
        UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey) - 1, '| ' || s_suppkey || ' | ' || CASE WHEN s_suppkey % 3 <> 0 THEN s_name || '\\|x' ELSE '' END || ' |' FROM supplier""",
    "git_snapshot_witness": f"""
        WITH f AS (SELECT c_nationkey AS n, 'src/' || c_custkey AS path, {_OID("c_custkey")} AS oid FROM customer WHERE c_custkey % 9 <> 0), m AS (SELECT s_nationkey AS n, 'libs/' || s_suppkey AS path, {_OID("s_suppkey")} AS oid FROM supplier),
        ff AS (SELECT n, count(*) AS c, string_agg({_ITEM("path", "blob_oid", "oid")}, '' ORDER BY path) AS h, string_agg({C.text("path")}, '' ORDER BY path) AS p FROM f GROUP BY n), mm AS (SELECT n, count(*) AS c, string_agg({_ITEM("path", "commit_oid", "oid")}, '' ORDER BY path) AS h FROM m GROUP BY n),
        j AS (SELECT {_OID("'nation' || n_nationkey")} AS "commit", n_nationkey % 2 = 0 AS clean, coalesce(ff.c, 0) AS files, coalesce(mm.c, 0) AS modules, CASE WHEN ff.c IS NULL THEN '80' ELSE {C.head(4, "ff.c")} || ff.h END AS f, CASE WHEN mm.c IS NULL THEN 'f6' ELSE {C.head(4, "mm.c")} || mm.h END AS m,
                     CASE WHEN ff.c IS NOT NULL THEN {C.sha256(f"({C.head(4, 'ff.c')} || ff.p)")} END AS manifest FROM nation LEFT JOIN ff ON ff.n = n_nationkey LEFT JOIN mm ON mm.n = n_nationkey)
        SELECT "commit", {C.sha256(C.mapping({"schema_id": C.text("'git-snapshot-witness/0'"), "schema_version": "'00'", "head_commit_oid": C.text('"commit"'), "is_clean": "CASE WHEN clean THEN 'f5' ELSE 'f4' END", "tracked_files": "f", "submodules": "m", "working_tree_manifest_sha256": C.text("manifest")}))} AS witness_id,
               files, modules AS submodules FROM j""",
    "git_diff_witness": f"""
        SELECT o_custkey AS diff, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY encode('new/' || o_orderkey)) AS INT) AS place, 'new/' || o_orderkey AS path, {_sql_pick(("added", "modified", "deleted", "renamed", "copied", "type_changed"), "o_orderkey")} AS change_kind,
               CASE WHEN o_orderkey % 6 <> 0 THEN 'b' || o_orderkey END AS old_blob_oid, CASE WHEN o_orderkey % 6 <> 2 THEN 'h' || o_orderkey END AS new_blob_oid FROM orders""",
    "git_provenance_bindings": """
        WITH b AS (SELECT DISTINCT 'repo:' || l_suppkey AS repository_id, l_returnflag AS artifact_kind, sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') || '|' || l_extendedprice) AS artifact_sha256 FROM lineitem)
        SELECT *, CAST(row_number() OVER (PARTITION BY repository_id ORDER BY artifact_kind, artifact_sha256) AS INT) AS place FROM b""",
    "program_bundle_faults": """
        WITH m AS (SELECT c_nationkey AS bundle, c_custkey % 40 AS module, c_custkey % 13 = 0 AS wrong, c_custkey % 60 AS t FROM customer)
        SELECT bundle, 'module_twice' AS fault, module FROM m GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT DISTINCT bundle, 'digest_differs', module FROM m WHERE wrong
        UNION ALL SELECT DISTINCT bundle, 'unknown_module', t FROM m a WHERE t NOT IN (SELECT module FROM m b WHERE b.bundle = a.bundle)""",
}
