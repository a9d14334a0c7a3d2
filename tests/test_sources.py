import json

import pytest

from rulelake.operators import chunkers as ch
from rulelake.operators import predicates as P
from rulelake.operators.findings import ProviderError
from rulelake.sources import files, repositories, rust_syntax

CARGO = """
[package]
name = "x"
[dependencies]
serde = "1"
left = { git = "https://example.com/left", package = "left-real" }
near = { path = "../near", version = "*" }
[dev-dependencies]
any = "*"
[target.'cfg(unix)'.dependencies]
unixy = "2"
"""
NPM = json.dumps({"dependencies": {"a": "^1", "b": "github:x/y", "c": "workspace:*"}, "devDependencies": {"d": "x", "e": "file:../e"}})


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    said = {"crate/Cargo.toml": CARGO, "web/package.json": NPM, "web/yarn.lock": "", "other/package.json": "{broken", "target/out.txt": "no", ".git/config": "no", "docs/a.md": "x", "docs/tmp/b.md": "y", "logs/l.txt": "n", "keep.log": "k", "surrealdb-data/f": "n"}
    for name, text in said.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_walk_skips_folders_and_ignored_paths(spark, tree):
    paths = {r.path for r in files.walk(spark, tree, ignore=("*.log", "/docs/tmp/", "# remark"), with_content=False).collect()}
    assert paths == {"crate/Cargo.toml", "web/package.json", "web/yarn.lock", "other/package.json", "docs/a.md"}
    snapshot = files.directory_snapshot(files.walk(spark, tree))
    one = files.snapshot_hash(snapshot).first().snapshot_hash
    assert one == files.snapshot_hash(snapshot.repartition(5)).first().snapshot_hash and len(one) == 64


def test_dependencies_and_rules(spark, tree):
    walked = files.walk(spark, tree)
    deps = files.dependencies(files.file_texts(walked))
    got = {(r.name, r.source_kind) for r in deps.collect()}
    assert got == {("serde", "registry"), ("left", "git"), ("near", "path"), ("any", "registry"), ("unixy", "registry"), ("a", "registry"), ("b", "git"), ("c", "workspace"), ("d", "registry"), ("e", "path"), ("", "unknown")}
    assert {r.name for r in P.git_dependencies(deps).collect()} == {"left", "b"}
    assert {r.name for r in P.wildcard_versions(deps).collect()} == {"near", "any", "d"}
    allowed = spark.createDataFrame([("left-real",), ("serde",)], "name string")
    assert "left" not in {r.name for r in P.unapproved_dependencies(deps, allowed).collect()}
    manifests, locks = files.manifests_and_locks(walked)
    assert {r.path for r in P.missing_lockfiles(manifests, locks).collect()} == {"crate/Cargo.toml", "other/package.json"}
    more = locks.unionByName(spark.createDataFrame([("elsewhere/Cargo.lock", "cargo")], "path string, kind string"))
    assert {r.path for r in P.missing_lockfiles(manifests, more).collect()} == {"other/package.json"}
    assert files.parse_cargo_lock("l", '[[package]]\nname="a"\nversion="1"\nsource="git+x"')[0][-1] == "git"


def test_changed_manifests(spark):
    df = spark.createDataFrame([(p,) for p in ("a/Cargo.toml", "a/Cargo.lock", "b/Cargo.toml", "c/package.json", "c/yarn.lock", "package.json")], "path string")
    assert {r.path for r in P.manifests_without_lock_change(df).collect()} == {"b/Cargo.toml", "package.json"}


STATUS = """# branch.oid abc123
# branch.head main
# branch.upstream origin/main
# branch.ab +2 -1
1 M. N... 100644 100644 100644 aaa bbb src/staged.rs
1 .M N... 100644 100644 100644 aaa bbb with space.txt
1 .D N... 100644 100644 000000 aaa bbb gone.txt
2 R. N... 100644 100644 100644 aaa bbb R100 new.rs\told.rs
u UU N... 100644 100644 100644 100644 a b c both.txt
? fresh/.env
"""


def test_git_status(spark):
    lines = repositories.status_lines(spark, STATUS)
    branch = repositories.branch_status(lines).first()
    assert (branch.branch, branch.ahead, branch.behind, branch.head_state) == ("main", 2, 1, "branch")
    paths = repositories.changed_paths(lines)
    assert {(r.path, r.old_path, r.xy) for r in paths.collect()} == {("src/staged.rs", None, "M."), ("with space.txt", None, ".M"), ("gone.txt", None, ".D"), ("new.rs", "old.rs", "R."), ("both.txt", None, "UU"), ("fresh/.env", None, "??")}
    facts = repositories.status_findings(paths)
    provider = P.GitWorkingTree()
    of = lambda name, **p: {r.path for r in provider.evaluate(name, facts, p).findings.collect()}
    assert of("untracked_file") == {"fresh/.env"} and of("staged_file") == {"src/staged.rs", "new.rs", "both.txt"} and of("modified_file") == {"with space.txt"}
    assert of("sensitive_path_touched", globs=["*.env", "src/*"]) == {"fresh/.env", "src/staged.rs"}
    assert provider.evaluate("dirty_state", facts, {}).triggered.first().triggered
    assert not provider.evaluate("dirty_state", facts.limit(0), {}).triggered.first().triggered
    with pytest.raises(ProviderError, match="not supported"):
        provider.evaluate("no_such", facts, {})


def test_pull_requests(spark):
    pr = {
        "number": 7, "title": "t", "state": "OPEN", "baseRefName": "main", "headRefName": "wip/x", "labels": [{"name": "b"}, {"name": "a"}, {"name": "b"}], "files": [{"path": ".github/workflows/ci.yml"}],
        "reviews": [{"author": {"login": "u"}, "state": "APPROVED", "submittedAt": "2024-01-01T00:00:00Z"}, {"author": {"login": "u"}, "state": "CHANGES_REQUESTED", "submittedAt": None}, {"author": {"login": "v"}, "state": "COMMENTED", "submittedAt": "2024-01-02T00:00:00Z"}, {"author": {"login": "v"}, "state": "APPROVED", "submittedAt": "2024-01-02T00:00:00Z"}],
        "statusCheckRollup": [{"name": "CI", "status": "COMPLETED", "conclusion": "SUCCESS"}, {"name": "lint", "status": "COMPLETED", "conclusion": "FAILURE"}, {"name": "slow", "status": "IN_PROGRESS"}],
    }
    prs = repositories.pull_requests(spark.createDataFrame([(json.dumps(pr),)], "value string"))
    assert repositories.pr_state(prs).first().labels == ["a", "b"]
    summary = P.review_summary(repositories.pr_reviews(prs))
    assert tuple(summary.first()) == (7, 2, 0)
    checks = repositories.pr_checks(prs)
    assert {tuple(r) for r in P.required_checks(checks, ["CI", "lint", "none"]).collect()} == {("lint", "red"), ("none", "missing")}
    assert {r.name for r in P.required_checks(checks, []).collect()} == {"lint", "slow"}
    assert P.workflow_changes_unapproved(repositories.pr_files(prs), summary, 3).count() == 1 and P.workflow_changes_unapproved(repositories.pr_files(prs), summary).count() == 0
    assert P.too_few_approvals(summary, 3).count() == 1
    state = repositories.pr_state(prs)
    assert P.protected_flow(state, ["main"], ["release/*"]).count() == 1 and P.protected_flow(state, ["main"], ["wip/?"]).count() == 0
    assert P.scope_unavailable(spark.createDataFrame([("github/scope_unavailable",)], "rule_id string")).first().triggered


RUST = "// SAFETY: fine\npub unsafe fn go() {}\nfn f() {\n    unsafe { x() }\n}\nstruct RunWitness {\n    a: u8,\n    schema_id: String,\n}\nmod inner;\n"


def test_rust_sources(spark):
    texts = spark.createDataFrame([("src/witness.rs", RUST + "use std::collections::HashMap;\n"), ("db/projection.rs", 'let q = "DELETE x";\nlet w = "insert y";\n')], "path string, text string")
    kinds = {(r.kind, r.name) for r in repositories.rust_items(texts).collect()}
    assert {("function", "go"), ("function", "f"), ("struct", "RunWitness"), ("module", "inner")} <= kinds and any(k == "unsafe_block" for k, _ in kinds)
    unsafe = repositories.rust_items(texts).where("kind = 'unsafe_block'").select("path", "line")
    assert P.unjustified(unsafe, repositories.safety_comments(texts)).count() == 1
    rules = {(r.rule_id, r.path) for r in repositories.rust_lints(texts).collect()}
    assert rules == {("IR-RS-04", "src/witness.rs"), ("IR-RS-05", "src/witness.rs"), ("IR-RS-02", "db/projection.rs"), ("IR-RS-03", "db/projection.rs")}


def test_rust_scanner():
    source = """//! fn no() {}
#![allow(x)]
use std::{a, b}; /* fn no() { /* nested */ } */
pub(crate) const X: [u8; { 2 }] = [1, 2];
static mut S: &str = "fn fake() {";
pub async unsafe extern "C" fn f<'a>(x: &'a str) where T: X { let s = r#"}"#; let d = '}'; let e = b'\\''; }
#[derive(A)]
pub struct P(u8, u8);
struct U;
union Un { a: u8 }
trait T: X { fn g(); }
trait Al = X + Y;
impl<T> X for Q { fn h() {} }
extern crate z;
extern "C" { fn k(); }
macro_rules! mm { () => {}; }
my_macro!(a, b);
const fn cf() {}
"""
    got = [(i.kind, i.name, i.public, i.start_line) for i in rust_syntax.items(source)]
    assert got == [
        ("use", "std", False, 2), ("const", "X", True, 4), ("static", "S", False, 5), ("fn", "f", True, 6), ("struct", "P", True, 7), ("struct", "U", False, 9), ("union", "Un", False, 10), ("trait", "T", False, 11),
        ("trait_alias", "Al", False, 12), ("impl", "", False, 13), ("extern_crate", "z", False, 14), ("foreign_mod", "", False, 15), ("macro", "mm", False, 16), ("macro", "my_macro", False, 17), ("fn", "cf", False, 18),
    ]
    for broken in ("fn f( {", "/* open", 'let s = r#"open', "fn f() { ] }", "#[", "pub"):
        assert rust_syntax.summary(broken) is None or json.loads(rust_syntax.summary(broken))["counts"] == {}
    assert rust_syntax.items("") == [] and json.loads(rust_syntax.summary("use a;"))["counts"] == {"use": 1}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    """A file that is read in many splits, with lines of very different lengths, and files beside it."""
    lines = [f"{k} " + "x" * (k * 37 % 900) for k in range(3000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.txt").write_text("one\n\nthree")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        got = {r.file.rsplit("/", 1)[-1]: [] for r in rows.select("file").distinct().collect()}
        for r in rows.orderBy("file", "line").collect():
            got[r.file.rsplit("/", 1)[-1]].append((r.line, r.raw))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got["a.txt"] == list(enumerate(lines, 1)) and got["b.txt"] == [(1, "one"), (2, ""), (3, "three")]


def test_empty_files_and_listings(spark, tmp_path):
    for name in ("a/b/c/empty", "a/full", "logs/empty", "top"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" if name == "a/full" else "")
    assert {(r.path, r.size) for r in files.walk(spark, str(tmp_path)).collect()} == {("a/b/c/empty", 0), ("a/full", 1), ("top", 0)}
    listing = spark.createDataFrame([(bytearray(b"r/a\0r/target/x\0other/b\0r/\xff\xfe\0r/a\0"),)], "content binary")
    assert [r.path for r in files.listed_paths(listing, "r").collect()] == ["a"]


def test_projected_frontmatter(spark):
    texts = {"a": "\ufeff---\r\ntitle:  'It is'  \r\nrole: x\r\ncanonical: true\r\n---\r\nbody", "b": "---\ntype: \"t\"\ncanonical: no\n---", "c": "no block\n---\ntype: t\n---\n", "d": None}
    rows = files.projected_frontmatter(spark.createDataFrame(list(texts.items()), "path string, text string")).collect()
    got = {r.path: tuple(r)[1:] for r in rows}
    assert got["a"] == ("It is", "x", None, True, True) and got["b"] == (None, None, "t", None, True) and got["c"] == (None, None, None, None, False) and got["d"][:4] == (None,) * 4


def test_notes_bundles_artifacts_and_ledger(spark, tmp_path):
    text = "---\nrole: concept\naliases: [One, \"Two\"]\nfacets:\n  - f1\n  - f2\ncanonical: true\n---\n# Real title #\nbody"
    note = files.notes(spark.createDataFrame([("c/irr.md", text), ("x.txt", "no"), ("plain.md", "no fields")], "path string, text string")).orderBy("path").collect()
    assert note[0].role == "concept" and note[0].aliases == ["One", "Two"] and note[0].facets == ["f1", "f2"] and note[0].canonical and note[0].title == "Real title"
    assert note[1].title == "plain" and note[1].aliases == []
    value, digest = files.load_bundle('{"b": 1, "a": [2]}')
    assert files.load_bundle('{"a":[2],"b":1}', digest)[1] == digest
    with pytest.raises(ValueError, match="sidecar"):
        files.load_bundle('{"a": 1}', digest)
    store = files.ArtifactStore(spark, f"{tmp_path}/artifacts")
    key = store.put("witness", {"a": [1, "x", None, True]})
    assert store.put("witness", {"a": [1, "x", None, True]}) == key and store.get("witness", key) == {"a": [1, "x", None, True]}
    assert store.listing().count() == 2 and store.resolve(key[:8]).first().kind == "witness"
    (tmp_path / "ledger.jsonl").write_text('{"event_id": "a", "event_type": "cost.declared"}\n\nnot json\n{"event_id": "b"}\n')
    got = [(r.line, r.event_id, r.payload is None) for r in files.ledger_rows(spark, f"{tmp_path}/ledger.jsonl").orderBy("line").collect()]
    assert got == [(1, "a", False), (3, None, True), (4, "b", False)]


def test_observations(spark):
    texts = spark.createDataFrame([("p.md", "You should go.\nYou must not.\nSHOULD it be"), ("q.md", "aaaa")], "path string, text string")
    got = {r.diff: (r.value, r.first_path) for r in files.observe(texts, {"difference:norm": r"\bshould\b|\bmust\b", "difference:aa": "aa"}).collect()}
    assert got == {"difference:norm": (3, "p.md"), "difference:aa": (3, "q.md")}


def test_chunks_by_format(spark):
    md = "intro\n# A\nx\n## B\ny\n# C\nz"
    assert [(c[3], c[4], c[5], c[6]) for c in ch.chunk_text("d.md", "md", md)] == [("markdown_section", [], 1, 1), ("markdown_section", ["A"], 2, 3), ("markdown_section", ["A", "B"], 4, 5), ("markdown_section", ["C"], 6, 7)]
    assert [c[9] for c in ch.chunk_text("t.txt", "txt", "a\nb\n\n\nc")] == ["a\nb\n", "c"]
    assert [(c[3], c[5]) for c in ch.chunk_text("m.py", "py", "import x\ndef f():\n  def g(): pass\nclass C:\n  pass\n")] == [("python_block", 1), ("python_block", 2), ("python_block", 4)]
    assert [(c[3], c[5]) for c in ch.chunk_text("m.rs", "rs", "use x;\nfn f() {\n  fn g() {}\n}\npub struct S {\n}\n")] == [("rust_item", 1), ("rust_item", 2), ("rust_item", 5)]
    assert [c[5] for c in ch.chunk_text("m.py", "py", "x\n" * 150)] == [1, 81]
    book = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n", "x"]}, {"cell_type": "code", "source": "y = 1"}, {"cell_type": "raw", "source": " "}]})
    assert [(c[3], c[4]) for c in ch.chunk_text("n.ipynb", "ipynb", book)] == [("ipynb_markdown_cell", ["Cell 1", "T"]), ("python_fallback_window", [])]
    long = ch.chunk_text("t.txt", "txt", "é" * 5000)
    assert [len(c[9]) for c in long] == [2400, 2400, 520] and long[1][7] == 2 * 2240
    rows = ch.chunk_files(spark.createDataFrame([("d.md", md), ("bad.ipynb", "{"), ("e.txt", None)], "path string, text string"))
    assert rows.where("path = 'd.md'").count() == 4 and rows.where("path = 'bad.ipynb'").first().kind == "fallback_window" and rows.where("path = 'e.txt'").count() == 0


def test_markdown_helpers():
    md = "---\n\n# T\n\nFirst line\nsecond.\n\n## Rules\n\n- It must hold.\n- plain\n\n### Sub\nmore\n\n## Next\n"
    assert ch.summary(md) == "First line second." and ch.normative_lines(md) == ["It must hold."]
    assert ch.section(md, "rules") == "- It must hold.\n- plain\n\n### Sub\nmore" and ch.section(md, "gone") is None
    assert ch.demote_headings("# A\n```\n# no\n```\n##### B", 2) == "### A\n```\n# no\n```\n###### B"
    assert ch.link_to_anchors("[[A|b]] [[X#y]]", {"a": "aa"}) == "[b](#aa) X"
    from rulelake.operators.dag import topological_order

    book = ch.concept_book({"b": "see [[a]]", "a": "# In\n", "z": "no"}, [("a", "b")], ["b"], topological_order)
    assert book.index("# a") < book.index("# b") and "[a](#a)" in book and "# z" not in book
