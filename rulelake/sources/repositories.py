"""Repository sources: status of a git working tree, pull requests, structure of Rust sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.findings import FINDING_SCHEMA

STATUS_NAMES = {"M": "modified", "A": "added", "D": "deleted", "R": "renamed", "C": "copied", "U": "conflicted"}


def status_lines(spark: SparkSession, text: str) -> DataFrame:
    """Lines of ``git status --porcelain=v2 --branch``."""
    return spark.createDataFrame([(k, line) for k, line in enumerate(text.splitlines()) if line], "k int, line string")


def head_state(branch: Column, commit: Column) -> Column:
    return F.when(commit.isNull() | (commit == "(initial)"), "unborn").when(branch == "(detached)", "detached").otherwise("branch")


def branch_status(lines: DataFrame) -> DataFrame:
    """One row: branch, commit, upstream, ahead, behind, head_state."""
    value = lambda key: F.max(F.when(F.startswith("line", F.lit(f"# branch.{key} ")), F.regexp_extract("line", rf"^# branch\.{key} (.*)$", 1)))
    row = lines.agg(value("head").alias("branch"), value("oid").alias("commit"), value("upstream").alias("upstream"), value("ab").alias("ab"))
    return row.select("branch", "commit", "upstream", F.regexp_extract("ab", r"\+(\d+)", 1).try_cast("int").alias("ahead"), F.regexp_extract("ab", r"-(\d+)", 1).try_cast("int").alias("behind"), head_state(F.col("branch"), F.col("commit")).alias("head_state"))


def changed_paths(lines: DataFrame) -> DataFrame:
    """(path, old_path, xy, kind): ordinary (1), renamed (2), conflicted (u) and untracked (?) entries."""
    kind = F.substring("line", 1, 1)
    fields = {"1": r"^1 (..) (?:\S+ ){6}(.*)$", "2": r"^2 (..) (?:\S+ ){7}([^\t]*)\t(.*)$", "u": r"^u (..) (?:\S+ ){8}(.*)$", "?": r"^\? (.*)$"}
    pick = lambda group: F.when(kind == "?", F.regexp_extract("line", fields["?"], 1) if group == 2 else F.lit("??")).when(kind == "1", F.regexp_extract("line", fields["1"], group)).when(kind == "2", F.regexp_extract("line", fields["2"], group)).when(kind == "u", F.regexp_extract("line", fields["u"], group))
    rows = lines.where(kind.isin("1", "2", "u", "?"))
    return rows.select(T.normalize_path(pick(2)).alias("path"), F.when(kind == "2", F.regexp_extract("line", fields["2"], 3)).alias("old_path"), pick(1).alias("xy"), kind.alias("kind"))


def status_findings(paths: DataFrame) -> DataFrame:
    """A finding per path and state: untracked, staged, modified, deleted, renamed, conflicted."""
    index, tree = F.substring("xy", 1, 1), F.substring("xy", 2, 1)
    states = F.filter(
        F.array(
            F.when(F.col("kind") == "?", "untracked"), F.when((F.col("kind") != "?") & (index != "."), "staged"), F.when((F.col("kind") != "?") & (tree == "M"), "modified"),
            F.when((F.col("kind") != "?") & ((index == "D") | (tree == "D")), "deleted"), F.when(F.col("kind") == "2", "renamed"), F.when(F.col("kind") == "u", "conflicted"),
        ),
        lambda s: s.isNotNull(),
    )
    rows = paths.select("path", F.explode(states).alias("state"))
    none = F.lit(None)
    return rows.select(F.concat(F.lit("git/"), "state", F.lit("_file")).alias("rule_id"), F.lit("info").alias("severity"), none.cast("string").alias("invariant"), "path", none.cast("int").alias("line"), none.cast("int").alias("col"), F.concat("state", F.lit(" "), "path").alias("message"), none.cast("string").alias("evidence"))


PR_SCHEMA = (
    "number long, title string, state string, isDraft boolean, baseRefName string, headRefName string, headRefOid string, labels array<struct<name:string>>, files array<struct<path:string>>, "
    "reviews array<struct<author:struct<login:string>,state:string,submittedAt:string>>, statusCheckRollup array<struct<name:string,context:string,status:string,conclusion:string,state:string>>"
)


def pull_requests(texts: DataFrame, column: str = "value") -> DataFrame:
    """Pull requests from the JSON of a viewer, one text per row."""
    return texts.select(F.from_json(column, PR_SCHEMA).alias("p")).select("p.*")


def pr_state(prs: DataFrame) -> DataFrame:
    labels = F.array_distinct(F.array_sort(F.transform(F.coalesce("labels", F.array()), lambda x: x["name"])))
    return prs.select(F.col("number").alias("pr"), "title", "state", F.col("baseRefName").alias("base"), F.col("headRefName").alias("head"), F.col("headRefOid").alias("sha"), labels.alias("labels"))


def pr_reviews(prs: DataFrame) -> DataFrame:
    rows = prs.select(F.col("number").alias("pr"), F.posexplode("reviews").alias("idx", "r"))
    return rows.select("pr", F.col("r.author.login").alias("reviewer"), F.col("r.state").alias("state"), F.col("r.submittedAt").alias("ts"), "idx")


def pr_checks(prs: DataFrame) -> DataFrame:
    rows = prs.select(F.col("number").alias("pr"), F.explode("statusCheckRollup").alias("c"))
    return rows.select("pr", F.coalesce("c.name", "c.context").alias("name"), F.coalesce("c.status", "c.state").alias("status"), F.coalesce("c.conclusion", F.when(F.col("c.state") == "SUCCESS", F.lit("SUCCESS"))).alias("conclusion"))


def pr_files(prs: DataFrame) -> DataFrame:
    return prs.select(F.col("number").alias("pr"), F.explode("files.path").alias("path")).distinct()


#: Items of Rust sources by line: kind and expression (the name is the first group).
RUST_ITEMS = (
    ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"),
    ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"), ("impl", r"^\s*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)"),
    ("use", r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([\w:]+)"), ("unsafe_block", r"\bunsafe\s*(\{)"), ("macro", r"^\s*macro_rules!\s+(\w+)"), ("const", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(\w+)\s*:"),
)


def rust_items(texts: DataFrame) -> DataFrame:
    """(path, line, kind, name, public) of (path, text) rows, by expressions over lines.

    This finds items as they are usually laid out; it is no parser, and what macros make is not seen.
    """
    rows = texts.select("path", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("k", "code"))
    rows = rows.where(~F.col("code").rlike(r"^\s*//"))
    found = F.filter(F.array(*[F.when(F.col("code").rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract("code", p, 1).alias("name"))) for kind, p in RUST_ITEMS]), lambda x: x.isNotNull())
    return rows.select("path", (F.col("k") + 1).alias("line"), F.explode(found).alias("i"), F.col("code").rlike(r"^\s*pub\b").alias("public")).select("path", "line", "i.kind", "i.name", "public")


def rust_item_counts(texts: DataFrame) -> DataFrame:
    return rust_items(texts).groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


def safety_comments(texts: DataFrame) -> DataFrame:
    """(path, line) of lines that a SAFETY comment stands on or right above."""
    rows = texts.select("path", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("k", "code")).where(F.col("code").rlike(r"//.*\bSAFETY:"))
    return rows.select("path", F.explode(F.array(F.col("k") + 1, F.col("k") + 2)).alias("line")).distinct()


#: Fields that a record named ...Witness must have, as expressions over its field names.
WITNESS_FIELDS = (
    ("schema_id", r"\bschema_id\s*:"), ("created_at/timestamp", r"\b(timestamp|created_at|\w+_created_at|\w*created_at_\w*)\s*:"),
    ("engine_version/tool_version/compiler", r"\b(engine_version|court_version|tool_version|compiler|producer)\s*:"), ("input_id(s)/config_hash", r"\b(input_ids?|config_hash|snapshot_hash|inputs?)\s*:"),
)


def rust_lints(texts: DataFrame, adapters: tuple[str, ...] = (), protected: str = r"(^|/)(core|engine)/", store_paths: str = "projection|store", engine_paths: str = "engine|witness|plan", run_field: str = "projection_run_id") -> DataFrame:
    """Findings of six rules over (path, text) rows: deletes outside vacuum code, writes without a run id, sources of
    nondeterminism in engine code, records that do not describe themselves, batch hashes that depend on an index, and
    references of protected code to adapters. Which paths are code of stores, engines and protected parts, and the field
    that names a run, are parameters."""
    low = F.lower("path")
    stores, engine = low.rlike(store_paths), low.rlike(engine_paths)
    rows = texts.select("path", "text", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("k", "code")).withColumn("low", F.lower("code"))
    quoted, comment = F.col("code").rlike("[\"']"), F.col("low").rlike(r"^\s*(//|\*|/\*)")
    hit = lambda rule, on, said: F.when(on, F.struct(F.lit(rule).alias("rule"), F.lit(said).alias("said")))
    checks = [
        hit("IR-RS-02", stores & ~low.contains("vacuum") & F.col("low").contains("delete ") & quoted & ~F.col("low").rlike("vacuum|justif"), "rows are deleted outside a vacuum"),
        hit("IR-RS-04", engine & F.col("low").rlike(r"hashmap<|std::collections::hashmap"), "a hash map's order may reach an engine's output"),
        hit("IR-RS-04", engine & F.col("low").rlike(r"rand::|thread_rng\("), "an engine draws random numbers"),
        hit("IR-RS-04", engine & F.col("low").rlike(r"utc::now\("), "an engine reads the clock"),
        hit("IR-RS-08", stores & F.col("low").rlike("batch_hash.*[=:]|[=:].*batch_hash") & F.col("low").rlike("batch_index|batch_idx|batch.*index|index.*batch"), "a batch's hash depends on its number"),
    ]
    if adapters:
        checks.append(hit("IR-RS-13", low.rlike(protected) & ~comment & F.col("low").rlike("|".join(rf"\b{a.lower()}\b" for a in adapters)), "protected code refers to an adapter"))
    by_line = rows.select("path", (F.col("k") + 1).alias("line"), F.explode(F.filter(F.array(*checks), lambda c: c.isNotNull())).alias("f"))
    writes = rows.where(stores & ~comment & quoted & F.col("low").rlike("(insert|update|create|relate|upsert) ") & ~F.lower("text").contains(run_field))
    by_file = writes.select("path").distinct().select("path", F.lit(None).cast("int").alias("line"), F.struct(F.lit("IR-RS-03").alias("rule"), F.lit(f"rows are written without {run_field}").alias("said")).alias("f"))
    structs = texts.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(struct\s+\w+Witness\b[^;{]*\{[^}]*\})"), F.lit(1))).alias("body")).where(F.col("body").rlike(r"\w+\s*:"))
    lacking = F.filter(F.array(*[F.when(~F.col("body").rlike(p), n) for n, p in WITNESS_FIELDS]), lambda n: n.isNotNull())
    said = F.concat(F.regexp_extract("body", r"struct\s+(\w+)", 1), F.lit(" does not say: "), F.array_join(lacking, ", "))
    by_struct = structs.where(F.size(lacking) > 0).select("path", F.lit(None).cast("int").alias("line"), F.struct(F.lit("IR-RS-05").alias("rule"), said.alias("said")).alias("f"))
    out = by_line.unionByName(by_file).unionByName(by_struct)
    none = F.lit(None)
    return out.select(F.col("f.rule").alias("rule_id"), F.lit("error").alias("severity"), none.cast("string").alias("invariant"), "path", F.col("line").cast("int").alias("line"), none.cast("int").alias("col"), F.col("f.said").alias("message"), none.cast("string").alias("evidence"))


FINDING_COLUMNS = [part.split()[0] for part in FINDING_SCHEMA.split(", ")]
