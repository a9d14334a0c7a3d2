"""Queries of policy programs, exact numbers, chunkers and text functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exact
from ..functions import text as T
from ..operators import chunkers as CH
from ..operators import documents as D
from ..operators import selection as S
from ..operators import witnesses as WI
from ..session import table
from ..sources import files as SF
from . import cbor_sql as C
from . import program as P
from .source_queries import _pick, _sql_pick


def _programs(spark, sf_dir):
    """A policy program per customer: a scope change, a priced and perhaps allowed erasure, commits and a constraint."""
    k = F.col("c_custkey")
    allow = F.when(k % 4 == 0, F.lit("allow_erase difference:d\n")).when(k % 4 == 1, F.lit("deny_erase difference:d\n")).otherwise(F.lit(""))
    change = F.when(k % 5 == 0, F.lit("scope_change scope:a -> scope:b widen { allow; cost 2 \"risk\" -> bucket:debt }\n")).when(k % 5 == 1, F.lit("scope_change scope:a -> scope:b translate\n")).when(k % 5 == 2, F.lit("scope_change scope:a -> scope:b narrow\n")).otherwise(F.lit(""))
    source = F.concat(
        F.lit("# of a customer\nmodule module:m@1\nscope scope:main\ndepends [module:std@1]\ndifference difference:d\ndifference difference:n unit \"items\"\nbucket bucket:debt\nerasure_rule difference:d cost "), k % 10, F.lit(" \"risk\" -> bucket:debt\n"), allow, change,
        F.lit("commit difference:n = "), k % 7, F.lit(" \"items\"\nconstraint constraint:c\n@tag invariant \"inv\"\n@inadmissible_if "),
        _pick(("displaced_total bucket:debt > 5 \"risk\"", "has_commit difference:n and commit_cmp difference:n >= 4 \"items\"", "not erase_allowed difference:d or has_commit difference:x"), k), F.lit("\nquery admissible\n"),
    )
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("program_id"), source.alias("source"))


_PROGRAM = """
WITH c AS (SELECT c_custkey AS k, c_custkey % 10 AS cost, c_custkey % 4 = 0 AS allowed, c_custkey % 5 AS change, c_custkey % 7 AS n, c_custkey % 3 AS kind FROM customer),
t AS (SELECT *, (CASE WHEN allowed THEN cost ELSE 0 END) + (CASE WHEN change = 0 THEN 2 ELSE 0 END) AS total FROM c),
v AS (SELECT *, change = 1 AS unaccounted, CASE kind WHEN 0 THEN total > 5 WHEN 1 THEN n >= 4 ELSE NOT allowed END AS bad FROM t)
"""


def program_verdicts(spark, sf_dir):
    return P.verdicts_of(_programs(spark, sf_dir)).select("program_id", "verdict", "reason")


def program_verdicts_strict(spark, sf_dir):
    """The same with bounds that equality does not reach."""
    return P.verdicts_of(_programs(spark, sf_dir), strict_bounds=True).select("program_id", "verdict")


def program_statements(spark, sf_dir):
    return P.statements_of(_programs(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count("cost").alias("costs"), F.count("mode").alias("modes"))


def program_tokens(spark, sf_dir):
    return P.tokens_of(_programs(spark, sf_dir)).where("line = 8").groupBy("program_id").agg(F.count(F.lit(1)).alias("tokens"), F.max(F.when(F.col("kind") == "number", F.col("text"))).alias("number"), F.max(F.when(F.col("kind") == "string", F.col("text"))).alias("unit"), F.max("col").alias("last_col"))


def program_facts(spark, sf_dir):
    """Facts of all witnesses by type."""
    return P.facts_of(_programs(spark, sf_dir)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def program_fact_order(spark, sf_dir):
    """The facts of each witness in reporting order, as one text."""
    rows = P.facts_of(_programs(spark, sf_dir)).groupBy("program_id").agg(F.array_sort(F.collect_list(F.struct("place", "type"))).alias("f"))  # a dozen facts a program
    return rows.select("program_id", F.array_join(F.transform("f", lambda x: x["type"]), ",").alias("types"))


def predicate_texts(spark, sf_dir):
    """Canonical texts of the predicates that were looked at, with their outcome."""
    return P.facts_of(_programs(spark, sf_dir)).where("type = 'predicate_evaluated'").groupBy("predicate", "result").agg(F.count(F.lit(1)).alias("n"))


def witness_explain(spark, sf_dir):
    """What a witness says of one rule: the facts that carry its key, with their lines."""
    return P.facts_of(_programs(spark, sf_dir)).where("key = 'd'").groupBy("type", "line").agg(F.count(F.lit(1)).alias("n"))


def program_problems(spark, sf_dir):
    """Programs that are not well-formed, one fault for each remainder."""
    k = F.col("c_custkey")
    base = F.lit("module module:m@1\nscope scope:s\n")
    body = (
        F.when(k % 7 == 0, F.lit("scope scope:t\n")).when(k % 7 == 1, F.lit("difference difference:a\ndifference difference:a\n")).when(k % 7 == 2, F.lit("allow_erase difference:z\n")).when(k % 7 == 3, F.lit("constraint constraint:c\n"))
        .when(k % 7 == 4, F.lit("meta_change kind from lens:l payload p route bucket:b cost 1 \"u\"\n")).when(k % 7 == 5, F.lit("nonsense\n")).otherwise(F.lit("erasure_rule difference:d cost 1 \" \" -> bucket:b\n"))
    )
    rows = table(spark, sf_dir, "customer").select(k.alias("program_id"), F.concat(base, body).alias("source"))
    return P.statements_of(rows).where("type = 'problem'").groupBy(F.regexp_replace("key", r"^\d+:", "").alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def lens_chain(spark, sf_dir):
    """The active lens after two meta changes, the second from the lens that the first derives."""
    k = F.col("n_nationkey")
    source = F.concat(F.lit("module module:m@1\nscope scope:s\nbucket bucket:b\nlens lens:one hash h"), k, F.lit("\nmeta_change widen from lens:one payload p1 route bucket:b cost 1 \"u\" to lens:two\nmeta_change "), F.when(k % 2 == 0, "narrow").otherwise("widen"), F.lit(" from lens:"), F.when(k % 5 == 4, "one").otherwise("two"), F.lit(" payload p2 route bucket:"), F.when(k % 3 == 2, "none").otherwise("b"), F.lit(" cost 1 \"u\"\nquery admissible\n"))
    return P.verdicts_of(table(spark, sf_dir, "nation").select(k.alias("program_id"), source.alias("source"))).select("program_id", "verdict", "lens_id", "lens_hash")


def observed_commits(spark, sf_dir):
    """Counts of words in documents as commits of a program that forbids more than a number of them."""
    counted = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\bthe\b"))).alias("n"))
    text = F.concat(F.lit("module module:m@1\nscope scope:s\ndifference difference:the unit \"count\"\ncommit difference:the = 1 \"count\"\ncommit difference:the = "), "n", F.lit(" \"count\"\nconstraint constraint:c\n@inadmissible_if commit_cmp difference:the > 100 \"count\"\nquery admissible\n"))
    return P.verdicts_of(counted.select(F.coalesce("source", F.lit("none")).alias("program_id"), text.alias("source"))).select("program_id", "verdict")


def unit_algebra(spark, sf_dir):
    """Amounts with units: sums of equal units, products and quotients by plain numbers, and what units refuse."""
    k = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("a"), F.when(k % 2 == 0, "kg").alias("ua"), k.cast("long").alias("b"), F.when(k % 3 == 0, "kg").alias("ub"))
    out = exact.amounts_of(rows, ("add", "multiply", "divide"))
    return out.groupBy("op", "unit", "error").agg(F.count(F.lit(1)).alias("n"), F.sum("num").alias("nums"))


def calc_plan(spark, sf_dir):
    """A calculation described, and its plan's digest."""
    tree = {"op": "compare", "cmp": "gt", "left": {"op": "multiply", "left": {"op": "input_ref", "name": "q"}, "right": {"op": "literal", "value": "1.5"}}, "right": {"op": "convert_unit", "to": "kg", "value": {"op": "literal", "value": 3, "unit": "g"}}}
    made = exact.plan(tree)
    return spark.createDataFrame([(exact.describe(tree), ",".join(made["inputs"]), made["plan_hash"])], "described string, inputs string, plan_hash string")


def calc_execute(spark, sf_dir):
    """The trace of a calculation, step by step, for each region."""
    tree = {"op": "add", "left": {"op": "multiply", "left": {"op": "input_ref", "name": "q"}, "right": {"op": "literal", "value": 3}}, "right": {"op": "literal", "value": "1/2"}}
    return exact.traces_of(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_regionkey").cast("long").alias("q")), tree, "id", ["q"])


def asset_targets(spark, sf_dir):
    target = F.concat(_pick(("./img/", "", "/a.b/", "  "), F.col("p_partkey")), F.lit("f"), F.col("p_partkey"), _pick((".png", ".md", "", ".MD", ".tar.gz"), F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", T.asset_like(target).alias("asset"))


def asset_links(spark, sf_dir):
    """Links to files, by path and under the root of the document that links."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    links = part.select(k, F.concat(F.lit("v"), k % 3, F.lit("/note.md")).alias("from_path"), F.concat(F.when(k % 2 == 0, F.concat(F.lit("v"), k % 3, F.lit("/"))).otherwise(F.lit("")), F.lit("img"), F.col("p_size"), F.lit(".png")).alias("target"))
    files = part.where("p_size % 4 != 0").select(F.concat(F.lit("v"), k % 3, F.lit("/img"), F.col("p_size"), F.lit(".png")).alias("path"))
    return D.resolve_assets(links, files, ["v0/", "v1/", "v2/"]).select("p_partkey", "file", "file_kind")


def heading_missing(spark, sf_dir):
    """Resolved links whose heading the document does not have, as written or as an anchor."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    links = part.select(k, F.concat(F.lit("n"), F.col("p_size")).alias("resolved"), F.when(k % 4 != 0, F.concat(_pick(("  Big   Head ", "big-head-", "Other "), k), F.col("p_size"))).alias("heading"))
    headings = part.where("p_size % 3 != 0").select(F.concat(F.lit("n"), F.col("p_size")).alias("path"), F.concat(F.lit("Big Head "), F.col("p_size")).alias("heading"))
    return D.resolve_headings(links, headings).select("p_partkey")


def heading_forms(spark, sf_dir):
    """Headings of conversations' texts: normal form, level and title."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("  "), F.repeat(F.lit("#"), (F.col("turn") % 8).cast("int")), F.lit(" "), F.regexp_replace(F.substring_index("text", "\n", 1), "[^A-Za-z .]", ""), F.lit("  ##")).alias("line"))
    return rows.select("conv_id", "turn", T.normalize_heading(F.col("line")).alias("normal"), T.heading_level(F.col("line")).alias("level"), T.heading_title(F.col("line")).alias("title"))


def term_occurrences(spark, sf_dir):
    """Occurrences of a word between spaces, beside those in plain text."""
    text = F.regexp_replace(T.ascii_lower(F.col("text")), "[^a-z ]", " ")
    return table(spark, sf_dir, "documents").select("doc_id", T.term_count(text, F.lit("the")).alias("n"))


def unresolved_link_ids(spark, sf_dir):
    """Ids of links without a target, from what they say."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.concat(F.lit("d/"), k).alias("from_path"), F.col("p_name").alias("target"), F.when(k % 2 == 0, F.col("p_brand")).alias("alias"), F.when(k % 3 == 0, F.lit("é")).alias("heading"), (k % 5 == 0).alias("embed"), F.col("p_size").alias("line"))
    return WI.unresolved_ids(rows).select("p_partkey", "unresolved_id")


def link_edge_ids(spark, sf_dir):
    """Ids of edges to documents and to files."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k, F.concat(F.lit("d/"), k).alias("from_path"), F.col("p_name").alias("target"), F.col("p_brand").alias("alias"), F.lit(None).cast("string").alias("heading"), F.lit(True).alias("embed"), F.col("p_size").alias("line"), F.lit("exact_path").alias("kind"), F.concat(F.lit("to"), "p_size").alias("to"))
    docs = WI.link_ids(rows, "to").select("p_partkey", F.lit("doc").alias("what"), "edge_id")
    return docs.unionByName(WI.link_ids(rows, "to", to_file=True).select("p_partkey", F.lit("file").alias("what"), "edge_id"))


def facet_edge_ids(spark, sf_dir):
    return WI.facet_ids(table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.coalesce("source", F.lit("")).alias("facet")))


def observed_spans(spark, sf_dir):
    """Patterns counted over whole documents, each with the place where it occurs first."""
    texts = table(spark, sf_dir, "documents").select(F.format_string("d%08d", "doc_id").alias("path"), F.regexp_replace("text", r"[^\x09\x0A\x20-\x7E]", "~").alias("text"))
    return SF.observe(texts, {"the": r"\bthe\b", "aa": "aa", "none": "zzzzzz"})


def file_formats(spark, sf_dir):
    path = F.concat(F.lit("a/b."), _pick(("md", "rs", "py", "txt", "ipynb", "JSON", "x"), F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", CH.format_of(path).alias("format"), CH.language_of(path).alias("language"))


def _files(spark, sf_dir, fmt, text):
    return table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey"), F.lit(f".{fmt}")).alias("path"), text.alias("text"))


def _chunks(rows):
    return CH.chunk_files(rows).select("path", "kind", F.array_join("heading_path", ">").alias("headings"), "start_line", "end_line", "start_byte", "end_byte", F.sha2("text", 256).alias("sha256"))


def chunk_rust_items(spark, sf_dir):
    """Sources of two items each, after two lines of use; braces inside do not open an item."""
    k = F.col("p_partkey")
    return _chunks(_files(spark, sf_dir, "rs", F.concat(F.lit("use a;\n\nfn f"), k, F.lit("() {\n    if x { fn inner() {} }\n}\npub struct é"), k, F.lit(";\n"))))


def chunk_python_blocks(spark, sf_dir):
    k = F.col("p_partkey")
    return _chunks(_files(spark, sf_dir, "py", F.concat(F.lit("import a\n\ndef f"), k, F.lit("():\n    def inner(): pass\n\nclass C"), k, F.lit(":\n    x = 1\n"))))


def chunk_notebooks(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit('{"cells":[{"cell_type":"markdown","source":["# T'), k, F.lit('\\n","body\\n"]},{"cell_type":"code","source":"def f'), k, F.lit('():\\n    pass\\n"},{"cell_type":"raw","source":""}]}'))
    return CH.chunk_files(_files(spark, sf_dir, "ipynb", F.when(k % 10 == 9, F.lit("{broken\n")).otherwise(text))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("end_line").alias("last"))


def chunk_text_files(spark, sf_dir):
    """Whole documents as text files: paragraphs with their places in bytes."""
    docs = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\.\n", ".\n\n").alias("text"))
    return CH.chunk_files(docs).groupBy("path").agg(F.count(F.lit(1)).alias("chunks"), F.max("end_line").alias("last_line"), F.max("end_byte").alias("last_byte"))


def normative_lines(spark, sf_dir):
    """What must be, among lines of each part's document."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("# Head must\n\n- It MUST hold "), k, F.lit("\n1. never "), k, F.lit("\nplain\n* mustard\n"))
    return CH.normative_rows(table(spark, sf_dir, "part").select(k.alias("path"), text.alias("text")))


def summary_lines(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("---\n\n# Head\n\nfirst "), k, F.lit("\nsecond\n\nthird\n"))
    return CH.described(table(spark, sf_dir, "part").select(k.alias("path"), F.when(k % 5 == 0, "# only\n").otherwise(text).alias("text")), "Rules").select("path", "summary")


def section_bodies(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("# T\n## rules ##\nkeep "), k, F.lit("\n### sub\nthis\n## Other\nnot\n"))
    return CH.described(table(spark, sf_dir, "part").select(k.alias("path"), F.when(k % 4 == 0, "# none\n").otherwise(text).alias("text")), "Rules").select("path", "section")


def demoted_headings(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.repeat(F.lit("#"), (k % 6 + 1).cast("int")), F.lit(" T\n```\n# code\n```\nx"))
    return CH.demoted(table(spark, sf_dir, "part").select(k.alias("path"), text.alias("text")), 2)


def concept_book(spark, sf_dir):
    """A book of the regions: each depends on the one before it; seeds bring what they need, dependencies first."""
    rows = sorted((r["r_regionkey"], r["r_name"]) for r in table(spark, sf_dir, "region").toLocalIterator())  # five rows
    from ..operators.dag import topological_order

    notes = {name: f"# In\nsee [[{rows[k - 1][1] if k else name}|before]] and [[none]]" for k, name in rows}
    edges = [(rows[k - 1][1], name) for k, name in rows if k]
    book = CH.concept_book(notes, edges, [name for k, name in rows if k == 2], topological_order)
    return spark.createDataFrame(list(enumerate(book.split("\n"))), "place int, line string")


def spine_view(spark, sf_dir):
    """Concepts with their primary spine and tier, rendered as lines of an index."""
    kind = F.when(F.col("n_chars") % 2 == 0, "structural").otherwise("textual")
    references = table(spark, sf_dir, "documents").select(F.col("source").alias("concept"), F.col("lang").alias("spine"), kind.alias("kind"))
    return D.spine_index(D.spine_counts(references))


def doc_stats_full(spark, sf_dir):
    """Statistics of documents with links to headings that are missing and to files."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    docs = part.select(F.concat(F.lit("n"), k, F.lit(".md")).alias("path"), F.concat(F.lit("t"), k).alias("title"))
    links = part.select(F.concat(F.lit("n"), F.col("p_size"), F.lit(".md")).alias("from_path"), F.when(k % 3 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("t"), k % 40)).alias("target"), F.when(k % 2 == 0, F.lit("Here")).alias("heading"))
    resolved = D.resolve_links(links, docs)
    headings = part.where("p_partkey % 4 = 0").select(F.concat(F.lit("n"), k, F.lit(".md")).alias("path"), F.lit("here").alias("heading"))
    files = part.select(F.concat(F.lit("n"), F.col("p_size"), F.lit(".md")).alias("from_path"), F.when(k % 5 == 0, "exact_path").otherwise("missing").alias("file_kind"))
    return D.link_stats(resolved, docs, "from_path", "path", headings, files)


def rerank_missing_vectors(spark, sf_dir):
    """Candidates re-ranked by cosine, where some have no vector and count as 0."""
    vectors = table(spark, sf_dir, "embeddings")
    heads = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("vec_id")).select(F.col("vec_id").alias("id"), F.col("label").alias("block"), "embedding", F.lit(None).cast("string").alias("resolved"))
    targets = vectors.select(F.col("label").alias("block"), F.format_string("d%08d", "vec_id").alias("path"), F.when(F.col("vec_id") % 3 == 0, None).otherwise(F.col("embedding")).alias("embedding"))
    return S.suggestions(heads, targets, "id", k=3).select("id", "candidate", F.round("similarity", 6).alias("similarity"), "place")


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_") and name.islower()}

_SHA = lambda *parts: "sha256(" + " || ".join(parts) + ")"
_EDGE = {"from": C.text("f"), "target": C.text("t"), "alias": C.text("a"), "heading": "'f6'", "embed": "'f5'", "line": C.integer("line"), "resolution_kind": C.text("'exact_path'")}
_COSINE = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
_SPINES = """
WITH c AS (SELECT source AS concept, lang AS spine, count(*) FILTER (n_chars % 2 = 0) AS s, count(*) AS total FROM documents GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, lead(total) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY concept ORDER BY total DESC, spine)),
b AS (SELECT concept, spine, total, CASE WHEN total = coalesce(nxt, 0) THEN 'tied' WHEN total >= 2 * coalesce(nxt, 0) THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN s = 0 THEN 'textual' WHEN s = total THEN 'structural' ELSE 'mixed' END AS tier FROM r WHERE k = 1)
"""

ORACLE_SQL = {
    "program_verdicts": _PROGRAM + """
        SELECT CAST(k AS VARCHAR) AS program_id, CASE WHEN bad OR unaccounted THEN 'inadmissible' ELSE 'admissible' END AS verdict,
               CASE WHEN bad AND unaccounted THEN 'constraints triggered; unaccounted boundary change [inv, irreversibility]' WHEN bad THEN 'constraints triggered [inv]' WHEN unaccounted THEN 'unaccounted boundary change [irreversibility]' ELSE 'admissible' END AS reason FROM v""",
    "program_verdicts_strict": _PROGRAM + "SELECT CAST(k AS VARCHAR) AS program_id, CASE WHEN (CASE kind WHEN 1 THEN n > 4 ELSE bad END) OR unaccounted THEN 'inadmissible' ELSE 'admissible' END AS verdict FROM v",
    "program_statements": _PROGRAM + """
        , s AS (SELECT unnest(['difference', 'difference', 'bucket', 'erasure_rule', 'commit', 'inadmissible_if', 'query', 'constraint', 'tag'] || CASE WHEN k % 4 < 2 THEN ['permission'] ELSE [] END || CASE change WHEN 0 THEN ['scope_change', 'permission', 'erasure_rule'] WHEN 1 THEN ['scope_change'] WHEN 2 THEN ['scope_change'] ELSE [] END) AS type FROM c)
        SELECT type, count(*) AS n, CASE WHEN type = 'erasure_rule' THEN count(*) ELSE 0 END AS costs, CASE WHEN type = 'scope_change' THEN count(*) ELSE 0 END AS modes FROM s WHERE type NOT IN ('constraint', 'tag') GROUP BY type""",
    "program_tokens": """SELECT CAST(c_custkey AS VARCHAR) AS program_id, CAST(7 AS BIGINT) AS tokens, CAST(c_custkey % 10 AS VARCHAR) AS number, 'risk' AS unit, CAST(length('erasure_rule difference:d cost 0 "risk" -> ') + 1 AS INT) AS last_col FROM customer""",
    "program_facts": _PROGRAM + """
        , f AS (SELECT unnest((CASE WHEN bad THEN ['constraint_triggered'] ELSE [] END) || (CASE WHEN k % 4 < 2 THEN ['permission_used'] ELSE [] END) || (CASE WHEN allowed THEN ['erasure_rule_used'] ELSE [] END) || (CASE WHEN change = 0 THEN ['permission_used', 'erasure_rule_used'] ELSE [] END)
                || (CASE kind WHEN 0 THEN ['predicate_evaluated'] WHEN 1 THEN ['predicate_evaluated', 'predicate_evaluated', 'commit_used'] ELSE CASE WHEN NOT allowed THEN ['predicate_evaluated'] ELSE ['predicate_evaluated', 'predicate_evaluated'] END END)
                || (CASE WHEN change < 3 THEN ['scope_change_used'] ELSE [] END) || (CASE WHEN unaccounted THEN ['unaccounted_boundary_change'] ELSE [] END)) AS type FROM v)
        SELECT type, count(*) AS n FROM f GROUP BY type""",
    "program_fact_order": _PROGRAM + """
        SELECT CAST(k AS VARCHAR) AS program_id, array_to_string((CASE WHEN bad THEN ['constraint_triggered'] ELSE [] END) || (CASE WHEN change = 0 THEN ['permission_used'] ELSE [] END) || (CASE WHEN k % 4 < 2 THEN ['permission_used'] ELSE [] END) || (CASE WHEN change = 0 THEN ['erasure_rule_used'] ELSE [] END) || (CASE WHEN allowed THEN ['erasure_rule_used'] ELSE [] END)
               || (CASE WHEN kind = 1 THEN ['commit_used'] ELSE [] END) || (CASE kind WHEN 0 THEN ['predicate_evaluated'] WHEN 1 THEN ['predicate_evaluated', 'predicate_evaluated'] ELSE CASE WHEN NOT allowed THEN ['predicate_evaluated'] ELSE ['predicate_evaluated', 'predicate_evaluated'] END END)
               || (CASE WHEN change < 3 THEN ['scope_change_used'] ELSE [] END) || (CASE WHEN unaccounted THEN ['unaccounted_boundary_change'] ELSE [] END), ',') AS types FROM v""",
    "predicate_texts": _PROGRAM + """
        , p AS (SELECT 'displaced_total debt gt 5.0 risk' AS predicate, bad AS result FROM v WHERE kind = 0 UNION ALL SELECT 'has_commit n', true FROM v WHERE kind = 1 UNION ALL SELECT 'commit_cmp n gte 4.0 items', n >= 4 FROM v WHERE kind = 1
                UNION ALL SELECT 'erase_allowed d', allowed FROM v WHERE kind = 2 UNION ALL SELECT 'has_commit x', false FROM v WHERE kind = 2 AND allowed)
        SELECT predicate, result, count(*) AS n FROM p GROUP BY ALL""",
    "witness_explain": _PROGRAM + """
        SELECT 'permission_used' AS type, CAST(9 AS INT) AS line, count(*) AS n FROM v WHERE k % 4 < 2 HAVING count(*) > 0 UNION ALL SELECT 'erasure_rule_used', 8, count(*) FROM v WHERE allowed HAVING count(*) > 0""",
    "program_problems": """
        SELECT problem, count(*) AS n FROM (SELECT ['multiple scope declarations', 'duplicate difference: a', 'allowed without a rule: z', 'constraint without condition: c', 'undeclared lens: l', '3:1: no statement begins with nonsense', 'rule without a unit: d'][c_custkey % 7 + 1] AS problem FROM customer) GROUP BY 1""",
    "lens_chain": """
        WITH a AS (SELECT n_nationkey AS k, 'h' || n_nationkey AS h0, CASE WHEN n_nationkey % 2 = 0 THEN 'narrow' ELSE 'widen' END AS kind FROM nation),
        b AS (SELECT *, sha256('{"from_lens_hash":"' || h0 || '","kind":"widen","payload_ref":"p1"}') AS h1 FROM a), c AS (SELECT *, sha256('{"from_lens_hash":"' || CASE WHEN k % 5 = 4 THEN h0 ELSE h1 END || '","kind":"' || kind || '","payload_ref":"p2"}') AS h2 FROM b)
        SELECT CAST(k AS VARCHAR) AS program_id, CASE WHEN k % 3 = 2 THEN 'inadmissible' ELSE 'admissible' END AS verdict, 'derived:' || h2[1:12] || '@0' AS lens_id, h2 AS lens_hash FROM c""",
    "observed_commits": "SELECT coalesce(source, 'none') AS program_id, CASE WHEN sum(len(regexp_extract_all(text, '\\bthe\\b'))) > 100 THEN 'inadmissible' ELSE 'admissible' END AS verdict FROM documents GROUP BY 1",
    "unit_algebra": """
        WITH r AS (SELECT CAST(l_quantity AS BIGINT) AS a, l_linenumber AS b, l_linenumber % 2 = 0 AS ka, l_linenumber % 3 = 0 AS kb FROM lineitem),
        o AS (SELECT 'add' AS op, CASE WHEN ka AND kb THEN 'kg' END AS unit, CASE WHEN ka <> kb THEN 'unit' END AS error, CASE WHEN ka = kb THEN a + b END AS num FROM r
              UNION ALL SELECT 'multiply', CASE WHEN ka <> kb THEN 'kg' END, CASE WHEN ka AND kb THEN 'unit' END, CASE WHEN NOT (ka AND kb) THEN a * b END FROM r
              UNION ALL SELECT 'divide', CASE WHEN ka AND NOT kb THEN 'kg' END, CASE WHEN kb THEN 'unit' END, CASE WHEN NOT kb THEN a // gcd(a, b) END FROM r)
        SELECT op, unit, error, count(*) AS n, CAST(sum(num) AS BIGINT) AS nums FROM o GROUP BY ALL""",
    "calc_plan": """SELECT '((q * 1.5) > convert(3 g to kg))' AS described, 'q' AS inputs, sha256('{"expr":{"cmp":"gt","left":{"left":{"name":"q","op":"input_ref"},"op":"multiply","right":{"op":"literal","value":"1.5"}},"op":"compare","right":{"op":"convert_unit","to":"kg","value":{"op":"literal","unit":"g","value":3}}},"inputs":["q"]}') AS plan_hash""",
    "calc_execute": """
        SELECT r_regionkey AS id, CAST(unnest(range(5)) AS INT) AS step, unnest(['input_ref', 'literal', 'multiply', 'literal', 'add']) AS op, unnest([CAST(r_regionkey AS VARCHAR), '3', CAST(r_regionkey * 3 AS VARCHAR), '1/2', (r_regionkey * 6 + 1) || '/2']) AS value FROM region""",
    "asset_targets": f"SELECT p_partkey, p_size % 5 NOT IN (1, 2, 3) AS asset FROM part",
    "asset_links": """
        WITH l AS (SELECT p_partkey, 'v' || (p_partkey % 3) || '/img' || p_size || '.png' AS f, p_partkey % 2 = 0 AS whole FROM part), f AS (SELECT DISTINCT 'v' || (p_partkey % 3) || '/img' || p_size || '.png' AS f FROM part WHERE p_size % 4 <> 0)
        SELECT p_partkey, f.f AS file, CASE WHEN f.f IS NULL THEN 'missing' WHEN whole THEN 'exact_path' ELSE 'prefix_join' END AS file_kind FROM l LEFT JOIN f USING (f)""",
    "heading_missing": "SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0 AND (p_partkey % 3 = 2 OR p_size % 3 = 0)",
    "heading_forms": """
        WITH l AS (SELECT conv_id, turn, turn % 8 AS n, regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z .]', '', 'g') AS t FROM conversations), x AS (SELECT *, '  ' || repeat('#', n::INT) || ' ' || t || '  ##' AS line FROM l)
        SELECT conv_id, turn, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS normal, CASE WHEN n BETWEEN 1 AND 6 THEN CAST(n AS INT) END AS level, trim(regexp_replace(trim(regexp_replace(line, '^\\s*#+', '')), '#+$', '')) AS title FROM x""",
    "term_occurrences": "SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z ]', ' ', 'g'), ' '), lambda w: w = 'the')) AS BIGINT) AS n FROM documents",
    "unresolved_link_ids": f"""
        WITH l AS (SELECT p_partkey AS k, 'd/' || p_partkey AS f, p_name AS t, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS a, CASE WHEN p_partkey % 3 = 0 THEN 'é' END AS h, p_size AS line FROM part)
        SELECT k AS p_partkey, {C.sha256(C.mapping({"tag": C.text("'unresolved_link_v1'"), "from": C.text("f"), "target": C.text("t"), "alias": C.text("a"), "heading": C.text("h"), "embed": "CASE WHEN k % 5 = 0 THEN 'f5' ELSE 'f4' END", "line": C.integer("line")}))} AS unresolved_id FROM l""",
    "link_edge_ids": f"""
        WITH l AS (SELECT p_partkey AS k, 'd/' || p_partkey AS f, p_name AS t, p_brand AS a, p_size AS line, 'to' || p_size AS z FROM part)
        SELECT k AS p_partkey, 'doc' AS what, {C.sha256(C.mapping(_EDGE | {"tag": C.text("'link_v1'"), "to": C.text("z")}))} AS edge_id FROM l UNION ALL SELECT k, 'file', {C.sha256(C.mapping(_EDGE | {"tag": C.text("'file_link_v1'"), "to_file_path": C.text("z")}))} FROM l""",
    "facet_edge_ids": f"SELECT 'd/' || doc_id AS path, coalesce(source, '') AS facet, sha256(coalesce(source, '')) AS facet_id, {C.sha256(C.mapping({'tag': C.text(chr(39) + 'has_facet_v1' + chr(39)), 'doc_path': C.text(chr(39) + 'd/' + chr(39) + ' || doc_id'), 'facet': C.text('coalesce(source, ' + chr(39) * 2 + ')')}))} AS edge_id FROM documents",
    "observed_spans": """
        WITH t AS (SELECT printf('d%08d', doc_id) AS path, lower(regexp_replace(text, '[^\\x09\\x0A\\x20-\\x7E]', '~', 'g')) AS t FROM documents),
        l AS (SELECT path, i AS line, l[i] AS s FROM (SELECT path, string_split(t, chr(10)) AS l, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM t)),
        p AS (SELECT path, line, s, unnest(range(1, length(s) + 1)) AS col FROM l),
        h AS (SELECT 'aa' AS diff, path, line, col FROM p WHERE s[col:col + 1] = 'aa' UNION ALL SELECT 'the', path, line, col FROM p WHERE s[col:col + 2] = 'the' AND NOT regexp_matches(coalesce(s[col - 1:col - 1], ''), '[a-z0-9_]') AND NOT regexp_matches(s[col + 3:col + 3], '[a-z0-9_]'))
        SELECT diff, count(*) AS value, 'count' AS unit, min(path) AS first_path, CAST(arg_min(line, (path, line, col)) AS INT) AS first_line, CAST(arg_min(col, (path, line, col)) AS INT) AS first_col FROM h GROUP BY diff UNION ALL SELECT 'none', 0, 'count', NULL, NULL, NULL""",
    "file_formats": f"SELECT p_partkey, {_sql_pick(('md', 'rs', 'py', 'txt', 'ipynb', 'json', 'x'), 'p_partkey')} AS format, CASE p_partkey % 7 WHEN 0 THEN 'markdown' WHEN 1 THEN 'rust' WHEN 2 THEN 'python' WHEN 3 THEN 'text' WHEN 4 THEN 'python' END AS language FROM part",
    "chunk_rust_items": """
        WITH p AS (SELECT 'f' || p_partkey || '.rs' AS path, 'use a;' || chr(10) || chr(10) AS a, 'fn f' || p_partkey || '() {' || chr(10) || '    if x { fn inner() {} }' || chr(10) || '}' || chr(10) AS b, 'pub struct é' || p_partkey || ';' || chr(10) AS c FROM part)
        SELECT path, 'rust_item' AS kind, '' AS headings, CAST(unnest([1, 3, 6]) AS INT) AS start_line, CAST(unnest([2, 5, 6]) AS INT) AS end_line, CAST(unnest([0, 8, 8 + strlen(b)]) AS BIGINT) AS start_byte, CAST(unnest([8, 8 + strlen(b), 8 + strlen(b) + strlen(c)]) AS BIGINT) AS end_byte, sha256(unnest([a, b, c])) AS sha256 FROM p""",
    "chunk_python_blocks": """
        WITH p AS (SELECT 'f' || p_partkey || '.py' AS path, 'import a' || chr(10) || chr(10) AS a, 'def f' || p_partkey || '():' || chr(10) || '    def inner(): pass' || chr(10) || chr(10) AS b, 'class C' || p_partkey || ':' || chr(10) || '    x = 1' || chr(10) AS c FROM part)
        SELECT path, 'python_block' AS kind, '' AS headings, CAST(unnest([1, 3, 6]) AS INT) AS start_line, CAST(unnest([2, 5, 7]) AS INT) AS end_line, CAST(unnest([0, 10, 10 + strlen(b)]) AS BIGINT) AS start_byte, CAST(unnest([10, 10 + strlen(b), 10 + strlen(b) + strlen(c)]) AS BIGINT) AS end_byte, sha256(unnest([a, b, c])) AS sha256 FROM p""",
    "chunk_notebooks": """
        WITH n AS (SELECT count(*) FILTER (p_partkey % 10 <> 9) AS good, count(*) FILTER (p_partkey % 10 = 9) AS broken FROM part)
        SELECT 'ipynb_markdown_cell' AS kind, good AS n, CAST(2 AS INT) AS last FROM n UNION ALL SELECT 'python_fallback_window', good, 2 FROM n UNION ALL SELECT 'fallback_window', broken, 1 FROM n WHERE broken > 0""",
    "chunk_text_files": """
        WITH t AS (SELECT doc_id, replace(coalesce(text, ''), '.' || chr(10), '.' || chr(10) || chr(10)) AS t FROM documents), l AS (SELECT doc_id, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS a FROM t),
        r AS (SELECT doc_id, i, a[i] AS line, NOT regexp_matches(a[i], '\\S') AS blank FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
        g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp, sum(strlen(line)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM r),
        p AS (SELECT doc_id, grp, max(i) AS last, max(upto) AS bytes, sum(length(line)) AS chars, string_agg(line, '' ORDER BY i) AS body FROM g WHERE NOT blank GROUP BY ALL),
        s AS (SELECT *, CASE WHEN chars <= 2400 THEN 1 ELSE CAST(ceil((chars - 2400) / 2240.0) AS INT) + 1 END AS n, chars > 2400 AND body LIKE '%' || chr(10) AS over FROM p)
        SELECT doc_id || '.txt' AS path, CAST(sum(n) AS BIGINT) AS chunks, CAST(max(last + over::INT) AS INT) AS last_line, CAST(max(bytes) AS BIGINT) AS last_byte FROM s GROUP BY doc_id""",
    "normative_lines": "SELECT p_partkey AS path, CAST(unnest([0, 1]) AS INT) AS place, unnest(['It MUST hold ' || p_partkey, 'never ' || p_partkey]) AS line FROM part",
    "summary_lines": "SELECT p_partkey AS path, CASE WHEN p_partkey % 5 <> 0 THEN 'first ' || p_partkey || ' second' END AS summary FROM part",
    "section_bodies": "SELECT p_partkey AS path, CASE WHEN p_partkey % 4 <> 0 THEN 'keep ' || p_partkey || chr(10) || '### sub' || chr(10) || 'this' END AS section FROM part",
    "demoted_headings": "SELECT p_partkey AS path, repeat('#', least(6, p_partkey % 6 + 3)::INT) || ' T' || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || 'x' AS text FROM part",
    "concept_book": """
        WITH r AS (SELECT r_regionkey AS k, r_name AS n, lag(r_name) OVER (ORDER BY r_regionkey) AS b FROM region), l AS (SELECT k, unnest(range(5)) AS i, unnest(['# ' || n, '', '## In', 'see [before](#' || lower(replace(coalesce(b, n), ' ', '-')) || ') and none', '']) AS line FROM r WHERE k < 3)
        SELECT CAST(row_number() OVER (ORDER BY k, i) - 1 AS INT) AS place, line FROM l""",
    "spine_view": _SPINES + "SELECT concept, spine, tier, confidence, '- **' || concept || '**: ' || spine || ' (' || tier || ', ' || confidence || ', ' || total || ')' AS line FROM b",
    "doc_stats_full": """
        WITH d AS (SELECT p_partkey AS k FROM part), l AS (SELECT p_size AS f, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 40 END AS t, p_partkey % 2 = 0 AS h, p_partkey % 5 = 0 AS file FROM part), r AS (SELECT l.*, d.k AS hit FROM l LEFT JOIN d ON d.k = t),
        o AS (SELECT f, count(hit) AS out_links, count(*) - count(hit) AS missing_out, count(*) FILTER (hit IS NOT NULL AND h AND hit % 4 <> 0) AS heads, count(*) FILTER (file) AS files FROM r GROUP BY f), i AS (SELECT hit, count(*) AS n FROM r WHERE hit IS NOT NULL GROUP BY hit)
        SELECT 'n' || k || '.md' AS path, coalesce(out_links, 0) AS out_links, coalesce(missing_out, 0) AS missing_out, CAST(0 AS BIGINT) AS ambiguous_out, coalesce(n, 0) AS in_links, coalesce(heads, 0) AS heading_missing_out, coalesce(files, 0) AS file_links FROM d LEFT JOIN o ON f = k LEFT JOIN i ON hit = k""",
    "rerank_missing_vectors": f"""
        WITH h AS (SELECT label, min(vec_id) AS id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label),
        s AS (SELECT h.id, printf('d%08d', vec_id) AS candidate, CASE WHEN vec_id % 3 = 0 THEN 0.0 ELSE {_COSINE.format("embedding", "q")} END AS s FROM embeddings e JOIN h ON h.label = e.label)
        SELECT id, candidate, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY id ORDER BY s DESC, candidate) AS INT) AS place FROM s QUALIFY place <= 3""",
}
