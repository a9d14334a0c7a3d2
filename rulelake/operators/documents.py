"""Documents: chunks and their digests, links and their resolution, mentions, spines, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

WINDOW_LINES, OVERLAP_LINES = 120, 24
WINDOW_CHARS, OVERLAP_CHARS = 2400, 160


def _window_starts(size: Column, window: int, overlap: int) -> Column:
    """0-based starts of windows over ``size`` items; the first window that reaches the end is the last."""
    step = max(1, window - overlap)
    last = F.greatest(F.lit(0), F.ceil((size - window) / step)).cast("int")
    return F.when(size > 0, F.sequence(F.lit(0), last * step, F.lit(step))).otherwise(F.array().cast("array<int>"))


def line_windows(docs: DataFrame, id_col: str, text: Column, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES) -> DataFrame:
    """(id, start_line, end_line, chunk) windows of lines that overlap; blank windows are left out."""
    rows = docs.select(F.col(id_col), T.lines_with_ends(F.coalesce(text, F.lit(""))).alias("rows"))
    rows = rows.select(id_col, "rows", F.explode(_window_starts(F.size("rows"), window, overlap)).alias("start"))
    chunks = rows.select(id_col, (F.col("start") + 1).alias("start_line"), F.least(F.col("start") + window, F.size("rows")).alias("end_line"), F.array_join(F.slice("rows", F.col("start") + 1, F.lit(window)), "").alias("chunk"))
    return chunks.where(F.col("chunk").rlike(r"\S"))


def char_windows(docs: DataFrame, id_col: str, text: Column, window: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, start_char, chunk) windows of characters; a text that fits is one window."""
    rows = docs.select(F.col(id_col), F.coalesce(text, F.lit("")).alias("t"))
    rows = rows.select(id_col, "t", F.explode(_window_starts(F.length("t"), window, overlap)).alias("start_char"))
    return rows.select(id_col, "start_char", F.substring(F.col("t"), F.col("start_char") + 1, F.lit(window)).alias("chunk"))


def paragraphs(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, start_line, end_line, chunk) runs of lines between blank lines, within the row by a fold over its lines."""
    rows = docs.select(F.col(id_col), T.lines_with_ends(F.coalesce(text, F.lit(""))).alias("rows"))
    edges = F.filter(F.transform("rows", lambda r, k: F.when(r.rlike(r"\S"), 0).otherwise(k + 1)), lambda k: k > 0)
    rows = rows.withColumn("cuts", F.when(F.size("rows") > 0, F.concat(F.array(F.lit(0)), edges, F.array(F.size("rows") + 1))).otherwise(F.array().cast("array<int>")))
    # neighbours are zipped, as a column that a lambda refers to is made anew for every element
    spans = F.arrays_zip(F.slice("cuts", 1, F.greatest(F.size("cuts") - 1, F.lit(0))).alias("a"), F.slice("cuts", 2, F.size("cuts")).alias("b"))
    rows = rows.select(id_col, "rows", F.explode(spans).alias("s"))
    rows = rows.select(id_col, "rows", F.struct((F.col("s.a") + 1).alias("a"), (F.col("s.b") - 1).alias("b")).alias("s")).where("s.a <= s.b")
    return rows.select(id_col, F.col("s.a").alias("start_line"), F.col("s.b").alias("end_line"), F.array_join(F.slice("rows", F.col("s.a"), F.col("s.b") - F.col("s.a") + 1), "").alias("chunk"))


def heading_sections(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, start_line, end_line, heading_path, chunk) sections that start at headings, each with the path of open headings.

    The stack of headings is a fold over the row's lines: a heading closes those of its level and below.
    """
    rows = docs.select(F.col(id_col), T.lines_with_ends(F.coalesce(text, F.lit(""))).alias("rows")).where(F.size("rows") > 0)
    numbered = F.transform("rows", lambda r, k: F.struct((k + 1).alias("line"), r.alias("r")))
    signed = F.filter(numbered, lambda m: F.startswith(F.ltrim(m["r"]), F.lit("#")))  # few lines are, and only those are looked into
    marks = F.transform(signed, lambda m: F.struct(m["line"].alias("line"), T.heading_level(F.regexp_replace(m["r"], r"[\r\n]+\z", "")).alias("level"), T.heading_title(F.regexp_replace(m["r"], r"[\r\n]+\z", "")).alias("title")))
    rows = rows.withColumn("heads", F.filter(marks, lambda m: m["level"].isNotNull()))
    heads = F.col("heads")
    empty = F.array().cast("array<struct<level:int,title:string>>")
    start = F.struct(empty.alias("stack"), F.array(F.struct(F.lit(1).alias("line"), F.array().cast("array<string>").alias("path"))).alias("sections"))

    def step(acc, m):
        stack = F.concat(F.filter(acc["stack"], lambda h: h["level"] < m["level"]), F.array(F.struct(m["level"].alias("level"), m["title"].alias("title"))))
        return F.struct(stack.alias("stack"), F.concat(acc["sections"], F.array(F.struct(m["line"].alias("line"), F.transform(stack, lambda h: h["title"]).alias("path")))).alias("sections"))

    sections = F.aggregate(heads, start, step, lambda acc: acc["sections"])
    rows = rows.withColumn("sections", sections)
    following = F.concat(F.slice(F.col("sections.line"), 2, F.size("sections")), F.array(F.size("rows") + 1))
    ends = F.arrays_zip(F.col("sections.line").alias("a"), following.alias("next"), F.col("sections.path").alias("path"))
    out = rows.select(id_col, "rows", F.explode(ends).alias("s"))
    out = out.select(id_col, "rows", F.struct("s.a", (F.col("s.next") - 1).alias("b"), "s.path").alias("s")).where("s.a <= s.b")
    out = out.select(id_col, F.col("s.a").alias("start_line"), F.col("s.b").alias("end_line"), F.col("s.path").alias("heading_path"), F.array_join(F.slice("rows", F.col("s.a"), F.col("s.b") - F.col("s.a") + 1), "").alias("chunk"))
    return out.where(F.col("chunk").rlike(r"\S"))


def chunk_digests(chunks: DataFrame, text_col: str = "chunk") -> DataFrame:
    """The chunks with digests of the text, of its words, and of its tokens, and its size."""
    text = F.col(text_col)
    return chunks.withColumns({
        "chunk_sha256": F.sha2(text, 256),
        "normalized_text_sha256": F.sha2(T.collapse_space(text), 256),
        "token_sha256": F.sha2(F.array_join(T.simple_tokens(text), "\n"), 256),
        "byte_len": F.octet_length(text).cast("long"),
        "line_count": F.size(T.lines(text)).cast("long"),
    })


def duplicate_groups(rows: DataFrame, digest: str, id_col: str) -> DataFrame:
    """Digests that several rows share: (digest, members, first_id)."""
    return rows.groupBy(digest).agg(F.count(F.lit(1)).alias("members"), F.min(id_col).alias("first_id")).where("members > 1")


def wiki_links(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, line, target, heading, alias, embed) of ``[[target#heading|alias]]`` links, with ``!`` before embeds."""
    rows = docs.select(F.col(id_col), F.posexplode(T.lines(F.coalesce(text, F.lit("")))).alias("k", "row"))
    found = rows.select(id_col, (F.col("k") + 1).alias("line"), F.explode(F.regexp_extract_all("row", F.lit(r"(!?\[\[(?:(?!\]\]).)*\]\])"), F.lit(1))).alias("raw"))
    inner = F.trim(F.regexp_extract("raw", r"^!?\[\[(.*)\]\]$", 1))
    left = F.trim(F.regexp_extract(inner, r"^([^|]*)", 1))
    blank = lambda c: F.when(c != "", c)
    out = found.select(id_col, "line", "raw", F.trim(F.regexp_extract(left, r"^([^#]*)", 1)).alias("target"), blank(F.trim(F.regexp_extract(left, r"^[^#]*#(.*)$", 1))).alias("heading"), blank(F.trim(F.regexp_extract(inner, r"^[^|]*\|(.*)$", 1))).alias("alias"), F.startswith("raw", F.lit("!")).alias("embed"))
    return out.where("target != ''")


def html_links(pages: DataFrame, id_col: str, html: Column) -> DataFrame:
    """(id, position, target) of the href attributes of a page."""
    hrefs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1))
    return pages.select(F.col(id_col), F.posexplode(hrefs).alias("position", "target"))


def title_index(docs: DataFrame, path_col: str, title_col: str, fold_case: bool) -> DataFrame:
    """(key, candidates, first) by title or lower-case title: how many documents have it, and the first of them in order."""
    key = F.lower(F.col(title_col)) if fold_case else F.col(title_col)
    rows = docs.select(key.alias("key"), F.col(path_col).alias("path")).where("key != ''").distinct()
    return rows.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("candidates"), F.min("path").alias("first"))


def resolve_links(links: DataFrame, docs: DataFrame, target_col: str = "target", path_col: str = "path", title_col: str = "title") -> DataFrame:
    """Links with resolved path, kind and number of candidates: by path, by path with ``.md``, by title, by lower-case
    title. Several candidates are ambiguous and end the search, as does a target with a slash that is no path.

    Titles come with a count and one path, never with all their documents; those of ambiguous links are
    ``choose_ambiguous``'s. ``stem`` and ``folded`` say by which title a link was found.
    """
    paths = docs.select(F.col(path_col).alias("hit")).distinct()
    rows = links.withColumn("norm", T.normalize_target(F.col(target_col)))
    rows = rows.withColumn("with_md", F.when(F.endswith(F.lower("norm"), F.lit(".md")), F.col("norm")).otherwise(F.concat("norm", F.lit(".md"))))
    rows = rows.withColumn("stem", F.when(~F.contains("norm", F.lit("/")) & (F.col("norm") != ""), F.regexp_replace("norm", r"(\.md)*(\.MD)*$", "")))
    side = lambda fold, n: title_index(docs, path_col, title_col, fold).select(*[F.col(c).alias(f"{c}{n}") for c in ("key", "candidates", "first")])
    rows = rows.join(paths.withColumnRenamed("hit", "hit1"), F.col("norm") == F.col("hit1"), "left")
    rows = rows.join(paths.withColumnRenamed("hit", "hit2"), F.col("with_md") == F.col("hit2"), "left")
    rows = rows.join(side(False, 1), F.col("stem") == F.col("key1"), "left").join(side(True, 2), F.lower("stem") == F.col("key2"), "left")
    count, first = F.coalesce("candidates1", "candidates2"), F.when(F.col("key1").isNotNull(), F.col("first1")).otherwise(F.col("first2"))
    path = F.coalesce("hit1", "hit2")
    kind = (
        F.when(F.col("norm") == "", "missing").when(path.isNotNull(), "exact_path").when(count > 1, "ambiguous")
        .when(F.col("key1").isNotNull(), "exact_title").when(F.col("key2").isNotNull(), "casefold_title").otherwise("missing")
    )
    resolved = F.when(F.col("norm") == "", None).when(path.isNotNull(), path).when(count == 1, first)
    candidates = F.when((F.col("norm") == "") | (path.isNull() & count.isNull()), F.lit(0)).when(path.isNotNull(), F.lit(1)).otherwise(count)
    out = rows.withColumn("kind", kind).withColumn("resolved", resolved).withColumn("candidates", candidates).withColumn("folded", F.col("key1").isNull())
    return out.drop("norm", "with_md", "hit1", "hit2", "key1", "key2", "candidates1", "candidates2", "first1", "first2")


NEIGHBOURHOODS = ("/concepts/", "/meta/", "/papers/", "/diagnostics/")


def longest_prefix(path: Column, prefixes: list[str]) -> Column:
    """The longest of a short list of prefixes that a path starts with, or the empty one."""
    fits = [F.when(F.startswith(path, F.lit(p)), F.lit(p)) for p in sorted(prefixes, key=lambda p: (-len(p), p)) if p]
    return F.coalesce(*fits, F.lit(""))


def choose_ambiguous(links: DataFrame, docs: DataFrame, prefixes: list[str], from_col: str = "from_path", path_col: str = "path", title_col: str = "title") -> DataFrame:
    """The ambiguous ones of resolved links with the best of their candidates: of the same root, then of the same
    neighbourhood, then the first in order; without a root none.

    What decides is the title, the root and the neighbourhood of a link, and each such triple meets the title's documents
    once; those are aggregated with map-side combining, so that a title of very many documents is never gathered.
    """
    near = F.lit(None).cast("string")
    for place in reversed(NEIGHBOURHOODS):
        near = F.when(F.contains(F.col(from_col), F.lit(place)), F.lit(place)).otherwise(near)
    rows = links.where("kind = 'ambiguous'").withColumn("key", F.when(F.col("folded"), F.lower("stem")).otherwise(F.col("stem")))
    rows = rows.withColumn("root", longest_prefix(F.col(from_col), prefixes)).withColumn("near", near)
    asked = rows.select("key", "folded", "root", "near").distinct()
    titles = lambda fold: docs.select((F.lower(F.col(title_col)) if fold else F.col(title_col)).alias("key"), F.lit(fold).alias("folded"), F.col(path_col).alias("candidate"))
    met = asked.where("root != ''").join(titles(False).unionByName(titles(True)).distinct(), ["key", "folded"])
    same, close = F.startswith("candidate", F.col("root")), F.coalesce(F.contains("candidate", F.col("near")), F.lit(False))
    pick = lambda when: F.min(F.when(when, F.col("candidate")))
    under = [F.count_if(F.startswith("candidate", F.lit(p))).alias(f"p{k}") for k, p in enumerate(prefixes)]
    best = met.groupBy("key", "folded", "root", "near").agg(F.count(F.lit(1)).alias("n"), pick(same).alias("s"), pick(same & close).alias("sc"), F.min("candidate").alias("a"), pick(close).alias("ac"), *under)
    shared = F.lit(False)
    for k in range(len(prefixes)):
        shared = shared | (F.col(f"p{k}") == F.col("n"))
    best = best.select(*[F.col(c).alias(f"b_{c}") for c in ("key", "folded", "root", "near")], F.when(F.col("s").isNotNull(), F.coalesce("sc", "s")).when(shared, F.coalesce("ac", "a")).alias("chosen"))
    on = (F.col("key") == F.col("b_key")) & (F.col("folded") == F.col("b_folded")) & (F.col("root") == F.col("b_root")) & F.col("near").eqNullSafe(F.col("b_near"))
    return rows.join(best, on, "left").select(*links.columns, "chosen")


def link_stats(resolved: DataFrame, docs: DataFrame, from_col: str, path_col: str, headings: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Per document: outgoing links by outcome, and incoming ones; with (path, heading) rows also links whose heading is
    missing, with asset links (from_col, file_kind) also links to files."""
    out = resolved.groupBy(F.col(from_col).alias(path_col)).agg(
        F.count_if(F.col("resolved").isNotNull()).alias("out_links"), F.count_if(F.col("kind") == "missing").alias("missing_out"), F.count_if(F.col("kind") == "ambiguous").alias("ambiguous_out")
    )
    into = resolved.where("resolved is not null").groupBy(F.col("resolved").alias(path_col)).agg(F.count(F.lit(1)).alias("in_links"))
    names, joined = ["out_links", "missing_out", "ambiguous_out", "in_links"], docs.select(path_col).join(out, path_col, "left").join(into, path_col, "left")
    for name, rows in (("heading_missing_out", headings), ("file_links", files)):
        if rows is not None:
            mine = resolve_headings(resolved, rows) if name == "heading_missing_out" else rows.where("file_kind != 'missing'")
            joined = joined.join(mine.groupBy(F.col(from_col).alias(path_col)).agg(F.count(F.lit(1)).alias(name)), path_col, "left")
            names.append(name)
    return joined.select(path_col, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def resolve_headings(links: DataFrame, headings: DataFrame) -> DataFrame:
    """Resolved links whose heading none of the document's (path, heading) rows has, as written or as an anchor."""
    index = headings.select("path", T.normalize_heading(F.col("heading")).alias("mark")).union(headings.select("path", T.heading_slug(F.col("heading")))).distinct()
    index = index.select(F.col("path").alias("resolved"), "mark")
    wanted = links.where("resolved is not null and heading is not null")
    by_name = wanted.withColumn("mark", T.normalize_heading(F.col("heading"))).join(index, ["resolved", "mark"], "left_anti").drop("mark")
    return by_name.withColumn("mark", T.heading_slug(F.col("heading"))).join(index, ["resolved", "mark"], "left_anti").drop("mark")


def resolve_assets(links: DataFrame, files: DataFrame, prefixes: list[str], from_col: str = "from_path", target_col: str = "target") -> DataFrame:
    """Links with file and kind: the target as a path, else under the root of the linking document."""
    index = files.select("path").distinct()
    rows = links.withColumn("norm", T.normalize_target(F.col(target_col))).withColumn("root", longest_prefix(F.col(from_col), prefixes))
    rows = rows.withColumn("under", F.when(~F.startswith("norm", F.col("root")), F.concat("root", "norm")))
    rows = rows.join(index.withColumnRenamed("path", "f1"), F.col("norm") == F.col("f1"), "left").join(index.withColumnRenamed("path", "f2"), F.col("under") == F.col("f2"), "left")
    kind = F.when(F.col("f1").isNotNull(), "exact_path").when(F.col("f2").isNotNull(), "prefix_join").otherwise("missing")
    return rows.withColumn("file", F.coalesce("f1", "f2")).withColumn("file_kind", kind).drop("norm", "root", "under", "f1", "f2")


def documents_to_resolve(changed_keys: DataFrame, cached_links: DataFrame) -> DataFrame:
    """Documents whose cached link keys (path, key) meet the changed (key) rows."""
    return cached_links.join(changed_keys.distinct(), "key", "left_semi").select("path").distinct()


def incremental_update(current: DataFrame, cached: DataFrame, cached_links: DataFrame, key: Column) -> DataFrame:
    """(path) of documents whose links must be resolved again: those with a cached link (path, key) to the key of a file that
    was added, changed or removed."""
    moved = classify_files(current, cached).where("change != 'unchanged'").select(key.alias("key"))
    return documents_to_resolve(moved, cached_links)


def classify_files(current: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, change) of (path, size, mtime) rows: added, changed, unchanged or removed."""
    joined = current.alias("n").join(cached.alias("o"), "path", "full_outer")
    change = F.when(F.col("o.size").isNull(), "added").when(F.col("n.size").isNull(), "removed").when((F.col("n.size") == F.col("o.size")) & (F.col("n.mtime") == F.col("o.mtime")), "unchanged").otherwise("changed")
    return joined.select("path", change.alias("change"))


#: Lists of so many terms at most are broadcast; beyond it the join decides by itself.
BROADCAST_TERMS = 500_000


def term_mentions(docs: DataFrame, id_col: str, text: Column, terms: DataFrame, longest: int) -> DataFrame:
    """(id, target, term, mentions) of single- and multi-word (target, term) rows in mention text.

    Words are kept only where a term begins with them, with the words that follow them; runs are then joined with the
    terms by value, so no document meets every term. Up to BROADCAST_TERMS terms, which are counted first, the texts'
    words are not shuffled. Occurrences of a term do not overlap in practice, as a term that repeats itself within its own
    length is not a name.
    """
    known = terms.select("target", "term").distinct()
    sizes = known.select("term", F.size(F.split("term", " ")).alias("size"), F.element_at(F.split("term", " "), 1).alias("first"))
    few = known.count() <= BROADCAST_TERMS
    hint = F.broadcast if few else (lambda df: df)
    words = docs.select(F.col(id_col), F.split(T.mention_text(F.coalesce(text, F.lit(""))), " ").alias("w"))
    follow = [F.slice("w", n, F.size("w")).alias(f"w{n}") for n in range(2, longest + 1)]
    zipped = F.arrays_zip(F.col("w").alias("w1"), *follow) if longest > 1 else F.transform("w", lambda x: F.struct(x.alias("w1")))
    at = words.select(F.col(id_col), F.explode(zipped).alias("z"))  # neighbours beyond the end are null
    starts = at.where(F.col("z.w1").isNotNull()).join(hint(sizes.groupBy(F.col("first").alias("word")).agg(F.sort_array(F.collect_set("size")).alias("sizes"))), F.col("z.w1") == F.col("word"))
    run = F.lit(None).cast("string")
    for n in range(1, longest + 1):
        whole = F.concat_ws(" ", *[F.col(f"z.w{k}") for k in range(1, n + 1)])
        run = F.when((F.col("size") == n) & F.col(f"z.w{n}").isNotNull(), whole).otherwise(run)
    runs = starts.select(F.col(id_col), "z", F.explode("sizes").alias("size")).select(F.col(id_col), run.alias("term"))
    counted = runs.where("term is not null").groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("mentions"))
    hits = counted.join(hint(known), "term")
    return hits.select(id_col, "target", "term", "mentions")


def mention_totals(mentions: DataFrame, id_col: str) -> DataFrame:
    """(id, target, total, via): all mentions of a target, and its most used term (the first in order of equals)."""
    best = F.min_by("term", F.struct(-F.col("mentions"), F.col("term")))
    return mentions.groupBy(id_col, "target").agg(F.sum("mentions").alias("total"), best.alias("via"))


def top_mentions(totals: DataFrame, id_col: str, n: int) -> DataFrame:
    order = W.partitionBy(id_col).orderBy(F.desc("total"), "target")
    return totals.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def name_collisions(names: DataFrame, name_col: str) -> DataFrame:
    return names.groupBy(F.lower(F.trim(F.col(name_col))).alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def spine_counts(references: DataFrame) -> DataFrame:
    """(concept, spine, kind) references, counted with a column per kind."""
    return references.groupBy("concept", "spine").pivot("kind", ["structural", "textual"]).count().na.fill(0, ["structural", "textual"])


def primary_spine(counts: DataFrame) -> DataFrame:
    """Each concept's spine of most references (the first in order of equals), and how clear the lead is."""
    total = counts.withColumn("total", F.col("structural") + F.col("textual"))
    order = W.partitionBy("concept").orderBy(F.desc("total"), "spine")
    ranked = total.withColumn("k", F.row_number().over(order)).withColumn("next", F.lead("total").over(order)).where("k = 1")
    lead = F.col("total") - F.coalesce("next", F.lit(0))
    return ranked.select("concept", "spine", "total", F.when(lead == 0, "tied").when(F.col("total") >= 2 * F.coalesce("next", F.lit(0)), "high").otherwise("medium").alias("confidence"))


def spine_index(counts: DataFrame) -> DataFrame:
    """Concepts with their primary spine, the tier of what ties them to it (structural, textual or mixed), how clear its lead
    is, and a line of an index of markdown."""
    best = primary_spine(counts).join(counts, ["concept", "spine"])
    tier = F.when(F.col("structural") == 0, "textual").when(F.col("textual") == 0, "structural").otherwise("mixed")
    line = F.concat(F.lit("- **"), "concept", F.lit("**: "), "spine", F.lit(" ("), tier, F.lit(", "), "confidence", F.lit(", "), F.col("total").cast("string"), F.lit(")"))
    return best.select("concept", "spine", tier.alias("tier"), "confidence", line.alias("line"))


def nearest(vectors: DataFrame, query: Column, k: int, id_col: str, vector_col: str) -> DataFrame:
    """The k vectors of highest cosine; ties go by id. k is held to 1..50."""
    scored = vectors.select(F.col(id_col), T.cosine(F.col(vector_col), query).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), id_col).limit(min(50, max(1, k)))


def mean_pool(vectors: DataFrame, key: str, vector_col: str) -> DataFrame:
    """Mean vector per key, by dimension; vectors of a key that differ in length are an error."""
    checked = vectors.select(key, F.posexplode(vector_col).alias("d", "v"), F.size(vector_col).alias("dim"))
    by_dim = checked.groupBy(key, "d").agg(F.avg("v").alias("v"), F.min("dim").alias("low"), F.max("dim").alias("high"))
    pooled = by_dim.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("pooled"), F.min("low").alias("low"), F.max("high").alias("high"))
    same = F.when(F.col("low") == F.col("high"), F.col("pooled")).otherwise(F.raise_error(F.lit("vectors differ in length")))
    return pooled.select(key, same.alias("pooled"))


def _equals(value: str):
    return lambda x: x == F.lit(value)


def bm25(docs: DataFrame, id_col: str, text: Column, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of documents that hold a query word, over lower-case words divided by space; k1 and b are our choice."""
    words = docs.select(F.col(id_col), F.split(T.collapse_space(T.ascii_lower(F.coalesce(text, F.lit("")))), " ").alias("w"))
    counted = words.select(id_col, F.size("w").alias("length"), *[F.size(F.filter("w", _equals(q))).alias(f"tf{k}") for k, q in enumerate(query)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(query))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for k in range(len(query)):
        tf, df = F.col(f"tf{k}"), F.col(f"df{k}")
        weight = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.select(id_col, score.alias("score")).where("score > 0")
