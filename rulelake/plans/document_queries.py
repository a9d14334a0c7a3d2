"""Queries of chunks, links, mentions, spines and vectors over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..session import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def chunk_line_windows(spark, sf_dir):
    out = D.line_windows(_docs(spark, sf_dir), "doc_id", F.col("text"), 12, 3)
    return out.select("doc_id", "start_line", "end_line", F.sha2("chunk", 256).alias("chunk_sha256"))


def chunk_char_windows(spark, sf_dir):
    out = D.char_windows(_docs(spark, sf_dir), "doc_id", F.col("text"))
    return out.select("doc_id", "start_char", F.sha2("chunk", 256).alias("chunk_sha256"), F.length("chunk").alias("chars"))


def _spaced(spark, sf_dir):
    """Documents with a blank line after each line that ends with a full stop."""
    text = F.regexp_replace("text", r"\.\n", ".\n\n")
    return _docs(spark, sf_dir).select("doc_id", text.alias("text"))


def chunk_paragraphs(spark, sf_dir):
    out = D.paragraphs(_spaced(spark, sf_dir), "doc_id", F.col("text"))
    return out.where(F.col("chunk").rlike(r"\S")).select("doc_id", "start_line", "end_line", F.sha2("chunk", 256).alias("chunk_sha256"))


def chunk_markdown_headings(spark, sf_dir):
    """Sections of documents whose lines become headings by their position."""
    lines = T.lines(F.col("text"))
    marked = F.transform(lines, lambda line, k: F.when(k % 7 == 0, F.concat(F.lit("# "), line)).when(k % 3 == 0, F.concat(F.lit("## "), line)).otherwise(line))
    docs = _docs(spark, sf_dir).select("doc_id", F.array_join(marked, "\n").alias("text"))
    out = D.heading_sections(docs, "doc_id", F.col("text"))
    return out.select("doc_id", "start_line", "end_line", F.size("heading_path").alias("depth"), F.sha2("chunk", 256).alias("chunk_sha256"))


def chunk_repr_hashes(spark, sf_dir):
    out = D.chunk_digests(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("chunk")))
    return out.select("doc_id", "chunk_sha256", "normalized_text_sha256", "byte_len", "line_count")


def chunk_token_hashes(spark, sf_dir):
    out = D.chunk_digests(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("chunk")))
    return out.select("doc_id", "token_sha256")


def duplicate_groups(spark, sf_dir):
    out = D.chunk_digests(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("chunk")))
    return D.duplicate_groups(out, "normalized_text_sha256", "doc_id")


def link_extract(spark, sf_dir):
    return D.html_links(table(spark, sf_dir, "pages"), "page_id", F.col("html"))


def wiki_link_extract(spark, sf_dir):
    """Wiki links in conversation texts whose first two words become ``[[first#second|alias]]``."""
    rows = table(spark, sf_dir, "conversations")
    text = F.regexp_replace("text", r"^(\S+) (\S+)", r"![[$1#$2|alias]] [[ $2 ]]")
    links = D.wiki_links(rows.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("place"), text.alias("text")), "place", F.col("text"))
    return links.select("place", "line", "target", "heading", "alias", "embed")


def _vault(spark, sf_dir):
    first = F.regexp_extract("text", r"^([A-Za-z]+)", 1)
    docs = _docs(spark, sf_dir).select(F.concat(F.lit("docs/"), "doc_id", F.lit(".md")).alias("path"), first.alias("title"))
    links = link_extract(spark, sf_dir).where(F.startswith("target", F.lit("/")))
    extra = _docs(spark, sf_dir).select(F.col("doc_id").alias("page_id"), F.lit(-1).alias("position"), F.concat(F.lit("./docs/"), "doc_id").alias("target"))
    return links.unionByName(extra), docs


def _resolved(spark, sf_dir):
    links, docs = _vault(spark, sf_dir)
    return D.resolve_links(links, docs), docs


def link_resolve_cascade(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].select("page_id", "position", "target", "kind", "resolved", "candidates")


def link_doc_stats(spark, sf_dir):
    links, docs = _resolved(spark, sf_dir)
    links = links.withColumn("from_path", F.concat(F.lit("docs/"), F.col("page_id"), F.lit(".md")))
    return D.link_stats(links, docs, "from_path", "path")


def top_hubs(spark, sf_dir):
    return link_doc_stats(spark, sf_dir).orderBy(F.desc("in_links"), "path").limit(50).select("path", "in_links")


def unresolved_summary(spark, sf_dir):
    return _resolved(spark, sf_dir)[0].where("resolved is null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def missing_targets(spark, sf_dir):
    missing = _resolved(spark, sf_dir)[0].where("kind = 'missing'")
    return missing.groupBy("target").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(50)


def ambiguous_choice(spark, sf_dir):
    links, docs = _resolved(spark, sf_dir)
    links = links.withColumn("from_path", F.concat(F.lit("docs/"), F.col("page_id") % 20))
    return D.choose_ambiguous(links, docs, ["docs/", "docs/1"]).select("page_id", "position", "target", "chosen")


PREFIXES = ["http://", "https://", "https://blog.", "https://www.", "http://tionsh.example.net/fr/"]


def vault_prefix_longest(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", D.longest_prefix(F.col("url"), PREFIXES).alias("prefix"))


def _terms(spark, sf_dir):
    words = F.split(T.mention_text(F.col("text")), " ")
    items = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    one = items.select(F.col("item_id").alias("target"), F.element_at("w", 1).alias("term"))
    two = items.where(F.size("w") > 3).select(F.col("item_id").alias("target"), F.array_join(F.slice("w", 2, 2), " ").alias("term"))
    return one.unionByName(two).distinct()


def _plain(text):
    """Text with all but ASCII blanked: to mentions no other letter is part of a word."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", " ")


def _mentions(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", _plain(F.col("text")).alias("text"))
    # a term is made plain as texts are, which may divide one of its words into several
    terms = _terms(spark, sf_dir).select("target", T.mention_text(_plain(F.col("term"))).alias("term")).where("term != ''").distinct()
    longest = terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    return D.term_mentions(docs, "doc_id", F.col("text"), terms, longest)


def term_mentions(spark, sf_dir):
    return _mentions(spark, sf_dir)


def backlinks(spark, sf_dir):
    totals = D.mention_totals(_mentions(spark, sf_dir), "doc_id")
    return D.top_mentions(totals, "doc_id", 3).select("doc_id", "target", "total", "via")


def name_collisions(spark, sf_dir):
    return D.name_collisions(_vault(spark, sf_dir)[1].where("title != ''"), "title")


def _references(spark, sf_dir):
    kind = F.when(F.col("n_chars") % 2 == 0, "structural").otherwise("textual")
    return _docs(spark, sf_dir).select(F.col("source").alias("concept"), F.col("lang").alias("spine"), kind.alias("kind"))


def spine_counts(spark, sf_dir):
    return D.spine_counts(_references(spark, sf_dir))


def primary_spine(spark, sf_dir):
    return D.primary_spine(spine_counts(spark, sf_dir))


def spine_audit(spark, sf_dir):
    spines = primary_spine(spark, sf_dir)
    counts = spine_counts(spark, sf_dir)
    return spines.join(counts, ["concept", "spine"]).agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("confidence") == "tied").alias("tied"), F.count_if(F.col("textual") == 0).alias("structural_only"))


PATTERN = r"\bthe\b|\bnd\b|aa"


def observe_pattern_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", "source", T.observed(F.regexp_replace("text", r"[^\x09\x0A\x20-\x7E]", "~"), PATTERN).alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("documents"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def cosine_topk(spark, sf_dir):
    query = _vectors(spark, sf_dir).where("vec_id = 0").select(F.col("embedding").alias("q"))
    paired = _vectors(spark, sf_dir).crossJoin(F.broadcast(query))  # one query row
    return D.nearest(paired, F.col("q"), 20, "vec_id", "embedding").select("vec_id", F.round("similarity", 6).alias("similarity"))


def doc_mean_pool(spark, sf_dir):
    pooled = D.mean_pool(_vectors(spark, sf_dir), "label", "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("d", "v")).select("label", "d", F.round("v", 6).alias("v"))


def vector_truncate(spark, sf_dir):
    cut = T.truncate_vector(F.col("embedding"), 8)
    return _vectors(spark, sf_dir).select("vec_id", F.size(cut).alias("dim"), F.round(F.aggregate(cut, F.lit(0.0), lambda s, v: s + v.cast("double")), 5).alias("total"))


def rerank_candidates(spark, sf_dir):
    """Each label's vectors ranked by cosine to the label's first vector; the best other one is recommended."""
    vectors = _vectors(spark, sf_dir)
    heads = vectors.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q"), F.min("vec_id").alias("head"))
    scored = vectors.join(heads, "label").where("vec_id != head").select("label", "vec_id", F.round(T.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))
    return scored.groupBy("label").agg(F.max_by("vec_id", F.struct("similarity", -F.col("vec_id"))).alias("recommended"), F.max("similarity").alias("similarity"))


def bm25_search(spark, sf_dir):
    return D.bm25(_docs(spark, sf_dir), "doc_id", F.col("text"), ["the", "erent"]).select("doc_id", F.round("score", 6).alias("score"))


def facet_distribution(spark, sf_dir):
    facets = F.array("lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))
    return _docs(spark, sf_dir).select(F.explode(facets).alias("facet")).groupBy("facet").agg(F.count(F.lit(1)).alias("n"))


def role_distribution(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("fm_role")).agg(F.count(F.lit(1)).alias("n"))


def frontmatter_overview(spark, sf_dir):
    first = F.regexp_extract("text", r"^([A-Za-z]+)", 1)
    return _docs(spark, sf_dir).select(F.concat(F.lit("docs/"), "doc_id").alias("doc_path"), first.alias("title"), F.col("source").alias("fm_role"), F.col("lang").alias("fm_type"), (F.col("n_chars") > 1000).alias("fm_canonical"))


def text_normalizers(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.file_stem(url).alias("stem"), T.normalize_target(F.concat(F.lit(" .\\"), url)).alias("target"), T.heading_slug(F.regexp_replace(url, r"[/.:]", " ")).alias("slug"), T.parent_dir(url).alias("dir"), T.normalize_invariant(F.regexp_replace(url, "/", " ")).alias("invariant"))


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

_VAULT_SQL = """
WITH docs AS (
  SELECT 'docs/' || doc_id || '.md' AS path, regexp_extract(text, '^([A-Za-z]+)', 1) AS title FROM documents
), hrefs AS (
  SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1) AS h FROM pages
), links AS (
  SELECT page_id, CAST(i - 1 AS INT) AS position, h[i] AS target FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM hrefs) WHERE h[i] LIKE '/%'
  UNION ALL SELECT doc_id, -1, './docs/' || doc_id FROM documents
), norm AS (
  SELECT *, regexp_replace(regexp_replace(trim(target), '^(\\./)+', ''), '^/+', '') AS n FROM links
), keyed AS (
  SELECT *, CASE WHEN lower(n) LIKE '%.md' THEN n ELSE n || '.md' END AS with_md, CASE WHEN n NOT LIKE '%/%' AND n <> '' THEN regexp_replace(n, '(\\.md)*(\\.MD)*$', '') END AS stem FROM norm
), exact AS (
  SELECT title AS k, list_sort(list(DISTINCT path)) AS c FROM docs GROUP BY title
), folded AS (
  SELECT lower(title) AS k, list_sort(list(DISTINCT path)) AS c FROM docs GROUP BY 1
), joined AS (
  SELECT l.*, coalesce(p1.path, p2.path) AS path, e.c AS ec, f.c AS fc, coalesce(e.c, f.c) AS c
  FROM keyed l LEFT JOIN docs p1 ON p1.path = n LEFT JOIN docs p2 ON p2.path = with_md LEFT JOIN exact e ON e.k = stem LEFT JOIN folded f ON f.k = lower(stem)
), resolved AS (
  SELECT page_id, position, target, c,
         CASE WHEN n = '' THEN 'missing' WHEN path IS NOT NULL THEN 'exact_path' WHEN len(c) > 1 THEN 'ambiguous' WHEN ec IS NOT NULL THEN 'exact_title' WHEN fc IS NOT NULL THEN 'casefold_title' ELSE 'missing' END AS kind,
         CASE WHEN n = '' THEN NULL WHEN path IS NOT NULL THEN path WHEN len(c) = 1 THEN c[1] END AS resolved,
         CASE WHEN n = '' OR (path IS NULL AND c IS NULL) THEN 0 WHEN path IS NOT NULL THEN 1 ELSE len(c) END AS candidates
  FROM joined
)
"""
_STATS_SQL = _VAULT_SQL + """
, outgoing AS (
  SELECT 'docs/' || page_id || '.md' AS path, count(resolved) AS out_links, count(*) FILTER (kind = 'missing') AS missing_out, count(*) FILTER (kind = 'ambiguous') AS ambiguous_out FROM resolved GROUP BY 1
), incoming AS (
  SELECT resolved AS path, count(*) AS in_links FROM resolved WHERE resolved IS NOT NULL GROUP BY 1
), stats AS (
  SELECT d.path, coalesce(out_links, 0) AS out_links, coalesce(missing_out, 0) AS missing_out, coalesce(ambiguous_out, 0) AS ambiguous_out, coalesce(in_links, 0) AS in_links
  FROM docs d LEFT JOIN outgoing USING (path) LEFT JOIN incoming USING (path)
)
"""
_LINES = "string_split(CASE WHEN t LIKE '%' || chr(10) THEN t[:-2] ELSE t END, chr(10))"
_MENTION_SQL = r"""
WITH items AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), ' ') AS w FROM benchmark
), terms AS (
  SELECT DISTINCT target, trim(regexp_replace(term, '[^a-z0-9_]+', ' ', 'g')) AS term FROM (SELECT item_id AS target, w[1] AS term FROM items UNION ALL SELECT item_id, w[2] || ' ' || w[3] FROM items WHERE len(w) > 3)
  WHERE regexp_matches(term, '[a-z0-9_]')
), lengths AS (
  SELECT DISTINCT len(string_split(term, ' ')) AS n FROM terms
), words AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(regexp_replace(text, '[^A-Za-z0-9_ \n]', ' ', 'g')), '[^a-z0-9_]+', ' ', 'g')), ' ') AS w FROM documents
), runs AS (
  SELECT doc_id, array_to_string(w[i:i + n - 1], ' ') AS term FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)
), mentions AS (
  SELECT doc_id, target, term, count(*) AS mentions FROM runs JOIN terms USING (term) GROUP BY ALL
)
"""
_SPINE_SQL = """
WITH counts AS (
  SELECT source AS concept, lang AS spine, count(*) FILTER (n_chars % 2 = 0) AS structural, count(*) FILTER (n_chars % 2 <> 0) AS textual FROM documents GROUP BY ALL
), ranked AS (
  SELECT concept, spine, structural, textual, structural + textual AS total, row_number() OVER w AS k, lead(structural + textual) OVER w AS nxt
  FROM counts WINDOW w AS (PARTITION BY concept ORDER BY structural + textual DESC, spine)
), best AS (
  SELECT *, CASE WHEN total = coalesce(nxt, 0) THEN 'tied' WHEN total >= 2 * coalesce(nxt, 0) THEN 'high' ELSE 'medium' END AS confidence FROM ranked WHERE k = 1
)
"""
_COSINE = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"

ORACLE_SQL = {
    "chunk_line_windows": """
        WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS rows FROM documents),
        s AS (SELECT doc_id, rows, unnest(range(0, CAST(greatest(0, ceil((len(rows) - 12) / 9.0)) AS BIGINT) * 9 + 1, 9)) AS start FROM l WHERE len(rows) > 0),
        c AS (SELECT doc_id, CAST(start + 1 AS INT) AS start_line, CAST(least(start + 12, len(rows)) AS INT) AS end_line, array_to_string(rows[start + 1:start + 12], '') AS chunk FROM s)
        SELECT doc_id, start_line, end_line, sha256(chunk) AS chunk_sha256 FROM c WHERE regexp_matches(chunk, '\\S')""",
    "chunk_char_windows": """
        WITH s AS (SELECT doc_id, text, CAST(unnest(range(0, CAST(greatest(0, ceil((length(text) - 2400) / 2240.0)) AS BIGINT) * 2240 + 1, 2240)) AS INT) AS start_char FROM documents WHERE length(text) > 0)
        SELECT doc_id, start_char, sha256(substr(text, start_char + 1, 2400)) AS chunk_sha256, length(substr(text, start_char + 1, 2400)) AS chars FROM s""",
    "chunk_paragraphs": """
        WITH t AS (SELECT doc_id, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS t FROM documents),
        l AS (SELECT doc_id, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS rows FROM t),
        r AS (SELECT doc_id, i, rows[i] AS line, NOT regexp_matches(rows[i], '\\S') AS blank FROM (SELECT doc_id, rows, unnest(range(1, len(rows) + 1)) AS i FROM l)),
        g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM r)
        SELECT doc_id, CAST(min(i) AS INT) AS start_line, CAST(max(i) AS INT) AS end_line, sha256(string_agg(line, '' ORDER BY i)) AS chunk_sha256 FROM g WHERE NOT blank GROUP BY doc_id, grp""",
    "chunk_markdown_headings": f"""
        WITH raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        l AS (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE list_transform({_LINES}, lambda x: regexp_replace(x, '\\r$', '')) END AS a FROM raw),
        e AS (SELECT doc_id, i, len(a) AS n, CASE WHEN (i - 1) % 7 = 0 THEN '# ' || a[i] WHEN (i - 1) % 3 = 0 THEN '## ' || a[i] ELSE a[i] END AS line
              FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM l)),
        h AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*#{{1,6}}[^#]') AND regexp_matches(regexp_replace(line, '^\\s*#+', ''), '\\S') THEN length(regexp_extract(line, '^\\s*(#+)', 1)) END AS level FROM e),
        s AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY i) AS sec, count(*) FILTER (level = 1) OVER (PARTITION BY doc_id ORDER BY i) AS ones FROM h),
        c AS (SELECT doc_id, sec, min(i) AS a, max(i) AS b, max(n) AS n, max(level) AS level, max(ones) AS ones, string_agg(line, chr(10) ORDER BY i) AS chunk FROM s GROUP BY doc_id, sec)
        SELECT doc_id, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, CAST(CASE WHEN sec = 0 THEN 0 WHEN level = 1 THEN 1 WHEN ones > 0 THEN 2 ELSE 1 END AS INT) AS depth,
               sha256(chunk || CASE WHEN b < n THEN chr(10) ELSE '' END) AS chunk_sha256 FROM c WHERE regexp_matches(chunk, '\\S')""",
    "chunk_repr_hashes": f"""
        WITH raw AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, sha256(t) AS chunk_sha256, sha256(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS normalized_text_sha256, CAST(strlen(t) AS BIGINT) AS byte_len,
               CAST(CASE WHEN t = '' THEN 0 ELSE len({_LINES}) END AS BIGINT) AS line_count FROM raw""",
    "chunk_token_hashes": """
        SELECT doc_id, sha256(array_to_string(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\s\\x0B\\x{85}\\p{Z}\\p{L}\\p{M}\\p{N}_]'), chr(10))) AS token_sha256 FROM documents""",
    "duplicate_groups": """
        SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normalized_text_sha256, count(*) AS members, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""",
    "link_extract": """
        WITH h AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1) AS h FROM pages)
        SELECT page_id, CAST(i - 1 AS INT) AS position, h[i] AS target FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM h)""",
    "wiki_link_extract": """
        WITH w AS (SELECT conv_id || '/' || turn AS place, regexp_extract(text, '^(\\S+) (\\S+)', 1) AS a, regexp_extract(text, '^(\\S+) (\\S+)', 2) AS b FROM conversations WHERE regexp_matches(text, '^\\S+ \\S+'))
        SELECT place, 1 AS line, a AS target, b AS heading, 'alias' AS alias, true AS embed FROM w UNION ALL SELECT place, 1, b, NULL, NULL, false FROM w""",
    "link_resolve_cascade": _VAULT_SQL + "SELECT page_id, position, target, kind, resolved, CAST(candidates AS INT) AS candidates FROM resolved",
    "link_doc_stats": _STATS_SQL + "SELECT * FROM stats",
    "top_hubs": _STATS_SQL + "SELECT path, in_links FROM stats ORDER BY in_links DESC, path LIMIT 50",
    "unresolved_summary": _VAULT_SQL + "SELECT kind, count(*) AS n FROM resolved WHERE resolved IS NULL GROUP BY kind",
    "missing_targets": _VAULT_SQL + "SELECT target, count(*) AS n FROM resolved WHERE kind = 'missing' GROUP BY target ORDER BY n DESC, target LIMIT 50",
    "ambiguous_choice": _VAULT_SQL + """
        SELECT page_id, position, target, CASE WHEN starts_with(CAST(page_id % 20 AS VARCHAR), '1') THEN coalesce(list_min(list_filter(c, lambda x: starts_with(x, 'docs/1'))), list_min(c)) ELSE list_min(c) END AS chosen
        FROM resolved WHERE kind = 'ambiguous'""",
    "vault_prefix_longest": f"""
        WITH p AS (SELECT unnest({PREFIXES}) AS p), m AS (SELECT page_id, p FROM pages LEFT JOIN p ON starts_with(url, p))
        SELECT page_id, coalesce(arg_max(p, length(p)), '') AS prefix FROM m GROUP BY page_id""",
    "term_mentions": _MENTION_SQL + "SELECT * FROM mentions",
    "backlinks": _MENTION_SQL + """
        , totals AS (SELECT doc_id, target, CAST(sum(mentions) AS BIGINT) AS total, first(term ORDER BY mentions DESC, term) AS via FROM mentions GROUP BY ALL)
        SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, target) <= 3""",
    "name_collisions": "SELECT lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS name, count(*) AS n FROM documents WHERE regexp_matches(text, '^[A-Za-z]') GROUP BY 1 HAVING count(*) > 1",
    "spine_counts": _SPINE_SQL + "SELECT * FROM counts",
    "primary_spine": _SPINE_SQL + "SELECT concept, spine, total, confidence FROM best",
    "spine_audit": _SPINE_SQL + "SELECT count(*) AS concepts, count(*) FILTER (confidence = 'tied') AS tied, count(*) FILTER (textual = 0) AS structural_only FROM best",
    "observe_pattern_counts": """
        WITH t AS (SELECT source, lower(regexp_replace(text, '[^\\x09\\x0A\\x20-\\x7E]', '~', 'g')) AS t FROM documents),
        p AS (SELECT source, len(list_filter(range(1, length(t) + 1), lambda i: t[i:i + 1] = 'aa')) + len(list_filter(regexp_extract_all(t, '[a-z0-9_]+'), lambda w: w IN ('the', 'nd'))) AS n FROM t)
        SELECT source, CAST(sum(n) AS BIGINT) AS n, count(*) FILTER (n > 0) AS documents FROM p GROUP BY source""",
    "cosine_topk": f"""
        WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, {_COSINE.format("embedding", "q")} AS s FROM embeddings, q)
        SELECT vec_id, round(s, 6) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 20""",
    "doc_mean_pool": """
        WITH x AS (SELECT label, i, embedding[i]::DOUBLE AS v FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
        SELECT label, CAST(i - 1 AS INT) AS d, round(avg(v), 6) AS v FROM x GROUP BY ALL""",
    "vector_truncate": "SELECT vec_id, len(embedding[1:8])::INT AS dim, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 5) AS total FROM embeddings",
    "rerank_candidates": f"""
        WITH h AS (SELECT label, arg_min(embedding, vec_id) AS q, min(vec_id) AS head FROM embeddings GROUP BY label),
        s AS (SELECT e.label, vec_id, round({_COSINE.format("embedding", "q")}, 6) AS similarity FROM embeddings e JOIN h ON h.label = e.label AND vec_id <> head)
        SELECT label, vec_id AS recommended, similarity FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) = 1""",
    "bm25_search": """
        WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
        c AS (SELECT doc_id, len(w) AS l, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'erent')) AS t1 FROM w),
        s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
        r AS (SELECT doc_id, ln(1 + (n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * t0 * 2.2::DOUBLE / (t0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m))
                          + ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * t1 * 2.2::DOUBLE / (t1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)) AS score FROM c, s)
        SELECT doc_id, round(score, 6) AS score FROM r WHERE score > 0""",
    "facet_distribution": "SELECT facet, count(*) AS n FROM (SELECT unnest([lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS facet FROM documents) GROUP BY facet",
    "role_distribution": "SELECT role AS fm_role, count(*) AS n FROM conversations GROUP BY role",
    "frontmatter_overview": "SELECT 'docs/' || doc_id AS doc_path, regexp_extract(text, '^([A-Za-z]+)', 1) AS title, source AS fm_role, lang AS fm_type, n_chars > 1000 AS fm_canonical FROM documents",
    "text_normalizers": """
        WITH u AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS name FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(name, '^\\.[^.]*$') THEN name ELSE regexp_replace(name, '(.)\\.[^.]*$', '\\1') END AS stem, url AS target,
               regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_replace(url, '[/.:]', ' ', 'g'))), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '-+$', '') AS slug,
               regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(lower(trim(replace(url, '/', ' '))), '\\s', '_', 'g') AS invariant FROM u""",
}
