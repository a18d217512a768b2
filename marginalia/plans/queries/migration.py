"""Queries over migration and suggestion jobs: A7, C4, C5, C14, C15, G10, G14, J9, J16, J17, J19, P5, S4, T3, W3–W6, W9, A8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed
from ...operators import html, migrate, notebooks, suggest
from ...operators.settle import settle
from ...sources import dims
from ...sources.vault import attachment_flags
from ...sources.views import table
from .common import OPEN_BODY, TRIM, Query, on_view, oracle, plain, view
from .notes import NATURAL, alias_frame


def _files(spark, sf):
    return view(spark, sf, "v_files")


P5 = oracle(rf"""WITH b AS (SELECT path, {TRIM('content')} AS whole, content, regexp_extract(path, '([^/]*)$', 1) AS name FROM v_files),
l AS (SELECT path, name, length(whole) AS total_len, length(CASE WHEN starts_with(whole, '# ') THEN {TRIM("regexp_replace(whole, '^[^\n]*\n?', '')")} ELSE whole END) AS body_len FROM b),
r AS (SELECT path, body_len, total_len, CASE WHEN path LIKE '%.html' THEN NULL WHEN starts_with(name, '_') THEN NULL WHEN name = '2.md' THEN 'generic-name'
  WHEN body_len < 10 AND total_len < 300 THEN 'too-short' END AS reason FROM l)
SELECT path, body_len, total_len, CASE WHEN reason IS NULL THEN 'keep' ELSE 'delete' END AS action, reason FROM r""", "v_files")


def w3(spark, sf):
    cleaned = migrate.clean_hashes(_files(spark, sf).where(F.lower("path").endswith(".md")))
    return plain(cleaned.select("path", "replacements", "changed", F.md5("content").alias("digest")))


def g14_cleaning(spark, sf):
    return plain(migrate.cleaning_summary(migrate.clean_hashes(_files(spark, sf).where(F.lower("path").endswith(".md")))))


def w4(spark, sf):
    """Safe, conflict-free names for pages: folder by host, title from the path of the URL."""
    pages = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("dir"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]*)", 1).alias("title"),
        F.lit(".md").alias("suffix"), F.col("page_id").alias("ord"),
    )
    return plain(migrate.safe_names(pages).select("dir", "ord", "name"))


W4 = r"""WITH p AS (SELECT page_id AS ord, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS dir, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]*)', 1) AS t FROM pages),
s AS (SELECT ord, dir, CASE WHEN t = '' THEN 'untitled' ELSE t END AS stem FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY dir, stem ORDER BY ord) AS n FROM s)
SELECT dir, ord, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS name FROM n"""

W5 = oracle(r"""WITH f AS (SELECT ord, path AS old_path, string_split(path, '/') AS p FROM v_files), d AS (SELECT * FROM f WHERE len(p) > 4 AND p[1] NOT IN ('Archive', '.config')),
s AS (SELECT ord, old_path, array_to_string(p[1:3], '/') AS dir, regexp_replace(array_to_string(list_transform(p[4:], lambda x: regexp_replace(trim(x), '\s+', ' ', 'g')), '__'), '\.[^.]*$', '') AS stem,
  regexp_extract(old_path, '(\.[^./]+)$', 1) AS suffix FROM d),
n AS (SELECT s.*, row_number() OVER (PARTITION BY dir, stem, suffix ORDER BY s.ord) + CASE WHEN e.path IS NOT NULL THEN 1 ELSE 0 END AS n
  FROM s LEFT JOIN v_files e ON e.path = dir || '/' || stem || suffix)
SELECT ord, old_path, dir || '/' || stem || CASE WHEN n > 1 THEN '--' || n ELSE '' END || suffix AS new_path FROM n""", "v_files")


def w6(spark, sf):
    return plain(migrate.journal_plan(_files(spark, sf), "Journals/Log/Daily", "Journals/Log", "Old-"))


W6 = oracle(r"""WITH f AS (SELECT ord, path, string_split(substr(path, 20), '/') AS p FROM v_files WHERE starts_with(path, 'Journals/Log/Daily/')),
s AS (SELECT ord, path, 'Old-' || p[1] || '-' || lpad(split_part(p[2], ' - ', 1), 2, '0') || '-' || lpad(split_part(p[3], ' - ', 1), 2, '0') || ' ' || split_part(p[3], ' - ', 2) AS stem FROM f),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY ord) AS n FROM s)
SELECT ord, path AS old_path, 'Journals/Log/' || stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS new_path FROM n""", "v_files")

MAPPING = [("Tech", "Knowledge/Tech", 0), ("Tech_note", "Knowledge/Notes", 1), ("Deep-2", "Knowledge/Deep", 2)]


def _clusters(spark, sf):
    mapping = spark.createDataFrame(MAPPING, "stem string, folder string, pos int")
    return migrate.cluster_moves(_files(spark, sf), "Import/root", mapping, "Archive/metadata", ["Demo"])


J19 = oracle("""WITH m(stem, folder, pos) AS (VALUES """ + ", ".join(f"('{s}', '{f}', {p})" for s, f, p in MAPPING) + r"""),
c AS (SELECT ord, path AS old_path, substr(path, 13) AS rel, split_part(substr(path, 13), '/', 1) AS child FROM v_files WHERE starts_with(path, 'Import/root/')),
h AS (SELECT c.ord, arg_min(m.folder, m.pos) AS folder FROM c JOIN m ON c.child = m.stem OR starts_with(c.child, m.stem || '.') OR starts_with(c.child, m.stem || '_') GROUP BY c.ord),
j AS (SELECT c.*, h.folder, starts_with(child, 'Demo_') AS demo FROM c LEFT JOIN h ON h.ord = c.ord)
SELECT ord, old_path, CASE WHEN demo THEN 'delete' ELSE 'move' END AS op, CASE WHEN NOT demo THEN coalesce(folder, 'Archive/metadata') || '/' || rel END AS new_path,
  CASE WHEN demo THEN 'demo-entry' WHEN folder IS NOT NULL THEN 'cluster' ELSE 'leftover' END AS reason FROM j""", "v_files")


def j9(spark, sf):
    files = _files(spark, sf)
    plan = settle(migrate.flatten_plan(files))
    out = migrate.rewrite_links(files, plan.select("old_path", "new_path"))
    return plain(out.select("path", "new_path", F.md5("content").alias("digest")))


def _plan(spark, sf):
    mapping = spark.createDataFrame(MAPPING, "stem string, folder string, pos int")
    return migrate.reorganise(
        _files(spark, sf), ["welcome.md", "2.md"], "Inbox/Journals", "Journals/Inbox", "Import/root", mapping, "Archive/metadata", ["Demo"],
        "Journals/Log/Daily", "Journals/Log",
    )


def c15(spark, sf):
    return plain(_plan(spark, sf))


def g14(spark, sf):
    return plain(migrate.migration_summary(_plan(spark, sf)))


def _pages(spark, sf):
    return table(spark, sf, "pages").withColumn("path", F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1), "/$", ""))


def a7(spark, sf):
    return plain(html.convert_pages(_pages(spark, sf)))


def c14(spark, sf):
    """Pages as an HTML export: file names from URLs, plus a link to the next page in every page."""
    p = _pages(spark, sf)
    path = F.concat("path", F.lit("-"), "page_id", F.lit(".html"))
    named = p.select(F.col("page_id").alias("ord"), path.alias("path"), "html")
    after = named.select((F.col("ord") - 1).alias("ord"), F.col("path").alias("next"))
    parts = html.page_parts(p)
    linked = named.repartition(parts, "ord").join(after.repartition(parts, "ord"), "ord", "left").select(
        "ord", "path", F.concat("html", F.coalesce(F.concat(F.lit('<p><a href="/'), F.regexp_replace("next", r"\.html$", ""), F.lit('?q=1#top">next</a></p>')), F.lit(""))).alias("html")
    )
    return plain(html.import_pages(settle(linked), "2024-01-01T00:00:00+00:00"))


# ------------------------------------------------------------------------------------------------------------ suggest


def c5(spark, sf):
    return plain(suggest.term_table(view(spark, sf, "v_notes")))


def _listed(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


C5 = oracle(rf"""WITH {NATURAL},
p AS (SELECT path, 'title' AS source, basename AS text FROM v_notes UNION ALL SELECT path, 'body', text FROM prose
  UNION ALL SELECT path, 'heading', unnest(regexp_extract_all({OPEN_BODY}, '(?m)^#{{1,6}}[ \t]+(.*?)[ \t]*#*[ \t]*$', 1)) FROM v_notes),
low AS (SELECT DISTINCT path, source, lower(text) AS t FROM p), texts AS (SELECT DISTINCT t FROM low),
runs AS (SELECT t, unnest(regexp_extract_all(t, '[{fixed.CJK}]{{2,24}}')) AS run FROM texts),
parts AS (SELECT t, run, list_filter(string_split_regex(run, '[{fixed.CJK_SPLIT_CHARS}]'), lambda x: length(x) >= 2) AS l FROM runs),
blocks AS (SELECT t, unnest(CASE WHEN len(l) > 0 THEN l ELSE [run] END) AS b FROM parts),
edges AS (SELECT t, b, unnest(range(2, least(CASE WHEN length(b) > 12 THEN 4 ELSE 6 END, length(b)) + 1)) AS k FROM blocks),
terms AS (SELECT t, trim(unnest(string_split_regex(t, '{fixed.TERM_SPLIT}'))) AS term FROM texts
  UNION SELECT t, unnest(regexp_extract_all(t, '\b[a-z][a-z-]{{2,}}\b')) FROM texts
  UNION SELECT t, b FROM blocks WHERE length(b) <= 10 UNION SELECT t, left(b, k) FROM edges UNION SELECT t, right(b, k) FROM edges),
named AS (SELECT DISTINCT term, length(term) AS n, regexp_matches(term, '^[a-z]') AS latin, len(regexp_extract_all(term, '[{fixed.CJK_FUNCTION_CHARS}]')) AS functional FROM terms),
good AS (SELECT term FROM named WHERE term <> '' AND NOT regexp_matches(term, '^\d+$') AND regexp_matches(term, '[A-Za-z0-9{fixed.CJK}]')
  AND NOT (latin AND (n < 3 OR term IN {_listed(fixed.EN_STOPWORDS)} OR term IN {_listed(fixed.NOISY_TOKENS)} OR term IN {_listed(fixed.STRUCTURAL_TOKENS)}))
  AND NOT (NOT latin AND term IN {_listed(fixed.STRUCTURAL_CJK)})
  AND NOT regexp_matches(term, '^第[一二三四五六七八九十百千0-9]+[章节部分篇讲]$')
  AND NOT (regexp_matches(term, '^[a-z][a-z0-9-]{{0,2}}$') AND NOT regexp_matches(term, '^[a-z]\d{{2}}$'))
  AND NOT (regexp_matches(term, '[{fixed.CJK}]') AND (n < 2 OR n > 12 OR replace(term, left(term, 1), '') = ''
    OR regexp_matches(term, '^[{fixed.CJK_FUNCTION_CHARS}]|[{fixed.CJK_FUNCTION_CHARS}]$') OR (n <= 3 AND functional > 0) OR functional > floor(n / 3.0))))
SELECT DISTINCT path, source, term FROM low JOIN terms USING (t) JOIN good USING (term)""", "v_notes")


def _pieces(spark, sf):
    v = view(spark, sf, "v_notes")
    profiles = settle(suggest.note_profiles(v))
    return v, profiles, suggest.text_pieces(suggest.body_lines(v), profiles, settle(suggest.context(profiles)))


def g10(spark, sf):
    _, _, pieces = _pieces(spark, sf)
    return plain(suggest.score_signals(suggest.keyword_signals(pieces)))


def w9(spark, sf):
    _, profiles, pieces = _pieces(spark, sf)
    return plain(suggest.keyword_suggestions(pieces, profiles).select("path", "tag", "kind", "score", "primary", "sources"))


def c4(spark, sf):
    return plain(suggest.suggest_tags(view(spark, sf, "v_notes"), alias_frame(spark), dims.default_facets(spark)))


def t3(spark, sf):
    return plain(suggest.preselected(suggest.suggest_tags(view(spark, sf, "v_notes"), alias_frame(spark), dims.default_facets(spark))))


def s4(spark, sf):
    """Two suggestion streams over all documents, merged per tag."""
    d = table(spark, sf, "documents")
    path = F.concat(F.lit("doc-"), "doc_id")
    none = F.lit(None).cast("string")
    row = lambda tag, kind, score, primary, source, stage: d.select(
        path.alias("path"), tag.alias("tag"), F.lit(kind).alias("kind"), score.cast("bigint").alias("score"), F.lit(primary).alias("primary"),
        F.array(F.lit(source)).alias("sources"), F.array("lang").alias("matches"), none.alias("facet"), F.struct(F.lit(stage).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("stage"),
    )
    a = row(F.concat(F.lit("Tag"), F.col("doc_id") % 3), "keyword", 10 + F.col("doc_id") % 7, False, "body", 5)
    b = row(F.concat(F.lit("#tag"), F.col("doc_id") % 2), "alias", F.lit(13), True, "alias", 3)
    return plain(suggest.merge_streams(a.unionByName(b)).select("path", "tag", "score", "kind", "primary", "sources"))


S4 = """WITH r AS (SELECT 'doc-' || doc_id AS path, 'Tag' || (doc_id % 3) AS tag, 'keyword' AS kind, 10 + doc_id % 7 AS score, false AS primary_, 'body' AS source, 5 AS stage FROM documents
  UNION ALL SELECT 'doc-' || doc_id, 'tag' || (doc_id % 2), 'alias', 13, true, 'alias', 3 FROM documents)
SELECT path, arg_min(tag, stage) AS tag, max(score) AS score, arg_max(kind, (score, -stage)) AS kind, bool_or(primary_) AS "primary", string_agg(source, '|' ORDER BY source) AS sources
FROM r GROUP BY path, lower(tag)"""

# ---------------------------------------------------------------------------------------------------------- notebooks


def _notebooks(spark, sf):
    """Orders of a customer as a notebook: line items are its artifacts, orders its notes."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    noted = o.groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct(
        F.concat(F.lit("n"), "o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey") % 3).alias("title"), F.col("o_orderpriority").alias("content")))).alias("notes"))
    kinds = F.create_map(*[F.lit(x) for x in ("A", "report", "N", "mind_map", "R", "audio")])
    made = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k")), "l_orderkey").groupBy("k").agg(F.array_sort(F.collect_set(F.struct(
        F.concat(F.lit("n"), F.col("l_orderkey") + F.col("l_linenumber") % 2).alias("id"), F.element_at(kinds, F.col("l_returnflag")).alias("type"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("in_progress").alias("status"), F.lit("2024").alias("created_at")))).alias("artifacts"))
    return noted.join(made, "k", "left").select(
        F.col("k").cast("string").alias("notebook_id"), F.concat(F.lit("Book "), "k").alias("title"), F.size("notes").alias("source_count"), F.lit("https://host").alias("url"), "notes", "artifacts"
    )


def a8(spark, sf):
    return plain(notebooks.exported_artifacts(_notebooks(spark, sf), ["report", "audio"]).select("notebook_id", "artifact_type", "artifact_id", "path"))


_MADE = """made AS (SELECT DISTINCT o_custkey::VARCHAR AS notebook_id, 'n' || (l_orderkey + l_linenumber % 2) AS id,
  CASE l_returnflag WHEN 'A' THEN 'report' WHEN 'N' THEN 'mind_map' WHEN 'R' THEN 'audio' END AS type FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'F')"""
A8 = f"""WITH {_MADE} SELECT notebook_id, type AS artifact_type, id AS artifact_id,
  'artifacts/' || type || '/' || type || '-' || substr(id, 1, 8) || CASE type WHEN 'report' THEN '.md' ELSE '.m4a' END AS path FROM made WHERE type <> 'mind_map'"""


def j17(spark, sf):
    n = _notebooks(spark, sf)
    return plain(notebooks.skipped_artifacts(n, notebooks.exported_notes(n)).select("notebook_id", "artifact_id", "covered_by_note_export"))


J17 = f"""WITH {_MADE}, n AS (SELECT o_custkey::VARCHAR AS notebook_id, 'n' || o_orderkey AS id FROM orders)
SELECT m.notebook_id, m.id AS artifact_id, n.id IS NOT NULL AS covered_by_note_export FROM made m LEFT JOIN n ON n.notebook_id = m.notebook_id AND n.id = m.id WHERE m.type = 'mind_map'"""


def k4(spark, sf):
    n = _notebooks(spark, sf)
    exported = notebooks.exported_notes(n)
    listed = exported.withColumn("path", F.concat(F.lit("notes/"), "title", F.lit("-"), "pos", F.lit(".md")))
    out = notebooks.index_notes(n, listed, notebooks.exported_artifacts(n, ["report", "audio"]), notebooks.skipped_artifacts(n, exported), "2024-01-01T00:00:00+00:00")
    return plain(out.select("path", F.length("content").alias("chars"), F.md5("content").alias("digest")))


def j16(spark, sf):
    v = view(spark, sf, "v_notes")
    asked = v.select("path", F.concat(F.lit("http://"), F.regexp_extract("path", r"doc-(\d+)", 1)).alias("pdf"))
    have = table(spark, sf, "pages").select(F.concat(F.lit("http://"), F.col("page_id") * 3).alias("path"))
    return plain(attachment_flags(asked, have))


J16 = oracle("SELECT path, 'http://' || ord AS pdf, ord % 3 = 0 AND ord // 3 IN (SELECT page_id FROM pages) AS attachment_exists FROM v_notes", "v_notes")

QUERIES = {
    "A7_pages_to_markdown": Query(a7),
    "A8_notebook_artifacts": Query(a8, A8),
    "C4_tag_suggestions": Query(c4),
    "C5_tag_terms": Query(c5, C5),
    "C14_html_import": Query(c14),
    "C15_reorganisation": Query(c15),
    "G10_keyword_signals": Query(g10),
    "G14_migration_summary": Query(g14),
    "G14_cleaning_summary": Query(g14_cleaning),
    "J9_link_rewriting": Query(j9),
    "J16_attachments": Query(j16, J16),
    "J17_skipped_artifacts": Query(j17, J17),
    "J19_cluster_mapping": Query(lambda s, d: plain(_clusters(s, d)), J19),
    "K4_notebook_index": Query(k4),
    "P5_junk_report": Query(on_view("v_files", migrate.junk_report), P5),
    "S4_merged_suggestions": Query(s4, S4),
    "T3_preselected_tags": Query(t3),
    "W3_hash_cleaning": Query(w3),
    "W4_safe_names": Query(w4, W4),
    "W5_flatten_plan": Query(on_view("v_files", migrate.flatten_plan), W5),
    "W6_journal_names": Query(w6, W6),
    "W9_keyword_suggestions": Query(w9),
}
