"""Queries over works and topics: A5, A6, A13, C10–C12, G5–G9, T2, T4, J10, J11, K1 rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed
from ...operators import works
from ...plans import workspace
from ...sources import dims
from .common import Query, oracle, plain, view


def work_rows(spark, sf, counted=True):
    """Works of the part table in the common shape. An author list holds all suppliers of the part. Without ``counted`` the numbers of references and of
    citations by year are left out, whose joins Spark would make for jobs that do not show them, too."""
    base = view(spark, sf, "v_works")
    authors = view(spark, sf, "v_work_authors").groupBy("work_no").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "author"))), lambda x: x["author"]).alias("authors")
    )
    joined = base.join(authors, "work_no", "left")
    if not counted:
        return _common(joined)
    cited = view(spark, sf, "v_work_references").groupBy("work_no").agg(F.count(F.lit(1)).alias("referenced_works_count"))
    # at most one entry a year
    years = view(spark, sf, "v_work_years").groupBy("work_no").agg(F.sort_array(F.collect_list(F.struct("year", "cited_by_count")), asc=False).alias("counts_by_year"))
    rows = _common(joined.join(cited, "work_no", "left").join(years, "work_no", "left"), "referenced_works_count", "counts_by_year")
    return rows.withColumns({
        "referenced_works_count": F.coalesce("referenced_works_count", F.lit(0)).cast("bigint"),
        "counts_by_year": F.coalesce("counts_by_year", F.array().cast("array<struct<year:int,cited_by_count:int>>")),
    })


def _common(joined, *more):
    none = F.array().cast("array<string>")
    names = F.coalesce("authors", none)
    doi, arxiv = works.doi_id(F.col("doi_raw")), works.arxiv_id(F.col("arxiv_raw"))
    rows = joined.select(
        "work_no", "openalex_id", F.when(doi != "", "doi").otherwise("arxiv").alias("source_type"), F.when(doi != "", doi).otherwise(arxiv).alias("source_id"),
        F.lit("journal-article").alias("entry_type"), "title", names.alias("authors"), F.array_join(names, ", ").alias("author"), "year",
        F.when(doi != "", doi).alias("doi"), F.when(arxiv != "", arxiv).alias("arxiv_id"), F.lit(None).cast("string").alias("pdf_url"),
        F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).alias("source_url"), "abstract", F.col("cited_by").alias("cited_by_count"),
        *more, none.alias("referenced_works"),
        F.lit(0).cast("bigint").alias("related_works_count"), none.alias("related_works"), F.array("concept_1", "concept_2").alias("concepts"),
        F.lit("").alias("publication_date"),
        F.lit("").alias("primary_location_url"), F.lit("").alias("source_display_name"),
    )
    return rows.withColumn("citation_key", works.citation_key(F.col("authors"), F.col("author"), F.col("year"), F.col("title")))


_W = r"""doi_arxiv AS (SELECT *, lower(trim(regexp_replace(regexp_replace(coalesce(doi_raw, ''), '(?i)^https?://(dx\.)?doi\.org/', ''), '(?i)^doi:\s*', ''))) AS doi,
  regexp_replace(coalesce(arxiv_raw, ''), '(?i)^https?://arxiv\.org/(abs|pdf)/', '') AS arxiv FROM v_works),
names AS (SELECT work_no, string_agg(author, ', ' ORDER BY pos) AS author, arg_min(author, pos) AS first_author, count(*) AS n_authors,
  list(author ORDER BY pos) AS authors FROM v_work_authors GROUP BY work_no),
w AS (SELECT d.*, coalesce(n.author, '') AS author, coalesce(n.first_author, '') AS first_author, coalesce(n.n_authors, 0) AS n_authors, n.authors,
  CASE WHEN doi <> '' THEN 'doi-' || trim(regexp_replace(doi, '[^a-z0-9]+', '-', 'g'), '-') ELSE 'arxiv-' || trim(regexp_replace(lower(arxiv), '[^a-z0-9]+', '-', 'g'), '-') END AS source_key,
  CASE WHEN doi <> '' THEN doi ELSE arxiv END AS source_id, strip_accents(title) AS flat FROM doi_arxiv d LEFT JOIN names n ON n.work_no = d.work_no),
keyed AS (SELECT *, CASE WHEN first_author = '' THEN 'item' ELSE lower(regexp_replace(first_author, '[^A-Za-z0-9]', '', 'g')) END
  || CASE WHEN year = '' THEN 'undated' ELSE year END || lower(regexp_extract(flat, '([A-Za-z0-9]+)', 1)) AS citation_key,
  CASE n_authors WHEN 0 THEN '(Unknown, ' WHEN 1 THEN '(' || authors[1] || ', ' WHEN 2 THEN '(' || authors[1] || ' & ' || authors[2] || ', ' ELSE '(' || authors[1] || ' et al., ' END
    || CASE WHEN year = '' THEN 'n.d.' ELSE year END || ')' AS citation FROM w)"""
_VIEWS = ("v_works", "v_work_authors")
_YEARS = """years AS (SELECT work_no, list(year || ':' || cited_by_count ORDER BY year DESC) AS shown,
  '[' || string_agg('{"year":' || year || ',"cited_by_count":' || cited_by_count || '}', ',' ORDER BY year DESC) || ']' AS listed FROM v_work_years GROUP BY work_no)"""
_TREND = lambda n: f"coalesce(array_to_string(list_slice(y.shown, 1, {n}), ', '), 'not available')"


def _items(spark, sf):
    """Every work under its topic."""
    topics = view(spark, sf, "v_topics")
    w = work_rows(spark, sf, counted=False)
    return topics.join(w, "work_no").withColumn("citation", works.parenthetical(F.col("authors"), F.col("year")))


_TAGGED = r"""bodies AS (SELECT t.topic, t.pos, k.*, lower(title || ' ' || abstract || ' ' || concept_1 || ' ' || concept_2) AS body FROM v_topics t JOIN keyed k ON k.work_no = t.work_no),
tagged AS (SELECT *, list_filter([
  'literature-note',
  CASE WHEN contains(lower(topic), 'data governance') OR regexp_matches(topic || ' ' || body, '数据治理|governance') THEN 'data-governance' END,
  CASE WHEN contains(lower(topic), 'data governance') OR regexp_matches(topic || ' ' || body, '数据治理|governance') THEN 'governance-mechanism' END,
  CASE WHEN contains(lower(topic), 'digital transformation') OR regexp_matches(topic || ' ' || body, '数智转型|数字化转型|transformation') THEN 'digital-transformation' END,
  CASE WHEN contains(lower(topic), 'intelligent') OR regexp_matches(topic || ' ' || body, '数智|智能|intelligent|ai') THEN 'intelligent-transformation' END,
  CASE WHEN contains(body, 'platform') THEN 'platform-governance' END,
  CASE WHEN regexp_matches(body, 'organiz|enterprise|firm') THEN 'organizational-capability' END,
  CASE WHEN regexp_matches(body, 'framework|model|mechanism') THEN 'framework' END,
  CASE WHEN regexp_matches(body, 'case study|case-study') THEN 'case-study' WHEN regexp_matches(body, 'empirical|experiment|survey|dataset') THEN 'empirical' ELSE 'conceptual' END
  ], lambda x: x IS NOT NULL) AS tags FROM bodies)"""
_TV = (*_VIEWS, "v_topics")


def a5(spark, sf):
    """Works as payload JSON, written by Spark from the part table, read back through the A5 source."""
    w = work_rows(spark, sf).join(view(spark, sf, "v_works").select("work_no", "doi_raw"), "work_no")
    words = F.split("abstract", " ")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda t: F.struct(
        t.alias("key"), F.filter(F.transform(words, lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull()).alias("value"))))
    payload = F.struct(
        F.col("openalex_id").alias("id"), F.col("doi_raw").alias("doi"), F.concat(F.lit(" "), "title").alias("display_name"),
        F.col("year").alias("publication_year"), F.col("cited_by_count"), F.array_repeat(F.lit("r1"), 2).alias("referenced_works"),
        F.transform("concepts", lambda c: F.struct(c.alias("display_name"))).alias("concepts"),
        F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships"),
        F.array(F.struct(F.concat(F.lit("https://host/"), "openalex_id").alias("landing_page_url"))).alias("locations"), index.alias("abstract_inverted_index"),
    )
    out = works.works_from_json(w.select(F.to_json(payload).alias("value")))
    return plain(out.select("openalex_id", "source_id", "title", "author", "year", "doi", "source_url", "abstract", "citation_key", "cited_by_count",
                            "referenced_works_count", "concepts", "entry_type"))


A5 = oracle("""SELECT openalex_id, CASE WHEN doi <> '' THEN doi ELSE openalex_id END AS source_id, title, author, year, nullif(doi, '') AS doi,
  'https://host/' || openalex_id AS source_url, abstract, citation_key, cited_by AS cited_by_count, 1::BIGINT AS referenced_works_count,
  concept_1 || '|' || concept_2 AS concepts, 'journal-article' AS entry_type FROM keyed""", *_VIEWS, using=(_W,))


def a6(spark, sf):
    """Works as Atom entries, each written twice by Spark, read back through the A6 source."""
    w = work_rows(spark, sf).where("arxiv_id is not null")
    people = F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author><name>"), a, F.lit("</name></author>"))), "")
    xml = F.concat(
        F.lit("<entry><id>http://arxiv.org/abs/"), "arxiv_id", F.lit("</id><published>"), "year", F.lit("-03-02T00:00:00Z</published><title>"),
        F.replace("title", F.lit(" "), F.lit("\n  ")), F.lit("</title><summary>"), "abstract", F.lit("</summary>"), people,
        F.lit('<arxiv:primary_category xmlns:arxiv="http://arxiv.org/schemas/atom" term="cs.IR"/></entry>'),
    )
    entries = works.entries_from_xml(w.select(F.explode(F.array(xml, xml)).alias("value")))
    return plain(entries.select("arxiv_id", "title", "author", "year", "pdf_url", "source_url", "abstract", "primary_category", "citation_key"))


A6 = oracle("""SELECT arxiv AS arxiv_id, title, author, year, 'https://arxiv.org/pdf/' || arxiv || '.pdf' AS pdf_url, 'https://arxiv.org/abs/' || arxiv AS source_url,
  abstract, 'cs.IR' AS primary_category, citation_key FROM keyed WHERE arxiv <> ''""", *_VIEWS, using=(_W,))


def a13(spark, sf):
    """Source lists of every part: a DOI, an arXiv link, a PDF and a bare id in one free text."""
    v = view(spark, sf, "v_works").select(
        "work_no", F.concat(F.coalesce("doi_raw", F.lit("")), F.lit(", "), F.coalesce("arxiv_raw", F.lit("")), F.lit("\npdf: /p/"), "openalex_id", F.lit(".PDF,"),
                            "openalex_id", F.lit(".pdf?x=1\n\n10.1/A"), "work_no").alias("text")
    )
    return plain(dims.source_requests(v, ["work_no"]))


A13 = oracle(r"""WITH l AS (SELECT work_no, unnest(list_filter([
  {'t': 'doi', 's': doi}, {'t': 'arxiv', 's': arxiv}, {'t': 'pdf', 's': '/p/' || openalex_id || '.PDF'}, {'t': 'pdf', 's': openalex_id || '.pdf?x=1'},
  {'t': 'doi', 's': '10.1/a' || work_no}], lambda x: x.s <> '')) AS r,
  generate_subscripts(list_filter([doi, arxiv, 'a', 'b', 'c'], lambda x: x <> ''), 1) - 1 AS pos FROM doi_arxiv)
SELECT work_no, pos, r.t AS source_type, r.s AS source FROM l""", "v_works", using=(_W.split(",\nnames AS")[0],))


def c10(spark, sf):
    return plain(works.deduplicate(work_rows(spark, sf, counted=False), "work_no").select("source_key", "copies", "work_no", "note_path", "citation_key"))


C10 = oracle(f"""SELECT source_key, count(*) AS copies, max(work_no) AS work_no, '{fixed.LITERATURE_FOLDER}/' || source_key || '.md' AS note_path,
  arg_max(citation_key, work_no) AS citation_key FROM keyed GROUP BY source_key""", *_VIEWS, using=(_W,))


def c11(spark, sf):
    w = work_rows(spark, sf)
    return plain(w.select("work_no", works.parenthetical(F.col("authors"), F.col("year")).alias("citation"), works.citation_author(F.col("authors"), F.col("author")).alias("first")))


C11 = oracle("SELECT work_no, citation, CASE WHEN n_authors = 0 THEN 'Unknown' ELSE authors[1] END AS first FROM keyed", *_VIEWS, using=(_W,))


def g5(spark, sf):
    return plain(works.literature_map(_items(spark, sf)).drop("first_tag_pos"))


G5 = oracle(f"""WITH t AS (SELECT topic, pos, citation, unnest(tags) AS tag FROM tagged), f AS (SELECT * FROM t WHERE tag IN ({", ".join(f"'{t}'" for t in fixed.MAP_TAGS)}))
SELECT topic, tag, count(*) OVER (PARTITION BY topic, tag) AS works, min(pos) OVER (PARTITION BY topic, tag) AS first_pos, pos, citation FROM f""", *_TV, using=(_W, _TAGGED))


def g6(spark, sf):
    return plain(works.matrix_rows(_items(spark, sf)))


G6 = oracle(f"""SELECT topic, pos, replace(title, '|', '/') AS title, year, coalesce(list_filter(tags, lambda x: x IN ({", ".join(f"'{t}'" for t in fixed.METHOD_TAGS)}))[1], 'conceptual') AS method,
  cited_by AS cited_by_count, concept_1 || ', ' || concept_2 AS concepts, replace(regexp_extract(abstract, '^(.+?[.!?])(?:\\s|$)', 1), '|', '/') AS contribution,
  array_to_string(list_filter(tags, lambda x: x <> 'literature-note'), ', ') AS tags FROM tagged""", *_TV, using=(_W, _TAGGED))


def g7(spark, sf):
    return plain(works.tagged(_items(spark, sf)).select("topic", "pos", "tags"))


G7 = oracle("SELECT topic, pos, array_to_string(tags, '|') AS tags FROM tagged", *_TV, using=(_W, _TAGGED))


def g8(spark, sf):
    return plain(works.topic_tags(_items(spark, sf)))


G8 = oracle(f"""SELECT DISTINCT topic, tag FROM (SELECT topic, 'topic-note' AS tag FROM tagged UNION ALL
  SELECT topic, CASE WHEN topic LIKE '%governance' THEN 'data-governance' ELSE 'intelligent-transformation' END FROM tagged UNION ALL
  SELECT topic, unnest(tags) FROM tagged) x WHERE tag NOT IN ({", ".join(f"'{t}'" for t in fixed.NON_TOPIC_TAGS)})""", *_TV, using=(_W, _TAGGED))


def g9(spark, sf):
    return plain(works.topic_statistics(_items(spark, sf)))


G9 = oracle("""SELECT topic, count(*) AS works, sum(cited_by)::BIGINT AS cited_by_total, max(cited_by) AS cited_by_max, round(avg(cited_by), 4) AS cited_by_avg
FROM v_topics t JOIN v_works w ON w.work_no = t.work_no GROUP BY topic""", "v_topics", "v_works")


def g9_works(spark, sf):
    return plain(works.citation_statistics(work_rows(spark, sf)))


G9_WORKS = oracle(f"""SELECT source_id, cited_by AS cited_by_count, coalesce(r.n, 0) AS reference_count, 0::BIGINT AS related_count, concept_1 || ', ' || concept_2 AS concepts,
  {_TREND(3)} AS trend FROM w LEFT JOIN (SELECT work_no, count(*) AS n FROM v_work_references GROUP BY 1) r ON r.work_no = w.work_no LEFT JOIN years y ON y.work_no = w.work_no""",
    *_VIEWS, "v_work_references", "v_work_years", using=(_W, _YEARS))


def t2(spark, sf):
    topics = view(spark, sf, "v_topics").join(view(spark, sf, "v_works").select("work_no", F.col("cited_by").alias("cited_by_count")), "work_no")
    return plain(works.top_cited(topics).select("topic", "rank", "work_no", "cited_by_count"))


T2 = oracle("""SELECT topic, rank, work_no, cited_by_count FROM (SELECT topic, t.work_no, cited_by AS cited_by_count,
  row_number() OVER (PARTITION BY topic ORDER BY cited_by DESC, pos) AS rank FROM v_topics t JOIN v_works w ON w.work_no = t.work_no) x WHERE rank <= 2""", "v_topics", "v_works")


def t4(spark, sf):
    return plain(works.capped_sources(view(spark, sf, "v_topics")))


T4 = oracle("SELECT * FROM (SELECT topic, work_no, pos, row_number() OVER (PARTITION BY topic ORDER BY pos) AS rank FROM v_topics) x WHERE rank <= 3", "v_topics")


def j10(spark, sf):
    """Entries of every second work carry its DOI; works with a DOI enrich them."""
    w = work_rows(spark, sf, counted=False)
    doi = works.doi_id(F.col("doi_raw"))
    asked = view(spark, sf, "v_works").select("work_no", F.when(doi != "", doi).alias("doi"))
    entries = asked.select(
        F.lit("arxiv").alias("source_type"), F.concat(F.lit("24.1"), "work_no").alias("source_id"), F.lit("preprint").alias("entry_type"),
        F.concat(F.lit("Preprint "), "work_no").alias("title"), F.array(F.lit("Ann Ode")).alias("authors"), F.lit("Ann Ode").alias("author"), F.lit("2024").alias("year"),
        F.concat(F.lit("24.1"), "work_no").alias("arxiv_id"), F.when(F.col("work_no") % 2 == 0, F.col("doi")).alias("doi"), F.lit(None).cast("string").alias("pdf_url"),
        F.lit("https://arxiv.org/abs/x").alias("source_url"), F.lit("A").alias("abstract"), F.lit("ode2024preprint").alias("citation_key"),
    )
    known = works.deduplicate(w.where("doi is not null"), "work_no")
    return plain(works.enrich_by_doi(entries, known).select("source_id", "title", "author", "year", "entry_type", "doi", "source_url", "citation_key", "cited_by_count", "enriched"))


J10 = oracle("""WITH known AS (SELECT * FROM keyed WHERE doi <> '' QUALIFY row_number() OVER (PARTITION BY doi ORDER BY work_no DESC) = 1)
SELECT '24.1' || e.work_no AS source_id, coalesce(k.title, 'Preprint ' || e.work_no) AS title, coalesce(k.author, 'Ann Ode') AS author, coalesce(k.year, '2024') AS year,
  CASE WHEN k.doi IS NULL THEN 'preprint' ELSE 'journal-article' END AS entry_type, CASE WHEN e.work_no % 2 = 0 THEN nullif(e.doi, '') END AS doi,
  'https://arxiv.org/abs/x' AS source_url, 'ode2024preprint' AS citation_key, coalesce(k.cited_by, 0) AS cited_by_count, k.doi IS NOT NULL AS enriched
FROM keyed e LEFT JOIN known k ON e.work_no % 2 = 0 AND k.doi = e.doi AND e.doi <> ''""", *_VIEWS, using=(_W,))


def j11(spark, sf):
    """PDF requests of every work: by DOI, by arXiv id or by file name, some with an explicit title."""
    w = work_rows(spark, sf, counted=False)
    n = F.col("work_no")
    asked = w.select(
        F.concat(F.lit("/papers/Scan "), n, F.lit(".v1.pdf")).alias("source"), F.when(n % 3 == 0, F.col("doi")).otherwise("").alias("metadata_doi"),
        F.when(n % 3 != 1, F.col("arxiv_id")).otherwise("").alias("metadata_arxiv"), F.when(n % 4 == 0, F.lit("Own title")).otherwise("").alias("title"),
        F.when(n % 8 == 0, F.lit("Zed Yu, Al Ba")).otherwise("").alias("authors"), F.lit("").alias("year"),
    )
    known = works.deduplicate(w.where("doi is not null"), "work_no")
    entries = w.where("arxiv_id is not null").select("arxiv_id", "title", "authors", "year", F.lit("preprint").alias("entry_type"), "citation_key", "abstract")
    return plain(works.pdf_sources(asked, known, entries).select("source", "source_id", "entry_type", "title", "author", "year", "citation_key"))


J11 = oracle(r"""WITH known AS (SELECT * FROM keyed WHERE doi <> '' QUALIFY row_number() OVER (PARTITION BY doi ORDER BY work_no DESC) = 1),
q AS (SELECT *, '/papers/Scan ' || work_no || '.v1.pdf' AS src, CASE WHEN work_no % 3 = 0 THEN doi ELSE '' END AS qd, CASE WHEN work_no % 3 <> 1 THEN arxiv ELSE '' END AS qa,
  CASE WHEN work_no % 4 = 0 THEN 'Own title' ELSE '' END AS qt, CASE WHEN work_no % 8 = 0 THEN 'Zed Yu, Al Ba' ELSE '' END AS qn FROM keyed),
f AS (SELECT q.src, q.work_no AS wn, qd, qa, qt, qn, coalesce(d.title, a.title) AS ft, coalesce(d.author, a.author, '') AS fa, coalesce(d.year, a.year, '') AS fy,
  coalesce(d.citation_key, a.citation_key) AS fk, CASE WHEN d.doi IS NOT NULL THEN 'journal-article' WHEN a.arxiv IS NOT NULL THEN 'preprint' ELSE 'pdf-document' END AS et
  FROM q LEFT JOIN known d ON qd <> '' AND d.doi = qd LEFT JOIN keyed a ON qd = '' AND qa <> '' AND a.arxiv = qa),
m AS (SELECT src, wn, et, CASE WHEN et = 'journal-article' THEN qd WHEN et = 'preprint' THEN qa ELSE src END AS source_id,
  CASE WHEN qt <> '' THEN qt ELSE coalesce(ft, 'Scan ' || wn || '.v1') END AS title, CASE WHEN qn <> '' THEN qn ELSE fa END AS author, fy AS year, fk FROM f)
SELECT src AS source, source_id, et AS entry_type, title, author, year,
  coalesce(fk, CASE WHEN author = '' THEN 'item' ELSE 'yu' END || 'undated' || lower(regexp_extract(title, '([A-Za-z0-9]+)', 1))) AS citation_key FROM m""", *_VIEWS, using=(_W,))


def c12(spark, sf):
    w = work_rows(spark, sf)
    asked = view(spark, sf, "v_topics").join(w.select("work_no", works.key_of(w).alias("source_key")), "work_no").select("topic", "pos", "source_key")
    firsts = asked.groupBy("topic", "source_key").agg(F.min("pos").alias("pos"))
    notes = workspace.workspaces(firsts, works.deduplicate(w, "work_no").drop("source_key", "copies", "note_path"))
    return plain(notes.select("topic", "kind", "path", F.length("content").alias("chars"), F.md5("content").alias("digest")))


def k1(spark, sf):
    notes = works.literature_notes(works.deduplicate(work_rows(spark, sf), "work_no"), "2024-01-01T00:00:00.000Z")
    return plain(notes.select("path", "content"))


_J = lambda x: f"to_json({x})::VARCHAR"
K1 = oracle(f"""WITH f AS (SELECT w.*, coalesce(r.n, 0) AS refs, citation_key AS ck FROM keyed w LEFT JOIN (SELECT work_no, count(*) AS n FROM v_work_references GROUP BY 1) r ON r.work_no = w.work_no
  QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY w.work_no DESC) = 1)
SELECT '{fixed.LITERATURE_FOLDER}/' || source_key || '.md' AS path, concat_ws(chr(10), '---', 'title: ' || {_J('title')}, 'authors: ' || coalesce({_J('authors')}, '[]'), 'author: ' || {_J('author')},
  'year: ' || {_J('year')}, 'source_id: ' || {_J('source_id')}, 'source_type: "' || CASE WHEN doi <> '' THEN 'doi' ELSE 'arxiv' END || '"', 'entry_type: "journal-article"', 'citekey: ' || {_J('ck')},
  'doi: ' || {_J('doi')}, 'arxiv_id: ' || {_J('arxiv')}, 'openalex_id: ' || {_J('openalex_id')}, 'cited_by_count: ' || cited_by, 'referenced_works: []', 'referenced_works_count: ' || refs,
  'related_works: []', 'related_works_count: 0', 'concepts: ' || to_json([concept_1, concept_2])::VARCHAR, 'counts_by_year: ' || coalesce(y.listed, '[]'), 'publication_date: ""', 'primary_location_url: ""',
  'source_display_name: ""', 'pdf: ""', 'pdf_url: ""', 'source_url: "' || CASE WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END || '"', 'imported_at: "2024-01-01T00:00:00.000Z"',
  'tags:', '  - literature-note', '---', '# ' || title, '## Source', '- Source ID: ' || source_id, '- Source type: ' || CASE WHEN doi <> '' THEN 'doi' ELSE 'arxiv' END,
  '- Entry type: journal-article', '- DOI: ' || nullif(doi, ''), '- arXiv: ' || nullif(arxiv, ''), '- OpenAlex: ' || openalex_id, '- Landing page: https://doi.org/' || nullif(doi, ''),
  '- PDF: Not attached', '## Citation context', '- Cited by: ' || cited_by, '- Referenced works tracked: ' || refs, '- Related works tracked: 0',
  '- OpenAlex concepts: ' || concept_1 || ', ' || concept_2, '- Recent citation counts: ' || {_TREND(5)}, '## Abstract', abstract, '## Notes', '## Exact references', '## Relations', '## Tags') AS content
FROM f LEFT JOIN years y ON y.work_no = f.work_no""", *_VIEWS, "v_work_references", "v_work_years", using=(_W, _YEARS))

QUERIES = {
    "A5_works_json": Query(a5, A5),
    "A6_works_atom": Query(a6, A6),
    "A13_source_lists": Query(a13, A13),
    "C10_work_keys": Query(c10, C10),
    "C11_citations": Query(c11, C11),
    "G5_literature_map": Query(g5, G5),
    "G6_comparison_matrix": Query(g6, G6),
    "G7_rule_tags": Query(g7, G7),
    "G8_topic_tags": Query(g8, G8),
    "G9_topic_citations": Query(g9, G9),
    "G9_work_citations": Query(g9_works, G9_WORKS),
    "T2_top_cited": Query(t2, T2),
    "T4_capped_sources": Query(t4, T4),
    "J10_doi_enrichment": Query(j10, J10),
    "J11_pdf_sources": Query(j11, J11),
    "C12_topic_workspaces": Query(c12),
    "K1_literature_notes": Query(k1, K1),
}
