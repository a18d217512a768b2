"""Derived views over the driver tables.

The tables hold plain prose, so notes, works, feeds and change events are written over them as SQL that reads the
same in Spark and in the oracle. Everything is a projection of whole tables: no row is dropped and nothing is random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.settle import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_NL = "chr(10)"

# one note per document: frontmatter, heading, prose, links and references, a fenced block, a block id
NOTES = f"""
SELECT ord, path, dir, name, regexp_replace(name, '[.][^.]*$', '') AS basename, ext, content
FROM (
  SELECT d.doc_id AS ord,
    'Notes/' || d.source || '/' || d.lang AS dir,
    'doc-' || cast(d.doc_id AS string) || d.suffix AS name,
    'Notes/' || d.source || '/' || d.lang || '/doc-' || cast(d.doc_id AS string) || d.suffix AS path,
    CASE WHEN d.suffix = '.excalidraw' THEN 'excalidraw' ELSE 'md' END AS ext,
    '---' || {_NL}
    || 'title: "Doc ' || cast(d.doc_id AS string) || '"' || {_NL}
    || 'aliases: ["alias-' || cast(d.doc_id AS string) || '"]' || {_NL}
    || 'tags: ["' || d.source || '","' || d.lang || '"'
    || CASE WHEN l.quality IS NULL THEN '' ELSE ',"Quality-' || cast(l.quality AS string) || '"' END
    || CASE WHEN l.toxic = 1 THEN ',"toxic"' ELSE '' END
    || CASE WHEN d.doc_id % 6 = 0 THEN ',"draft"' ELSE '' END || ']' || {_NL}
    || 'supports: ["doc-' || cast((d.doc_id * 5 + 1) % 211 AS string) || '"]' || {_NL}
    || CASE WHEN d.doc_id % 3 = 0 THEN 'citekey: key' || cast(2000 + d.doc_id % 25 AS string) || {_NL}
         || 'authors: ["Smith ' || cast(d.doc_id % 9 AS string) || '","Lee"]' || {_NL}
         || 'year: ' || cast(2000 + d.doc_id % 25 AS string) || {_NL}
         || 'source_type: journal_article' || {_NL} ELSE '' END
    || CASE WHEN d.doc_id % 4 = 0 THEN 'page: ' || cast(d.doc_id % 300 AS string) || {_NL} ELSE '' END
    || CASE WHEN d.doc_id % 5 = 0 THEN 'evidence_kind: field-note' || {_NL} ELSE '' END
    || 'note: part of ' || d.lang || ': ' || d.source || {_NL}
    || '---' || {_NL}
    || '# Heading ' || d.lang || ' ' || cast(d.doc_id % 17 AS string) || {_NL}
    || d.text || {_NL}
    || CASE WHEN d.doc_id % 5 = 0 THEN '数据治理与数智转型' || {_NL} ELSE '' END
    || CASE WHEN d.doc_id % 7 = 0 THEN 'A survey of experiment and corpus work.' || {_NL} ELSE '' END
    || CASE WHEN d.doc_id % 11 = 0 THEN 'Compare doc-' || cast((d.doc_id * 3 + 2) % 157 AS string)
         || ' again.' || {_NL} ELSE '' END
    || CASE WHEN d.doc_id % 13 = 0 THEN 'As alias-' || cast((d.doc_id * 2 + 5) % 173 AS string)
         || ' says.' || {_NL} ELSE '' END
    || {_NL} || '## Links' || {_NL}
    || 'See [[doc-' || cast((d.doc_id * 7 + 3) % 199 AS string) || ']] and <<doc-'
    || cast(d.doc_id + 1 AS string) || ':1-3>> then (((doc-' || cast((d.doc_id * 13) % 199 AS string) || '#16))) plus [[doc-'
    || cast(d.doc_id % 50 AS string) || '#^b-1|q]] not `<<doc-' || cast(d.doc_id % 10 AS string)
    || ':1>>` end #inline-' || d.lang || {_NL}
    || '```' || {_NL} || '#code-tag [[doc-0]]' || {_NL} || '```' || {_NL}
    || 'Closing block of ' || d.source || ' ^b-1' || {_NL} AS content
  FROM (SELECT doc_id, text, lang, source,
          CASE WHEN doc_id % 40 = 39 THEN '.excalidraw.md' WHEN doc_id % 40 = 38 THEN '.excalidraw' ELSE '.md' END AS suffix
        FROM documents) d
  LEFT JOIN labels l ON l.doc_id = d.doc_id
) n
"""

# one work per part
WORKS = """
SELECT p.p_partkey AS work_no,
  'W' || cast(p.p_partkey AS string) AS openalex_id,
  CASE WHEN p.p_partkey % 5 = 0 THEN NULL
       WHEN p.p_partkey % 3 = 0 THEN 'https://doi.org/10.1000/P' || cast(p.p_partkey - p.p_partkey % 2 AS string)
       ELSE 'DOI: 10.1000/p' || cast(p.p_partkey - p.p_partkey % 2 AS string) END AS doi_raw,
  CASE WHEN p.p_partkey % 5 = 0 THEN 'https://arxiv.org/abs/24' || cast(10 + p.p_partkey % 3 AS string) || '.'
       || cast(10000 + p.p_partkey AS string) || 'v1' ELSE NULL END AS arxiv_raw,
  CASE p.p_partkey % 6 WHEN 0 THEN 'Data governance framework for ' WHEN 1 THEN 'Digital transformation survey of '
       WHEN 2 THEN 'Platform case study: ' WHEN 3 THEN 'Enterprise model of ' WHEN 4 THEN 'Notes | on '
       ELSE 'Élan and ' END || p.p_name AS title,
  'About ' || p.p_name || '. It studies ' || lower(p.p_type) || ' goods; more text follows! End' AS abstract,
  p.p_type AS concept_1, p.p_brand AS concept_2,
  cast(coalesce(s.cited_by, 0) AS bigint) AS cited_by,
  coalesce(cast(s.first_year AS string), '') AS year
FROM part p
LEFT JOIN (
  SELECT l.l_partkey, count(*) AS cited_by, min(year(o.o_orderdate)) AS first_year
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_partkey
) s ON s.l_partkey = p.p_partkey
"""

# citations of a work by year
WORK_YEARS = """
SELECT l.l_partkey AS work_no, cast(year(o.o_orderdate) AS int) AS year, cast(count(*) AS int) AS cited_by_count
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY l.l_partkey, year(o.o_orderdate)
"""

# ordered authors of a work: all its suppliers
WORK_AUTHORS = """
SELECT a.work_no, a.pos, s.s_name AS author
FROM (
  SELECT l_partkey AS work_no, l_suppkey, pos FROM (
    SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS pos
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) u
  ) r
) a JOIN supplier s ON s.s_suppkey = a.l_suppkey
"""

# a work references the part on the next line of the same order
WORK_REFERENCES = """
SELECT DISTINCT a.l_partkey AS work_no, b.ref_no
FROM lineitem a
JOIN (SELECT l_orderkey, l_linenumber - 1 AS prev_line, min(l_partkey) AS ref_no
      FROM lineitem GROUP BY l_orderkey, l_linenumber) b
  ON b.l_orderkey = a.l_orderkey AND b.prev_line = a.l_linenumber
WHERE b.ref_no <> a.l_partkey
"""

# one feed item per event; counts are text, as in the payload
FEED = """
SELECT 'f' || cast(event_id AS string) AS feed_id, event_id AS pos, ts AS published_at,
  CASE WHEN event_type IN ('view', 'click') THEN 'video' ELSE 'normal' END AS note_type,
  event_type || ' ' || CASE WHEN event_id % 4 = 0 THEN '数据治理与数智转型实践案例' ELSE 'item ' END
    || cast(event_id AS string) AS title,
  'u' || cast(user_id AS string) AS user_id,
  CASE WHEN event_id % 10 = 0 THEN '10+' ELSE cast(cast(floor(value) AS bigint) AS string) END AS liked_count,
  cast(event_id % 7 AS string) AS comment_count,
  cast(event_id % 11 AS string) AS collected_count,
  CASE WHEN user_id % 2 = 0 THEN 'local' ELSE 'far' END AS place,
  event_type = 'view' AS seen, user_id % 3 = 0 AS followed
FROM events
"""

# comments: turn 0 opens a thread, the other turns answer it
COMMENTS = """
SELECT 'n' || cast(conv_id % 40 AS string) AS note_id, 't' || cast(conv_id AS string) AS thread_id, conv_id AS thread_no,
  'c' || cast(conv_id AS string) || '-' || cast(turn AS string) AS comment_id, turn,
  CASE WHEN turn % 5 = 4 THEN 'many' ELSE cast((conv_id * 3 + turn) % 50 AS string) END AS like_count,
  text AS content
FROM conversations
"""

# change requests of the note views
CHANGES = """
SELECT event_id AS id, ts,
  CASE event_type WHEN 'view' THEN 'metadata' WHEN 'click' THEN 'mutation' WHEN 'error' THEN 'context'
    WHEN 'purchase' THEN 'settings' ELSE 'metadata' END AS reason,
  'Notes/u' || cast(user_id AS string) || '.md' AS path_1,
  CASE WHEN event_id % 3 = 0 THEN 'Notes/u' || cast(user_id + 1 AS string) || '.md' ELSE '' END AS path_2,
  CASE WHEN event_id % 4 = 0 THEN 'section-' || cast(event_id % 8 AS string) ELSE NULL END AS focus,
  event_type = 'error' AS force,
  event_id % 9 = 0 AS preserve_scroll
FROM events
"""

# evidence queries: the second word of every document, searched in its note
QUERIES = """
SELECT doc_id AS query_id,
  'Notes/' || source || '/' || lang || '/doc-' || cast(doc_id AS string)
    || CASE WHEN doc_id % 40 = 39 THEN '.excalidraw.md' WHEN doc_id % 40 = 38 THEN '.excalidraw' ELSE '.md' END AS path,
  split_part(text, ' ', 2) AS query,
  CASE WHEN doc_id % 2 = 0 THEN 'line' ELSE 'paragraph' END AS scope,
  CASE WHEN doc_id % 3 = 0 THEN 2 ELSE NULL END AS occurrence,
  CASE WHEN doc_id % 4 = 0 THEN 'block' ELSE 'line' END AS kind,
  1 + doc_id % 9 AS start_line,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 + doc_id % 9 + doc_id % 11 - doc_id % 3 END AS end_line
FROM documents
"""

# files of a folder tree before it is tidied up, each with a very short one beside it
FILES = """
SELECT ord, path,
  text || chr(10)
    || '[next](../doc-' || cast((ord + 8) % 800 AS string) || '.md#top) ![pic](img%20' || cast(ord % 3 AS string) || '.png) '
    || '[self](doc-' || cast(ord AS string) || '.md) [web](https://example.org/a) [up](../../' || source || '/doc-'
    || cast(ord AS string) || '.md) #ff00aa see https://example.org/x#frag and #root/abc1' || chr(10) AS content
FROM (
  SELECT doc_id AS ord, text, source,
    CASE doc_id % 8
      WHEN 0 THEN 'Journals/Log/Daily/' || cast(2020 + doc_id % 4 AS string) || '/' || cast(1 + doc_id % 12 AS string) || ' - Month/'
        || cast(1 + doc_id % 28 AS string) || ' - day ' || cast(doc_id % 5 AS string) || '/doc-' || cast(doc_id AS string) || '.md'
      WHEN 1 THEN 'Import/root/' || CASE doc_id % 3 WHEN 0 THEN 'Tech_note' WHEN 1 THEN 'Tech.old' ELSE 'Other' END || '/' || source || '/doc-'
        || cast(doc_id AS string) || '.md'
      WHEN 2 THEN 'Knowledge/Tech/' || source || '/part  one/' || lang || '/doc-' || cast(doc_id AS string) || '.md'
      WHEN 3 THEN 'Knowledge/Tech/' || source || '/doc-' || cast(doc_id AS string) || '.md'
      WHEN 4 THEN 'Misc/' || source || '/' || lang || cast(doc_id AS string) || '/2.md'
      WHEN 5 THEN 'Misc/' || source || '/_keep-' || cast(doc_id AS string) || '.md'
      WHEN 6 THEN 'Import/root/' || CASE WHEN doc_id % 3 = 0 THEN 'Demo_' ELSE 'Deep-' END || cast(doc_id AS string) || '/' || source || '/page.html'
      ELSE 'Archive/' || source || '/' || lang || '/old/doc-' || cast(doc_id AS string) || '.md' END AS path
  FROM documents
) f
UNION ALL
SELECT 1000000000000 + doc_id, 'Misc/' || source || '/' || lang || '/short-' || cast(doc_id AS string) || '.md', '# T' || chr(10) || 'hi'
FROM documents
"""

# topics: one per brand, whose sources are its works in part order
TOPICS = """
SELECT p_brand || CASE WHEN p_size % 2 = 0 THEN ' data governance' ELSE ' intelligent work' END AS topic, p_partkey AS work_no, p_partkey AS pos
FROM part
"""

# recogniser results: every sentence of a turn first as its beginning, then as the finished text
_ASR = """
SELECT session, turn, n, is_endpoint, CASE WHEN is_endpoint THEN part || ' 在显价值 ' ELSE substr(part, 1, 5) END AS text
FROM (SELECT session, turn, n, part, false AS is_endpoint FROM (SENTENCES) a WHERE part <> ''
      UNION ALL SELECT session, turn, n, part, true FROM (SENTENCES) b WHERE part <> '') c
"""
ASR = _ASR.replace("SENTENCES", "SELECT conv_id AS session, turn, pos + 1 AS n, part FROM conversations LATERAL VIEW posexplode(split(text, '[.]')) s AS pos, part")
ASR_ORACLE = _ASR.replace(
    "SENTENCES",
    "SELECT conv_id AS session, turn, unnest(string_split(text, '.')) AS part, generate_subscripts(string_split(text, '.'), 1) AS n FROM conversations",
)

# status polls of artifacts and the jobs that wait for them
POLLS = """
SELECT ts, 'nb' || cast(user_id % 20 AS string) AS notebook_id, 'a' || cast(event_id % 400 AS string) AS artifact_id,
  CASE event_id % 4 WHEN 0 THEN 'report' WHEN 1 THEN 'audio' WHEN 2 THEN 'mind_map' ELSE 'video' END AS type,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status,
  cast(event_id % 97 AS string) AS created_at
FROM events
"""
WATCH_JOBS = """
SELECT DISTINCT 'nb' || cast(user_id % 20 AS string) || '-' || cast(user_id % 3 AS string) AS job_id,
  'nb' || cast(user_id % 20 AS string) AS notebook_id,
  CASE user_id % 3 WHEN 0 THEN 'report' WHEN 1 THEN 'audio' ELSE 'infographic' END AS artifact_type, cast(NULL AS string) AS artifact_id
FROM events
"""

VIEWS = {
    "v_notes": NOTES, "v_works": WORKS, "v_work_authors": WORK_AUTHORS, "v_work_references": WORK_REFERENCES, "v_work_years": WORK_YEARS,
    "v_feed": FEED, "v_comments": COMMENTS, "v_changes": CHANGES,
    "v_queries": QUERIES, "v_files": FILES, "v_topics": TOPICS, "v_asr": ASR, "v_polls": POLLS, "v_watch_jobs": WATCH_JOBS,
}
# views whose text differs where the oracle's engine unnests another way
ORACLE_VIEWS = {**VIEWS, "v_asr": ASR_ORACLE}


# tables whose rows carry text or vectors: worth spreading when a small file gives a single split
HEAVY = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, HEAVY[name]) if name in HEAVY else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the tables in ``sf_dir``; only the tables it names are read."""
    text = VIEWS[name]
    wanted = [t for t in TABLES if f" {t}" in text]
    frames = {t: table(spark, sf_dir, t) for t in wanted}
    for t in wanted:
        for old, new in ((f"FROM {t}", f"FROM {{{t}}}"), (f"JOIN {t}", f"JOIN {{{t}}}")):
            text = text.replace(f"{old} ", f"{new} ").replace(f"{old})", f"{new})").replace(f"{old}\n", f"{new}\n")
    return spark.sql(text, **frames)


def with_views(sql: str, *names: str) -> str:
    """Oracle SQL that starts with the named views as common table expressions."""
    ctes = ", ".join(f"{n} AS ({ORACLE_VIEWS[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
