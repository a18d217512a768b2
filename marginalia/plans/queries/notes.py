"""Queries over note tables: A2–A4, P1–P4, G1–G3, J14, J15, A12, C5–C7, C9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.text import distinct_ci
from ...operators import migrate, notes, tags
from ...sources import dims
from ...sources.views import table
from .common import BODY, LINES, TAGS, TRIM, Query, on_view, oracle, plain, view

# the user's alias settings of the tag queries
ALIASES = [("src1", "source-one"), ("src1", "Quality-1"), ("Quality-0", "low"), ("language", "DE"), ("language", "fr"), ("mixed", "en")]
_ALIAS_SQL = "alias(canonical, alias) AS (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in ALIASES) + ")"


def alias_frame(spark):
    return spark.createDataFrame(ALIASES, "canonical string, alias string")


def _facts(spark, sf):
    return notes.note_facts(view(spark, sf, "v_notes"))


def _facet_words_sql() -> str:
    import json

    rows = []
    for no, (facet, entries) in enumerate(json.loads(fixed.DEFAULT_FACETS_JSON).items()):
        for canonical, aliases in entries.items():
            rows += [(no, facet, canonical, a) for a in aliases]
    values = ", ".join(f"({no}, '{f}', '{c}', '{a}')" for no, f, c, a in rows)
    return (
        f"facet(facet_no, facet, canonical, alias) AS (VALUES {values}), facet_keys AS (SELECT tag_key, arg_min(facet, facet_no) AS facet FROM ("
        "SELECT lower(canonical) AS tag_key, facet, facet_no FROM facet UNION ALL SELECT lower(alias), facet, facet_no FROM facet) f GROUP BY tag_key)"
    )


def a2(spark, sf):
    return plain(notes.frontmatter_table(view(spark, sf, "v_notes")).select("path", "key", "kind", "value"))


A2 = oracle(rf"""WITH head AS (
  SELECT path, unnest(string_split(regexp_extract(content, '^---\n([\s\S]*?)\n---', 1), chr(10))) AS line FROM v_notes),
kv AS (SELECT path, trim(split_part(line, ':', 1)) AS key, trim(substr(line, instr(line, ':') + 1)) AS raw FROM head WHERE instr(line, ':') > 1)
SELECT path, key,
  CASE WHEN NOT json_valid(raw) THEN 'text' WHEN raw LIKE '"%' THEN 'string' WHEN raw LIKE '[%' THEN 'array' WHEN raw LIKE '{{%' THEN 'object' ELSE 'number' END AS kind,
  CASE WHEN json_valid(raw) AND raw LIKE '"%' THEN json_extract_string(raw, '$') ELSE raw END AS value
FROM kv WHERE key <> 'tags'""", "v_notes")

A3 = oracle(f"SELECT path, unnest(string_split({BODY}, chr(10))) AS text, generate_subscripts(string_split({BODY}, chr(10)), 1) AS line_no FROM v_notes", "v_notes")

A4 = oracle(rf"""WITH flags AS (
  SELECT path, line_no, line, regexp_matches(line, '^\s*(```|~~~)') AS fence,
    sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS fences,
    sum(CASE WHEN line = '---' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS rules
  FROM lines),
live AS (SELECT path, line_no, line FROM flags WHERE NOT fence AND fences % 2 = 0 AND rules >= 2)
SELECT path, line_no, 'tag' AS kind, v AS value, '' AS detail FROM (
  SELECT path, line_no, unnest(regexp_extract_all(line, '(?:^|\s)#([\p{{L}}\p{{N}}_/-]+)', 1)) AS v FROM live) t WHERE regexp_matches(v, '[^0-9]')
UNION ALL
SELECT path, line_no, 'heading', regexp_extract(line, '^(#{{1,6}})[ \t]+(.*?)[ \t]*#*[ \t]*$', 2), regexp_extract(line, '^(#{{1,6}})[ \t]', 1)
FROM live WHERE regexp_matches(line, '^#{{1,6}}[ \t]+')
UNION ALL
SELECT path, line_no, 'wikilink', trim(v), coalesce(d, '') FROM (
  SELECT path, line_no, unnest(regexp_extract_all(line, '\[\[([^\]\[|#\n]+)(#[^\]|\n]*)?(?:\|([^\]\n]+))?\]\]', 1)) AS v,
    unnest(regexp_extract_all(line, '\[\[([^\]\[|#\n]+)(#[^\]|\n]*)?(?:\|([^\]\n]+))?\]\]', 2)) AS d FROM live) w
UNION ALL
SELECT path, line_no, 'block', regexp_extract(line, '\s+\^([A-Za-z0-9-]+)\s*$', 1), '' FROM live WHERE regexp_matches(line, '\s+\^([A-Za-z0-9-]+)\s*$')""",
    "v_notes", using=(LINES,))

_META = rf"""meta AS (
  SELECT path, nullif(regexp_extract(content, '\ncitekey: ([^\n]*)', 1), '') AS citekey,
    nullif(array_to_string(nullif(regexp_extract(content, '\nauthors: (\[[^\n]*\])', 1), '')::JSON::VARCHAR[], ', '), '') AS author,
    nullif(regexp_extract(content, '\nyear: (\d+)', 1), '') AS year, nullif(regexp_extract(content, '\nsource_type: ([^\n]*)', 1), '') AS source_type,
    nullif(regexp_extract(content, '\npage: (\d+)', 1), '') AS locator, nullif(regexp_extract(content, '\nevidence_kind: ([^\n]*)', 1), '') AS evidence_kind
  FROM v_notes)"""
P1 = oracle("SELECT * FROM meta WHERE coalesce(citekey, author, year, source_type, locator, evidence_kind) IS NOT NULL", "v_notes", using=(_META,))
P2 = oracle(rf"""SELECT path, substr(array_to_string(list_filter(list_transform(string_split({BODY}, chr(10)), lambda x: {TRIM('x')}),
  lambda x: x <> '' AND NOT starts_with(x, '#')), ' '), 1, 180) AS excerpt FROM v_notes""", "v_notes")
P3 = oracle("""SELECT path, chips FROM (SELECT path, concat_ws(' · ', '@' || citekey, nullif(concat_ws(' ', author, year), ''),
  replace(replace(source_type, '_', ' '), '-', ' '), replace(replace(evidence_kind, '_', ' '), '-', ' '), 'p. ' || locator) AS chips FROM meta) m WHERE chips <> ''""",
    "v_notes", using=(_META,))
_CODE = fixed.CODE_LIKE.replace("'", "''")
NATURAL = rf"""body AS (SELECT path, unnest(list_transform(string_split({BODY}, chr(10)), lambda x: {TRIM('x')})) AS text FROM v_notes),
c AS (SELECT path, text, length(text) AS n, length(regexp_replace(text, '[^\x{{3400}}-\x{{9fff}}]', '', 'g')) AS cjk,
  length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(text, '[^0-9\s]', '', 'g')) AS other FROM body),
prose AS (SELECT path, text FROM c WHERE n > 0 AND NOT regexp_matches(text, '{_CODE}')
  AND NOT (n - cjk - latin - other > greatest(8, floor((cjk + latin) * 0.7))) AND NOT (n > 220 AND n - cjk - latin - other > 4))"""
P4 = oracle(f"WITH {NATURAL} SELECT path, text, count(*) AS n FROM prose GROUP BY path, text", "v_notes")


def p4(spark, sf):
    rows = notes.natural_line_table(view(spark, sf, "v_notes"))
    return plain(rows.groupBy("path", "text").agg(F.count(F.lit(1)).alias("n")))


def g1(spark, sf):
    return plain(tags.tag_statistics(_facts(spark, sf), alias_frame(spark)).select("tag", "count", "aliases"))


G1 = oracle(f"""WITH {_ALIAS_SQL},
spelled AS (SELECT DISTINCT tag, tag_key FROM tags),
closure AS (
  SELECT s.tag_key, a.alias AS related FROM spelled s JOIN alias a ON a.canonical = s.tag
  UNION SELECT s.tag_key, a.canonical FROM spelled s JOIN alias a ON lower(a.alias) = s.tag_key WHERE s.tag NOT IN (SELECT canonical FROM alias)),
lists AS (SELECT tag_key, string_agg(related, '|' ORDER BY related) AS aliases FROM closure GROUP BY tag_key),
stats AS (SELECT tag_key, arg_min(tag, ((ext = 'excalidraw')::INT, ord, pos)) AS tag, count(*) AS count FROM tags GROUP BY tag_key)
SELECT s.tag, s.count, coalesce(l.aliases, '') AS aliases FROM stats s LEFT JOIN lists l USING (tag_key)""", "v_notes", using=(TAGS,))


def g2(spark, sf):
    return plain(tags.tags_by_facet(_facts(spark, sf), dims.default_facets(spark)))


G2 = oracle("""WITH j AS (SELECT t.path, t.pos, t.tag, k.facet FROM tags t LEFT JOIN facet_keys k USING (tag_key)),
g AS (SELECT path, facet, count(*) AS count, string_agg(tag, '|' ORDER BY pos) AS tags FROM j GROUP BY path, facet),
h AS (SELECT DISTINCT path FROM g WHERE facet IS NOT NULL)
SELECT g.path, CASE WHEN g.facet IS NOT NULL THEN replace(g.facet, '_', ' ') WHEN h.path IS NOT NULL THEN 'unclassified' END AS label, g.count, g.tags
FROM g LEFT JOIN h ON h.path = g.path""", "v_notes", using=(TAGS, _facet_words_sql()))


def g3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", distinct_ci(F.split("text", r"\n")).alias("lines"))
    return plain(docs.select("doc_id", F.size("lines").alias("lines"), F.md5(F.array_join("lines", "\n")).alias("digest")))


G3 = rf"""WITH l AS (SELECT doc_id, {TRIM('v')} AS v, i FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) a),
f AS (SELECT * FROM l WHERE v <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(v) ORDER BY i) = 1)
SELECT doc_id, count(*) AS lines, md5(string_agg(v, chr(10) ORDER BY i)) AS digest FROM f GROUP BY doc_id"""


def j14(spark, sf):
    return plain(tags.facet_of_tags(tags.note_tags(_facts(spark, sf)), dims.default_facets(spark)))


J14 = oracle("SELECT DISTINCT t.tag_key, k.facet FROM tags t LEFT JOIN facet_keys k USING (tag_key)", "v_notes", using=(TAGS, _facet_words_sql()))


def j15(spark, sf):
    return plain(tags.alias_closure(tags.note_tags(_facts(spark, sf)), alias_frame(spark)))


J15 = oracle(f"""WITH {_ALIAS_SQL}, spelled AS (SELECT DISTINCT tag, tag_key FROM tags)
SELECT s.tag, a.alias AS related FROM spelled s JOIN alias a ON a.canonical = s.tag
UNION SELECT s.tag, a.canonical FROM spelled s JOIN alias a ON lower(a.alias) = s.tag_key WHERE s.tag NOT IN (SELECT canonical FROM alias)""",
    "v_notes", using=(TAGS,))


def a12(spark, sf):
    return plain(dims.alias_rows(table(spark, sf, "events"), ["event_id"], "props"))


A12 = "SELECT event_id, 'k' AS canonical, cast(0 AS BIGINT) AS pos, json_extract_string(props, '$.k') AS alias FROM events"


def c6(spark, sf, old="draft", new="Sketch"):
    changed = tags.replace_tag(view(spark, sf, "v_notes"), old, new)
    return plain(changed.select("path", F.md5("content").alias("digest")))


C6_RENAME = oracle(r"""SELECT path, md5(CASE WHEN contains(content, ',"draft"]') THEN replace(content, ',"draft"]', ',"Sketch"]')
  ELSE regexp_replace(content, '(\ntags: \[[^\n]*)\]', '\1,"Sketch"]') END) AS digest FROM v_notes""", "v_notes")
C6_DELETE = oracle(r"""SELECT path, md5(replace(content, ' #inline-fr' || chr(10), ' ' || chr(10))) AS digest FROM v_notes WHERE contains(content, ' #inline-fr')""", "v_notes")


def c7(spark, sf):
    v = view(spark, sf, "v_notes")
    labels = table(spark, sf, "labels").withColumnRenamed("doc_id", "ord")
    asked = v.select("path", "ord").join(labels, "ord").select(
        "path", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("#reviewed").alias("tag")), F.struct(F.lit(1).alias("pos"), F.lit("SRC1").alias("tag")))).alias("r")
    ).select("path", "r.*")
    return plain(tags.append_tags(v, asked).select("path", "tags", F.md5("content").alias("digest")))


C7 = oracle(r"""WITH t AS (
  SELECT n.path, n.content, regexp_extract(content, '\ntags: (\[[^\n]*\])', 1)::JSON::VARCHAR[] AS have FROM v_notes n JOIN labels l ON l.doc_id = n.ord),
u AS (SELECT path, content, list_concat(have, ['reviewed'], CASE WHEN list_contains(have, 'src1') THEN [] ELSE ['SRC1'] END) AS want FROM t)
SELECT path, array_to_string(want, '|') AS tags,
  md5(regexp_replace(content, '\ntags: \[[^\n]*\]', chr(10) || 'tags: ' || to_json(want)::VARCHAR)) AS digest FROM u""", "v_notes")


def c9(spark, sf):
    v = view(spark, sf, "v_notes").withColumn("content", F.when(F.col("ord") % 2 == 0, F.concat("content", F.lit("\n%%\nend"))).otherwise(F.col("content")))
    out = migrate.append_section(v, v.select("path", F.concat(F.lit("Added to "), "basename").alias("text")))
    return plain(out.select("path", F.md5("content").alias("digest")))


C9 = oracle(r"""WITH n AS (SELECT path, basename, ext, name, CASE WHEN ord % 2 = 0 THEN content || chr(10) || '%%' || chr(10) || 'end' ELSE content END AS c FROM v_notes),
d AS (SELECT *, (ext = 'excalidraw' OR name LIKE '%.excalidraw.md') AND contains(c, chr(10) || '%%' || chr(10)) AS inside FROM n)
SELECT path, md5(CASE WHEN inside THEN replace(c, chr(10) || chr(10) || '%%' || chr(10) || 'end', chr(10) || 'Added to ' || basename || chr(10) || chr(10) || '%%' || chr(10) || 'end')
  WHEN c LIKE '%' || chr(10) THEN c || 'Added to ' || basename || chr(10) ELSE c || chr(10) || 'Added to ' || basename || chr(10) END) AS digest FROM d""", "v_notes")

def c7_relations(spark, sf):
    v = view(spark, sf, "v_notes")
    item = lambda key, pos, target: F.struct(F.lit(key).alias("relation_key"), F.lit(pos).alias("pos"), target.alias("target"))
    asked = v.select("path", F.inline(F.array(item("supports", 0, F.concat(F.lit("doc-"), F.col("ord") % 7)), item("supports", 1, F.lit("Notes/x.md")), item("extends", 0, F.lit("doc-1")))))
    return plain(tags.append_relations(v, asked))


C7_RELATIONS = oracle("""WITH r AS (SELECT path, 'supports' AS relation_key, ['doc-' || ((ord * 5 + 1) % 211), 'doc-' || (ord % 7), 'Notes/x.md'] AS t FROM v_notes
  UNION ALL SELECT path, 'extends', ['doc-1'] FROM v_notes)
SELECT path, relation_key, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS targets FROM r""", "v_notes")

QUERIES = {
    "A2_frontmatter": Query(a2, A2),
    "A3_lines": Query(on_view("v_notes", notes.line_table), A3),
    "A4_markup": Query(on_view("v_notes", lambda n: notes.markup_table(n).drop("pos")), A4),
    "A12_alias_dimension": Query(a12, A12),
    "P1_source_metadata": Query(on_view("v_notes", notes.metadata_table), P1),
    "P2_excerpts": Query(on_view("v_notes", notes.excerpt_table), P2),
    "P3_metadata_chips": Query(on_view("v_notes", notes.chip_table), P3),
    "P4_natural_lines": Query(p4, P4),
    "G1_tag_statistics": Query(g1, G1),
    "G2_tags_by_facet": Query(g2, G2),
    "G3_distinct_lists": Query(g3, G3),
    "J14_facet_lookup": Query(j14, J14),
    "J15_alias_closure": Query(j15, J15),
    "C6_rename_tag": Query(c6, C6_RENAME),
    "C6_delete_tag": Query(lambda s, d: c6(s, d, "inline-fr", None), C6_DELETE),
    "C7_append_tags": Query(c7, C7),
    "C7_append_relations": Query(c7_relations, C7_RELATIONS),
    "C9_append_section": Query(c9, C9),
}
