"""The reference graph: target resolution, edges, backlinks, dangling targets, relations, note dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import distinct_ci, let, trim_all
from .notes import (
    as_list, entries, file_rank, frontmatter_links, is_drawing, key_facts, note_tags, outside_fences, raw_value, relation_table, relations_in, wikilinks,
    wikilinks_in,
)
from .refs import block_table, block_targets, line_targets, preview_table, range_label, reference_targets, references
from .settle import settle


def target_key(raw: Column) -> Column:
    return F.lower(trim_all(raw))


def note_keys(facts: DataFrame) -> DataFrame:
    """One row per lower-cased key: the note it stands for.

    A path (with or without ``.md``) is looked up first, as the host does; after that the first note in file order
    whose path, basename, name or alias equals the key. Ties are settled by a partial aggregate, so a basename shared
    by very many notes costs one row per map task.
    """
    link_path = F.lower(F.col("path"))
    direct = F.array(link_path, F.regexp_replace(link_path, r"\.md$", ""))
    loose = F.concat(F.array(F.lower("basename"), F.lower("name")), F.transform("aliases", F.lower))
    keyed = F.concat(
        F.transform(direct, lambda k: F.struct(F.lit(0).alias("stage"), k.alias("key"))),
        F.transform(loose, lambda k: F.struct(F.lit(1).alias("stage"), k.alias("key"))),
    )
    rows = facts.select("path", "basename", file_rank(F.col("ext"), F.col("ord")).alias("rank"), F.explode(keyed).alias("k"))
    return rows.groupBy(F.col("k.key").alias("key")).agg(
        F.min_by(F.struct("path", "basename"), F.struct("k.stage", "rank")).alias("n")
    ).select("key", F.col("n.path").alias("target_path"), F.col("n.basename").alias("target_basename"))


def resolve(rows: DataFrame, keys: DataFrame, target: str = "target", how: str = "inner") -> DataFrame:
    """Equi join of raw targets with the key table (unique on its side; AQE splits a hub key on the other)."""
    left = rows.withColumn("key", target_key(F.col(target)))
    return left.join(keys, "key", how).drop("key")


def resolution_table(notes: DataFrame) -> DataFrame:
    """Every raw target of the corpus with its note, or null."""
    content = F.col("content")
    raw = notes.select(F.explode(F.concat(reference_targets(content), wikilinks(content))).alias("target"))
    return resolve(raw.distinct(), note_keys(key_facts(notes)), how="left").select("target", "target_path")


def _hosts(pairs: Column, body: Column) -> Column:
    """Raw targets of the links the host knows itself: wikilinks and frontmatter links."""
    return F.concat(wikilinks_in(body), frontmatter_links(pairs))


def _aliases(pairs: Column) -> Column:
    return distinct_ci(as_list(raw_value(pairs, "aliases", "alias")))


def read_hosts(notes: DataFrame, **extra: Column) -> DataFrame:
    """What a note is found by, and its ``hosts``: raw targets of its wikilinks and frontmatter links, from one pass over the text. ``extra`` columns come
    from the same pass."""
    content = F.col("content")
    found = let(entries(content), lambda fm: F.struct(_aliases(fm).alias("aliases"), _hosts(fm, outside_fences(content)).alias("hosts")))
    return notes.select("path", "ord", "name", "basename", "ext", F.inline(F.array(found)), *[value.alias(name) for name, value in extra.items()])


def read_notes(notes: DataFrame) -> DataFrame:
    """All that a dashboard counts, from one pass over the text: what ``read_hosts`` gives, the number of tags, the targets of line and block references
    and the relations with their raw targets."""
    content = F.col("content")
    found = let(
        F.struct(entries(content).alias("fm"), outside_fences(content).alias("body")),
        lambda n: F.struct(
            _aliases(n["fm"]).alias("aliases"), _hosts(n["fm"], n["body"]).alias("hosts"),
            F.size(note_tags(n["fm"], n["body"])).alias("tags"), relations_in(n["fm"]).alias("relations"),
        ),
    )
    return notes.select(
        "path", "ord", "name", "basename", "ext", is_drawing(F.col("path"), F.col("ext")).alias("is_drawing"), F.inline(F.array(found)),
        line_targets(content).alias("lines"), block_targets(content).alias("blocks"),
    )


def raw_links(notes: DataFrame) -> DataFrame:
    """Host links and line references as one list of raw targets, from one pass over the text."""
    content = F.col("content")
    targets = F.concat(wikilinks(content), frontmatter_links(entries(content)), line_targets(content))
    return notes.select("path", F.explode(F.array_distinct(targets)).alias("target")).dropDuplicates(["path", "target"])


def link_edges(notes: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Distinct (path, target_path, target_basename) edges of every note."""
    keys = note_keys(facts if facts is not None else key_facts(notes))
    return resolve(raw_links(notes), keys).select("path", "target_path", "target_basename").distinct()


def backlinks(edges: DataFrame) -> DataFrame:
    """The transpose of the link edges without self links, as rows; nothing is collected per target."""
    return edges.where("path <> target_path").select(F.col("target_path").alias("path"), F.col("path").alias("source_path"))


def resolved_references(notes: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    keys = note_keys(facts if facts is not None else key_facts(notes))
    return resolve(references(notes), keys)


def exact_references(notes: DataFrame) -> DataFrame:
    """Resolved references with context, previews and line spans."""
    # previews, line spans and blocks all start from the resolved references, which carry no note text
    refs = settle(resolved_references(notes))
    spans = refs.where("kind <> 'native-block'")
    previews = preview_table(spans, notes)
    lined = spans.join(
        previews, (spans.target_path == previews.target_path) & (spans.start_line == previews.start_line)
        & spans.end_line.eqNullSafe(previews.end_line), "left",
    ).select(spans["*"], F.coalesce(previews.preview, F.lit("")).alias("target_preview"))
    blocks = block_table(notes).select(
        F.col("path").alias("target_path"), "block_id", F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"),
        "preview",
    )
    native = refs.where("kind = 'native-block'").join(blocks, ["target_path", "block_id"], "left")
    native = native.withColumns(
        {"start_line": F.col("b_start"), "end_line": F.col("b_end"), "target_preview": F.coalesce("preview", F.lit(""))}
    ).select(*lined.columns)
    return lined.unionByName(native)


def incoming_references(notes: DataFrame) -> DataFrame:
    """The same rows seen from the target, without self references."""
    return exact_references(notes).where("path <> target_path")


def resolved_relations(notes: DataFrame, keys: list[str] | None = None, facts: DataFrame | None = None) -> DataFrame:
    """Relation values that name a note."""
    return resolve(relation_table(notes, keys), note_keys(facts if facts is not None else key_facts(notes)), "target_raw")


def dangling(notes: DataFrame) -> DataFrame:
    """Unresolved targets with the number of references and of notes that use them."""
    keys = note_keys(key_facts(notes)).select("key")
    raw = notes.select("path", F.explode(reference_targets(F.col("content"))).alias("target")).withColumn("key", target_key(F.col("target")))
    return (
        raw.join(keys, "key", "left_anti")
        .groupBy("key").agg(F.count(F.lit(1)).alias("references"), F.count_distinct("path").alias("notes"))
        .withColumnRenamed("key", "target")
    )


def dashboard(facts: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Counts per note, from the notes as ``read_notes`` gives them; they are settled by the caller, since every part reads them. Every count
    is a partial aggregate on its own edge table; drawings have no exact references."""
    keys = settle(note_keys(facts))
    asked = facts.select("path", F.explode(F.array_distinct(F.concat("hosts", "lines"))).alias("target"))
    edges = settle(resolve(asked, keys).select("path", "target_path").distinct())
    refs = settle(resolve(facts.select("path", F.explode(F.concat("lines", "blocks")).alias("target")), keys).select("path", "target_path"))
    named = facts.select("path", F.explode("relations").alias("r")).select("path", "r.relation_key", F.explode("r.targets").alias("target_raw"))
    relations = resolve(named, keys, "target_raw")
    parts = [
        edges.select("path", F.lit("outlinks").alias("what")),
        backlinks(edges).select("path", F.lit("backlinks").alias("what")),
        refs.select("path", F.lit("refs_out").alias("what")),
        refs.where("path <> target_path").select(F.col("target_path").alias("path"), F.lit("refs_in").alias("what")),
        relations.select("path", "relation_key").distinct().select("path", F.lit("relation_groups").alias("what")),
    ]
    if mentions is not None:
        parts.append(mentions.select(F.col("target_path").alias("path"), F.lit("mentions").alias("what")))
    facts_rows = parts[0]
    for p in parts[1:]:
        facts_rows = facts_rows.unionByName(p)
    names = ["outlinks", "backlinks", "refs_out", "refs_in", "relation_groups", "mentions"]
    counts = facts_rows.groupBy("path").agg(*[F.count_if(F.col("what") == n).alias(n) for n in names])
    joined = facts.select("path", "is_drawing", "tags").join(counts, "path", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("bigint")
    hidden = lambda n: F.when(F.col("is_drawing"), F.lit(0)).otherwise(zero(n)).cast("bigint")
    return joined.select(
        "path", "is_drawing", F.col("tags").cast("bigint").alias("tags"), zero("outlinks").alias("outlinks"),
        zero("backlinks").alias("backlinks"), hidden("refs_out").alias("refs_out"), hidden("refs_in").alias("refs_in"),
        zero("relation_groups").alias("relation_groups"), zero("mentions").alias("mentions"),
    )


def reference_previews(notes: DataFrame) -> DataFrame:
    """Every reference with title, location label and snippet; unresolved ones are marked missing."""
    refs = settle(resolve(references(notes, context=False), note_keys(key_facts(notes)), how="left"))
    spans = refs.where("kind <> 'native-block' and target_path is not null")
    previews = preview_table(spans, notes).withColumnRenamed("end_line", "p_end")
    blocks = block_table(notes).select(
        F.col("path").alias("target_path"), "block_id", F.col("start_line").alias("b_start"), F.col("end_line").alias("b_end"),
        F.col("preview").alias("b_preview"),
    )
    joined = refs.join(blocks, ["target_path", "block_id"], "left").join(
        previews, ["target_path", "start_line"], "left"
    ).where("preview is null or end_line <=> p_end")
    missing = F.col("target_path").isNull()
    native = F.col("kind") == "native-block"
    caret = F.concat(F.lit("^"), F.col("block_id"))
    block_label = F.when(
        F.col("b_preview").isNotNull(), F.concat_ws(" · ", range_label(F.col("b_start"), F.col("b_end")), caret)
    ).otherwise(caret)
    line_label = range_label(F.col("start_line"), F.col("end_line"))
    shown = F.when(native, F.col("b_preview")).otherwise(F.col("preview"))
    return joined.select(
        "path", "kind", "raw", "pos_start",
        F.when(missing, F.col("target")).otherwise(F.col("target_basename")).alias("title"),
        F.coalesce("target_path", F.lit("")).alias("target_path"),
        F.when(native & ~missing, block_label).when(native, caret).otherwise(line_label).alias("location"),
        F.when(missing | F.coalesce(shown == "", F.lit(True)), F.col("raw")).otherwise(shown).alias("snippet"),
        missing.alias("missing"),
    )
