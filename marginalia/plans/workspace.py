"""Topic workspaces rendered from topics and their works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import distinct_ci, first_sentence, let, trim_all
from ..operators import works as W


def topic_items(requests: DataFrame, works: DataFrame, max_sources: int = 3) -> DataFrame:
    """Works of every topic in request order, capped, with keys, tags and citation. ``requests``: topic, pos, source_key."""
    keyed = works.withColumn("source_key", W.key_of(works))
    items = W.capped_sources(requests, max_sources).drop("rank").join(keyed, "source_key")
    slug = W.topic_slug(F.col("topic"))
    return W.tagged(items).withColumns({
        "slug": slug, "citation": W.parenthetical(F.col("authors"), F.col("year")),
        "note_path": W.note_path(F.col("source_key")),
    }).withColumn("analysis_path", F.concat(F.lit(fixed.ANALYSIS_FOLDER + "/"), "slug", F.lit("-"), "source_key", F.lit("-analysis.md")))


def _link(path: Column) -> Column:
    return F.concat(F.lit("[["), F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), F.lit("]]"))


def _q(value: Column) -> Column:
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _yaml(key: str, values: Column) -> Column:
    lines = let(distinct_ci(values), lambda v: F.when(F.size(v) == 0, F.lit(f"{key}: []")).otherwise(
        F.concat(F.lit(f"{key}:\n"), F.array_join(F.transform(v, lambda x: F.concat(F.lit("  - "), _q(x))), "\n"))))
    return lines


def _note(*lines: Column) -> Column:
    """Lines that are null are left out; empty ones stay."""
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


def _each(build) -> Column:
    """One line per item, null without items."""
    return let(F.array_join(F.transform("items", build), "\n"), lambda t: F.when(t != "", t))


def workspaces(requests: DataFrame, works: DataFrame, max_sources: int = 3) -> DataFrame:
    """One (topic, kind, path, content) row per note. A topic holds at most ``max_sources`` works, so its list is small."""
    items = topic_items(requests, works, max_sources)
    c = F.col
    fields = ["pos", "title", "authors", "author", "year", "citation", "note_path", "analysis_path", "tags", "cited_by_count", "abstract", "concepts", "citation_key", "referenced_works_count"]
    per_topic = items.groupBy("topic", "slug").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    path = lambda folder, tail: F.concat(F.lit(f"{folder}/"), c("slug"), F.lit(f"{tail}.md"))
    t = per_topic.withColumns({
        "topic_path": path(fixed.TOPICS_FOLDER, ""), "matrix_path": path(fixed.ANALYSIS_FOLDER, "-comparison-matrix"),
        "map_path": path(fixed.ANALYSIS_FOLDER, "-literature-map"), "outline_path": path(fixed.DRAFTS_FOLDER, "-outline"),
        "draft_path": path(fixed.DRAFTS_FOLDER, "-draft"),
        "topic_tags": F.array_distinct(F.concat(
            F.array(F.lit("topic-note")),
            W.topical(W.research_tags(c("topic"), c("topic"), F.lit(""), F.array().cast("array<string>"))),
            W.topical(F.flatten(F.transform("items", lambda i: i["tags"]))),
        )),
        "reviews": F.transform("items", lambda i: i["analysis_path"]), "notes": F.transform("items", lambda i: i["note_path"]),
        "top": F.slice(F.array_sort("items", lambda a, b: F.when(b["cited_by_count"] != a["cited_by_count"], F.when(b["cited_by_count"] > a["cited_by_count"], 1).otherwise(-1)).otherwise(a["pos"].cast("int") - b["pos"].cast("int"))), 1, 2),
    })
    blank, e = F.lit(""), F.lit
    head = lambda suffix: F.concat(F.lit("# "), "topic", F.lit(suffix))
    front = lambda title, *rest: [F.lit("---"), F.concat(F.lit("title: "), _q(title)), *rest, F.lit("---"), blank]
    topic_note = _note(
        *front(c("topic"), _yaml("same_question", c("notes")), _yaml("reviews", c("reviews")), _yaml("tags", c("topic_tags"))), head(""), blank,
        e("## Topic overview"), *[F.concat(F.lit(f"- {label}: "), _link(c(p))) for label, p in (
            ("Topic note", "topic_path"), ("Comparison matrix", "matrix_path"), ("Literature map", "map_path"), ("Outline", "outline_path"), ("Draft", "draft_path"))],
        blank, e("## Source notes"), _each(lambda i: F.concat(F.lit("- "), _link(i["note_path"]), F.lit(" "), i["citation"])), blank,
        e("## Analysis notes"), _each(lambda i: F.concat(F.lit("- "), _link(i["analysis_path"]), F.lit(" -> "), _link(i["note_path"]))),
    )
    slash = lambda v: F.replace(v, F.lit("|"), F.lit("/"))
    method = lambda i: F.coalesce(F.get(F.filter(i["tags"], lambda x: x.isin(*fixed.METHOD_TAGS)), F.lit(0)), F.lit("conceptual"))
    lens = lambda i: F.filter(i["tags"], lambda x: x != "literature-note")
    row = lambda i: F.concat(F.lit("| "), F.concat_ws(
        " | ", slash(i["title"]), F.coalesce(i["year"], F.lit("")), method(i), i["cited_by_count"].cast("string"), slash(W.concept_list(i["concepts"], 3)),
        slash(first_sentence(i["abstract"])), F.array_join(lens(i), ", "), _link(i["analysis_path"])), F.lit(" |"))
    same = _yaml("same_question", F.array("topic_path"))
    tagged = lambda *names: _yaml("tags", F.array(*[F.lit(n) for n in names]))
    matrix_note = _note(
        *front(F.concat("topic", F.lit(" Comparison Matrix")), same, _yaml("reviews", c("reviews")), tagged("analysis-note", "comparison-matrix", "analyzed")),
        head(" Comparison Matrix"), blank, e("| Source | Year | Method | Citations | Concepts | Core contribution | Topic tags | Link |"),
        e("| --- | --- | --- | --- | --- | --- | --- | --- |"), _each(row), blank,
    )
    seen = F.array_distinct(F.filter(F.flatten(F.transform("items", lambda i: i["tags"])), lambda x: x.isin(*fixed.MAP_TAGS)))
    group = lambda tag: F.concat(F.lit("\n### "), tag, F.lit("\n"), F.array_join(F.transform(
        F.filter("items", lambda i: F.array_contains(i["tags"], tag)), lambda i: F.concat(F.lit("- "), _link(i["analysis_path"]), F.lit(" "), i["citation"])), "\n"))
    groups = let(F.array_join(F.transform(seen, group), "\n"), lambda x: F.when(x != "", x))
    map_note = _note(
        *front(F.concat("topic", F.lit(" Literature Map")), same, _yaml("reviews", c("reviews")), tagged("analysis-note", "literature-map", "analyzed")),
        head(" Literature Map"), blank, e("## Grouped by analytical lens"), groups,
    )
    outline_note = _note(
        *front(F.concat("topic", F.lit(" Outline")), same, _yaml("reviews", c("reviews")), tagged("outline-note", "draft-note", "draft")), head(" Outline"), blank,
        e("## Abstract"), F.array_join(F.transform(F.slice("items", 1, 2), lambda i: F.concat(F.lit("- Use "), _link(i["analysis_path"]), F.lit(" "), i["citation"])), "\n"), blank,
        e("## Introduction"), _each(lambda i: F.concat(F.lit("- Introduce "), i["title"], F.lit(" "), i["citation"])), blank,
        e("## Related research"), _each(lambda i: F.concat(F.lit("- Review "), _link(i["analysis_path"]))), blank,
        e("## Citation strategy"), F.array_join(F.transform("top", lambda i: F.concat(
            F.lit("- Anchor with "), _link(i["analysis_path"]), F.lit(" because it is cited "), i["cited_by_count"].cast("string"), F.lit(" times."))), "\n"),
    )
    lead = lambda i: let(first_sentence(i["abstract"]), lambda s: F.when(s != "", s).otherwise("-"))
    draft_note = _note(
        *front(F.concat("topic", F.lit(" Draft")), same, _yaml("reviews", c("reviews")),
               _yaml("tags", F.concat(F.array(F.lit("draft-note"), F.lit("drafted")), F.filter("topic_tags", lambda x: x != "topic-note")))),
        head(" Draft"), blank, e("## Introduction"), F.array_join(F.transform("items", lambda i: i["citation"]), "；"), blank, e("## Related research"),
        _each(lambda i: F.concat(F.lit("\n### "), i["title"], F.lit("\n"), i["citation"], F.lit(" "), lead(i), F.lit(" "), W.concept_list(i["concepts"], 4), F.lit(" "), _link(i["analysis_path"]))),
        blank, e("## Source map"), _each(lambda i: F.concat(
            F.lit("- "), W.citation_author(i["authors"], i["author"]), F.lit(" ("), let(trim_all(F.coalesce(i["year"], F.lit(""))), lambda y: F.when(y != "", y).otherwise("n.d.")),
            F.lit(") "), i["title"], F.lit(" -> "), _link(i["note_path"]), F.lit(" / "), let(trim_all(F.coalesce(i["citation_key"], F.lit(""))), lambda k: F.when(k != "", k).otherwise("no-citekey")))),
    )
    notes = t.select("topic", F.inline(F.array(*[
        F.struct(F.lit(k).alias("kind"), c(p).alias("path"), body.alias("content"))
        for k, p, body in (("topic", "topic_path", topic_note), ("matrix", "matrix_path", matrix_note), ("map", "map_path", map_note),
                           ("outline", "outline_path", outline_note), ("draft", "draft_path", draft_note))
    ])))
    a = items.withColumns({"topic_path": path(fixed.TOPICS_FOLDER, ""), "draft_path": path(fixed.DRAFTS_FOLDER, "-draft")})
    own = F.filter("tags", lambda x: x != "literature-note")
    analysis = _note(
        *front(F.concat("title", F.lit(" Analysis")), F.concat(F.lit("citekey: "), _q(F.coalesce("citation_key", F.lit("")))), F.concat(F.lit("year: "), _q(F.coalesce("year", F.lit("")))),
               _yaml("same_question", F.array("topic_path")), _yaml("reviews", F.array("note_path")), _yaml("evidence_for", F.array("draft_path")),
               _yaml("tags", F.concat(F.array(F.lit("analysis-note"), F.lit("analyzed")), own))),
        F.concat(F.lit("# "), "title", F.lit(" Analysis")), blank, e("## Source linkage"), F.concat(F.lit("- Topic: "), _link(c("topic_path"))),
        F.concat(F.lit("- Literature note: "), _link(c("note_path"))), F.concat(F.lit("- Citation: "), "citation"), blank, e("## Core claim"),
        let(first_sentence(c("abstract")), lambda s: F.when(s != "", F.concat(F.lit("- "), s)).otherwise("- Abstract summary unavailable.")), blank,
        e("## Citation context"), F.concat(F.lit("- Cited-by count: "), c("cited_by_count").cast("string")),
        F.concat(F.lit("- Referenced works tracked: "), F.coalesce("referenced_works_count", F.lit(0)).cast("string")),
        F.concat(F.lit("- Core concepts: "), W.concept_list(c("concepts"), 4)), blank, e("## Relevance to topic"),
        F.concat(F.lit('- This source is analyzed under the theme "'), "topic", F.lit('".')), F.array_join(F.transform(own, lambda x: F.concat(F.lit("- Tag lens: #"), x)), "\n"),
    )
    return notes.unionByName(a.select("topic", F.lit("analysis").alias("kind"), F.col("analysis_path").alias("path"), analysis.alias("content")))
