"""Tag suggestions for every note: keyword signals, phrase matches, context tags, merge and top list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.terms import (
    candidate_terms, is_bad_cjk, is_candidate, is_noisy, is_structural, length_bonus, raw_terms, tag_form,
)
from ..functions.text import distinct_ci, let
from .graph import note_keys, resolve
from .notes import entries, frontmatter_links, headings, headings_in, natural_lines, note_facts, outside_fences, wikilinks_in
from .refs import reference_targets
from .phrases import phrase_hits
from .settle import settle
from .skew import top_k
from .tags import alias_closure, note_tags, tag_statistics

TOP = 14


def _terms_of(texts: Column) -> Column:
    return F.flatten(F.transform(texts, candidate_terms))


def note_profiles(notes: DataFrame) -> DataFrame:
    """One row per note with what it offers to others: names, tags, headings, folder terms and raw link targets. No body."""
    content = F.col("content")
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    # headings and targets are read from the text once, their terms from them
    told = let(outside_fences(content), lambda body: F.struct(
        headings_in(body).alias("headings"), F.concat(wikilinks_in(body), let(entries(content), frontmatter_links)).alias("links"),
        reference_targets(content).alias("targets"),
    ))
    rows = notes.select("path", "ord", "dir", "name", "basename", "ext", "content", F.inline(F.array(told)))
    named = F.array_distinct(F.transform("targets", lambda t: F.regexp_replace(t, r"(?i)\.md$", "")))
    return note_facts(
        rows, headings=F.col("headings"), heading_terms=_terms_of(F.col("headings")), folder_terms=_terms_of(folders),
        links=F.col("links"), targets=F.col("targets"), reference_terms=let(named, lambda t: F.array_distinct(_terms_of(t))),
    )


def context(profiles: DataFrame) -> DataFrame:
    """Terms and tags of the notes a note links to or references: (path, terms, tags). Bounded by the links of one note."""
    targets = profiles.select("path", F.explode(F.array_distinct(F.concat("links", "targets"))).alias("target"))
    edges = resolve(targets, note_keys(profiles)).select("path", "target_path").distinct()
    offered = profiles.select(
        F.col("path").alias("target_path"),
        F.array_distinct(F.concat(candidate_terms(F.col("basename")), F.transform("aliases", F.lower), "heading_terms")).alias("terms"),
        F.col("tags").alias("target_tags"),
    )
    kept = lambda c: F.filter(c, lambda t: ~is_noisy(t) & ~is_structural(t))
    spelled = F.transform("target_tags", lambda t: F.struct(F.col("target_path").alias("p"), t.alias("t")))
    grouped = edges.join(offered, "target_path").groupBy("path").agg(
        F.array_distinct(F.flatten(F.collect_set("terms"))).alias("terms"), F.flatten(F.collect_list(spelled)).alias("tags")
    )
    # one spelling per tag: that of the first linked note
    tags = distinct_ci(F.transform(F.array_sort("tags"), lambda x: x["t"]))
    return grouped.select("path", F.array_sort(kept(F.col("terms"))).alias("terms"), kept(tags).alias("tags"))


def _marked(source: str, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(source).alias("source"), t.alias("text")))


def body_lines(notes: DataFrame) -> DataFrame:
    """(path, lines): the prose of every note, cleaned once for the jobs that read it."""
    return notes.select("path", natural_lines(F.col("content")).alias("lines"))


def text_pieces(lines: DataFrame, profiles: DataFrame, ctx: DataFrame) -> DataFrame:
    """Weighted texts of every note: (path, source, text), from ``body_lines``, profiles and context. Each term counts once per piece."""
    body = lines.select("path", F.explode(_marked("body", F.col("lines"))).alias("p"))
    rest = profiles.select(
        "path",
        F.explode(F.concat(
            _marked("title", F.array("basename")), _marked("heading", F.col("headings")), _marked("path", F.col("folder_terms")),
            _marked("alias", F.col("aliases")), _marked("reference", F.col("reference_terms")),
        )).alias("p"),
    )
    linked = ctx.select("path", F.explode(_marked("context", F.col("terms"))).alias("p"))
    return body.unionByName(rest).unionByName(linked).select("path", "p.source", "p.text")


def term_table(notes: DataFrame) -> DataFrame:
    """C5 over titles, headings and prose lines: distinct (path, source, term). A note without text still has its title."""
    content = F.coalesce("content", F.lit(""))
    rows = notes.select(
        "path",
        F.explode(F.concat(
            _marked("title", F.array("basename")), _marked("heading", headings(content)), _marked("body", natural_lines(content))
        )).alias("p"),
    )
    terms = rows.select("path", "p.source", F.explode(raw_terms(F.col("p.text"))).alias("term"))
    return terms.where(is_candidate(F.col("term"))).distinct()


def keyword_signals(pieces: DataFrame) -> DataFrame:
    """Weight, occurrences and sources per note and term.

    Sources are gathered as bits, so the aggregate keeps plain numbers, runs as a hash aggregate and folds map-side.
    """
    names = sorted(fixed.SOURCE_WEIGHT)
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in fixed.SOURCE_WEIGHT.items() for x in kv]), F.col("source"))
    bit = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, 1 << i)]), F.col("source"))
    rows = pieces.select("path", weight.alias("weight"), bit.alias("bit"), F.explode(raw_terms(F.col("text"))).alias("raw"))
    named = rows.where(is_candidate(F.col("raw"))).withColumn("term", tag_form(F.col("raw")))
    kept = named.where((F.col("term") == F.col("raw")) | is_candidate(F.col("term")))
    summed = kept.groupBy("path", "term").agg(
        F.sum("weight").cast("bigint").alias("weight"), F.count(F.lit(1)).alias("occurrences"), F.bit_or("bit").alias("bits")
    )
    found = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, n) for i, n in enumerate(names)]))
    return summed.select("path", "term", "weight", "occurrences", found.alias("sources"))


def score_signals(signals: DataFrame) -> DataFrame:
    has = lambda s: F.array_contains("sources", s)
    bonus = sum((F.when(has(s), v).otherwise(0) for s, v in fixed.SOURCE_BONUS.items()), F.lit(0))
    body = F.when(has("body"), F.least(F.lit(6), F.col("occurrences") * 2)).otherwise(0)
    generic = F.when(F.col("term").isin(*fixed.GENERIC_CJK), 5).otherwise(0)
    return signals.withColumn("score", (F.col("weight") + bonus + body + length_bonus(F.col("term")) - generic).cast("bigint"))


def without_redundant(scored: DataFrame) -> DataFrame:
    """Greedy walk by score, equal scores in Chinese collation; a term falls when an accepted term contains it or is contained in it.

    Accepted terms never score lower than the walked one, so the score margins of the rule always hold.
    """
    item = F.struct((-F.col("score")).alias("minus"), F.collate("term", "zh").alias("zh"), "term", "sources", "occurrences")
    plain = lambda x: F.struct(x["minus"].alias("minus"), x["term"].alias("term"), x["sources"].alias("sources"), x["occurrences"].alias("occurrences"))
    lists = scored.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(item)), plain).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        clash = F.contains(acc["joined"], x["term"]) | F.exists(acc["kept"], lambda a: F.contains(x["term"], a["term"]))
        return F.when(clash, acc).otherwise(
            F.struct(F.concat(acc["joined"], F.lit("\n"), x["term"]).alias("joined"), F.concat(acc["kept"], F.array(x)).alias("kept"))
        )

    item_type = "array<struct<minus:bigint,term:string,sources:array<string>,occurrences:bigint>>"
    start = F.struct(F.lit("").alias("joined"), F.array().cast(item_type).alias("kept"))
    kept = F.aggregate(F.col("items").cast(item_type), start, step, lambda acc: acc["kept"])
    return lists.select("path", F.explode(kept).alias("k")).select(
        "path", "k.term", (-F.col("k.minus")).alias("score"), "k.sources", "k.occurrences"
    )


def keyword_suggestions(pieces: DataFrame, facts: DataFrame) -> DataFrame:
    scored = score_signals(keyword_signals(pieces))
    strong = F.arrays_overlap("sources", F.array(*[F.lit(s) for s in fixed.STRONG_SOURCES]))
    own = note_tags(facts).select("path", F.col("tag_key").alias("term"))
    kept = scored.where((F.col("score") >= 18) | strong | (F.col("occurrences") >= 2)).join(own, ["path", "term"], "left_anti")
    rows = without_redundant(kept)
    only_path = (F.size("sources") == 1) & F.array_contains("sources", "path")
    return rows.select(
        "path", F.col("term").alias("tag"), F.when(only_path, "source-path").otherwise("keyword").alias("kind"), "score",
        (~(only_path | (~strong & (F.col("score") < 28)))).alias("primary"), "sources",
        F.array().cast("array<string>").alias("matches"), F.lit(None).cast("string").alias("facet"), F.struct(F.lit(5).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")).alias("stage"),
    )


# --------------------------------------------------------------------------------------------------- phrase matches


def source_texts(lines: DataFrame, profiles: DataFrame, ctx: DataFrame) -> DataFrame:
    """Texts that phrases are looked for in: (path, source, text), from ``body_lines``, profiles and context."""
    row = lambda source, texts: F.struct(F.lit(source).alias("source"), F.array_join(texts, "\n").alias("text"))
    body = lines.select("path", F.lit("body").alias("source"), F.array_join("lines", "\n").alias("text"))
    rest = profiles.select(
        "path",
        F.inline(F.array(
            row("title", F.array("basename")), row("heading", F.col("heading_terms")), row("path", F.col("folder_terms")),
            row("alias", F.col("aliases")), row("reference", F.col("reference_terms")),
        )),
    )
    linked = ctx.select("path", F.lit("context").alias("source"), F.array_join(F.concat("terms", "tags"), "\n").alias("text"))
    return body.unionByName(rest).unionByName(linked).where("text <> ''")


def _phrase_suggestions(hits, facts, words, kind, score, sources, stage, with_source=False):
    """Suggestions from phrase hits. ``words``: (tag, phrase, extra columns). ``score`` is an expression over ``m``."""
    extra = [c for c in words.columns if c not in ("tag", "phrase")]
    used = hits if with_source else hits.where("source <> 'path'").select("path", "phrase").distinct()
    joined = used.join(words, "phrase")
    aggs = [F.count(F.lit(1)).alias("m"), F.array_sort(F.collect_set("phrase")).alias("matches")]
    if with_source:
        aggs.append(F.collect_set("source").alias("hit_sources"))
    grouped = joined.groupBy("path", "tag", *extra).agg(*aggs)
    own = note_tags(facts).select("path", "tag_key")
    free = grouped.where(~is_noisy(F.col("tag"))).withColumn("tag_key", F.lower("tag")).join(own, ["path", "tag_key"], "left_anti")
    return free.select(
        "path", "tag", F.lit(kind).alias("kind"), score.cast("bigint").alias("score"), F.lit(True).alias("primary"),
        sources.alias("sources"), "matches", (F.col("facet") if "facet" in extra else F.lit(None).cast("string")).alias("facet"), stage.alias("stage"),
    )


def merge_streams(rows: DataFrame) -> DataFrame:
    """One row per note and tag: best score, kind of the first stream that reached it, any primary, united sets."""
    named = rows.withColumn("tag", tag_form(F.col("tag"))).where(
        ~is_noisy(F.col("tag")) & ~is_structural(F.col("tag")) & ~is_bad_cjk(F.col("tag"))
    )
    early = F.struct(F.col("score"), (-F.col("stage.a")).alias("a"), (-F.col("stage.b")).alias("b"), (-F.col("stage.c")).alias("c"))
    return named.groupBy("path", F.lower("tag").alias("tag_key")).agg(
        F.min_by("tag", "stage").alias("tag"), F.max("score").alias("score"), F.max_by("kind", early).alias("kind"),
        F.bool_or("primary").alias("primary"), F.max_by("facet", F.when(F.col("facet").isNotNull(), early)).alias("facet"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("matches")))).alias("matches"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    )


def suggest_tags(notes: DataFrame, alias: DataFrame, facet: DataFrame, top: int = TOP) -> DataFrame:
    """C4: up to ``top`` suggestions per note, primary first, then score, then tag (Chinese collation)."""
    facts = settle(note_profiles(notes))
    ctx = settle(context(facts))
    lines = settle(body_lines(notes))
    stage = lambda a, b=None, c=None: F.struct(
        F.lit(a).alias("a"), (b if b is not None else F.lit(0)).cast("int").alias("b"), (c if c is not None else F.lit(0)).cast("int").alias("c")
    )
    known = settle(tag_statistics(facts).select("tag", "count"))
    related = alias_closure(known.select("tag"), alias)
    known_words = known.select("tag", "count", F.col("tag").alias("phrase")).unionByName(
        related.join(known, "tag").select("tag", "count", F.col("related").alias("phrase"))
    )
    facet_words = facet.select("canonical", "alias", "facet", "facet_no").groupBy("canonical", "facet", "facet_no").agg(
        F.collect_set("alias").alias("aliases")
    ).select("canonical", "facet", "facet_no", F.explode(F.array_distinct(F.concat(F.array("canonical"), "aliases"))).alias("phrase"))
    alias_words = alias.groupBy("canonical").agg(F.collect_list("alias").alias("aliases")).select(
        F.col("canonical").alias("tag"), F.explode(F.concat(F.array("canonical"), "aliases")).alias("phrase")
    )
    phrases = known_words.select("phrase").unionByName(facet_words.select("phrase")).unionByName(alias_words.select("phrase"))
    # three streams read the hits; they are a few short rows per note
    hits = settle(phrase_hits(source_texts(lines, facts, ctx), phrases))
    bonus = F.lit(fixed.FACET_BONUS_OTHER)
    for name, value in fixed.FACET_BONUS.items():
        bonus = F.when(F.col("facet") == name, value).otherwise(bonus)
    m = F.col("m")
    own = note_tags(facts).select("path", "tag_key")
    from_context = (
        ctx.select("path", F.explode("tags").alias("tag")).withColumn("tag_key", F.lower("tag")).join(own, ["path", "tag_key"], "left_anti")
        .select(
            "path", "tag", F.lit("known-tag").alias("kind"), F.lit(24).cast("bigint").alias("score"), F.lit(True).alias("primary"),
            F.array(F.lit("context"), F.lit("vault-tag")).alias("sources"), F.array("tag").alias("matches"),
            F.lit(None).cast("string").alias("facet"), stage(1).alias("stage"),
        )
    )
    from_facets = _phrase_suggestions(
        hits, facts, facet_words.withColumnRenamed("canonical", "tag"), "facet-tag", 54 + m * 4 + bonus,
        F.array_union(F.array(F.lit("facet")), F.col("hit_sources")), stage(2, F.col("facet_no")), with_source=True,
    )
    from_alias = _phrase_suggestions(hits, facts, alias_words, "alias", 46 + m * 4, F.array(F.lit("alias")), stage(3))
    from_known = _phrase_suggestions(
        hits, facts, known_words, "known-tag", 28 + F.least(F.col("count"), F.lit(5)) + m * 3, F.array(F.lit("vault-tag")), stage(4)
    )
    keywords = keyword_suggestions(text_pieces(lines, facts, ctx), facts)
    merged = merge_streams(
        from_context.unionByName(from_facets).unionByName(from_alias).unionByName(from_known).unionByName(keywords)
    )
    order = [F.desc("primary"), F.desc("score"), F.collate(F.col("tag"), "zh"), F.col("tag")]
    return top_k(merged, ["path"], order, top).select(
        "path", "rank", "tag", "score", "kind", F.when(F.col("primary"), "primary").otherwise("secondary").alias("bucket"),
        "facet", "matches", "sources",
    )


def preselected(suggestions: DataFrame) -> DataFrame:
    """Three primary suggestions, filled up to four with secondary ones."""
    place = F.row_number().over(Window.partitionBy("path", "bucket").orderBy("rank"))
    primary = F.count_if(F.col("bucket") == "primary").over(Window.partitionBy("path"))
    rows = suggestions.withColumns({"place": place, "n_primary": F.least(F.lit(3), primary)})
    return rows.where(
        ((F.col("bucket") == "primary") & (F.col("place") <= 3)) | ((F.col("bucket") == "secondary") & (F.col("place") <= 4 - F.col("n_primary")))
    ).select("path", "rank", "tag", "bucket")
