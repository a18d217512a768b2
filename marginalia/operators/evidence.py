"""Evidence search: snippet queries and line ranges against notes. The requests of a note travel together, so its text meets them once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normalise
from ..functions.text import let, search_form, trim_all
from .refs import format_block, format_line, paragraph_islands

MAX_RESULTS = 5
PREVIEW_LINES = 6
PACK = 256  # requests that share one copy of a note


def note_path(raw: Column) -> Column:
    """Path a request means: forward slashes, no leading slash, ``.md`` added; null when it leaves the corpus."""
    plain = normalise(F.regexp_replace(F.replace(trim_all(raw), F.lit("\\"), F.lit("/")), "^/+", ""))
    return let(
        plain,
        lambda p: F.when((p == "") | p.rlike(r"(^|/)\.\.(/|$)"), F.lit(None)).when(F.lower(p).endswith(".md"), p)
        .otherwise(F.concat(p, F.lit(".md"))),
    )


def link_text(path: Column) -> Column:
    return F.regexp_replace(path, r"(?i)\.md$", "")


def _preview(lines: Column, start: Column, end: Column, limit: Column) -> Column:
    shown = F.least(end, start + limit - 1)
    return F.struct(
        trim_all(F.array_join(F.slice(lines, start, shown - start + 1), "\n")).alias("preview"),
        (end - start + 1).alias("selected_line_count"), (shown - start + 1).alias("preview_line_count"),
        F.when(shown < end, "preview_truncated").otherwise("").alias("warnings"),
    )


def _candidates(lines: Column, scope: Column) -> Column:
    each = F.filter(
        F.transform(
            lines, lambda x, i: F.struct((i + 1).alias("start_line"), (i + 1).alias("end_line"), x.alias("text"))
        ),
        lambda c: F.length(trim_all(c["text"])) > 0,
    )
    return F.when(scope == "line", each).otherwise(paragraph_islands(lines))


def per_note(requests: DataFrame, notes: DataFrame, job: Callable[[Column, Column], Column]) -> DataFrame:
    """``requests`` with a column ``out``: what ``job(lines, request)`` makes of the lines of the note at ``path`` (null without one).

    Requests of one note are dealt into rows of about ``PACK``, and each such row is joined to the note: few requests read a text once, very many read it
    once for every ``PACK`` of them, in different tasks.
    """
    columns = requests.columns
    rows = requests.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", F.coalesce("path", F.lit("")))
    counts = rows.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("_packs"))
    dealt = rows.join(counts, "_key").withColumn("_pack", F.pmod(F.xxhash64("_row"), F.col("_packs")))
    packed = dealt.groupBy("_key", "_pack").agg(F.collect_list(F.struct(*columns)).alias("_asked"))
    joined = packed.join(notes.select(F.col("path").alias("_key"), F.split("content", "\n").alias("_lines")), "_key", "left")
    told = F.transform("_asked", lambda r: F.struct(*[r[c].alias(c) for c in columns], job(F.col("_lines"), r).alias("out")))
    return joined.select(F.inline(told))


def _hits(queries: DataFrame, notes: DataFrame, shape: Callable[[Column, Column], Column] = lambda lines, hits: hits) -> DataFrame:
    """Queries with input_error, total_lines, match_count and ``hits``: the matching ranges of their note as ``shape(lines, hits)`` gives them."""
    scope = F.lower(trim_all(F.coalesce("scope", F.lit(""))))
    asked = queries.withColumns(
        {"scope": F.when(scope == "", "paragraph").otherwise(scope), "path": note_path(F.col("path")), "wanted": search_form(F.col("query"))}
    )
    asked = asked.withColumn("input_error", F.when(F.col("path").isNull(), "invalid-note-path").when(F.length("wanted") == 0, "missing-query").when(
        ~F.col("scope").isin("line", "paragraph"), "unsupported-scope"))

    def find(lines: Column, r: Column) -> Column:
        error = F.coalesce(r["input_error"], F.when(lines.isNull(), F.lit("note-not-found")))
        hits = F.when(error.isNull(), F.filter(_candidates(lines, r["scope"]), lambda c: F.contains(search_form(c["text"]), r["wanted"])))
        return let(hits, lambda h: F.struct(error.alias("error"), F.size(lines).alias("total_lines"), F.size(h).alias("match_count"), shape(lines, h).alias("hits")))

    found = per_note(asked, notes, find)
    return found.select(*[c for c in asked.columns if c not in ("input_error", "wanted")], F.col("out.error").alias("input_error"), "out.total_lines", "out.match_count", "out.hits")


def locate(queries: DataFrame, notes: DataFrame, max_results: int = MAX_RESULTS, preview_lines: int = PREVIEW_LINES) -> DataFrame:
    """C1 (with W8 and T1): numbered matches in document order, the first ``max_results`` of all."""
    first = lambda lines, hits: F.transform(F.slice(hits, 1, max_results), lambda h: F.struct(
        h["start_line"].alias("start_line"), h["end_line"].alias("end_line"), _preview(lines, h["start_line"], h["end_line"], F.lit(preview_lines)).alias("p")))
    rows = _hits(queries, notes, first).select(
        "query_id", "path", "query", "scope", "total_lines", "match_count", F.posexplode("hits").alias("n", "h"),
    )
    start, end, link = F.col("h.start_line"), F.col("h.end_line"), link_text(F.col("path"))
    return rows.select(
        "query_id", "path", "query", "scope", link.alias("target_linktext"), "total_lines", "match_count",
        (F.col("n") + 1).alias("occurrence"), start.alias("start_line"), end.alias("end_line"), F.col("h.p").alias("p"),
        format_line(link, start, end).alias("line_reference"), format_block(link, start, end).alias("block_reference"),
        (F.col("match_count") > max_results).alias("result_truncated"),
    ).select("*", "p.*").drop("p")


def match_numbers(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """Every match with its 1-based number and the total."""
    return _hits(queries, notes).select(
        "query_id", "match_count", F.posexplode("hits").alias("n", "h")
    ).select("query_id", (F.col("n") + 1).alias("occurrence"), "match_count", "h.start_line", "h.end_line")


def inspect(ranges: DataFrame, notes: DataFrame, preview_lines: int = PREVIEW_LINES) -> DataFrame:
    """Preview of explicit ranges, or an error code."""
    end = F.coalesce("end_line", F.col("start_line"))
    limit = F.coalesce("max_preview_lines", F.lit(preview_lines)) if "max_preview_lines" in ranges.columns else F.lit(preview_lines)
    asked = ranges.withColumns({"path": note_path(F.col("path")), "end_line": end, "_limit": limit})

    def look(lines: Column, r: Column) -> Column:
        total, first, last = F.size(lines), r["start_line"], r["end_line"]
        error = (
            F.when(r["path"].isNull(), "invalid-note-path").when(lines.isNull(), "note-not-found")
            .when(first.isNull() | (first < 1) | (last < first), "invalid-line-range")
            .when((first > total) | (last > total), "line-out-of-bounds").when(r["_limit"] < 1, "invalid-preview-line-limit")
        )
        return F.struct(total.alias("total_lines"), error.alias("error"), F.when(error.isNull(), _preview(lines, first, last, r["_limit"])).alias("p"))

    key = [c for c in ranges.columns if c not in ("path", "start_line", "end_line", "max_preview_lines")]
    return per_note(asked, notes, look).select(
        *key, "path", "start_line", "end_line", link_text(F.col("path")).alias("target_linktext"), "out.total_lines", "out.error", "out.p",
    ).select("*", "p.*").drop("p")


def format_references(queries: DataFrame, notes: DataFrame) -> DataFrame:
    """One reference string per query, or why there is none."""
    rows = _hits(queries, notes)
    count, wanted = F.col("match_count"), F.col("occurrence")
    kind = F.lower(trim_all(F.coalesce("kind", F.lit(""))))
    kind = F.when(kind == "", "line").otherwise(kind)
    error = F.coalesce(
        F.col("input_error"),
        F.when(count == 0, "no-match").when(wanted > count, "occurrence-out-of-range")
        .when(wanted.isNull() & (count > 1), "ambiguous-match").when(~kind.isin("line", "block"), "unsupported-kind"),
    )
    chosen = F.get("hits", F.coalesce(wanted, F.lit(1)) - 1)
    picked = rows.select("query_id", "path", kind.alias("kind"), count.alias("match_count"), error.alias("error"), chosen.alias("h"))
    start, end, link = F.col("h.start_line"), F.col("h.end_line"), link_text(F.col("path"))
    text = F.when(F.col("kind") == "line", format_line(link, start, end)).otherwise(format_block(link, start, end))
    ok = F.col("error").isNull()
    return picked.select(
        "query_id", "path", "kind", F.when(F.col("match_count") >= 0, F.col("match_count")).alias("match_count"), "error",
        F.when(ok, start).alias("start_line"), F.when(ok, end).alias("end_line"), F.when(ok, text).alias("reference"),
    )
