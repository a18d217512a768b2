"""Line and block references: extraction with offsets, formatting, context, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, let, trim_all
from .notes import BLOCK_ID

# <<target:12>>, <<{target}:{12}-{15}>>, (((target#12-15)))
LINE_REF = (
    r"(?:<<\{?([^:}]+)\}?:\{?(\d+)\}?(?:-\{?(\d+)\}?)?>>(?!>)|\(\(\(([^#)]+)#(\d+)(?:-(\d+))?\)\)\))"
)
# [[target#^id|alias]]
BLOCK_REF = r"\[\[([^\]|#]+)#\^([A-Za-z0-9-]+)(?:\|([^\]]+))?\]\]"
CONTEXT_RADIUS = 72
PREVIEW_LINES = 6


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def located(content: Column, pattern: str, groups: int) -> Column:
    """Matches of ``pattern`` with their offsets, in the row: the text is cut at the matches and the pieces measured."""
    # one pass over the text; the groups are then taken from the short matches
    hits = F.transform(
        F.regexp_extract_all(content, F.lit(pattern), F.lit(0)),
        lambda raw: F.struct(raw.alias("raw"), *[F.regexp_extract(raw, pattern, g).alias(f"g{g}") for g in range(1, groups + 1)]),
    )

    def place(x: Column) -> Column:
        before = lambda n: F.aggregate(F.slice(x["pieces"], 1, n + 1), F.lit(0), lambda a, p: a + F.length(p))
        matched = lambda n: F.aggregate(F.slice(x["hits"], 1, n), F.lit(0), lambda a, h: a + F.length(h["raw"]))
        return F.transform(x["hits"], lambda h, n: F.struct(h.alias("hit"), (before(n) + matched(n)).alias("start")))

    return let(F.struct(hits.alias("hits"), F.split(content, pattern, -1).alias("pieces")), place)


def context_snippet(content: Column, start: Column, length: Column) -> Column:
    first = F.greatest(F.lit(0), start - CONTEXT_RADIUS)
    end = start + length
    last = F.least(F.length(content), end + CONTEXT_RADIUS)
    parts = [
        F.when(first > 0, F.lit("...")).otherwise(F.lit("")),
        collapse(F.substring(content, first + 1, start - first)),
        collapse(F.substring(content, start + 1, length)),
        collapse(F.substring(content, end + 1, last - end)),
        F.when(last < F.length(content), F.lit("...")).otherwise(F.lit("")),
    ]
    return trim_all(F.concat(*parts))


def _reference(content: Column, m: Column, context: bool, **columns: Column) -> Column:
    raw, start = m["hit"]["raw"], m["start"]
    around = []
    if context:
        first_line = newline_count(F.substring(content, 1, start)) + 1
        around = [
            first_line.alias("source_start_line"), (first_line + newline_count(raw)).alias("source_end_line"),
            context_snippet(content, start, F.length(raw)).alias("source_context"),
        ]
    return F.struct(
        columns["kind"].alias("kind"), raw.alias("raw"), columns["target"].alias("target"),
        columns["start_line"].cast("int").alias("start_line"), columns["end_line"].cast("int").alias("end_line"),
        columns["block_id"].cast("string").alias("block_id"), columns["alias"].cast("string").alias("alias"),
        start.alias("pos_start"), (start + F.length(raw)).alias("pos_end"), *around,
    )


def _explode(notes: DataFrame, found: Column) -> DataFrame:
    """Only the finished references leave the row; the text stays behind."""
    return notes.select("path", "ord", F.explode(found).alias("r")).select("path", "ord", "r.*")


def _line_target(hit: Column) -> Column:
    return trim_all(F.when(hit["g4"] != "", hit["g4"]).otherwise(hit["g1"]))


def line_hits(content: Column) -> Column:
    """Located line references of one text. One counts only when an even number of back-ticks follows it."""

    def counts(m: Column) -> Column:
        after = F.substring(content, m["start"] + F.length(m["hit"]["raw"]) + 1, F.length(content))
        ticks = F.length(after) - F.length(F.replace(after, F.lit("`"), F.lit("")))
        return (ticks % 2 == 0) & (F.length(_line_target(m["hit"])) > 0)

    return F.filter(located(content, LINE_REF, 6), counts)


def line_targets(content: Column) -> Column:
    """Targets of the line references of one text, as ``line_hits`` counts them, without their places.

    References and back-ticks are taken from the text together; walked from the end, each reference knows the back-ticks behind it.
    """
    marks = F.regexp_extract_all(content, F.lit(f"{LINE_REF}|`"), F.lit(0))

    def target(raw: Column) -> Column:
        return _line_target(F.struct(F.regexp_extract(raw, LINE_REF, 1).alias("g1"), F.regexp_extract(raw, LINE_REF, 4).alias("g4")))

    def step(state: Column, mark: Column) -> Column:
        counts = (mark != "`") & (state["ticks"] % 2 == 0)
        ticks = F.length(mark) - F.length(F.replace(mark, F.lit("`"), F.lit("")))
        return F.struct(
            (state["ticks"] + ticks).alias("ticks"),
            F.when(counts, F.concat(state["found"], F.array(target(mark)))).otherwise(state["found"]).alias("found"),
        )

    start = F.struct(F.lit(0).alias("ticks"), F.array().cast("array<string>").alias("found"))
    found = F.aggregate(F.reverse(marks), start, step, lambda state: F.reverse(state["found"]))
    return F.filter(found, lambda t: F.length(t) > 0)


def block_targets(content: Column) -> Column:
    """Targets of the block references of one text."""
    return F.filter(F.transform(F.regexp_extract_all(content, F.lit(BLOCK_REF), F.lit(1)), trim_all), lambda t: t != "")


def reference_targets(content: Column) -> Column:
    """Targets of all line and block references of one text."""
    return F.concat(line_targets(content), block_targets(content))


def _line_structs(content: Column, context: bool) -> Column:
    def number(a: Column, b: Column) -> Column:
        return F.when(a != "", a).when(b != "", b).try_cast("int")

    def build(m: Column) -> Column:
        h = m["hit"]
        return _reference(
            content, m, context, kind=F.when(h["g4"] != "", "block").otherwise("line"), target=_line_target(h),
            start_line=number(h["g2"], h["g5"]), end_line=number(h["g3"], h["g6"]), block_id=F.lit(None), alias=F.lit(None),
        )

    return F.transform(line_hits(content), build)


def _native_structs(content: Column, context: bool) -> Column:
    def build(m: Column) -> Column:
        h = m["hit"]
        return _reference(
            content, m, context, kind=F.lit("native-block"), target=trim_all(h["g1"]), start_line=F.lit(None), end_line=F.lit(None),
            block_id=h["g2"], alias=F.when(h["g3"] != "", trim_all(h["g3"])),
        )

    return F.filter(F.transform(located(content, BLOCK_REF, 3), build), lambda r: r["target"] != "")


def line_references(notes: DataFrame) -> DataFrame:
    return _explode(notes, _line_structs(F.col("content"), True))


def native_block_references(notes: DataFrame) -> DataFrame:
    return _explode(notes, _native_structs(F.col("content"), True))


def references(notes: DataFrame, context: bool = True) -> DataFrame:
    """Line and block references, from one pass over the notes; without ``context`` their lines and surroundings in the source note are left out."""
    return _explode(notes, F.concat(_line_structs(F.col("content"), context), _native_structs(F.col("content"), context)))


def format_line(target: Column, start: Column, end: Column) -> Column:
    tail = F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("<<"), target, F.lit(":"), start.cast("string"), tail, F.lit(">>"))


def format_block(target: Column, start: Column, end: Column) -> Column:
    tail = F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("((("), target, F.lit("#"), start.cast("string"), tail, F.lit(")))"))


def range_label(start: Column, end: Column) -> Column:
    tail = F.when(end > start, F.concat(F.lit("-"), end.cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("L"), start.cast("string"), tail)


def clamped_range(start: Column, end: Column, total: Column) -> Column:
    safe_total = F.greatest(total, F.lit(1))
    first = F.least(safe_total, F.greatest(F.lit(1), start))
    last = F.least(safe_total, F.greatest(F.coalesce(end, first), first))
    return F.struct(first.alias("start"), last.alias("end"))


def range_preview(lines: Column, start: Column, end: Column, max_lines: int = PREVIEW_LINES) -> Column:
    """At most ``max_lines`` lines of the clamped range, trimmed."""
    return let(lines, lambda ls: let(
        clamped_range(start, end, F.size(ls)),
        lambda r: trim_all(
            F.array_join(F.slice(ls, r["start"], F.least(r["end"] - r["start"] + 1, F.lit(max_lines))), "\n")
        ),
    ))


def preview_table(ranges: DataFrame, notes: DataFrame) -> DataFrame:
    """Preview of every distinct (path, start, end).

    Ranges are made distinct first, so a note that is the target of a third of all references meets its text once per
    different range, not once per reference.
    """
    wanted = ranges.select("target_path", "start_line", "end_line").distinct()
    text = notes.select(F.col("path").alias("target_path"), "content")
    lines = F.split("content", "\n")
    return wanted.join(text, "target_path").select(
        "target_path", "start_line", "end_line", range_preview(lines, F.col("start_line"), F.col("end_line")).alias("preview")
    )


# -------------------------------------------------------------------------------------------- islands and blocks

STANDALONE = r"^\s*#{1,6}\s+|^\s*(?:[-*+]\s+|\d+\.\s+)|^\s*>|^\s*```"


def paragraph_islands(lines: Column, last_line: str | None = None) -> Column:
    """Paragraphs as (start_line, end_line, text), found as gaps and islands inside the row. ``last_line`` keeps those whose last line matches it.

    A line starts an island when it stands alone or when the line before it is not prose; it ends one by the mirrored
    rule. Starts and ends pair up by position, so neither a shuffle nor a running sum is needed.
    """
    blank, alone, prose = F.lit(0), F.lit(1), F.lit(2)

    def kinds(body_from: Column) -> Column:
        return F.transform(
            lines,
            lambda x, i: F.when((i < body_from) | ~x.rlike(r"(?U)\S"), blank).when(x.rlike(STANDALONE), alone).otherwise(prose),
        )

    def cut(k: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(k) - 1)
        at = lambda i: F.coalesce(F.get(k, i), blank)
        starts = F.filter(index, lambda i: (at(i) == 1) | ((at(i) == 2) & ((i == 0) | (at(F.greatest(i - 1, F.lit(0))) != 2))))
        ends = F.filter(index, lambda i: (at(i) == 1) | ((at(i) == 2) & (at(i + 1) != 2)))
        pairs = F.arrays_zip(starts.alias("s"), ends.alias("e"))
        if last_line:
            pairs = F.filter(pairs, lambda z: F.get(lines, z["e"]).rlike(last_line))
        return F.transform(
            pairs,
            lambda z: F.struct(
                (z["s"] + 1).cast("int").alias("start_line"), (z["e"] + 1).cast("int").alias("end_line"),
                F.array_join(F.slice(lines, z["s"] + 1, z["e"] - z["s"] + 1), "\n").alias("text"),
            ),
        )

    # frontmatter counts only when line 1 is ---; without a closing --- it swallows the whole note
    close = F.array_position(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), trim_all), F.lit("---"))
    body = F.when(
        trim_all(F.get(lines, F.lit(0))) == "---", F.when(close > 0, close + 1).otherwise(F.size(lines))
    ).otherwise(F.lit(0))
    return let(body, lambda b: let(kinds(b), cut))


def island_table(notes: DataFrame) -> DataFrame:
    return notes.select("path", F.posexplode(let(F.split("content", "\n"), lambda lines: paragraph_islands(lines))).alias("n", "p")).select(
        "path", (F.col("n") + 1).alias("paragraph_no"), "p.*"
    )


def block_table(notes: DataFrame) -> DataFrame:
    """Blocks that end with ``^id``: (path, block_id, start_line, end_line, preview)."""
    rows = notes.where(F.col("content").rlike(r"(?m)\^[A-Za-z0-9-]+\s*$"))
    # the id stands in the last line, so only paragraphs that end like this are put together
    ended = let(F.split("content", "\n"), lambda lines: paragraph_islands(lines, r"(?:^|\s)\^[A-Za-z0-9-]+\s*$"))
    blocks = F.filter(ended, lambda p: p["text"].rlike(BLOCK_ID))
    return (
        rows.select("path", F.explode(blocks).alias("p"))
        .select(
            "path", F.regexp_extract("p.text", BLOCK_ID, 1).alias("block_id"), "p.start_line", "p.end_line",
            trim_all(F.regexp_replace("p.text", BLOCK_ID, "")).alias("preview"),
        )
        .where("preview <> ''")
        .groupBy("path", "block_id")
        .agg(F.max_by(F.struct("start_line", "end_line", "preview"), "start_line").alias("b"))
        .select("path", "block_id", "b.*")
    )
