"""Note tables: frontmatter, lines, inline markup, metadata, excerpts.

All facts about one note are computed inside its row (array functions over its lines), so none of these jobs
shuffles text. Only the small derived columns travel further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import (
    clean_list, collapse, distinct_ci, facet_label, first_filled, is_in, let, planned, trim_all,
)

FRONTMATTER = r"^\s*---\n[\s\S]*?\n---\n?"
HEADER = r"^\s*---\n([\s\S]*?)\n---"
# key: value, where the value may be followed by "- item" lines
ENTRY = r"(?m)^([^\s:#-][^:\n]*):[ \t]*([^\n]*(?:\n[ \t]*- [^\n]*)*)"
FENCE = r"^\s*(```|~~~)"
INLINE_TAG = r"(?m)(?:^|\s)#([\p{L}\p{N}_/-]+)"
WIKILINK = r"\[\[([^\]\[|#\n]+)(#[^\]|\n]*)?(?:\|([^\]\n]+))?\]\]"
BLOCK_ID = r"\s+\^([A-Za-z0-9-]+)\s*$"


def strip_frontmatter(content: Column) -> Column:
    return F.regexp_replace(content, FRONTMATTER, "")


def is_supported(path: Column) -> Column:
    lowered = F.lower(trim_all(path))
    return lowered.endswith(".md") | lowered.endswith(".excalidraw")


def is_drawing(path: Column, ext: Column) -> Column:
    return F.lower(path).endswith(".excalidraw.md") | (ext == "excalidraw")


def file_rank(ext: Column, ord_: Column) -> Column:
    """Host file order: Markdown files first, then raw drawings, each in ``ord`` order."""
    return F.struct((ext == "excalidraw").cast("int").alias("late"), ord_.alias("ord"))


# ---------------------------------------------------------------------------------------------------- frontmatter


def entries(content: Column) -> Column:
    """Frontmatter as ordered (key, raw value) pairs."""
    return let(
        F.regexp_extract(content, HEADER, 1),
        lambda h: F.arrays_zip(
            F.transform(F.regexp_extract_all(h, F.lit(ENTRY), F.lit(1)), trim_all).alias("key"),
            F.transform(F.regexp_extract_all(h, F.lit(ENTRY), F.lit(2)), trim_all).alias("raw"),
        ),
    ).cast("array<struct<key:string,raw:string>>")


def raw_value(pairs: Column, *keys: str) -> Column:
    """Raw text of the first of ``keys`` that is present; the last entry of a repeated key wins."""
    return _raw_of(pairs, F.array(*[F.lit(k) for k in keys]))


def _raw_of(pairs: Column, keys: Column) -> Column:
    found = F.transform(keys, lambda k: F.get(F.reverse(F.filter(pairs, lambda e: e["key"] == k)), F.lit(0))["raw"])
    return F.get(F.filter(found, lambda r: r.isNotNull() & ~r.isin("null", "~")), F.lit(0))


def _unquote(value: Column) -> Column:
    def plain(raw: Column) -> Column:
        parsed = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
        return F.when(raw.startswith('"'), F.coalesce(parsed, raw)).when(
            raw.rlike("^'.*'$"), F.substring(raw, 2, F.length(raw) - 2)
        ).otherwise(raw)

    return let(value, plain)


def as_list(value: Column) -> Column:
    """Text or list value as a clean list; numbers and booleans are not text and give an empty list."""

    def items(raw: Column) -> Column:
        dashed = F.transform(F.regexp_extract_all(raw, F.lit(r"(?m)^[ \t]*- ([^\n]*)$"), F.lit(1)), _unquote)
        bare = F.split(F.regexp_replace(raw, r"^\[|\]$", ""), ",")
        return (
            F.when(raw.rlike(r"(?m)^[ \t]*- "), dashed)
            .when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), bare))
            .when(raw.rlike(r"^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false)?$"), F.array().cast("array<string>"))
            .otherwise(F.array(_unquote(raw)))
        )

    return clean_list(let(value, items))


def as_scalar(value: Column) -> Column:
    """Text or number as text; a list gives its first filled item; booleans give nothing."""

    def pick(raw: Column) -> Column:
        listed = raw.startswith("[") | raw.rlike(r"(?m)^[ \t]*- ")
        plain = F.when(~raw.isin("true", "false"), first_filled(_unquote(raw)))
        return F.when(listed, F.get(as_list(raw), F.lit(0))).otherwise(plain)

    return let(value, pick)


def frontmatter_table(notes: DataFrame) -> DataFrame:
    """A2: one row per note and key, parsed line by line. Key ``tags`` is left out and the last line of a key wins."""
    lines = F.split(F.regexp_extract("content", r"^---\n([\s\S]*?)\n---", 1), "\n")
    pairs = F.filter(
        F.transform(
            F.filter(lines, lambda x: F.instr(x, ":") > 1),
            lambda x: F.struct(
                trim_all(F.substring_index(x, ":", 1)).alias("key"),
                trim_all(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("raw"),
            ),
        ),
        lambda e: ~e["key"].isin("", "tags"),
    )
    last = let(
        pairs,
        lambda p: F.filter(p, lambda e, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda later: later["key"] == e["key"])),
    )
    rows = notes.select("path", F.explode(last).alias("e")).select("path", "e.key", "e.raw")
    json = F.try_parse_json("raw")
    first = F.substring("raw", 1, 1)
    kind = (
        F.when(json.isNull() | (F.length("raw") == 0), "text").when(first == '"', "string").when(first == "[", "array")
        .when(first == "{", "object").when(F.col("raw").isin("true", "false"), "boolean")
        .when(F.col("raw") == "null", "null").otherwise("number")
    )
    value = F.when(kind == "string", json.cast("string")).otherwise(F.col("raw"))
    return rows.select("path", "key", kind.alias("kind"), value.alias("value"))


# ------------------------------------------------------------------------------------------------------- lines


def line_table(notes: DataFrame) -> DataFrame:
    """A3: numbered lines of the note body, frontmatter removed."""
    return notes.select("path", F.posexplode(F.split(strip_frontmatter(F.col("content")), "\n"))).select(
        "path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("text")
    )


def fence_flags(lines: Column) -> Column:
    """True for every line that is a fence or stands inside one."""

    def flags(marks: Column) -> Column:
        inside = lambda i: F.size(F.filter(marks, lambda m: m < i)) % 2 == 1
        return F.transform(lines, lambda x, i: x.rlike(FENCE) | inside(i))

    positions = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(FENCE), i)), lambda i: i.isNotNull())
    return let(positions, flags)


def outside_fences(content: Column) -> Column:
    """Body text without fenced blocks and frontmatter."""
    return F.regexp_replace(
        strip_frontmatter(content), r"(?m)^[ \t]*(?:```|~~~)[\s\S]*?(?:\n[ \t]*(?:```|~~~)[^\n]*$|\z)", ""
    )


def inline_tags(content: Column) -> Column:
    """``#tag`` outside fences, ordered, first spelling wins. A tag needs one character that is not a digit."""
    return inline_tags_in(outside_fences(content))


def inline_tags_in(body: Column) -> Column:
    found = F.regexp_extract_all(body, F.lit(INLINE_TAG), F.lit(1))
    return distinct_ci(F.filter(found, lambda t: t.rlike(r"[^0-9]")))


def note_tags(pairs: Column, body: Column) -> Column:
    """Tags of the frontmatter, then those of the text outside fences."""
    return distinct_ci(F.concat(distinct_ci(as_list(raw_value(pairs, "tags"))), inline_tags_in(body)))


def markup_table(notes: DataFrame) -> DataFrame:
    """A4: tags, headings, wikilinks and block ids outside fences, with their line in the whole note."""
    lines = F.split("content", "\n")
    header_lines = F.length(F.regexp_replace(F.regexp_extract("content", FRONTMATTER, 0), r"[^\n]", ""))
    live = let(
        F.struct(lines.alias("lines"), fence_flags(lines).alias("fenced"), header_lines.alias("header")),
        lambda n: F.filter(
            F.transform(
                n["lines"],
                lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text"), (F.get(n["fenced"], i) | (i < n["header"])).alias("skip")),
            ),
            lambda x: ~x["skip"],
        ),
    )
    rows = notes.select("path", F.explode(live).alias("l")).select("path", "l.line_no", "l.text")
    empty = F.array().cast("array<struct<kind:string,value:string,detail:string>>")

    def items(kind: str, values: Column, details: Column | None = None) -> Column:
        return F.transform(
            F.arrays_zip(values.alias("v"), (details if details is not None else values).alias("d")),
            lambda z: F.struct(
                F.lit(kind).alias("kind"), trim_all(z["v"]).alias("value"),
                (z["d"] if details is not None else F.lit("")).alias("detail"),
            ),
        ).cast("array<struct<kind:string,value:string,detail:string>>")

    text = F.col("text")
    heading = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
    tags = F.filter(F.regexp_extract_all(text, F.lit(INLINE_TAG), F.lit(1)), lambda t: t.rlike("[^0-9]"))
    found = F.concat(
        items("tag", tags),
        F.when(
            text.rlike(heading),
            items("heading", F.array(F.regexp_extract(text, heading, 2)), F.array(F.regexp_extract(text, heading, 1))),
        ).otherwise(empty),
        items(
            "wikilink", F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(1)),
            F.regexp_extract_all(text, F.lit(WIKILINK), F.lit(2)),
        ),
        F.when(text.rlike(BLOCK_ID), items("block", F.array(F.regexp_extract(text, BLOCK_ID, 1)))).otherwise(empty),
    )
    return rows.select("path", "line_no", F.posexplode(found).alias("pos", "m")).select(
        "path", "line_no", "pos", "m.kind", "m.value", "m.detail"
    )


# ---------------------------------------------------------------------------------------------------- note facts


# fixed values: spellings of the source fields, first present wins
METADATA_KEYS = {
    "citekey": ["citekey", "citationKey", "citation_key", "cite_key"],
    "author": ["author"],
    "year": ["year", "publication_year", "date"],
    "source_type": ["entry_type", "itemType", "source_type", "sourceType"],
    "locator": ["page", "pages", "locator"],
    "evidence_kind": ["evidence_kind", "evidenceKind", "note_kind"],
}


def source_metadata(pairs: Column) -> Column:
    """Six optional fields with their synonyms; null when none is set."""
    groups = F.array(*[F.array(*[F.lit(k) for k in keys]) for keys in METADATA_KEYS.values()])
    authors = F.array_join(as_list(raw_value(pairs, "authors", "author")), ", ")

    def fields(found: Column) -> Column:
        value = {name: F.get(found, F.lit(i)) for i, name in enumerate(METADATA_KEYS)}
        listed = let(authors, lambda a: F.when(a != "", a))
        value["author"] = F.coalesce(listed, value["author"])
        return F.struct(*[v.alias(name) for name, v in value.items()])

    return let(F.transform(groups, lambda keys: as_scalar(_raw_of(pairs, keys))), fields)


def source_metadata_of(content: Column) -> Column:
    return let(entries(content), source_metadata)


METADATA_FIELDS = list(METADATA_KEYS)


@planned
def _facts() -> Column:
    return let(
        entries(F.col("content")),
        lambda fm: F.struct(
            distinct_ci(as_list(raw_value(fm, "aliases", "alias"))).alias("aliases"),
            note_tags(fm, outside_fences(F.col("content"))).alias("tags"),
            source_metadata(fm).alias("metadata"),
        ),
    )


def note_facts(notes: DataFrame, **extra: Column) -> DataFrame:
    """Everything other jobs need to know about a note, without its text. ``extra`` columns come from the same scan."""
    return notes.select(
        "path", "ord", "dir", "name", "basename", "ext",
        is_drawing(F.col("path"), F.col("ext")).alias("is_drawing"), F.inline(F.array(_facts())),
        *[value.alias(name) for name, value in extra.items()],
    )


def key_facts(notes: DataFrame) -> DataFrame:
    """What a note is found by, for jobs that only resolve targets: no tags and no source fields are read from its text."""
    aliases = let(entries(F.col("content")), lambda fm: distinct_ci(as_list(raw_value(fm, "aliases", "alias"))))
    return notes.select("path", "ord", "name", "basename", "ext", aliases.alias("aliases"))


def metadata_table(notes: DataFrame) -> DataFrame:
    """Notes that carry at least one source field."""
    filled = F.filter(
        F.array(source_metadata_of(F.col("content"))), lambda m: F.coalesce(*[m[c] for c in METADATA_FIELDS]).isNotNull()
    )
    return notes.select("path", F.inline(filled))


def metadata_chips(meta: Column) -> Column:
    """Display chips in fixed order."""
    author_year = F.concat_ws(" ", meta["author"], meta["year"])
    locator = F.when(
        meta["locator"].rlike(r"(?i)^(p|pp|sec|chapter|ch)(?![0-9A-Za-z_])"), meta["locator"]
    ).otherwise(F.concat(F.lit("p. "), meta["locator"]))
    chips = F.array(
        F.concat(F.lit("@"), meta["citekey"]), F.when(author_year != "", author_year),
        facet_label(meta["source_type"]), facet_label(meta["evidence_kind"]), locator,
    )
    return F.filter(chips, lambda c: c.isNotNull())


def chip_table(notes: DataFrame) -> DataFrame:
    chips = let(source_metadata_of(F.col("content")), lambda m: F.array_join(metadata_chips(m), " · "))
    return notes.select("path", F.explode(F.filter(F.array(chips), lambda c: c != "")).alias("chips"))


def excerpt(content: Column) -> Column:
    """Body lines without blanks and ``#`` lines, joined, first 180 characters."""
    lines = F.transform(F.split(strip_frontmatter(content), "\n"), trim_all)
    kept = F.filter(lines, lambda x: (F.length(x) > 0) & ~x.startswith("#"))
    return F.substring(F.array_join(kept, " "), 1, 180)


def excerpt_table(notes: DataFrame) -> DataFrame:
    return notes.select("path", excerpt(F.col("content")).alias("excerpt"))


def is_natural_line(line: Column) -> Column:
    """Prose, not code and not mostly symbols. ``line`` is trimmed.

    Characters are counted by what is left when whole runs of the others are taken out, and letters only where symbols are many.
    """
    symbols = F.length(F.regexp_replace(line, rf"(?U)[A-Za-z0-9{fixed.CJK}\s]+", ""))
    letters = F.length(line) - F.length(F.regexp_replace(line, f"[A-Za-z{fixed.CJK}]+", ""))

    def prose(n: Column) -> Column:
        # seven tenths in whole numbers: 90 * 0.7 falls below 63 as a double
        dense = F.when(n > 8, n > F.floor(letters * 7 / 10)).otherwise(F.lit(False))
        return ~dense & ~((F.length(line) > 220) & (n > 4))

    return (F.length(line) > 0) & let(symbols, prose) & ~line.rlike(fixed.CODE_LIKE)


def natural_lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(strip_frontmatter(content), "\n"), trim_all), is_natural_line)


def natural_line_table(notes: DataFrame) -> DataFrame:
    """Numbered prose lines of every body."""
    return notes.select("path", F.posexplode(natural_lines(F.col("content")))).select(
        "path", (F.col("pos") + 1).alias("natural_no"), F.col("col").alias("text")
    )


def headings(content: Column) -> Column:
    return headings_in(outside_fences(content))


def headings_in(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"(?m)^#{1,6}[ \t]+(.*?)[ \t]*#*[ \t]*$"), F.lit(1))


def wikilinks(content: Column) -> Column:
    """Targets of links outside fences, in order."""
    return wikilinks_in(outside_fences(content))


def wikilinks_in(body: Column) -> Column:
    return F.transform(F.regexp_extract_all(body, F.lit(WIKILINK), F.lit(1)), trim_all)


# ----------------------------------------------------------------------------------------------------- relations


def relations_in(fm: Column, keys: list[str] | None = None) -> Column:
    """Typed relations of a frontmatter: (relation_key, targets)."""
    present = F.filter(F.transform(fm, lambda e: e["key"]), lambda k: is_in(k, keys or fixed.RESEARCH_RELATION_KEYS))
    return F.transform(
        F.array_distinct(present),
        lambda k: F.struct(
            k.alias("relation_key"),
            distinct_ci(as_list(F.get(F.reverse(F.filter(fm, lambda e: e["key"] == k)), F.lit(0))["raw"])).alias("targets"),
        ),
    )


def relation_table(notes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Typed relation values per note: (path, relation_key, pos, target_raw)."""
    return notes.select("path", F.explode(let(entries(F.col("content")), lambda fm: relations_in(fm, keys))).alias("r")).select(
        "path", "r.relation_key", F.posexplode("r.targets").alias("pos", "target_raw")
    )


def frontmatter_links(pairs: Column) -> Column:
    """Wikilinks written inside frontmatter values."""
    return F.flatten(F.transform(pairs, lambda e: F.regexp_extract_all(e["raw"], F.lit(WIKILINK), F.lit(1))))


def summary_text(values: Column) -> Column:
    return collapse(trim_all(values))
