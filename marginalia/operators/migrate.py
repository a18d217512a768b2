"""Corpus migration: junk report, names, path plans, link rewriting, hash cleaning, section and block edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import decode_link, dir_of, encode_link, name_of, relative, resolve, stem_of, suffix_of
from ..functions.text import let, safe_filename, trim_all
from .evidence import per_note
from .notes import FENCE
from .refs import clamped_range, range_preview
from .settle import settle
from .skew import number_within

# ------------------------------------------------------------------------------------------------------ junk report


def note_lengths(content: Column) -> Column:
    """(body_len, total_len): body without frontmatter and without a leading ``# `` line."""
    body = trim_all(F.regexp_replace(content, r"\A---\n[\s\S]*?\n---\n?", ""))
    bare = let(body, lambda b: F.when(b.startswith("# "), trim_all(F.regexp_replace(b, r"\A[^\n]*\n?", ""))).otherwise(b))
    return F.struct(F.length(bare).alias("body_len"), F.length(trim_all(content)).alias("total_len"))


def junk_reason(path: Column, body_len: Column, total_len: Column) -> Column:
    name, generic = name_of(path), stem_of(name_of(path)).isin(*fixed.GENERIC_STEMS)
    html = F.lower(path).endswith(".html")
    archived = F.array_contains(F.split(path, "/"), F.lit("Archive"))
    return (
        F.when(html & ~archived & generic, "generic-name").when(html | ~path.endswith(".md"), F.lit(None))
        .when(name.startswith("_"), F.lit(None)).when(generic, "generic-name")
        .when((body_len < 10) & (total_len < 300), "too-short")
    )


def junk_report(files: DataFrame) -> DataFrame:
    """P5: keep or delete for every file, with lengths and reason."""
    rows = files.select("path", F.inline(F.array(note_lengths(F.col("content")))))
    return rows.withColumn("reason", junk_reason(F.col("path"), F.col("body_len"), F.col("total_len"))).select(
        "path", "body_len", "total_len", F.when(F.col("reason").isNull(), "keep").otherwise("delete").alias("action"), "reason"
    )


# ------------------------------------------------------------------------------------------------------------ names


def conflict_free(rows: DataFrame, existing: DataFrame | None = None, sep: str = "-") -> DataFrame:
    """Number equal targets. ``rows`` has dir, stem, suffix and a unique integer ``ord``; the result adds ``name``.

    The first file keeps its name, later ones get ``-2``, ``-3`` … A numbered name that another file carries literally is
    skipped. Copies of one name are numbered in buckets, so a name shared by very many files is no bottleneck.
    """
    key = ["dir", "stem", "suffix"]
    numbered = number_within(rows, key, "ord", "copy")
    if existing is not None:
        held = existing.select(*key).distinct().withColumn("held", F.lit(1))
        numbered = numbered.join(held, key, "left").withColumn("copy", F.col("copy") + F.coalesce("held", F.lit(0))).drop("held")
    many = numbered.where("copy > 1").select(*key).distinct()
    literal = rows.select(*key).unionByName(existing.select(*key)) if existing is not None else rows.select(*key)
    pattern = rf"^(.*){sep}([1-9]\d*)$"
    claims = literal.distinct().where(F.col("stem").rlike(pattern)).select(
        "dir", F.regexp_extract("stem", pattern, 1).alias("stem"), "suffix", F.regexp_extract("stem", pattern, 2).try_cast("bigint").alias("taken")
    ).where("taken >= 2").join(many, key, "left_semi")
    blocked = claims.groupBy(*key).agg(F.transform(F.array_sort(F.collect_set("taken")), lambda k, i: k - i).alias("blocked"))
    joined = numbered.join(blocked, key, "left")
    skip = F.when(F.col("copy") > 1, F.size(F.filter(F.coalesce("blocked", F.array().cast("array<bigint>")), lambda b: b <= F.col("copy")))).otherwise(0)
    number = F.col("copy") + skip
    label = F.when(F.col("copy") > 1, F.concat(F.lit(sep), number.cast("string"))).otherwise("")
    return joined.withColumn("name", F.concat("stem", label, "suffix")).drop("copy", "blocked")


def settled_names(rows: DataFrame) -> DataFrame:
    """``conflict_free`` computed once, for plans that look the names up more than once."""
    return settle(conflict_free(rows))


def safe_names(rows: DataFrame) -> DataFrame:
    """W4 from raw titles: (dir, title, suffix, ord) -> name."""
    return conflict_free(rows.withColumn("stem", safe_filename(F.col("title"))))


# ------------------------------------------------------------------------------------------------------- path plans

MAX_STEM_BYTES = 150


def flat_stem(parts: Column, rel: Column) -> Column:
    """Parts joined by ``__``; a stem over 150 bytes is clipped at a character and gets a hash of the old path."""
    clean = F.transform(F.filter(parts, lambda p: p != ""), lambda p: trim_all(F.regexp_replace(p, r"(?U)\s+", " ")))
    budget = MAX_STEM_BYTES - 12

    def limit(stem: Column) -> Column:
        raw = F.encode(stem, "UTF-8")
        heads = [F.try_validate_utf8(F.substring(raw, 1, budget - n).cast("string")) for n in range(4)]
        clipped = F.regexp_replace(F.coalesce(*heads), "[_ ]+$", "")
        return F.when(F.octet_length(stem) <= MAX_STEM_BYTES, stem).otherwise(
            F.concat(clipped, F.lit("__"), F.substring(F.sha1(F.encode(rel, "UTF-8")), 1, 10))
        )

    return let(F.array_join(clean, "__"), limit)


def flatten_plan(files: DataFrame, depth: int = 3, skip: tuple[str, ...] = ("Archive", ".config")) -> DataFrame:
    """Files more than one level below a folder of depth ``depth`` move up into it: (ord, old_path, new_path)."""
    parts = F.split("path", "/")
    deep = files.where((F.size(parts) > depth + 1) & ~F.get(parts, F.lit(0)).isin(*skip)).select("path", "ord", parts.alias("p"))
    rel = F.slice("p", depth + 1, F.greatest(F.size("p") - depth, F.lit(0)))
    file_name = F.element_at("p", -1)
    flat = flat_stem(
        F.concat(F.slice("p", depth + 1, F.greatest(F.size("p") - depth - 1, F.lit(0))), F.array(stem_of(file_name))), F.array_join(rel, "/")
    )
    with_stem = deep.select(
        "path", "ord", F.inline(F.array(F.struct(
            F.array_join(F.slice("p", 1, depth), "/").alias("dir"), flat.alias("stem"), suffix_of(file_name).alias("suffix")
        ))),
    )
    there = files.where(F.size(parts) == depth + 1).select(
        dir_of(F.col("path")).alias("dir"), stem_of(name_of(F.col("path"))).alias("stem"), suffix_of(name_of(F.col("path"))).alias("suffix")
    )
    return conflict_free(with_stem, there, "--").select(
        "ord", F.col("path").alias("old_path"), F.concat("dir", F.lit("/"), "name").alias("new_path")
    )


def journal_name(rel: Column, prefix: Column) -> Column:
    """``2024/3 - March/7 - label/…`` -> ``2024-03-07 label``; other files keep their stem. Prefix first."""
    two = lambda v: F.when(F.length(v) < 2, F.lpad(v, 2, "0")).otherwise(v)

    def build(x: Column) -> Column:
        p, day = x["parts"], x["day"]
        dated = (F.size(p) >= 3) & F.get(p, F.lit(0)).rlike(r"^\d+$") & F.contains(day, F.lit(" - "))
        month = two(F.substring_index(F.get(p, F.lit(1)), " - ", 1))
        number = two(F.substring_index(day, " - ", 1))
        label = F.substring(day, F.instr(day, " - ") + 3, F.length(day))
        date = F.concat(F.get(p, F.lit(0)), F.lit("-"), month, F.lit("-"), number, F.lit(" "), label)
        return F.concat(prefix, F.when(dated, date).otherwise(x["stem"]))

    def split(p: Column) -> Column:
        return let(
            stem_of(F.element_at(p, -1)),
            lambda s: F.struct(p.alias("parts"), s.alias("stem"), F.when(F.size(p) > 3, F.get(p, F.lit(2))).otherwise(s).alias("day")),
        )

    return let(let(F.split(rel, "/"), split), build)


def journal_plan(files: DataFrame, root: str, target: str, prefix: str = "") -> DataFrame:
    """W6 for all text files below ``root``: (ord, old_path, new_path); generic names are left to the junk report."""
    inside = files.where(
        F.col("path").startswith(root + "/") & F.lower(suffix_of(name_of(F.col("path")))).isin(".md", ".html")
        & ~stem_of(name_of(F.col("path"))).isin(*fixed.GENERIC_STEMS)
    )
    rel = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    rows = inside.select(
        "ord", "path", F.lit(target).alias("dir"), F.inline(F.array(F.struct(
            journal_name(rel, F.lit(prefix)).alias("stem"), suffix_of(name_of(F.col("path"))).alias("suffix")
        ))),
    )
    there = files.where(dir_of(F.col("path")) == target).select(
        F.lit(target).alias("dir"), stem_of(name_of(F.col("path"))).alias("stem"), suffix_of(name_of(F.col("path"))).alias("suffix")
    )
    return conflict_free(rows, there).select("ord", F.col("path").alias("old_path"), F.concat("dir", F.lit("/"), "name").alias("new_path"))


def cluster_moves(files: DataFrame, root: str, mapping: DataFrame, leftovers: str, demos: list[str]) -> DataFrame:
    """Entries below ``root`` go to the folder of the first stem they equal or start with (``stem.`` or ``stem_``).

    The prefix join is an equi join: an entry offers itself and every prefix that ends before a dot or underscore. Entries
    of ``demos`` are deleted, the rest moves to ``leftovers``. ``mapping``: (stem, folder, pos).
    """
    rel = F.substring("path", F.lit(len(root) + 2), F.length("path"))
    inside = files.where(F.col("path").startswith(root + "/")).select("path", "ord", rel.alias("rel"))
    child = F.get(F.split("rel", "/"), F.lit(0))
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(F.length("child"), F.lit(1))), lambda i: F.substring("child", i, F.lit(1)).isin(".", "_"))
    prefixes = F.array_distinct(F.concat(F.array("child"), F.transform(cuts, lambda i: F.substring("child", F.lit(1), i - 1))))
    names = inside.select(child.alias("child")).distinct().withColumn("stems", prefixes)
    found = names.select("child", F.explode("stems").alias("stem")).join(mapping, "stem").groupBy("child").agg(F.min_by("folder", "pos").alias("folder"))
    demo = F.exists("stems", lambda s: s.isin(*demos)) if demos else F.lit(False)
    settled = names.select("child", demo.alias("demo")).join(found, "child", "left")
    joined = inside.withColumn("child", child).join(settled, "child")
    dst = F.concat_ws("/", F.coalesce("folder", F.lit(leftovers)), "rel")
    return joined.select(
        "ord", F.col("path").alias("old_path"), F.when(F.col("demo"), "delete").otherwise("move").alias("op"), F.when(~F.col("demo"), dst).alias("new_path"),
        F.when(F.col("demo"), "demo-entry").when(F.col("folder").isNotNull(), "cluster").otherwise("leftover").alias("reason"),
    )


# ---------------------------------------------------------------------------------------------------- link rewriting

MARKDOWN_LINK = r"(!?\[[^\]]*\]\()([^)]+)(\))"
HTML_LINK = r"""(?i)((?:src|href)=["'])([^"']+)(["'])"""


def skips(target: Column) -> Column:
    low = F.lower(target)
    return (
        (target == "") | target.rlike("^[#/?]") | F.contains(target, F.lit("://")) | low.startswith("mailto:")
        | low.startswith("javascript:") | low.startswith("data:")
    )


def _link_rows(files: DataFrame, pattern: str) -> DataFrame:
    return files.where(F.col("content").rlike(pattern)).select(
        "path", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(2))).alias("n", "raw")
    )


def _with_targets(pattern: str) -> Column:
    """``content`` with the targets of ``new`` (n, target) in their places."""
    pieces = F.split("content", pattern, -1)
    hits = F.arrays_zip(*[F.regexp_extract_all("content", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (1, 2, 3)])

    def put(new: Column) -> Column:
        by_n = F.map_from_entries(new)
        return F.transform(hits, lambda h, i: F.concat(h["g1"], F.coalesce(F.try_element_at(by_n, i), h["g2"]), h["g3"]))

    return let(
        F.struct(pieces.alias("p"), put(F.col("new")).alias("h")),
        lambda x: F.array_join(F.transform(x["p"], lambda p, i: F.concat(p, F.coalesce(F.get(x["h"], i), F.lit("")))), ""),
    )


def _rebuild(files: DataFrame, pattern: str, replaced: DataFrame) -> DataFrame:
    """Put new targets into their places. ``replaced``: (path, n, target), only of files with a changed link."""
    lists = replaced.groupBy("path").agg(F.collect_list(F.struct("n", "target")).alias("new"))
    return files.join(lists, "path").select(*[c for c in files.columns if c != "content"], _with_targets(pattern).alias("content"))


def rewrite_links(files: DataFrame, path_map: DataFrame, html: bool = False) -> DataFrame:
    """Files whose links change when ``path_map`` (old_path, new_path) is carried out: (path, new_path, content).

    Links are looked up as distinct old targets (equi join with moved and existing files), so a target linked from very many files
    is resolved once. Text is touched only for files with a changed link.
    """
    pattern = HTML_LINK if html else MARKDOWN_LINK
    suffix = ".html" if html else ".md"
    texts = files.select("path", "content").where(F.lower("path").endswith(suffix))
    moved = texts.select("path").join(path_map.select(F.col("old_path").alias("path"), "new_path"), "path", "left")
    moved = moved.withColumn("new_path", F.coalesce("new_path", "path"))
    links = _link_rows(texts, pattern).where(~skips(F.col("raw")))
    bare = F.substring_index("raw", "#", 1)
    anchor = F.when(F.contains("raw", F.lit("#")), F.substring("raw", F.length(bare) + 2, F.length("raw"))).otherwise("")
    links = links.select("path", "n", "raw", anchor.alias("anchor"), decode_link(bare).alias("decoded")).where(~skips(F.col("decoded")))
    links = links.withColumn("old_target", resolve(dir_of(F.col("path")), F.col("decoded")))
    known = files.select(F.col("path").alias("old_target")).unionByName(path_map.select(F.col("old_path").alias("old_target"))).distinct()
    places = links.select("old_target").distinct().join(known, "old_target", "left_semi").join(
        path_map.select(F.col("old_path").alias("old_target"), F.col("new_path").alias("new_target")), "old_target", "left"
    ).withColumn("new_target", F.coalesce("new_target", "old_target"))
    placed = links.join(places, "old_target").join(moved, "path")
    link = encode_link(relative(F.col("new_target"), dir_of(F.col("new_path"))))
    target = F.when(F.col("anchor") != "", F.concat(link, F.lit("#"), "anchor")).otherwise(link)
    changed = placed.select("path", "n", "raw", target.alias("target")).where("raw <> target").drop("raw")
    return _rebuild(texts, pattern, changed).join(moved, "path").select("path", "new_path", "content")


def import_links(pages: DataFrame, path_map: DataFrame, key: str, parts: int) -> DataFrame:
    """J9 for imported pages: targets may lack ``.html`` or start at the root; query and fragment stay.

    ``pages``: (key, path = old path, new_path, content), dealt to ``parts`` tasks by ``key``; returns every page with its rewritten
    content. Texts are computed once and stay in their tasks: links leave them as short rows and come back as one list a page.
    """
    pattern = MARKDOWN_LINK
    pages = settle(pages)
    links = pages.where(F.col("content").rlike(pattern)).select(
        key, "path", "new_path", F.posexplode(F.regexp_extract_all("content", F.lit(pattern), F.lit(2))).alias("n", "raw")
    ).where(~F.col("raw").rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//|#)"))
    bare = F.regexp_extract("raw", r"^[^?#]*", 0)
    rest = F.substring("raw", F.length(bare) + 1, F.length("raw"))
    rooted = decode_link(bare)
    at = F.when(rooted.startswith("/"), F.regexp_replace(rooted, "^/+", "")).otherwise(resolve(dir_of(F.col("path")), rooted))
    links = links.select(key, "n", dir_of(F.col("new_path")).alias("new_dir"), rest.alias("rest"), at.alias("at"))
    # a file answers to its path, and a page also to its path without .html where no other suffix is left
    bald = F.regexp_replace("old_path", r"\.html$", "")
    plain = F.col("old_path").endswith(".html") & (suffix_of(name_of(bald)) == "")
    answers = F.array(F.struct(F.lit(0).alias("v"), F.col("old_path").alias("at")), F.struct(F.lit(1).alias("v"), bald.alias("at")))
    places = path_map.select(F.col("new_path").alias("target_path"), F.explode(F.when(plain, answers).otherwise(F.slice(answers, 1, 1))).alias("o")).select(
        "target_path", "o.*"
    ).groupBy("at").agg(F.min_by("target_path", "v").alias("target_path"))
    target = F.concat(encode_link(relative(F.col("target_path"), F.col("new_dir"))), "rest")
    lists = links.join(places, "at").select(key, "n", target.alias("target")).repartition(parts, key).groupBy(key).agg(
        F.collect_list(F.struct("n", "target")).alias("new")
    )
    text = F.when(F.col("new").isNull(), F.col("content")).otherwise(_with_targets(pattern))
    return pages.repartition(parts, key).join(lists, key, "left").select("path", "new_path", text.alias("content"))


# ---------------------------------------------------------------------------------------------------- hash cleaning

HEADING = r"^(\s{0,3}#{1,6})([^ #`\r\n].*?)(\r?)$"
URL = r"(?U)https?://[^\s)>]+"
CLEANING = [
    # (counted pattern, replaced pattern, replacement), in order
    (URL, r"(?U)(https?://[^\s)>#]*?)\\*#([^\s)>]*)", r"$1\\#$2"),
    (r"(?U)(?<!\\)(?<![\w/])#([0-9A-Fa-f]{3,8})\b", None, r"\\#$1"),
    (r"(?U)(?<!\\)#(root/[A-Za-z0-9_-]+)\b", None, r"\\#$1"),
    (r"(?U)(?<!\\)#(fnref?[A-Za-z0-9_-]+)\b", None, r"\\#$1"),
    (r"url\(#([A-Za-z][A-Za-z0-9_-]*)\)", None, r"url(\\#$1)"),
    (r"(?U)(?<!\\)(?<!\w)#(\d+)(?=\b|\])", None, r"\\#$1"),
    (r"(?U)(?<!\\)(?<!\w)#((?=[A-Za-z0-9-]*[A-Za-z])(?=[A-Za-z0-9-]*\d)[A-Za-z0-9-]+)\b", None, r"\\#$1"),
    (r"(?U)(?<!\\)(?<!\w)#([A-Z][A-Za-z0-9]+(?:[A-Z][A-Za-z0-9]+)+)\b", None, r"\\#$1"),
    (r"(?U)([:：])\s*#(?=[A-Za-z\x{4e00}-\x{9fff}])", None, "$1 "),
    (r"(?U)(?<=\s)#([\x{4e00}-\x{9fff}][\w\x{4e00}-\x{9fff}]+)", None, " $1"),
]


def clean_line(line: Column) -> Column:
    """W3 for one line outside a fence: (text, replacements)."""
    body = F.regexp_extract(line, HEADING, 2)
    inner = trim_all(body)
    accidental = inner.rlike(r"^(?:[0-9A-Fa-f]{3,8}|root/[A-Za-z0-9_-]+|fnref?[A-Za-z0-9_-]+|\d+)$")
    titled = inner.rlike(r"[\x{4e00}-\x{9fff}]") | inner.rlike(r"(?U)\s")
    spaced = line.rlike(HEADING) & ~accidental & titled & (inner != "")
    state = F.struct(
        F.when(spaced, F.regexp_replace(line, HEADING, "$1 $2$3")).otherwise(line).alias("text"), spaced.cast("int").alias("n")
    )
    for counted, replaced, by in CLEANING:
        state = let(state, _pass(counted, replaced or counted, by))
    return F.when(F.contains(line, F.lit("#")) | F.contains(line, F.lit("://")), state).otherwise(
        F.struct(line.alias("text"), F.lit(0).alias("n"))
    )


def _pass(counted: str, replaced: str, by: str):
    return lambda s: F.struct(
        F.regexp_replace(s["text"], replaced, by).alias("text"), (s["n"] + F.regexp_count(s["text"], F.lit(counted))).alias("n")
    )


def clean_hashes(notes: DataFrame) -> DataFrame:
    """Every note with its cleaned text, the number of replacements and whether the text changed."""
    header = F.regexp_extract("content", r"\A---\n[\s\S]*?\n---\n?", 0)
    body = F.substring("content", F.length(header) + 1, F.length("content"))

    def cleaned(lines: Column) -> Column:
        marks = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(FENCE), i)), lambda i: i.isNotNull())
        return let(
            marks,
            lambda m: F.transform(
                lines,
                lambda x, i: F.when(
                    x.rlike(FENCE) | (F.size(F.filter(m, lambda k: k < i)) % 2 == 1), F.struct(x.alias("text"), F.lit(0).alias("n"))
                ).otherwise(clean_line(x)),
            ),
        )

    result = let(
        cleaned(F.split(body, "\n")),
        lambda c: F.struct(
            F.concat(header, F.array_join(F.transform(c, lambda x: x["text"]), "\n")).alias("cleaned"),
            F.aggregate(c, F.lit(0), lambda a, x: a + x["n"]).alias("replacements"),
        ),
    )
    rows = notes.select("path", "content", F.inline(F.array(result)))
    return rows.select("path", F.col("cleaned").alias("content"), "replacements", (F.col("cleaned") != F.col("content")).alias("changed"))


def cleaning_summary(cleaned: DataFrame) -> DataFrame:
    """Processed and changed files; replacements are summed over changed files only."""
    return cleaned.agg(
        F.count(F.lit(1)).alias("processed"), F.count_if("changed").alias("changed"),
        F.coalesce(F.sum(F.when(F.col("changed"), F.col("replacements"))), F.lit(0)).alias("replacements"),
    )


# ------------------------------------------------------------------------------------------------------------- edits


def append_section(notes: DataFrame, additions: DataFrame) -> DataFrame:
    """Add ``text`` at the end of notes, in drawings before the ``%%`` line. ``additions``: (path, text)."""
    rows = notes.join(additions, "path")
    drawing = F.lower("path").endswith(".excalidraw.md") | F.lower("path").endswith(".excalidraw")
    at = F.instr("content", "\n%%\n")
    line_end = lambda c: F.when(c.endswith("\n"), "").otherwise("\n")
    before = F.substring("content", F.lit(1), at - 1)
    after = F.substring("content", at, F.length("content"))
    inside = F.concat(before, line_end(before), F.col("text"), F.lit("\n"), after)
    tail = F.concat("content", line_end(F.col("content")), F.col("text"), F.lit("\n"))
    return rows.select("path", F.when(drawing & (at > 0), inside).otherwise(tail).alias("content"))


ANCHOR_ID = r"\s+\^([A-Za-z0-9-]+)\s*$"


def assign_block_ids(notes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Block id for every requested range (path, start_line, end_line); an id on the last filled line is reused.

    New ids are a hash of path and line. Several ranges of one note may share their anchor line, so ids are made per
    anchor line and the note text is written once, by the first range of the note.
    """
    def anchor(lines: Column, r: Column) -> Column:
        def told(span: Column) -> Column:
            filled = F.filter(F.sequence(span["start"], span["end"]), lambda i: F.length(trim_all(F.get(lines, i - 1))) > 0)
            at = F.coalesce(F.when(F.size(filled) > 0, F.element_at(filled, -1)), span["end"])
            return let(at, lambda a: F.struct(
                span["start"].alias("start_line"), span["end"].alias("end_line"), a.alias("anchor_line"),
                F.regexp_extract(F.get(lines, a - 1), ANCHOR_ID, 1).alias("old"), range_preview(lines, span["start"], span["end"]).alias("preview")))

        return F.when(lines.isNotNull(), let(clamped_range(r["start_line"], r["end_line"], F.size(lines)), told))

    rows = per_note(ranges.select("path", "start_line", "end_line").distinct(), notes, anchor).where("out IS NOT NULL").select("path", "out.*")
    made = F.concat(F.lit("ref-"), F.substring(F.sha1(F.concat_ws(":", "path", "anchor_line")), 1, 6))
    return rows.select(
        "path", "start_line", "end_line", "anchor_line", F.when(F.col("old") != "", F.col("old")).otherwise(made).alias("block_id"), (F.col("old") != "").alias("reused"), "preview",
    )


def write_block_ids(notes: DataFrame, assigned: DataFrame) -> DataFrame:
    """Notes with the new ids written at their anchor lines; only changed notes."""
    new = assigned.where("not reused").select("path", "anchor_line", "block_id").distinct()
    lists = new.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("anchor_line", "block_id"))).alias("ids"))

    def mark(x: Column, i: Column) -> Column:
        base = F.regexp_replace(x, r"(?U)\s+$", "")
        block = F.try_element_at("ids", i + 1)
        return F.when(block.isNull(), x).when(base == "", F.concat(F.lit("^"), block)).otherwise(F.concat(base, F.lit(" ^"), block))

    return notes.join(lists, "path").select("path", F.array_join(F.transform(F.split("content", "\n"), mark), "\n").alias("content"))


# --------------------------------------------------------------------------------------------------- reorganisation


def reorganise(
    files: DataFrame, examples: list[str], inbox: str, inbox_target: str, import_root: str, mapping: DataFrame, leftovers: str,
    demos: list[str], journal_root: str, journal_target: str,
) -> DataFrame:
    """One plan row per touched file and step: (step, op, src, dst, reason, path).

    Steps run in order on the paths that earlier steps left: root examples, inbox notes, imported clusters, journals, flattening,
    junk. Only paths, lengths and ids travel; the text is measured once at the start.
    """
    state = settle(files.select(F.col("ord"), F.col("path").alias("origin"), "path", F.inline(F.array(note_lengths(F.col("content"))))))
    plans = []

    def apply(step: int, moves: DataFrame) -> None:
        """``moves``: (ord, op, new_path, reason)."""
        nonlocal state
        named = moves.select("ord", "op", "new_path", "reason")
        # every later step reads this state several times
        joined = settle(state.join(named, "ord", "left"))
        plans.append(
            joined.where("op is not null").select(
                F.lit(step).alias("step"), "op", F.col("path").alias("src"), F.col("new_path").alias("dst"), "reason", F.col("origin").alias("path")
            )
        )
        state = joined.where("op is null or op = 'move'").withColumn("path", F.coalesce("new_path", "path")).select(
            "ord", "origin", "path", "body_len", "total_len"
        )

    moved = lambda plan, why: plan.select("ord", F.lit("move").alias("op"), "new_path", F.lit(why).alias("reason"))
    apply(1, state.where(F.col("path").isin(*examples)).select("ord", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("new_path"), F.lit("root-example").alias("reason")))
    rel = F.substring("path", F.lit(len(inbox) + 2), F.length("path"))
    apply(2, state.where(F.col("path").startswith(inbox + "/")).select(
        "ord", F.lit("move").alias("op"), F.concat(F.lit(inbox_target + "/"), F.regexp_replace(rel, r"^([^/]*)/notes/([^/]*)$", "$1/$2")).alias("new_path"), F.lit("inbox").alias("reason")
    ))
    apply(3, cluster_moves(state, import_root, mapping, leftovers, demos))
    apply(4, moved(journal_plan(state, journal_root, journal_target), "journal"))
    apply(5, moved(flatten_plan(state), "too-deep"))
    reason = junk_reason(F.col("path"), F.col("body_len"), F.col("total_len"))
    junk = state.select("ord", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("new_path"), reason.alias("reason")).where("reason is not null")
    apply(6, junk)
    out = plans[0]
    for p in plans[1:]:
        out = out.unionByName(p)
    return out


def migration_summary(plan: DataFrame) -> DataFrame:
    """Planned operations per kind."""
    return plan.groupBy("op").agg(F.count(F.lit(1)).alias("files"))


def by_file(plan: DataFrame) -> DataFrame:
    """First planned step of every file."""
    w = Window.partitionBy("path").orderBy("step")
    return plan.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
