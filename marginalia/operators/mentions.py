"""Unlinked mentions of note titles and aliases.

Titles are found by equi joins on n-grams, never by comparing every title with every text. A title has the windows of up to four of its
tokens, or of the characters of its first CJK run, or of its first run of signs when it has nothing else; a text offers its distinct windows of the
sizes that occur, and only those that begin like a title where titles begin with few words. Texts are counted for every window that titles and texts share, and each title is looked up by its rarest one. The whole
title is then checked, all candidates of a note at once, so a window only narrows and a text is read once.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import ASCII_BOUNDARY, WORD_END, collapse, distinct_ci, has_cjk, let, trim_all
from .graph import note_keys, read_hosts, resolve
from .notes import strip_frontmatter
from .settle import settle
from .skew import number_within, top_k

TOKEN = r"[0-9A-Za-z_]+|[^\x00-\x7f\x{3400}-\x{9fff}]+"
SIGN = r"[^0-9A-Za-z_\s\x{80}-\x{10ffff}]"
# the two kinds of runs in TOKEN, and what stands between tokens
RUNS = ("[0-9A-Za-z_]", r"[^\x00-\x7f\x{3400}-\x{9fff}]")
BETWEEN = r"(?:(?![0-9A-Za-z_])[\x00-\x7f\x{3400}-\x{9fff}])*+"
MAX_GRAM = 4
FEW_STARTS = 1000  # different first tokens of title windows that a text is sifted by
PER_NOTE = 8


def title_terms(facts: DataFrame) -> DataFrame:
    """Distinct titles and aliases of at least two characters: (target_path, term_no, term)."""
    terms = F.filter(distinct_ci(F.concat(F.array("basename"), F.col("aliases"))), lambda t: F.length(t) >= 2)
    return facts.select(F.col("path").alias("target_path"), F.posexplode(terms).alias("term_no", "term"))


def _windows(items: Column, size: Column, glue: str) -> Column:
    """All runs of ``size`` neighbours of ``items``, joined."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(items) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(items, i, size), glue)))


def _term_grams(term: Column) -> Column:
    """Windows of a title: (family, size, gram)."""
    run = F.regexp_extract(term, f"[{fixed.CJK}]+", 0)
    signs = F.regexp_extract(term, f"{SIGN}+", 0)
    tokens = F.regexp_extract_all(F.lower(term), F.lit(TOKEN), F.lit(0))
    chars = lambda text: F.filter(F.split(text, ""), lambda c: c != "")

    def grams(family: str, items: Column, glue: str) -> Column:
        size = lambda x: F.least(F.size(x), F.lit(MAX_GRAM))
        return let(items, lambda x: F.transform(_windows(x, size(x), glue), lambda g: F.struct(F.lit(family).alias("family"), size(x).alias("size"), g.alias("gram"))))

    return F.when(has_cjk(term), grams("c", chars(run), "")).when(F.size(tokens) > 0, grams("w", tokens, " ")).otherwise(grams("s", chars(signs), ""))


def _text_grams(body: Column, sizes: list[tuple[str, int]], starts: list[str] | None = None) -> Column:
    """Distinct n-grams of a text, only of the sizes that occur among the keys, and if ``starts`` are given only those of words that begin with one."""

    def words(tokens: Column, n: int) -> Column:
        grams = tokens
        for k in range(1, n):
            rest = F.slice(tokens, k + 1, F.greatest(F.size(tokens) - k, F.lit(0)))
            # the shorter side pads with null, which makes the unfinished grams at the end null
            grams = F.zip_with(grams, rest, lambda a, t: F.concat(a, F.lit(" "), t))
        return F.array_compact(F.array_distinct(grams))

    def chars(kind: str, n: int) -> Column:
        return F.array_distinct(F.regexp_extract_all(body, F.lit(f"(?=({kind}{{{n}}}))"), F.lit(1)))

    def begun(text: Column, n: int) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(_begun(starts, n)), F.lit(1)))
        return F.array_distinct(F.transform(found, lambda w: F.array_join(F.regexp_extract_all(w, F.lit(TOKEN), F.lit(0)), " ")))

    def collect(text: Column) -> Column:
        kinds = {"c": f"[{fixed.CJK}]", "s": SIGN}
        of_words = words if starts is None else begun
        parts = [F.transform(of_words(text, n) if fam == "w" else chars(kinds[fam], n), functools.partial(_tag, fam, n)) for fam, n in sizes]
        return F.concat(*parts)

    # a text is cut into all its tokens only where any of them may begin a title
    lowered = F.lower(body)
    return let(lowered if starts is not None else F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0)), collect)


def _begun(starts: list[str], size: int) -> str:
    """Pattern whose first group is a run of ``size`` tokens that begins with one of ``starts``; runs may overlap. A token holds no sign of a pattern."""
    options = []
    for run in RUNS:
        by_first: dict[str, list[str]] = {}
        for t in starts:
            if re.match(r"[0-9A-Za-z_]", t) if run == RUNS[0] else not t[0].isascii():
                by_first.setdefault(t[0], []).append(t[1:])
        if by_first:
            words = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items()))
            options.append(f"(?<!{run})(?:{words})(?!{run})")
    more = f"(?:{BETWEEN}(?:{RUNS[0]}++|{RUNS[1]}++)){{{size - 1}}}"
    return f"(?=((?:{'|'.join(options)}){more}))"


def _tag(family: str, size: int, gram: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), F.lit(size).alias("size"), gram.alias("gram"))


def first_position(text: Column, term: Column) -> Column:
    """1-based place of the first mention, 0 when there is none. CJK terms match anywhere, others as whole words."""
    escaped = F.regexp_replace(term, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    # the plain look-around is enough for an edge that is an ASCII word character; behind the term it is tried only where the term stands
    behind = F.concat(escaped, F.lit("(?<![0-9A-Za-z_]"), escaped, F.lit(")"))
    start = F.when(term.rlike("^[0-9A-Za-z_]"), behind).otherwise(F.concat(F.lit(ASCII_BOUNDARY), escaped))
    end = F.when(term.rlike("[0-9A-Za-z_]$"), WORD_END).otherwise(ASCII_BOUNDARY)
    pattern = F.concat(F.lit("(?i)"), start, end)
    return F.when(has_cjk(term), F.instr(text, term)).otherwise(F.regexp_instr(text, pattern))


def snippet(text: Column, position: Column, length: Column) -> Column:
    start = F.greatest(F.lit(0), position - 1 - 50)
    end = F.least(F.length(text), position - 1 + length + 80)
    return trim_all(collapse(F.substring(text, start + 1, end - start)))


def mention_hits(notes: DataFrame, terms: DataFrame) -> DataFrame:
    """Every (term, note) pair in which the note mentions the term, checked, with its snippet."""
    key = ["family", "size", "gram"]
    offered = settle(terms.select("term").distinct().select("term", F.explode(_term_grams(F.col("term"))).alias("g")).select("term", "g.*").where("gram <> ''"))
    # at most 3 * MAX_GRAM rows reach the driver
    sizes = [(r.family, r.size) for r in offered.select("family", "size").distinct().collect()]
    body = strip_frontmatter(F.col("content"))
    if not sizes:
        sizes = [("w", 1)]
    # titles of numbered notes begin with few words: then a text offers only the windows that begin with one of these; no more than they are read here
    begun = offered.where("family = 'w'").select(F.substring_index("gram", " ", 1).alias("t")).distinct().limit(FEW_STARTS + 1).collect()
    starts = sorted(r.t for r in begun) if 0 < len(begun) <= FEW_STARTS else None
    grams = notes.select("path", F.explode(_text_grams(body, sorted(sizes), starts)).alias("g")).select("path", "g.*")
    # windows that a title and a text share; Spark picks the join by the measured bytes of the dictionary
    met = settle(grams.join(offered.select(*key).distinct(), key))
    texts = met.groupBy(*key).agg(F.count(F.lit(1)).alias("texts"))
    # a title with a window that no text has is mentioned nowhere
    counted = offered.join(texts, key, "left").groupBy("term").agg(F.min(F.coalesce("texts", F.lit(0))).alias("least"), F.min_by(F.struct(*key), F.struct("texts", "gram")).alias("k"))
    rarest = counted.where("least > 0").select("term", "k.*")
    candidates = met.join(rarest, key).groupBy("path").agg(F.collect_set("term").alias("terms"))
    checked = notes.select("path", "ord", "ext", body.alias("body")).join(candidates, "path")
    found = lambda t: let(first_position(F.col("body"), t), lambda p: F.when(p > 0, F.struct(t.alias("term"), snippet(F.col("body"), p, F.length(t)).alias("snippet"))))
    hits = F.filter(F.transform("terms", found), lambda x: x.isNotNull())
    return checked.select("path", "ord", "ext", F.explode(hits).alias("h")).select("h.term", "path", "ord", "ext", "h.snippet")


def unlinked_mentions(notes: DataFrame, limit: int = PER_NOTE, read: DataFrame | None = None) -> DataFrame:
    """Up to ``limit`` notes per target that mention it without a host link to it, in file order. A line reference is no such link.

    A common title may belong to very many notes and appear in very many texts. A target needs no more than the first
    ``limit + 1 + (notes already linking to it)`` mentions of each of its terms to fill its list, because only itself and
    those notes can be skipped; so the mention list of a term is numbered once and every target joins the places it needs.
    ``read``: the notes as ``read_hosts`` or ``read_notes`` gives them, if they were read already.
    """
    facts = settle(read_hosts(notes)) if read is None else read
    terms = title_terms(facts)
    hits = settle(mention_hits(notes, terms))
    rank_key = F.shiftleft((F.col("ext") == "excalidraw").cast("bigint"), 62) + F.col("ord")
    numbered = number_within(hits.withColumn("file_order", rank_key), ["term"], "file_order", "place")
    edges = resolve(facts.select("path", F.explode("hosts").alias("target")), note_keys(facts)).where("target_path <> path")
    links = settle(edges.select("target_path", F.col("path").alias("source_path")).distinct())
    linked = links.groupBy("target_path").agg(F.count(F.lit(1)).alias("linked"))
    owners = terms.join(linked, "target_path", "left").withColumn("need", F.coalesce("linked", F.lit(0)) + limit + 1)
    # an owner asks for the places it needs, so a title of many notes that stands in many texts costs no more than those rows
    asked = owners.withColumn("place", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("need"))))
    pairs = asked.join(numbered.drop("ord"), ["term", "place"]).where("path <> target_path").select(
        "target_path", F.col("path").alias("source_path"), "file_order", "term_no", "term", "snippet"
    )
    unlinked = pairs.join(links, ["target_path", "source_path"], "left_anti")
    first_term = unlinked.groupBy("target_path", "source_path", "file_order").agg(
        F.min_by(F.struct("term", "snippet"), "term_no").alias("m")
    )
    return top_k(first_term, ["target_path"], [F.col("file_order")], limit).select(
        "target_path", "source_path", "rank", F.col("m.term").alias("matched_term"), F.col("m.snippet").alias("snippet")
    )

