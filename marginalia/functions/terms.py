"""Tag-term rules as columns. Terms are lower-cased before any rule; none of the rules depends on case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import ASCII_BOUNDARY, WORD_START, collapse, has_cjk, is_in, let, trim_all


def _none() -> Column:
    return F.array().cast("array<string>")


def is_noisy(t: Column) -> Column:
    ascii_word = t.rlike("^[A-Za-z]") & (
        (F.length(t) < 3) | is_in(F.lower(t), fixed.EN_STOPWORDS) | is_in(F.lower(t), fixed.NOISY_TOKENS)
    )
    return (t == "") | t.rlike(r"^\d+$") | ascii_word | t.rlike(f"^[^A-Za-z0-9{fixed.CJK}]+$")


def is_structural(t: Column) -> Column:
    return (
        F.when(t == "", True).when(t.rlike("^[A-Za-z]"), is_in(F.lower(t), fixed.STRUCTURAL_TOKENS))
        .otherwise(is_in(t, fixed.STRUCTURAL_CJK))
    )


def is_low_signal(t: Column) -> Column:
    short = t.rlike(r"^[A-Za-z][A-Za-z0-9-]{0,2}$") & ~t.rlike(r"^[A-Za-z]\d{2}$")
    return (t == "") | t.rlike("^第[一二三四五六七八九十百千0-9]+[章节部分篇讲]$") | short


def is_bad_cjk(t: Column) -> Column:
    """CJK phrases that are too short, too long, repetitive or built on function characters."""
    chars = f"[{fixed.CJK_FUNCTION_CHARS}]"
    count = F.regexp_count(t, F.lit(chars))
    size = F.length(t)
    return has_cjk(t) & (
        (size < 2) | (size > 12) | t.rlike(r"^(.)\1*$") | t.rlike(f"^{chars}|{chars}$")
        | ((size <= 3) & (count > 0)) | (count > F.floor(size / 3))
    )


# words of four or more lower-case letters: only the word lists can rule them out, and they are their own tag form
PLAIN_WORD = "^[a-z]{4,}$"
_LISTED = (*fixed.EN_STOPWORDS, *fixed.NOISY_TOKENS, *fixed.STRUCTURAL_TOKENS)


def is_candidate(t: Column) -> Column:
    every_rule = ~is_noisy(t) & ~is_structural(t) & ~is_low_signal(t) & ~is_bad_cjk(t)
    return F.when(t.rlike(PLAIN_WORD), ~is_in(t, _LISTED)).otherwise(every_rule)


def raw_terms(text: Column) -> Column:
    """Distinct lower-cased pieces of a text: split words, ASCII words, CJK phrases with their heads and tails."""

    def phrases(block: Column) -> Column:
        size = F.length(block)
        longest = F.least(F.when(size > 12, F.lit(4)).otherwise(F.lit(6)), size)
        edges = F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.greatest(longest, F.lit(2))),
                lambda k: F.array(F.substring(block, F.lit(1), k), F.substring(block, size - k + 1, k)),
            )
        )
        return F.filter(F.concat(F.when(size <= 10, F.array(block)).otherwise(_none()), edges), lambda p: ~is_bad_cjk(p))

    def blocks(run: Column) -> Column:
        parts = F.filter(F.split(run, f"[{fixed.CJK_SPLIT_CHARS}]"), lambda p: F.length(p) >= 2)
        return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(run)))

    def collect(low: Column) -> Column:
        split = F.split(low, fixed.TERM_SPLIT)
        # the words are cut at plain blanks, so they need trimming only where the text has others
        words = F.filter(F.when(low.rlike(r"(?U)[\s&&[^ \t\n\x0B\f\r]]"), F.transform(split, trim_all)).otherwise(split), lambda w: w != "")
        english = F.regexp_extract_all(low, F.lit(f"{WORD_START}[a-z][a-z-]{{2,}}{ASCII_BOUNDARY}"), F.lit(0))
        runs = F.regexp_extract_all(low, F.lit(f"[{fixed.CJK}]{{2,24}}"), F.lit(0))
        cjk = F.flatten(F.transform(F.flatten(F.transform(runs, blocks)), phrases))
        return F.array_distinct(F.concat(words, english, cjk))

    return let(F.lower(text), collect)


def candidate_terms(text: Column) -> Column:
    """Terms of a text that may become tags."""
    return F.filter(raw_terms(text), is_candidate)


def tag_form(tag: Column) -> Column:
    return F.when(tag.rlike(PLAIN_WORD), tag).otherwise(trim_all(collapse(F.regexp_replace(trim_all(tag), "^#", ""))))


def length_bonus(t: Column) -> Column:
    n = F.length(t)
    ascii_bonus = F.least(F.lit(6), F.greatest(F.lit(1), n - 2))
    other = (
        F.when(n == 4, 8).when(n.isin(3, 5), 7).when(n.isin(2, 6), 5).when(n <= 8, 3).otherwise(1)
    )
    return F.when(t.rlike("^[A-Za-z]"), ascii_bonus).otherwise(other)
