"""Column helpers for text: trimming, distinct lists, slugs, words. All of them stay in the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

# an ASCII word boundary; the plain \b of the JVM also accepts accented letters as word characters
WORD_START = r"(?<![0-9A-Za-z_])"
WORD_END = r"(?![0-9A-Za-z_])"
ASCII_BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"

# the characters of Unicode's White_Space property
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def planned(build):
    """Keep the column a zero-argument builder returns: long expressions are built once per gateway, not once per job."""
    kept: dict[int, Column] = {}

    @functools.wraps(build)
    def column() -> Column:
        gateway = id(SparkContext._gateway)
        if gateway not in kept:
            kept.clear()
            kept[gateway] = build()
        return kept[gateway]

    return column


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def trim_all(value: Column) -> Column:
    """Trim every Unicode blank (line breaks, no-break and full-width space), not only the plain space."""
    return F.btrim(value, F.lit(BLANKS))


def collapse(value: Column, by: str = " ") -> Column:
    return F.regexp_replace(value, r"(?U)\s+", by)


def blank_to_null(value: Column) -> Column:
    return let(trim_all(value), lambda v: F.when(F.length(v) > 0, v))


def first_filled(*values: Column) -> Column:
    """First value that is not null and not blank, trimmed."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def clean_list(values: Column) -> Column:
    """Trim every item and drop the empty ones; a null list becomes an empty one."""
    items = F.coalesce(values, F.array().cast("array<string>"))
    return F.filter(F.transform(items, trim_all), lambda v: F.length(v) > 0)


def distinct_ci(values: Column) -> Column:
    """Ordered distinct that ignores case and keeps the first spelling."""

    def pick(items: Column) -> Column:
        return let(
            F.transform(items, F.lower),
            lambda keys: F.filter(items, lambda v, i: F.array_position(keys, F.lower(v)) == i + 1),
        )

    return let(clean_list(values), pick)


def text_or(value: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(value), F.lit(default))


def _accent_pairs() -> tuple[str, str]:
    """Characters whose compatibility form is one plain ASCII letter or digit, by rule."""
    source, target = [], []
    for point in range(0xA0, 0x10000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_pairs()


def strip_accents(value: Column) -> Column:
    return F.translate(F.regexp_replace(value, r"[\x{0300}-\x{036f}]", ""), ACCENTED, PLAIN)


def slug(value: Column) -> Column:
    """Lower-case ASCII words joined by ``-``; ``item`` when nothing is left."""
    dashed = F.regexp_replace(strip_accents(F.coalesce(value, F.lit(""))), "[^a-zA-Z0-9]+", "-")
    return let(
        F.lower(F.regexp_replace(dashed, "^-+|-+$", "")), lambda s: F.when(F.length(s) > 0, s).otherwise(F.lit("item"))
    )


def first_sentence(value: Column) -> Column:
    def pick(text: Column) -> Column:
        hit = F.trim(F.regexp_extract(text, r"^(.+?[.!?])(?:\s|$)", 1))
        return F.when(F.length(hit) > 0, hit).otherwise(text)

    return let(collapse(trim_all(F.coalesce(value, F.lit("")))), pick)


def search_form(value: Column) -> Column:
    """Form in which evidence text and queries are compared."""
    return collapse(F.lower(trim_all(F.coalesce(value, F.lit("")))))


def facet_label(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(trim_all(value), "[_-]+", " "), r"(?U)\s+", " ")


def is_in(value: Column, words) -> Column:
    return value.isin(*list(words))


def has_cjk(value: Column) -> Column:
    return value.rlike(f"[{fixed.CJK}]")


def utf16_units(value: Column) -> Column:
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")


def title_weight(value: Column) -> Column:
    """ASCII counts one half, every other UTF-16 unit counts one; rounded up."""
    ascii_count = F.length(F.regexp_replace(value, r"[^\x00-\x7f]", ""))
    units = utf16_units(value)
    return F.floor((ascii_count + 2 * (units - ascii_count) + 1) / 2).cast("int")


def safe_filename(name: Column, fallback: str = "untitled", max_length: int = 120) -> Column:
    """File name without reserved characters, reserved device names or trailing dots, at most ``max_length`` long."""
    spaced = F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\x00]', " "), r"(?U)\s+", " ")

    def strip(v: Column) -> Column:
        return F.regexp_replace(v, r"^[ .]+|[ .]+$", "")

    def finish(v: Column) -> Column:
        filled = F.when(F.length(v) > 0, v).otherwise(F.lit(fallback))
        named = F.when(F.upper(filled).isin(*fixed.RESERVED_NAMES), F.concat(filled, F.lit("_"))).otherwise(filled)
        cut = F.regexp_replace(F.substring(named, 1, max_length), r"[ .]+$", "")
        return let(
            F.when(F.length(named) > max_length, cut).otherwise(named),
            lambda c: F.when(F.length(c) > 0, c).otherwise(F.lit(fallback)),
        )

    return let(strip(spaced), finish)


def base36(value: Column) -> Column:
    """Lower-case base-36 text of a non-negative number."""
    return F.lower(F.conv(value.cast("string"), 10, 36))


def topic_hash(value: Column) -> Column:
    """32-bit ``h * 33 xor code point`` over the characters, in base 36."""
    chars = F.filter(F.split(value, ""), lambda c: F.length(c) > 0)
    points = F.transform(chars, lambda c: F.ascii(c).cast("bigint"))
    folded = F.aggregate(
        points, F.lit(5381).cast("bigint"), lambda h, p: ((h * 33).bitwiseXOR(p)).bitwiseAND(F.lit(0xFFFFFFFF))
    )
    return base36(folded)
