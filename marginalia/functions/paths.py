"""Path columns: parts, normal form, relative form, link encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def dir_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem_of(name: Column) -> Column:
    """Name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$|(?<=\.)(?<=[^/]{2})\.[^./]*$", "")


def suffix_of(name: Column) -> Column:
    return F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)


def normalise(path: Column) -> Column:
    """Fold ``.`` and ``..`` parts; a path that climbs above its root keeps the ``..``."""

    def step(done: Column, part: Column) -> Column:
        depth = F.size(done)
        climbs = (part == "..") & (depth > 0) & (F.element_at(done, F.greatest(depth, F.lit(1))) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when(climbs, F.slice(done, 1, F.greatest(depth - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    start = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")


def resolve(base_dir: Column, target: Column) -> Column:
    return normalise(F.when(F.length(base_dir) > 0, F.concat_ws("/", base_dir, target)).otherwise(target))


def relative(to_path: Column, from_dir: Column) -> Column:
    """``to_path`` as seen from ``from_dir``; both are normal forms without a leading slash."""

    def build(to_parts: Column, from_parts: Column) -> Column:
        width = F.least(F.size(to_parts), F.size(from_parts))
        differs = F.filter(
            F.sequence(F.lit(1), F.greatest(width, F.lit(1))),
            lambda i: (i > width) | (F.get(to_parts, i - 1) != F.get(from_parts, i - 1)),
        )
        shared = F.when(width == 0, F.lit(0)).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, width))
        ups = F.array_repeat(F.lit(".."), F.size(from_parts) - shared)
        rest = F.slice(to_parts, shared + 1, F.greatest(F.size(to_parts) - shared, F.lit(0)))
        return let(F.concat(ups, rest), lambda p: F.when(F.size(p) > 0, F.array_join(p, "/")).otherwise(F.lit(".")))

    parts = lambda p: F.filter(F.split(p, "/"), lambda x: x != "")
    return let(parts(to_path), lambda t: let(parts(from_dir), lambda f: build(t, f)))


def encode_link(path: Column) -> Column:
    return F.replace(path, F.lit(" "), F.lit("%20"))


def decode_link(path: Column) -> Column:
    """Percent decoding that keeps ``+``; a malformed escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
