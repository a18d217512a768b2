"""Secrets in texts: known shapes, and further strings that a battery of randomness tests sets apart from structured ones. DataFrame functions only.

Known shapes are found by pattern. What they leave is searched for long runs of letters and digits. Each run gets the smallest encoding
alphabet that holds it and three tests against uniform, independent symbols: chi-squared of the symbol counts, runs about the middle of the
alphabet, and serial correlation. A run that any of them rejects is structured. For the others the number of equal symbol pairs is held against
what structured text of that length has; these p-values, of all texts together, are cut by Benjamini and Hochberg's rule within strata of encoding
and length, as short runs carry less evidence than long ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.settle import settle

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
# Patterns of the known shapes, and alphabets of encodings, smaller ones first.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of 24 and more: a shorter run has no such part
ENCODINGS = {
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "base36": _DIGITS + _LOWER, "BASE36": _DIGITS + _UPPER,
    "base62": _UPPER + _LOWER + _DIGITS, "base64": _UPPER + _LOWER + _DIGITS + "+/", "base64url": _UPPER + _LOWER + _DIGITS + "-_"}
KINDS = ["assign", "access", "hex", "random"]

STRUCTURED = 0.055  # share of equal symbol pairs in structured text; words have about 0.066
_RUN = r"[A-Za-z0-9+/_-]{20,}"
_PADDED = _RUN + "={0,2}"
_CHUNK = 128
_BINS, _PER_TEN = 300, 10  # p-values are counted in tenths of a power of ten
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_TESTED = "array<struct<start:bigint,end:bigint,stratum:string,bin:int>>"


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _running(steps: Column) -> Column:
    """Running sums of an array of longs, by chunks, so that long arrays cost little more than short ones."""

    def sums(s: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _CHUNK).cast("int"))
        part = lambda c: F.slice(s, c * _CHUNK + 1, F.lit(_CHUNK))
        within = lambda offset, p: F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: offset + _sum(F.slice(p, F.lit(1), i)))
        whole = F.transform(chunks, lambda c: _sum(part(c)))
        return let(whole, lambda w: F.flatten(F.transform(chunks, lambda c: let(part(c), lambda p: within(_sum(F.slice(w, F.lit(1), c)), p)))))

    return let(steps, sums)


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, text) of the leftmost matches that do not overlap, in code points."""

    def placed(parts: Column, found: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(found, F.length))
        steps = F.transform(found, lambda m, i: (F.length(parts[i]) + before[i]).cast("long"))
        return let(_running(steps), lambda at: F.transform(found, lambda m, i: F.struct(at[i].alias("start"), (at[i] + F.length(m)).alias("end"), m.alias("shown"))))

    none = F.array().cast("array<struct<start:bigint,end:bigint,shown:string>>")
    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(text.rlike(pattern), let(both, lambda x: placed(x["parts"], x["found"]))).otherwise(none)


def _known(text: Column, kind: str, pattern: str, holds: Column | None, least: int, value: int) -> Column:
    """Spans of one known shape whose group ``value`` has at least ``least`` characters. ``holds`` is a cheap test for texts that may have it."""
    long_enough = lambda m: F.length(F.regexp_extract(m["shown"], pattern, value)) >= least
    spans = F.transform(F.filter(_matches(text, pattern), long_enough), lambda m: F.struct(m["start"], F.lit(KINDS.index(kind)).alias("kind"), m["end"]))
    return spans if holds is None else F.when(holds, spans).otherwise(F.array().cast(_SPANS))


def _blanked(text: Column, pattern: str, least: int, value: int) -> Column:
    """``text`` with spaces in place of what ``_known`` finds."""
    blank = lambda m: F.when(F.length(F.regexp_extract(m, pattern, value)) >= least, F.repeat(F.lit(" "), F.length(m))).otherwise(m)
    both = F.struct(F.split(text, pattern, -1).alias("parts"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    joined = let(both, lambda x: F.array_join(F.transform(x["parts"], lambda p, i: F.concat(p, F.coalesce(blank(F.get(x["found"], i)), F.lit("")))), ""))
    return F.when(text.rlike(pattern), joined).otherwise(text)


def _two_sided(z: Column) -> Column:
    """Probability of a normal value at least as far from zero: the rational approximation of erfc of Abramowitz and Stegun (7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.least(poly * F.exp(-x * x), F.lit(1.0)), F.lit(1e-40))


def _upper(z: Column) -> Column:
    return F.when(z >= 0, _two_sided(z) / 2).otherwise(1 - _two_sided(z) / 2)


def _tests(token: Column, alphabet: Column) -> Column:
    """chi, runs, serial: p-values under uniform independent symbols; structured: p-value of the equal pairs under structured text."""
    n, k = F.length(token).cast("double"), F.length(alphabet).cast("double")
    symbols = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    squares = F.aggregate(symbols(alphabet), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0)))
    half = F.floor(k / 2).cast("int")

    def judged(v: Column) -> Column:
        # v: places of the symbols in the alphabet
        high = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x >= half, 1.0).otherwise(0.0))
        low = n - high
        pairs = F.zip_with(v, F.concat(F.slice(v, F.lit(2), F.size(v)), F.slice(v, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.aggregate(F.slice(pairs, F.lit(1), F.size(v) - 1), F.lit(1.0), lambda s, p: s + F.when((p["a"] >= half) != (p["b"] >= half), 1.0).otherwise(0.0))
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        powers = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
        lagged = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["a"] * p["b"])
        return F.struct(high.alias("high"), low.alias("low"), turns.alias("turns"), total.alias("total"), powers.alias("powers"), lagged.alias("lagged"), squares.alias("squares"))

    def p_values(s: Column) -> Column:
        chi, df = k / n * s["squares"] - n, k - 1
        fit = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        both = 2 * s["high"] * s["low"]
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, (s["turns"] - both / n - 1) / F.sqrt(spread)).otherwise(F.lit(40.0))
        level = n * s["powers"] - s["total"] * s["total"]
        serial = F.when(level > 0, ((n * s["lagged"] - s["total"] * s["total"]) / level + 1 / (n - 1)) * (n - 1) / F.sqrt(n * (n - 3) / (n + 1))).otherwise(F.lit(40.0))
        equal, share = (s["squares"] - n) / 2, F.greatest(F.lit(STRUCTURED), 1.6 / k)
        expected = share * n * (n - 1) / 2
        deviation = F.sqrt(expected + n * (n - 1) * (n - 2) * 0.5 * share * share)
        return F.struct(_upper(fit).alias("chi"), _two_sided(runs).alias("runs"), _two_sided(serial).alias("serial"), _upper((expected - equal) / deviation).alias("structured"))

    places = F.transform(symbols(token), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return let(let(places, judged), p_values)


def _tested(text: Column, alpha: float) -> Column:
    """Runs of symbols that no test rejects as random: (start, end, stratum, bin of the structured p-value)."""
    bare = lambda m: F.rtrim(m["shown"], F.lit("="))

    def one(m: Column) -> Column:
        token = bare(m)
        chosen = label = F.lit(None).cast("string")
        for encoding, symbols in reversed(ENCODINGS.items()):
            fits = token.rlike("^[" + symbols.replace("-", r"\-") + "]+$")
            chosen, label = F.when(fits, F.lit(symbols)).otherwise(chosen), F.when(fits, F.lit(encoding)).otherwise(label)
        stratum = F.concat(label, F.lit(":"), F.floor(F.log2(F.length(token).cast("double"))).cast("string"))

        def row(p: Column) -> Column:
            kept = 3 * F.least(p["chi"], p["runs"], p["serial"]) >= alpha
            bin_ = F.least(F.floor(-F.log10(p["structured"]) * _PER_TEN), F.lit(_BINS)).cast("int")
            return F.when(kept, F.struct(m["start"], m["end"], stratum.alias("stratum"), bin_.alias("bin")))

        return let(chosen, lambda a: F.when(a.isNotNull(), let(_tests(token, a), row)))

    mixed = lambda m: bare(m).rlike("[0-9]") & bare(m).rlike("[A-Za-z]")
    return F.filter(F.transform(F.filter(_matches(text, _PADDED), mixed), one), lambda x: x.isNotNull())


def _cuts(scanned: DataFrame, q: float) -> dict[str, int]:
    """First bin of the discoveries of each stratum: the largest p for which p times the tests is at most ``q`` times those at or below it. A
    stratum is an encoding and a length's power of two, so the table stays below a few hundred rows."""
    counts = scanned.select(F.explode("tested").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count(F.lit(1)).alias("c"))
    every = Window.partitionBy("stratum")
    below = every.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    held = counts.select("stratum", "bin", F.sum("c").over(below).alias("upto"), F.sum("c").over(every).alias("tests"))
    held = held.where(F.col("tests") * F.pow(F.lit(10.0), -F.col("bin") / _PER_TEN) <= q * F.col("upto"))
    return {r["stratum"]: r["bin"] for r in held.groupBy("stratum").agg(F.min("bin").alias("bin")).collect()}


def find(docs: DataFrame, alpha: float = 0.01, q: float = 0.05) -> DataFrame:
    """doc_id and spans (start, end in code points, kind) of every document, by start and kind: known shapes first of all, then what the tests add.

    ``alpha``: chance that the battery rejects a random string; ``q``: share of false discoveries among the added spans of a stratum. Null and empty texts
    have no spans. Texts count in whole, whatever their length. Repeated rows and null ids come back as they are; an empty table gives an
    empty result. Other columns take no part. Whether a string is added depends on the strings of all texts, not on their order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    shapes = [("assign", ASSIGN, None, 6, 2), ("access", ACCESS, F.col("t").contains("AKIA"), 20, 0), ("hex", HEX, None, 24, 0)]
    rows = docs.select("doc_id", text.alias("t"))
    base = F.concat(*[_known(F.col("t"), *shape) for shape in shapes])
    rest = F.col("t")
    for _, pattern, _, least, value in shapes:
        rest = _blanked(rest, pattern, least, value)
    maybe = F.col("t").rlike(_RUN)
    tested = F.when(maybe, let(rest, lambda t: _tested(t, alpha))).otherwise(F.array().cast(_TESTED))
    scanned = settle(rows.select("doc_id", base.cast(_SPANS).alias("base"), tested.cast(_TESTED).alias("tested")))
    cuts = _cuts(scanned, q)
    added = F.array().cast(_SPANS)
    if cuts:
        table = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
        found = F.filter("tested", lambda t: t["bin"] >= F.coalesce(F.try_element_at(table, t["stratum"]), F.lit(_BINS + 1)))
        added = F.transform(found, lambda t: F.struct(t["start"], F.lit(KINDS.index("random")).alias("kind"), t["end"]))
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat("base", added)), lambda s: F.struct(s["start"], s["end"], names[s["kind"]].alias("kind")))
    return scanned.select("doc_id", spans.alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans as text, from ``find``."""
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"), count("random"))
