"""Replacement of personal data by keyed surrogates, with DataFrame functions only.

Found entities become one table of distinct (kind, canonical value) rows. Every row gets a surrogate derived from a keyed hash, of the
same kind, script, gender and format. Surrogates that two entities share, or that are themselves an entity of the texts, are drawn
again until all are distinct. The same value gets the same surrogate in every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settle import settle

# Titles before names, by gender, and syllables for invented names, by script.
MALE = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"]
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "ha", "je", "ki", "lo", "ma", "ne", "pi", "ro", "sa", "te", "vi", "zo"],
    "cyrillic": ["ба", "де", "фи", "го", "ха", "же", "ки", "ло", "ма", "не", "пи", "ро", "са", "те", "ви", "зо"],
    "greek": ["βα", "δε", "φι", "γο", "χα", "ζε", "κι", "λο", "μα", "νε", "πι", "ρο", "σα", "τε", "θι", "ξο"],
}
ENDINGS = {"latin": {"m": "n", "f": "lia", "n": "r"}, "cyrillic": {"m": "н", "f": "лия", "n": "р"}, "greek": {"m": "ς", "f": "λια", "n": "ρ"}}

KEY_SETTING = "spark.marginalia.pii.key"
INVENTED = "key of runs over invented data"
_ATTEMPTS = 60

_NAME = r"\p{Lu}[\p{L}'’-]+"
_TITLE = r"(?:" + "|".join(MALE + FEMALE) + r")"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"[A-Za-z0-9_%+](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<=\b(?i:password|passwd|secret|token|api_key|apikey)\s?[=:]\s?[\"']?)[A-Za-z0-9+/_-][A-Za-z0-9+/_.=-]{6,}[A-Za-z0-9+/_=-]|\bAKIA[0-9A-Z]{16}\b",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\w)",
    "name": rf"(?<!\p{{L}}){_TITLE}\.? {_NAME}(?: {_NAME}){{0,2}}",
}
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_MAYBE = r"[0-9]|@|[=:]|" + _TITLE
_WHOLE = {kind: f"^(?:{p})$" for kind, p in PATTERNS.items()}


def _kind(m: Column) -> Column:
    """Kind of a match. A secret is known by what stands before it, so it is what is left."""
    out = F.lit("secret")
    for kind in reversed(["email", "phone", "ssn", "ip", "card", "iban", "name"]):
        out = F.when(m.rlike(_WHOLE[kind]), kind).otherwise(out)
    return F.when(m.rlike(r"^AKIA[0-9A-Z]{16}$"), F.lit("secret")).otherwise(out)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _canonical(kind: Column, m: Column) -> Column:
    """The form that all spellings of one entity share."""
    numbers = F.concat(F.when(m.startswith("+"), "+").otherwise(""), _digits(m))
    return (
        F.when(kind == "email", F.lower(m)).when(kind.isin("phone", "ssn", "card"), numbers)
        .when(kind == "iban", F.regexp_replace(m, " ", "")).when(kind.startswith("name"), F.lower(m)).otherwise(m)
    )


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _alike(text: Column, stream: Column, keep: Column | None = None) -> Column:
    """Every letter and digit exchanged for one of its class; the first ``keep`` characters stay."""
    hexa = text.rlike(r"^[0-9a-f]*$")
    pick = lambda from_, c: F.substring(F.lit(from_), c + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        new = (
            F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(hexa & c.rlike("[a-f]"), pick("abcdef", b % 6))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", b % 26)).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b % 26)).otherwise(c)
        )
        return new if keep is None else F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(_chars(text), one), "")


def _luhn(digits: Column) -> Column:
    """Check sum of card numbers, from 0 to 9."""
    back = F.reverse(_chars(digits))
    at = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(at, F.lit(0), lambda a, x: a + x) % 10


def _surrogate(key: str) -> Column:
    """Surrogate of (kind, value) at the given ``attempt``."""
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    seed = [F.lit(key), kind, value, attempt.cast("string")]
    stream = F.concat(F.sha2(F.concat_ws("\u0001", *seed, F.lit("a")), 512), F.sha2(F.concat_ws("\u0001", *seed, F.lit("b")), 512))
    late = F.when(attempt >= 8, attempt.cast("string")).otherwise("")  # short values have few others
    at = F.instr(value, "@")
    local = F.substring(value, F.lit(1), at - 1)
    email = F.concat(_alike(local, stream), late, F.substring(value, at, F.length(value)))
    body = _alike(value, stream, F.when(value.startswith("+"), 2).otherwise(1))
    rest = F.substring(body, F.lit(1), F.length(body) - 1)
    card = F.concat(rest, F.pmod(_luhn(value) - _luhn(F.concat(rest, F.lit("0"))), F.lit(10)).cast("string"))
    ip = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: (_byte(stream, i) % 254 + 1).cast("string")), ".")
    size = F.least(F.greatest(F.lit(2), F.floor((F.length(value) - 1) / 2).cast("int")), F.lit(6)) + attempt  # every attempt has sixteen times as many stems
    name = None
    for script, syllables in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        stem = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.element_at(table, _byte(stream, i) % 16 + 1)), "")  # noqa: B023
        for gender, end in ENDINGS[script].items():
            match = kind == f"name:{script}:{gender}"
            name = F.when(match, F.concat(stem, F.lit(end))) if name is None else name.when(match, F.concat(stem, F.lit(end)))
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind.startswith("name"), name)
        .when(kind.isin("phone", "ssn"), body).when(kind == "iban", _alike(value, stream, F.lit(2)))
        .when(value.startswith("AKIA"), _alike(value, stream, F.lit(4))).otherwise(_alike(value, stream))
    )


def _distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate): no two values of a kind share a surrogate, and none is a value of the texts. A clash keeps the row with the
    smallest value; the others draw again, against all that is taken. Every round is written to the shared folder. Names grow with every attempt; a format
    of fixed length that has no free surrogate left after ``_ATTEMPTS`` is an error."""
    drawn = settle(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", _surrogate(key)))
    taken = entities.select("kind", F.col("value").alias("surrogate"))
    kept = []
    for _ in range(_ATTEMPTS):
        free = settle(drawn.join(taken, ["kind", "surrogate"], "left_anti"))
        first = settle(free.groupBy("kind", "surrogate").agg(F.min("value").alias("value")))
        kept.append(first)
        again = settle(drawn.join(first.select("kind", "value"), ["kind", "value"], "left_anti"))
        if again.isEmpty():
            break
        taken = taken.unionByName(first.select("kind", "surrogate"))
        drawn = settle(again.withColumn("attempt", F.col("attempt") + 1).withColumn("surrogate", _surrogate(key)))
    else:
        raise RuntimeError(f"no free surrogates for {drawn.select('kind').first()[0]}")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.select("kind", "value", "surrogate")


def _rendered(kind: Column, shown: Column, surrogate: Column) -> Column:
    """The surrogate in the spelling of the occurrence."""
    numbers = _digits(surrogate)
    place = lambda i: F.length(_digits(F.substring(shown, F.lit(1), i + 1)))
    as_digits = F.array_join(F.transform(_chars(shown), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(numbers, place(i), F.lit(1))).otherwise(c)), "")
    taken = lambda i: F.length(F.regexp_replace(F.substring(shown, F.lit(1), i + 1), " ", ""))
    as_iban = F.array_join(F.transform(_chars(shown), lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, taken(i), F.lit(1)))), "")
    upper = (F.upper(shown) == shown) & (F.lower(shown) != shown)
    capital = F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate)))
    return (
        F.when(kind.isin("phone", "ssn", "card"), as_digits).when(kind == "iban", as_iban)
        .when(kind.startswith("name"), F.when(upper & (F.length(shown) > 1), F.upper(surrogate)).otherwise(capital))
        .when((kind == "email") & upper, F.upper(surrogate)).otherwise(surrogate)
    )


def _tokens(m: Column) -> Column:
    """What a match stands for: one entity, or for a name one for each word after the title. The last word is the family name."""
    kind = _kind(m)
    words = F.slice(F.split(m, " "), 2, 10)
    gender = F.when(F.regexp_extract(m, r"^([^ .]+)", 1).isin(*FEMALE), "f").otherwise("m")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    of_name = F.transform(words, lambda w, i: F.struct(F.concat(F.lit("name:"), script(w), F.lit(":"), F.when(i == F.size(words) - 1, "n").otherwise(gender)).alias("kind"), w.alias("shown")))
    return F.when(kind == "name", of_name).otherwise(F.array(F.struct(kind.alias("kind"), m.alias("shown"))))


def session_key(spark: SparkSession, default: str | None = None) -> str:
    """Key of the surrogates: the session's ``spark.marginalia.pii.key``. Whoever knows it can compute surrogates, so there is none without that setting, unless a
    ``default`` is given, as by runs over invented data."""
    key = spark.conf.get(KEY_SETTING, None) or default
    if not key:
        raise ValueError(f"set {KEY_SETTING}")
    return key


def replace_entities(docs: DataFrame, key: str | None = None, count: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text``, all other columns as they were, and the number of found entities in a new column ``count``.

    ``docs`` needs a text column; a column that has the name ``count`` is replaced. Null and empty texts stay as they are with count 0. Repeated
    rows each come back, alike. ``key``: see ``session_key``. A family name that a document gives with a title is also replaced where it stands without one. An empty
    table gives an empty result. ``docs`` must give the same rows in the same order when read again, as a Parquet folder does.
    """
    key = key or session_key(docs.sparkSession)
    row = "__pii_row"
    columns = [c for c in docs.columns if c != count]
    rows = docs.select(*[F.col(f"`{c}`") for c in columns]).withColumn(row, F.monotonically_increasing_id())
    maybe = F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))
    found = settle(rows.where(maybe).select(row, F.regexp_extract_all("text", F.lit(_ANY), F.lit(0)).alias("m")).where(F.size("m") > 0))
    each = found.select(row, F.explode(F.flatten(F.transform(F.array_distinct("m"), _tokens))).alias("e")).select(row, "e.kind", "e.shown")
    each = each.withColumn("value", _canonical(F.col("kind"), F.col("shown")))
    surrogates = settle(_distinct_surrogates(settle(each.select("kind", "value").distinct()), key))
    named = each.join(surrogates, ["kind", "value"]).select(row, "shown", "kind", _rendered(F.col("kind"), F.col("shown"), F.col("surrogate")).alias("new"))
    # first by kind decides if one spelling is of two kinds
    maps = named.groupBy(row, "shown").agg(F.min(F.struct("kind", "new")).alias("x")).groupBy(row).agg(
        F.map_from_entries(F.collect_list(F.struct("shown", "x.new"))).alias("__pii_map"),
        F.collect_set(F.when(F.col("x.kind").startswith("name"), F.col("shown"))).alias("__pii_names"))
    maps = maps.join(found.select(row, F.size("m").cast("long").alias(count)), row).hint("shuffle_hash")
    swap = lambda w: F.coalesce(F.element_at("__pii_map", w), w)
    with_title = lambda m: F.concat(F.regexp_extract(m, r"^([^ ]+ )", 1), F.array_join(F.transform(F.slice(F.split(m, " "), 2, 10), swap), " "))
    pieces, matches = F.split("text", _ANY, -1), F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))
    words = lambda t: F.array_join(F.transform(F.split(t, r"(?<!\p{L})(?=\p{Lu})|(?<=[\p{L}'’-])(?![\p{L}'’-])"), lambda w: F.when(F.array_contains("__pii_names", w), swap(w)).otherwise(w)), "")
    between = F.when(F.size("__pii_names") > 0, F.transform(pieces, words)).otherwise(pieces)
    texts = F.array_join(F.flatten(F.transform(F.arrays_zip(between.alias("p"), F.transform(matches, lambda m: F.when(_kind(m) == "name", with_title(m)).otherwise(swap(m))).alias("m")), lambda z: F.array(z["p"], F.coalesce(z["m"], F.lit(""))))), "")
    changed = rows.where(maybe).join(maps, row, "left")
    changed = changed.withColumn("__pii_text", F.when(F.col("__pii_map").isNull(), F.col("text")).otherwise(texts)).withColumn("text", F.col("__pii_text"))
    number = F.coalesce(count, F.lit(0).cast("long")).alias(count)
    quoted = [F.col(f"`{c}`") for c in columns]
    return changed.select(*quoted, number).unionByName(rows.where(~maybe).select(*quoted, F.lit(0).cast("long").alias(count)))
