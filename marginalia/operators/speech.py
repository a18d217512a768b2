"""Transcript text jobs: corrections, recall, vocabulary, levels, prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import trim_all
from .skew import fits

MAX_CORRECTIONS = 10_000


def correct(rows: DataFrame, dictionary: DataFrame | dict[str, str] | None = None, column: str = "text") -> DataFrame:
    """Replace every wrong word in dictionary order; later entries see the result of earlier ones.

    A dictionary is an ordered list by nature, so it becomes a constant of the plan; its size is checked. ``dictionary`` as a
    DataFrame is (pos, wrong, right).
    """
    if dictionary is None:
        dictionary = fixed.CORRECTIONS
    if isinstance(dictionary, DataFrame):
        if not fits(dictionary, MAX_CORRECTIONS):
            raise ValueError(f"more than {MAX_CORRECTIONS} corrections")
        dictionary = {r.wrong: r.right for r in dictionary.orderBy("pos").collect()}
    pairs = F.array(*[F.struct(F.lit(w).alias("wrong"), F.lit(r).alias("right")) for w, r in dictionary.items()])
    fixed_text = F.aggregate(pairs, F.col(column), lambda t, d: F.replace(t, d["wrong"], d["right"]))
    return rows.withColumn(column, fixed_text)


def term_recall(rows: DataFrame, terms: list[str] | None = None, key: str = "item_id") -> DataFrame:
    """G12 per item (item, category, truth, output): expected and found terms, ratio, grade."""
    words = F.array(*[F.lit(t) for t in (terms or fixed.RECALL_TERMS)])
    expected = F.filter(words, lambda t: F.contains(F.col("truth"), t))
    found = F.filter(words, lambda t: F.contains(F.col("truth"), t) & F.contains(F.col("output"), t))
    sized = rows.select(key, "category", F.size(expected).alias("expected"), F.size(found).alias("found"))
    ratio = F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).otherwise(0.0)
    return sized.withColumn("ratio", ratio).withColumn(
        "grade", F.when(F.col("ratio") >= 0.8, "good").when(F.col("ratio") >= 0.5, "fair").otherwise("poor")
    )


def recall_summary(items: DataFrame) -> DataFrame:
    """Totals per category and overall (category null)."""
    return items.rollup("category").agg(F.sum("expected").alias("expected"), F.sum("found").alias("found")).withColumn(
        "percent", F.when(F.col("expected") > 0, F.round(F.col("found") * 100 / F.col("expected"), 1))
    )


def vocabulary_words(facts: DataFrame) -> DataFrame:
    """Distinct words from titles and tags: 2 to 15 CJK or ASCII characters, spaces and dashes."""
    raw = facts.select(F.explode(F.concat(F.array("basename"), "tags")).alias("w"))
    clean = trim_all(F.regexp_replace(trim_all(F.regexp_replace("w", "^#", "")), r"[\[\]()#*_?]", ""))
    rows = raw.select(clean.alias("word")).distinct()
    return rows.where((F.length("word") >= 2) & (F.length("word") <= 15) & F.col("word").rlike(r"(?U)^[\x{4e00}-\x{9fa5}a-zA-Z0-9\s-]+$"))


def rms(samples: Column) -> Column:
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def decibels(value: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value) | (value <= 0), F.lit(float("-inf"))).otherwise(20 * F.log10(value))


def gain(samples: Column, db: Column) -> Column:
    factor = F.pow(F.lit(10.0), db / 20)
    return F.transform(samples, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * factor)))


def level_sweep(clips: DataFrame, levels: list[int], key: str = "clip_id") -> DataFrame:
    """Level in dBFS of every clip at every gain."""
    rows = clips.select(key, "samples", F.explode(F.array(*[F.lit(x) for x in levels])).alias("gain_db"))
    return rows.select(key, "gain_db", rms(gain(F.col("samples"), F.col("gain_db"))).alias("rms")).withColumn("dbfs", decibels(F.col("rms")))


def hit_sweep(outputs: DataFrame, terms: list[str]) -> DataFrame:
    """Target words found per gain level in recognised texts (gain_db, text)."""
    words = F.array(*[F.lit(t) for t in terms])
    hits = F.size(F.filter(words, lambda t: F.contains(F.col("text"), t)))
    return outputs.groupBy("gain_db").agg(F.sum(hits).alias("hits"), (F.count(F.lit(1)) * len(terms)).alias("possible"))


def render_prompts(rows: DataFrame, templates: dict[str, str], appended: str = "\n\n待整理的转录文本：\n") -> DataFrame:
    """C17: every template filled for every row (selection, file, date, transcript); the transcript is appended when a
    template has no slot for it. Templates are a handful of settings, so they are exploded in the row."""
    listed = F.array(*[F.struct(F.lit(k).alias("template_id"), F.lit(v).alias("prompt")) for k, v in templates.items()])
    keep = [c for c in rows.columns if c not in ("selection", "file", "date", "transcript")]
    x = rows.select("*", F.explode(listed).alias("t"))
    text = F.col("t.prompt")
    for slot, column in (("selection", "selection"), ("file:whole", "file"), ("date", "date")):
        text = F.replace(text, F.lit("{{" + slot + "}}"), F.coalesce(F.col(column), F.lit("")))
    said = F.coalesce("transcript", F.lit(""))
    full = (
        F.when(F.contains("t.prompt", F.lit("{{transcription}}")), F.replace(text, F.lit("{{transcription}}"), said))
        .when(said != "", F.concat(text, F.lit(appended), said)).otherwise(text)
    )
    return x.select(*keep, F.col("t.template_id").alias("template_id"), full.alias("prompt"))
