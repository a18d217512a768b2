"""Dimension and configuration sources: tag aliases, facets, vocabularies, corrections, source lists, watch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import clean_list, let, trim_all
from ..operators.works import arxiv_id, doi_id


def _json_object(text: Column) -> Column:
    """Ordered (key, raw JSON) pairs of a JSON object; anything else gives no pairs."""
    keys = F.json_object_keys(text)
    values = F.from_json(text, "map<string,string>", {"mode": "PERMISSIVE"})
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(values, k).alias("raw")))


def _text_list(raw: Column) -> Column:
    """JSON array items as text, any other value as one item."""
    listed = F.from_json(raw, "array<string>")
    return clean_list(F.when(raw.startswith("[") & listed.isNotNull(), listed).otherwise(F.array(raw)))


def alias_rows(texts: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """Alias JSON per row -> (keys, canonical, pos, alias). Text that is not a JSON object gives no rows."""
    valid = F.when(F.try_parse_json(column).isNotNull(), F.col(column))
    pairs = texts.select(*key, F.explode(_json_object(valid)).alias("e"))
    named = pairs.select(*key, trim_all(F.col("e.key")).alias("canonical"), _text_list(F.col("e.raw")).alias("aliases"))
    return named.where("canonical <> ''").select(*key, "canonical", F.posexplode("aliases").alias("pos", "alias"))


def facet_rows(texts: DataFrame, key: list[str], column: str = "text") -> DataFrame:
    """Facet JSON per row -> (keys, facet_no, facet, canonical, alias). Values may be objects, arrays or scalars."""
    valid = F.when(F.try_parse_json(column).isNotNull(), F.col(column))
    facets = texts.select(*key, F.posexplode(_json_object(valid)).alias("facet_no", "f")).select(
        *key, "facet_no", trim_all(F.col("f.key")).alias("facet"), F.col("f.raw").alias("raw")
    ).where("facet <> ''")
    is_object = F.col("raw").startswith("{")
    none = F.array().cast("array<string>")
    entries = F.when(
        is_object,
        F.transform(_json_object(F.when(is_object, F.col("raw"))), lambda e: F.struct(trim_all(e["key"]).alias("canonical"), _text_list(e["raw"]).alias("aliases"))),
    ).otherwise(F.transform(_text_list(F.col("raw")), lambda c: F.struct(c.alias("canonical"), none.alias("aliases"))))
    rows = facets.select(*key, "facet_no", "facet", F.explode(entries).alias("e")).where("e.canonical <> ''")
    return rows.select(*key, "facet_no", "facet", F.col("e.canonical").alias("canonical"), F.explode_outer("e.aliases").alias("alias"))


def default_facets(spark: SparkSession) -> DataFrame:
    return facet_rows(spark.createDataFrame([(fixed.DEFAULT_FACETS_JSON,)], "text string"), [])


def vocabulary(lines: DataFrame, column: str = "value") -> DataFrame:
    """A10: ``word :score`` lines -> (word, score); the word also loses trailing spaces, dots, dashes, 0 and 9."""
    parts = F.split(trim_all(F.col(column)), ":")
    word = F.regexp_replace(trim_all(F.get(parts, F.lit(0))), r"[ 0\-9.]+$", "")
    return lines.select(word.alias("word"), trim_all(F.get(parts, F.lit(1))).try_cast("double").alias("score")).where("word <> ''")


def corrections(lines: DataFrame, column: str = "value") -> DataFrame:
    """``wrong:right`` lines, split at the first colon."""
    text = F.col(column)
    cut = F.instr(text, ":")
    rows = lines.where(cut > 1).select(
        trim_all(F.substring(text, F.lit(1), cut - 1)).alias("wrong"),
        trim_all(F.substring(text, cut + 1, F.length(text))).alias("right"),
    )
    return rows.where("wrong <> '' and right <> ''")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return vocabulary(spark.read.text(path))


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return corrections(spark.read.text(path))


def source_requests(lists: DataFrame, key: list[str], column: str = "text", default: str = "arxiv") -> DataFrame:
    """Free-text source lists -> typed requests, in list order."""
    specs = F.filter(F.transform(F.split(column, "[\n,]"), trim_all), lambda s: s != "")
    rows = lists.select(*key, F.posexplode(specs).alias("pos", "spec"))
    spec = F.col("spec")
    prefix = F.lower(F.regexp_extract(spec, r"(?s)^([^:]+):(.*)$", 1))
    rest = trim_all(F.regexp_extract(spec, r"(?s)^([^:]+):(.*)$", 2))
    prefixed = trim_all(prefix).isin("doi", "arxiv", "pdf") & (rest != "")
    kind = (
        F.when(prefixed, trim_all(prefix))
        .when(spec.rlike(r"(?i)^10\.\S+") | spec.rlike(r"(?i)^https?://(dx\.)?doi\.org/"), "doi")
        .when(spec.rlike(r"(?i)\.pdf($|\?)"), "pdf").otherwise(default)
    )
    value = F.when(prefixed, rest).otherwise(spec)
    clean = let(value, lambda v: F.when(kind == "doi", doi_id(v)).when(kind == "arxiv", arxiv_id(v)).otherwise(v))
    return rows.select(*key, "pos", kind.alias("source_type"), clean.alias("source")).where("source <> ''")


def watch_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Watch-job configuration files -> validated job rows with defaults and minimums."""
    schema = (
        "jobs array<struct<notebook_id string, artifact_type string, output_path string, artifact_id string, "
        "output_format string, slide_deck_format string>>, poll_interval_seconds int, timeout_seconds int, profile string"
    )
    return parse_watch_jobs(spark.read.schema(schema).option("multiLine", True).json(path))


def parse_watch_jobs(config: DataFrame) -> DataFrame:
    rows = config.select(
        F.greatest(F.lit(1), F.coalesce("poll_interval_seconds", F.lit(30))).alias("poll_interval_seconds"),
        F.greatest(F.lit(0), F.coalesce("timeout_seconds", F.lit(3600))).alias("timeout_seconds"),
        F.posexplode_outer("jobs").alias("n", "j"),
    )
    text = lambda c: trim_all(F.coalesce(F.col(f"j.{c}"), F.lit("")))
    filled = lambda c, d: F.when(text(c) != "", text(c)).otherwise(d)
    known = sorted([*fixed.ARTIFACT_SUFFIX, "mind_map"])
    error = (
        F.when(F.col("n").isNull(), "missing-jobs").when(text("notebook_id") == "", "missing-notebook-id")
        .when(~text("artifact_type").isin(*known), "invalid-artifact-type").when(text("output_path") == "", "missing-output-path")
    )
    return rows.select(
        (F.col("n") + 1).alias("job_no"), text("notebook_id").alias("notebook_id"), text("artifact_type").alias("artifact_type"),
        text("output_path").alias("output_path"), F.when(text("artifact_id") != "", text("artifact_id")).alias("artifact_id"),
        filled("output_format", "json").alias("output_format"), filled("slide_deck_format", "pdf").alias("slide_deck_format"),
        "poll_interval_seconds", "timeout_seconds", error.alias("error"),
    )
