"""Queries that write files below the checkpoint folder and read them back: A1, A14, A15, K1–K3, K5, K6, J16 checksums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...operators.settle import checkpoint_dir
from ...sinks import notes as sinks
from ...sinks.files import current_version, write_note_files
from ...sources import dims, vault
from ...sources.views import table, view
from .common import Query, oracle, plain
from .works import K1, k1


def _folder(spark: SparkSession, name: str) -> str:
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _written(notes: DataFrame, name: str) -> str:
    """Folder of ``notes`` as published files."""
    target = _folder(notes.sparkSession, name)
    write_note_files(notes, target)
    return current_version(target)[0]


def a1(spark, sf):
    found = vault.read_notes(spark, _written(view(spark, sf, "v_notes"), "a1"))
    return plain(found.select("path", "dir", "name", "basename", "ext", "is_drawing", F.sha2("content", 256).alias("content_sha256")))


A1 = oracle("""SELECT path, dir, name, regexp_replace(name, '[.][^.]*$', '') AS basename, ext, ext = 'excalidraw' OR name LIKE '%.excalidraw.md' AS is_drawing,
  sha256(content) AS content_sha256 FROM v_notes""", "v_notes")


def k1_files(spark, sf):
    return plain(vault.read_notes(spark, _written(k1(spark, sf), "k1"), numbered=False).select("path", "content"))


def _page_files(spark, sf):
    pages = table(spark, sf, "pages").select(F.concat(F.lit("pages/p"), "page_id", F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).alias("content"))
    return vault.read_attachments(spark, _written(pages, "a15"), "*.html")


def a15(spark, sf):
    return plain(_page_files(spark, sf))


A15 = "SELECT 'pages/p' || page_id || '.html' AS path, strlen(coalesce(html, ''))::BIGINT AS bytes, sha256(coalesce(html, '')) AS sha256 FROM pages"


def j16_checksums(spark, sf):
    pages = table(spark, sf, "pages")
    text = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    wanted = pages.select(F.concat(F.lit("pages/p"), F.col("page_id") + F.when(F.col("page_id") % 5 == 0, 1000000).otherwise(0), F.lit(".html")).alias("path"), F.upper(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("sha256"))
    return plain(vault.checksum_matches(_page_files(spark, sf), wanted))


J16 = """SELECT 'pages/p' || (page_id + CASE WHEN page_id % 5 = 0 THEN 1000000 ELSE 0 END) || '.html' AS path,
  page_id % 3 <> 0 AND page_id % 5 <> 0 AS matches FROM pages"""


def a14(spark, sf):
    """One configuration file for every notebook, with gaps and numbers below their minimum, as a watcher has them."""
    jobs = view(spark, sf, "v_watch_jobs").withColumn("k", F.substring("notebook_id", 3, 9).cast("int"))
    job = F.struct(
        F.when(F.col("k") % 7 != 0, F.concat(F.lit(" "), "notebook_id")).alias("notebook_id"), F.when(F.col("k") % 5 == 0, "video-x").otherwise(F.col("artifact_type")).alias("artifact_type"),
        F.when(F.col("k") % 3 != 0, F.concat(F.lit("out/"), "job_id")).otherwise("").alias("output_path"), F.when(F.col("k") % 2 == 0, "csv").alias("output_format"))
    told = jobs.groupBy("notebook_id", "k").agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    config = F.to_json(F.struct("jobs", F.when(F.col("k") % 2 == 0, F.col("k") - 5).alias("poll_interval_seconds"), (F.col("k") * 10 - 50).alias("timeout_seconds")))
    files = told.select(F.concat("notebook_id", F.lit(".json")).alias("path"), config.alias("content"))
    return plain(dims.watch_jobs(spark, _written(files, "a14")).drop("job_no"))


A14 = oracle("""WITH j AS (SELECT *, substr(notebook_id, 3)::INT AS k FROM v_watch_jobs),
x AS (SELECT CASE WHEN k % 7 <> 0 THEN notebook_id ELSE '' END AS notebook_id, CASE WHEN k % 5 = 0 THEN 'video-x' ELSE artifact_type END AS artifact_type,
  CASE WHEN k % 3 <> 0 THEN 'out/' || job_id ELSE '' END AS output_path, CASE WHEN k % 2 = 0 THEN 'csv' ELSE 'json' END AS output_format, k FROM j)
SELECT notebook_id, artifact_type, output_path, NULL::VARCHAR AS artifact_id, output_format, 'pdf' AS slide_deck_format, CASE WHEN k % 2 = 0 THEN greatest(1, k - 5) ELSE 30 END::BIGINT AS poll_interval_seconds,
  greatest(0, k * 10 - 50)::BIGINT AS timeout_seconds, CASE WHEN notebook_id = '' THEN 'missing-notebook-id' WHEN artifact_type = 'video-x' THEN 'invalid-artifact-type' WHEN output_path = '' THEN 'missing-output-path' END AS error FROM x""", "v_watch_jobs")


def k3(spark, sf):
    """Two rewrites of the notes: a tag renamed, then some notes moved and emptied of their last line."""
    v = view(spark, sf, "v_notes")
    target = _folder(spark, "k3")
    first = v.where("ord % 3 = 0").select("path", F.replace("content", F.lit("#inline-"), F.lit("#spoken-")).alias("content"))
    sinks.write_changed(v, first, target)
    stored = spark.read.parquet(target)
    second = stored.join(v.where("ord % 10 = 1").select("path", "ord"), "path").select("path", F.concat(F.lit("Moved/"), "ord", F.lit(".md")).alias("new_path"), F.lit("moved").alias("content"))
    sinks.write_changed(v, second, target)
    return plain(spark.read.parquet(target).select("path", F.sha2("content", 256).alias("content_sha256")))


K3 = oracle("""SELECT CASE WHEN ord % 10 = 1 THEN 'Moved/' || ord || '.md' ELSE path END AS path,
  sha256(CASE WHEN ord % 10 = 1 THEN 'moved' WHEN ord % 3 = 0 THEN replace(content, '#inline-', '#spoken-') ELSE content END) AS content_sha256 FROM v_notes""", "v_notes")


def k5(spark, sf):
    words = view(spark, sf, "v_notes").select(F.explode(F.array(F.concat(F.lit("term-"), "ext"), F.substring_index("dir", "/", -1), F.concat(F.lit("w"), "basename"))).alias("word"))
    target = _folder(spark, "k5")
    sinks.write_vocabulary(words, target)
    return plain(dims.read_vocabulary(spark, target))


K5 = oracle(r"""SELECT regexp_replace(word, '[ 0\-9.]+$', '') AS word, 3.0::DOUBLE AS score FROM (
  SELECT DISTINCT unnest(['term-' || ext, string_split(dir, '/')[-1], 'w' || regexp_replace(name, '[.][^.]*$', '')]) AS word FROM v_notes) w""", "v_notes")


def k6(spark, sf):
    source, target = _written(view(spark, sf, "v_notes"), "k6"), _folder(spark, "k6-archive")
    sinks.compact_archive(spark, source, target, 1 << 20)
    left = sinks._exists(spark, source)
    return plain(spark.read.parquet(target).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(left).alias("original_left")))


K6 = oracle("SELECT path, strlen(content)::BIGINT AS bytes, sha256(content) AS sha256, false AS original_left FROM v_notes", "v_notes")

QUERIES = {
    "A1_note_folder": Query(a1, A1),
    "A14_watch_config": Query(a14, A14),
    "A15_attachments": Query(a15, A15),
    "J16_checksums": Query(j16_checksums, J16),
    "K1_note_files": Query(k1_files, K1),
    "K3_rewritten_corpus": Query(k3, K3),
    "K5_vocabulary_file": Query(k5, K5),
    "K6_archive": Query(k6, K6),
}
