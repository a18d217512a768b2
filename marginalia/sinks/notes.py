"""Sinks for rendered notes, rewritten corpora, vocabularies and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settle import settle
from ..sources.walk import files_below, with_content
from .files import delete_folder

PREFIX = 2


def _prefix(key: Column) -> Column:
    return F.substring(F.sha1(key.cast("binary")), 1, PREFIX)


def write_notes(notes: DataFrame, target: str, key: str = "path") -> None:
    """K1, K2, K4: rendered notes as a table partitioned by a hash prefix; a rewritten key replaces its old row.

    The new rows of a prefix are merged with the stored ones and only touched prefixes are overwritten. Of several new rows with one key the
    greatest stays (by its other columns, in order). Rows are dealt by prefix before they are written, large prefixes to several tasks, so the number of
    files follows the prefixes and bytes, not the tasks.
    """
    spark = notes.sparkSession
    others = [c for c in notes.columns if c != key]
    notes = notes.groupBy(key).agg(F.max(F.struct(*others)).alias("row")).select(key, "row.*").select(*notes.columns)
    prefixed = notes.withColumn("prefix", _prefix(F.col(key)))
    writer = lambda df: df.hint("rebalance", "prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(target)
    if not _exists(spark, target):
        writer(prefixed)
        return
    fresh = settle(prefixed)
    stored = spark.read.schema(prefixed.schema).parquet(target).join(fresh.select("prefix").distinct(), "prefix", "left_semi")
    kept = stored.join(fresh.select(key), key, "left_anti").select(*fresh.columns)
    writer(settle(kept.unionByName(fresh)))


def read_notes_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("prefix")


def write_changed(original: DataFrame, changed: DataFrame, target: str, dry_run: bool = False) -> DataFrame:
    """K3: the corpus below ``target`` with the changed notes in place of the old ones. A dry run writes nothing.

    ``changed``: (path, content) or (path, new_path, content). The corpus is partitioned by a hash prefix of the path; once it is there only the prefixes that
    a changed note leaves or enters are written again. Of several notes that move to one path the greatest text stays. Returns the changed rows.
    """
    if dry_run:
        return changed
    spark = original.sparkSession
    moved = settle((changed if "new_path" in changed.columns else changed.withColumn("new_path", F.col("path"))).select("path", "new_path", "content"))
    fresh = moved.groupBy(F.col("new_path").alias("path")).agg(F.max("content").alias("content"))
    prefixed = lambda df: df.withColumn("prefix", _prefix(F.col("path")))
    gone = moved.select("path").unionByName(fresh.select("path")).distinct()
    if _exists(spark, target):
        touched = prefixed(gone).select("prefix").distinct()
        stored = spark.read.schema("path string, content string, prefix string").parquet(target).join(touched, "prefix", "left_semi")
    else:
        touched, stored = None, prefixed(original.select("path", "content"))
    rows = settle(stored.join(gone, "path", "left_anti").select("path", "content", "prefix").unionByName(prefixed(fresh)))
    rows.hint("rebalance", "prefix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(target)
    if touched is not None:  # a prefix that every note has left
        for r in touched.join(rows.select("prefix").distinct(), "prefix", "left_anti").collect():  # at most one for each prefix
            delete_folder(spark, f"{target}/prefix={r.prefix}")
    return changed


def write_vocabulary(words: DataFrame, target: str, score: str = "3.0") -> None:
    """K5: ``word :score`` lines, each word once, in one file; the recogniser reads a single small file, so this is the one place with one task."""
    words.select("word").distinct().select(F.concat("word", F.lit(f" :{score}")).alias("value")).coalesce(1).write.mode("overwrite").text(target)


def compact_archive(spark: SparkSession, source: str, target: str, file_bytes: int = 256 << 20) -> int:
    """K6: many raw files into compressed Parquet files of about ``file_bytes`` raw bytes each, with relative path, size and bytes. The originals are dropped once the
    archive holds as many files and bytes as they are. Returns that number of files."""
    raw = files_below(spark, source)
    totals = lambda df: tuple(df.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first())
    files, size = totals(raw)
    parts = max(1, -(-size // file_bytes))
    with_content(raw, source, parts).write.mode("overwrite").option("compression", "zstd").parquet(target)
    held = spark.read.parquet(target).select(F.octet_length("content").alias("length"))
    if totals(held) != (files, size):
        raise RuntimeError(f"{target} does not hold what {source} has; the originals stay")
    delete_folder(spark, source)
    return files


def _exists(spark: SparkSession, target: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
