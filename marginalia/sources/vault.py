"""File sources: note folders and binary attachments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import dir_of, name_of, stem_of, suffix_of
from ..operators.notes import is_drawing, is_supported
from ..operators.settle import settle
from .walk import files_below, with_content


def read_notes(spark: SparkSession, root: str, numbered: bool = True) -> DataFrame:
    """A1: all supported notes below a folder, empty ones too: path, dir, basename, name, ext, content, is_drawing and, in path order, ord.

    ``ord`` comes from a distributed sort of the paths alone, kept by a checkpoint, so later jobs see the same order. Texts are neither sorted, shuffled nor
    written: tasks that get paths with their numbers read the files.
    """
    paths = files_below(spark, root).select("path", "length").where(is_supported(F.col("path")))
    if numbered:
        paths = settle(paths.orderBy("path").withColumn("ord", F.monotonically_increasing_id()))
    name = name_of(F.col("path"))
    rows = with_content(paths, root).withColumn("content", F.col("content").cast("string"))
    rows = rows.select(
        "path", dir_of(F.col("path")).alias("dir"), stem_of(name).alias("basename"), name.alias("name"),
        F.regexp_replace(suffix_of(name), r"^\.", "").alias("ext"), "content", *paths.columns[2:],
    )
    return rows.withColumn("is_drawing", is_drawing(F.col("path"), F.col("ext")))


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All files below a folder, empty ones too: path, modificationTime, length, content."""
    return with_content(files_below(spark, root, glob), root)


def read_attachments(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files with size and content hash."""
    return read_files(spark, root, glob).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def attachment_flags(notes_pdf: DataFrame, attachments: DataFrame) -> DataFrame:
    """Does the ``pdf`` of a note exist? ``notes_pdf``: (path, pdf)."""
    there = attachments.select(F.col("path").alias("pdf")).distinct().withColumn("hit", F.lit(True))
    return notes_pdf.join(there, "pdf", "left").select("path", "pdf", F.col("hit").isNotNull().alias("attachment_exists"))


def checksum_matches(attachments: DataFrame, expected: DataFrame) -> DataFrame:
    """Hash comparison of (path, sha256) lists."""
    want = expected.select("path", F.lower("sha256").alias("wanted"))
    return want.join(attachments.select("path", "sha256"), "path", "left").select("path", F.coalesce(F.col("sha256") == F.col("wanted"), F.lit(False)).alias("matches"))
