"""A pipeline over ``documents``: five stages, each one operator of ``marginalia.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
``docs``. All but the last keep the columns of ``docs``, extra ones too; rows that repeat, null ids and null texts are judged like any others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, pieces, pii, quality, simhash
from marginalia.operators.settle import checkpoint_dir

_ROW = "__stage_row"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects (score below a half). It learns from ``labels`` that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen = labels.select("doc_id", F.col("quality").alias("label")).where(~quality.held_out())
    return quality.score(docs, quality.train(docs, seen)).where(F.col(quality.SCORE) >= 0.5).drop(quality.SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that SimHash links: the smallest doc_id, the first of its rows; a null id only if the group has no other."""
    rows = docs.withColumn(_ROW, F.monotonically_increasing_id())
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(_ROW).alias("row"))
    groups = simhash.near_duplicates(rows.select(key.alias("doc_id"), "text"))
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id.row").alias(_ROW))
    return rows.join(gone, _ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with benchmark passages in a twentieth of their words or more."""
    rows = docs.withColumn(_ROW, F.monotonically_increasing_id())
    found = decontaminate.contamination(rows.select(F.col(_ROW).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("contaminated").select(F.col("doc_id").alias(_ROW))
    return rows.join(gone, _ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by surrogates; n_chars follows the new text."""
    out = pii.replace_entities(docs, pii.session_key(spark, pii.INVENTED), count="__entities")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__entities") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("__entities")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, score and others of every document, and whether the ids decode to its text."""
    coded = pieces.decode(pieces.encode(docs))
    return coded.select("doc_id", "ids", "score", "others", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same_text"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_pii),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage leaves is written to the shared folder."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # a trained model and a vocabulary search take part
