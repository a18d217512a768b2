"""State of artifact watch jobs over status polls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.settle import settle


def poll_states(jobs: DataFrame, polls: DataFrame) -> DataFrame:
    """State of every job at every poll of its notebook: (job_id, ts, found_id, status).

    ``jobs``: job_id, notebook_id, artifact_type, artifact_id; ``polls``: ts, notebook_id, artifact_id, type, status, created_at. Newest artifact
    per type unless the job names one; ``waiting`` when none is visible.
    """
    newest = polls.groupBy("notebook_id", "ts", F.col("type").alias("artifact_type")).agg(
        F.max(F.struct(F.coalesce("created_at", F.lit("")).alias("created_at"), F.col("artifact_id").alias("found_id"), "status")).alias("a")
    ).select("notebook_id", "ts", "artifact_type", "a.found_id", "a.status")
    seen = polls.select("notebook_id", "ts").distinct()
    open_jobs = jobs.join(seen, "notebook_id")
    by_type = open_jobs.where("artifact_id is null").join(newest, ["notebook_id", "ts", "artifact_type"], "left")
    named = polls.groupBy("notebook_id", "ts", "artifact_id").agg(F.max("status").alias("status"))
    by_id = open_jobs.where("artifact_id is not null").join(named, ["notebook_id", "ts", "artifact_id"], "left").withColumn("found_id", F.col("artifact_id"))
    cols = ["job_id", "ts", "found_id", F.coalesce("status", F.lit("waiting")).alias("status")]
    return by_type.select(*cols).unionByName(by_id.select(*cols))


def job_states(states: DataFrame, done: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """Final state per job. A job is completed at its first poll that shows a completed artifact, or from the start when its
    output exists (``done``: job_id); a failed download (``failed``: job_id) keeps it open as ``download_failed``; else its latest status counts."""
    rows = states
    if failed is not None:
        rows = rows.join(failed.select("job_id").distinct().withColumn("bad", F.lit(True)), "job_id", "left").withColumn(
            "status", F.when(F.col("bad") & (F.col("status") == "completed"), "download_failed").otherwise(F.col("status"))
        )
    per = rows.groupBy("job_id").agg(
        F.min(F.when(F.col("status") == "completed", F.col("ts"))).alias("completed_at"), F.max_by("status", "ts").alias("last_status"),
        F.max("ts").alias("last_at"),
    )
    if done is not None:
        marked = done.select("job_id").distinct().withColumn("there", F.lit(True))
        per = per.join(marked, "job_id", "full")
    else:
        per = per.withColumn("there", F.lit(None).cast("boolean"))
    finished = F.col("there") | F.col("completed_at").isNotNull()
    return per.select(
        "job_id", F.when(F.coalesce(finished, F.lit(False)), "completed").otherwise(F.col("last_status")).alias("status"),
        F.coalesce("completed_at", "last_at").alias("updated_at"),
    )


def track(polls: DataFrame, jobs: DataFrame, target: str, checkpoint: str, done: DataFrame | None = None, failed: DataFrame | None = None):
    """R6 as a stream: each batch of polls is folded into the job table, written as a new version per batch; ``read_jobs`` gives the last one.

    A job that completed in an earlier batch is left as it is. ``done`` and ``failed`` (job_id) are read with every batch, as in ``job_states``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = job_states(poll_states(jobs, batch), done, failed)
        if batch_id > 0:
            old = spark.read.parquet(f"{target}/version={batch_id - 1}").withColumnsRenamed({"status": "s0", "updated_at": "u0"})
            both = old.join(fresh, "job_id", "full")
            keep = (F.col("s0") == "completed") | F.col("status").isNull()
            fresh = both.select("job_id", F.when(keep, F.col("s0")).otherwise(F.col("status")).alias("status"), F.when(keep, F.col("u0")).otherwise(F.col("updated_at")).alias("updated_at"))
        settle(fresh).write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    return polls.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_jobs(spark: SparkSession, target: str) -> DataFrame:
    """The job table of the last batch below ``target``."""
    versions = spark.read.parquet(target)
    last = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == last).drop("version")
