"""Change requests: coalescing per window, dependency filter, maintenance of affected edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.graph import note_keys, read_hosts, resolve, target_key
from ..operators.refs import line_targets
from ..operators.settle import settle


def priority(reason: Column) -> Column:
    pairs = [F.lit(x) for kv in fixed.REFRESH_PRIORITY.items() for x in kv]
    return F.element_at(F.create_map(*pairs), reason)


def coalesce_changes(changes: DataFrame, window: str = "10 minutes", watermark: str | None = None) -> DataFrame:
    """One merged request per window, the same for batch and stream.

    Reason: highest priority, the later one on ties. Focus: the latest one given. Flags are OR-ed, paths united (sorted, since the union
    is a set here). ``changes``: ts, id, reason, changed_paths, focus, force, preserve_scroll. Late rows are dropped by the watermark.
    """
    source = changes.withWatermark("ts", watermark) if watermark else changes
    at = F.struct("ts", "id")
    # paths are made distinct per row before they are gathered, and a set keeps each path once per task
    return source.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("merged"), F.max_by("reason", F.struct(priority(F.col("reason")).alias("p"), "ts", "id")).alias("reason"),
        F.max_by("focus", F.when(F.col("focus").isNotNull(), at)).alias("focus"), F.bool_or("force").alias("force"),
        F.bool_or("preserve_scroll").alias("preserve_scroll"),
    ).select(F.col("w.start").alias("window_start"), "merged", "reason", "focus", "force", "preserve_scroll")


def changed_paths(changes: DataFrame, window: str = "10 minutes") -> DataFrame:
    """The united paths of every window as rows; a busy window is never one big list."""
    rows = changes.select(F.window("ts", window)["start"].alias("window_start"), F.explode("changed_paths").alias("path"))
    return rows.where("path <> ''").distinct()


def must_refresh(changes: DataFrame, dependencies: DataFrame | None) -> DataFrame:
    """Adds ``handle``. A metadata change without force matters only when one of its paths is a dependency; no paths or no
    dependencies mean it does."""
    plain = changes.where("force or reason <> 'metadata' or size(changed_paths) = 0").withColumn("handle", F.lit(True))
    checked = changes.where("not (force or reason <> 'metadata' or size(changed_paths) = 0)")
    if dependencies is None or not dependencies.take(1):
        return plain.unionByName(checked.withColumn("handle", F.lit(True)))
    hit = checked.select("id", F.explode("changed_paths").alias("path")).join(dependencies.select("path").distinct(), "path", "left_semi").select("id").distinct()
    flagged = checked.join(hit.withColumn("hit", F.lit(True)), "id", "left")
    return plain.unionByName(flagged.withColumn("handle", F.col("hit").isNotNull()).drop("hit"))


def affected_notes(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """R2: changed notes and the notes that link to them (path)."""
    dependents = edges.join(changed.select(F.col("path").alias("target_path")).distinct(), "target_path", "left_semi").select("path")
    return changed.select("path").unionByName(dependents).distinct()


def maintain_edges(versions: DataFrame, target: str, checkpoint: str):
    """R2 as a stream: new note versions arrive as files, and ``target`` keeps the edges of all notes up to date; ``read_edges`` gives them.

    ``versions``: streaming (path, ord, dir, name, basename, ext, content, ts) and maybe deleted; a note whose latest version is deleted leaves its keys to
    others and has no edges, until a later version brings it back. Three tables hold one row per note: facts, raw link targets
    and resolved edges, each by hash prefix. A batch resolves its own notes again, and the notes with a raw target whose key now stands
    for another note. A note without edges keeps a row with an empty list, so no prefix is left behind. Facts are written last: a batch
    that is repeated after a failure finds the old facts and does the same work.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        from ..sinks.notes import _exists, read_notes_table, write_notes

        spark = batch.sparkSession
        # what a version says is read before the versions of a note meet, so its text is read once and stays behind
        said = read_hosts(batch, lines=line_targets(F.col("content")), ts=F.col("ts"), gone=F.col("deleted") if "deleted" in batch.columns else F.lit(False))
        latest = said.groupBy("path").agg(F.max_by(F.struct(*[c for c in said.columns if c != "path"]), "ts").alias("v")).select("path", "v.*")
        latest = settle(latest.withColumn("gone", F.coalesce("gone", F.lit(False))))
        none = F.array().cast("array<string>")
        listed = lambda rows, name, to: rows.groupBy("path").agg(F.array_sort(F.collect_set(name)).alias(to))
        every = lambda notes, rows, name: notes.select("path").join(rows, "path", "left").select("path", F.coalesce(name, none).alias(name))
        fresh = latest.select("path", *[F.when(~F.col("gone"), F.col(c)).alias(c) for c in ("ord", "basename", "name", "ext", "aliases")], "gone")
        targets = F.array_sort(F.array_distinct(F.concat("hosts", "lines")))
        raw = latest.select("path", F.coalesce(F.when(~F.col("gone"), targets), none).alias("targets"))
        if _exists(spark, f"{target}/facts"):
            old = read_notes_table(spark, f"{target}/facts").select(*fresh.columns).where("NOT gone")
            keys = settle(note_keys(old.join(latest, "path", "left_anti").unionByName(fresh.where("NOT gone"))))
            before = note_keys(old).select("key", F.col("target_path").alias("before"))
            moved = keys.join(before, "key", "full").where(~F.col("target_path").eqNullSafe(F.col("before"))).select("key")
            others = read_notes_table(spark, f"{target}/links").join(latest, "path", "left_anti").select("path", "targets")
            asks = others.select("path", F.explode("targets").alias("target")).select("path", target_key(F.col("target")).alias("key"))
            raw = raw.unionByName(others.join(asks.join(moved, "key", "left_semi"), "path", "left_semi"))
        else:
            keys = settle(note_keys(fresh.where("NOT gone")))
        raw = settle(raw)
        edges = resolve(raw.select("path", F.explode("targets").alias("target")), keys)
        write_notes(every(raw, listed(edges, "target_path", "target_paths"), "target_paths"), f"{target}/edges")
        write_notes(raw, f"{target}/links")
        write_notes(fresh, f"{target}/facts")

    return versions.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_edges(spark: SparkSession, target: str) -> DataFrame:
    """Edges (path, target_path) that ``maintain_edges`` keeps below ``target``."""
    return spark.read.parquet(f"{target}/edges").select("path", F.explode("target_paths").alias("target_path"))
