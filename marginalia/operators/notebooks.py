"""Notebook exports: note and artifact tables, normalised notes, coverage, index notes, latest artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import encode_link
from ..functions.text import let, safe_filename, trim_all
from .migrate import conflict_free


NOTEBOOKS = (
    "notebook_id string, title string, source_count int, url string, notes array<struct<id:string,title:string,content:string>>, "
    "artifacts array<struct<id:string,type:string,status:string,created_at:string>>"
)
CONVERSATION = r"(?:conversation_id|Conversation ID)[：:\s]+([0-9a-fA-F-]{36})"
COVERED = "download is not supported for this type; the note export covers it when the ids match"


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per notebook."""
    return spark.read.schema(NOTEBOOKS).option("multiLine", True).json(path)


def exported_notes(notebooks: DataFrame, wanted: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Notes of every notebook in payload order, filtered by id list and limit."""
    notes = F.col("notes")
    if wanted:
        notes = F.filter(notes, lambda n: n["id"].isin(*wanted))
    if limit > 0:
        notes = F.slice(notes, 1, limit)
    return notebooks.select("notebook_id", F.posexplode(notes).alias("pos", "n")).select(
        "notebook_id", "pos", F.col("n.id").alias("note_id"), "n.title", "n.content"
    )


def exported_artifacts(notebooks: DataFrame, types: list[str], wanted: list[str] | None = None) -> DataFrame:
    """Completed artifacts of the wanted types with their target path; mind maps are handled by ``skipped_artifacts``."""
    rows = notebooks.select("notebook_id", F.posexplode("artifacts").alias("pos", "a")).select("notebook_id", "pos", "a.*").where("status = 'completed'")
    if wanted:
        rows = rows.where(F.col("id").isin(*wanted))
    suffix = F.create_map(*[F.lit(x) for kv in fixed.ARTIFACT_SUFFIX.items() for x in kv])
    name = F.concat(F.col("type"), F.lit("-"), F.substring("id", 1, 8))
    return rows.where(F.col("type").isin(*[t for t in types if t in fixed.ARTIFACT_SUFFIX])).select(
        "notebook_id", "pos", F.col("type").alias("artifact_type"), F.col("id").alias("artifact_id"),
        F.concat(F.lit("artifacts/"), F.col("type"), F.lit("/"), safe_filename(name), F.element_at(suffix, F.col("type"))).alias("path"),
    )


def skipped_artifacts(notebooks: DataFrame, notes: DataFrame) -> DataFrame:
    """Completed mind maps with a flag when a note of the same id is exported."""
    maps = notebooks.select("notebook_id", F.posexplode("artifacts").alias("pos", "a")).where("a.status = 'completed' and a.type = 'mind_map'")
    ids = notes.select("notebook_id", F.col("note_id").alias("artifact_id")).distinct().withColumn("hit", F.lit(True))
    rows = maps.select("notebook_id", "pos", F.col("a.type").alias("artifact_type"), F.col("a.id").alias("artifact_id"))
    return rows.join(ids, ["notebook_id", "artifact_id"], "left").select(
        "notebook_id", "pos", "artifact_type", "artifact_id", F.col("hit").isNotNull().alias("covered_by_note_export"), F.lit(COVERED).alias("reason")
    )


def normalise_note(title: Column, content: Column) -> Column:
    r"""Line ends, literal ``\n`` (only when at most one real line break exists), literal ``\t``, title heading."""

    def lines(text: Column) -> Column:
        breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
        return F.when(F.contains(text, F.lit("\\n")) & (breaks <= 1), F.replace(text, F.lit("\\n"), F.lit("\n"))).otherwise(text)

    def tabs(text: Column) -> Column:
        wanted = F.contains(text, F.lit("\\t")) & ~F.contains(text, F.lit("\t"))
        return F.when(wanted, F.replace(text, F.lit("\\t"), F.lit("\t"))).otherwise(text)

    def headed(text: Column) -> Column:
        head = F.concat(F.lit("# "), safe_filename(title, "Untitled Note", 200))
        return F.when(text.startswith("#"), text).when(text == "", head).otherwise(F.concat(head, F.lit("\n\n"), text))

    start = trim_all(F.replace(F.coalesce(content, F.lit("")), F.lit("\r\n"), F.lit("\n")))
    text = let(let(let(start, lines), lambda t: trim_all(tabs(t))), headed)
    return F.concat(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\n"))


def normalised_notes(notes: DataFrame) -> DataFrame:
    """Notes with repaired text, conversation id and a free file name. ``notes``: notebook_id, ord, title, content."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Untitled Note"))
    rows = notes.withColumn("title", title)
    rows = rows.select("notebook_id", "ord", "title", F.explode(F.array(normalise_note(F.col("title"), F.col("content")))).alias("text"))
    rows = rows.withColumnRenamed("text", "content")
    found = F.regexp_extract("content", CONVERSATION, 1)
    named = rows.select(
        "notebook_id", "ord", "title", "content", F.when(found != "", found).alias("conversation_id"),
        F.col("notebook_id").cast("string").alias("dir"), safe_filename(title).alias("stem"), F.lit(".md").alias("suffix"),
    )
    small = conflict_free(named.select("ord", "dir", "stem", "suffix")).select("ord", "name")
    return named.join(small, "ord").select("notebook_id", "ord", "title", "name", "conversation_id", "content")


def notebook_counts(notebooks: DataFrame) -> DataFrame:
    """Notes and artifacts per notebook."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return notebooks.select("notebook_id", size("notes").alias("notes"), size("artifacts").alias("artifacts"))


def index_notes(notebooks: DataFrame, notes: DataFrame, artifacts: DataFrame, skipped: DataFrame, exported_at: str) -> DataFrame:
    """K4: one index note per notebook (path, content). ``notes`` needs pos, title and path; lists keep payload order."""
    lines = lambda df, text: df.select("notebook_id", F.struct("pos", text.alias("line")).alias("x")).groupBy("notebook_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("lines"), F.count(F.lit(1)).alias("n")
    )
    n = lines(notes, F.concat(F.lit("- ["), "title", F.lit("]("), encode_link(F.col("path")), F.lit(")")))
    a = lines(artifacts, F.concat(F.lit("- `"), "artifact_type", F.lit("` `"), "artifact_id", F.lit("` -> ["), F.regexp_extract("path", r"([^/]*)$", 1), F.lit("]("), encode_link(F.col("path")), F.lit(")")))
    s = lines(skipped, F.concat(F.lit("- `"), "artifact_type", F.lit("` `"), "artifact_id", F.lit("` | covered_by_note_export=`"), F.initcap(F.col("covered_by_note_export").cast("string")), F.lit("` | "), "reason"))
    base = notebooks.select("notebook_id", "title", "source_count", "url")
    for name, df in (("n", n), ("a", a), ("s", s)):
        base = base.join(df.select("notebook_id", F.col("lines").alias(f"{name}_lines"), F.col("n").alias(f"{name}_n")), "notebook_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit("- None"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    body = F.concat_ws(
        "\n", F.concat(F.lit("# Notebook export | "), "title"), F.lit(""), F.lit(f"- Exported at: `{exported_at}`"),
        F.concat(F.lit("- notebook_id: `"), "notebook_id", F.lit("`")), F.concat(F.lit("- source_count: `"), F.col("source_count").cast("string"), F.lit("`")),
        F.concat(F.lit("- URL: "), F.coalesce("url", F.lit(""))), F.concat(F.lit("- Notes exported: `"), count("n_n"), F.lit("`")),
        F.concat(F.lit("- Artifacts exported: `"), count("a_n"), F.lit("`")), F.lit(""), F.lit("## Notes"), none("n_lines"), F.lit(""),
        F.lit("## Artifacts"), none("a_lines"), F.lit(""), F.lit("## Skipped Artifacts"), none("s_lines"),
    )
    return base.select(
        F.concat(safe_filename(F.col("title")), F.lit("/_index.md")).alias("path"), F.concat(body, F.lit("\n")).alias("content")
    )


def latest_artifacts(jobs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The artifact of every watch job: the explicit id, else the newest of its type by (created_at, id).

    ``jobs``: job_id, notebook_id, artifact_type, artifact_id; ``artifacts``: notebook_id, artifact_id, type, status, created_at.
    The newest per notebook and type is found once by a partial aggregate, then joined to the jobs.
    """
    c = F.col
    newest = artifacts.groupBy("notebook_id", c("type").alias("artifact_type")).agg(
        F.max(F.struct(F.coalesce("created_at", F.lit("")).alias("created_at"), F.col("artifact_id").alias("found_id"), "status")).alias("a")
    )
    by_type = jobs.where("artifact_id is null").join(newest, ["notebook_id", "artifact_type"], "left").select("job_id", c("a.found_id"), c("a.status"))
    ids = artifacts.groupBy("notebook_id", "artifact_id").agg(F.max(F.struct("created_at", "status")).alias("s"))
    by_id = jobs.where("artifact_id is not null").join(ids, ["notebook_id", "artifact_id"], "left").select(
        "job_id", F.when(c("s").isNotNull(), c("artifact_id")).alias("found_id"), c("s.status").alias("status")
    )
    return by_type.unionByName(by_id)


