"""Retrieval: nearest vectors, and normal forms of results that outside commands return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, trim_all
from .settle import settle
from .skew import fits, top_k
from .vectors import build_index, lists

RESULTS = 20
COPIED = 10_000  # vectors with copies that every task may hold


def comparable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding has a length, no null and no value that is not finite."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(e.isNotNull() & finite & F.exists(e, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = RESULTS, exclude_folders: list[str] | None = None) -> DataFrame:
    """The ``k`` vectors most similar (cosine) to every query: (query_id, rank, vec_id, score).

    ``vectors``: vec_id, embedding, optional path and heading; ``queries``: query_id, embedding, optional own_id to leave out. Any number of
    queries: equal vectors and equal queries are searched once, by ``vectors.lists``, with one more than ``k`` as a query may leave itself out. A vector
    that is null, zero or not finite takes no part, nor does one without a vec_id; a query meets the vectors of its own length.
    """
    rows = vectors
    if "path" in vectors.columns:
        for folder in exclude_folders if exclude_folders is not None else fixed.SEMANTIC_EXCLUDED_FOLDERS:
            rows = rows.where(~F.col("path").startswith(folder + "/"))
    if "heading" in vectors.columns:
        rows = rows.where(F.col("heading").isNull() | ~F.col("heading").isin(*fixed.SEMANTIC_EXCLUDED_HEADINGS))
    own = F.col("own_id") if "own_id" in queries.columns else F.lit(None)
    plain = lambda df: df.withColumn("embedding", F.col("embedding").cast("array<float>"))
    rows = comparable(plain(rows.select("vec_id", "embedding").where("vec_id IS NOT NULL")))
    asked = comparable(plain(queries.select(F.col("query_id").cast("string").alias("query_id"), own.cast("bigint").alias("own_id"), "embedding")))
    asked = settle(asked.withColumn("row", F.monotonically_increasing_id()))
    # of equal vectors only the k + 1 smallest ids can be in a list
    equal = Window.partitionBy("embedding").orderBy("vec_id")
    numbered = rows.withColumn("id", F.first("vec_id").over(equal.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    copies = settle(numbered.withColumn("_copy", F.row_number().over(equal)).where(F.col("_copy") <= k + 1))
    distinct = copies.where("_copy = 1").select("id", "embedding")
    once = settle(asked.groupBy("embedding").agg(F.min("row").alias("id")))
    found = None
    for (size,) in distinct.select(F.size("embedding")).distinct().collect():  # lengths are few
        index = build_index(distinct.where(F.size("embedding") == size), k + 1)
        part = lists(index, once.where(F.size("embedding") == size), k + 1)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    # vectors and texts of queries are in no row of a hit: a query's list stays one value until it lies at its query_id
    more = copies.where("_copy > 1").groupBy("id").agg(F.collect_list("vec_id").alias("more"))  # k at most
    requests = asked.join(once, "embedding").select("query_id", "own_id", F.col("id").alias("query"))
    listed = requests.join(_with_copies(found, more, k), "query").select("query_id", F.slice(F.filter("hits", lambda h: F.col("own_id").isNull() | (F.col("own_id") != h["vec_id"])), 1, k).alias("hits"))
    hits = listed.repartition("query_id").select("query_id", F.explode("hits").alias("hit"))
    return top_k(hits.select("query_id", "hit.vec_id", (-F.col("hit.less")).alias("score")), ["query_id"], [F.desc("score"), F.asc("vec_id")], k)


def _with_copies(found: DataFrame, more: DataFrame, k: int) -> DataFrame:
    """Lists (query, ids, scores) with the further copies (id, more) of their vectors: (query, hits), a hit being its negative score and a vec_id, best first. Of a list
    that names no vec_id twice ``k + 1`` hits stay, as its query may leave one out."""
    if more.isEmpty():
        return found.select("query", F.transform(F.arrays_zip("ids", "scores"), lambda h: F.struct((-h["scores"]).alias("less"), h["ids"].alias("vec_id"))).alias("hits"))
    each = found.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("query", F.col("hit.ids").alias("id"), (-F.col("hit.scores")).alias("less"))
    each = each.join(F.broadcast(more) if fits(more, COPIED) else more, "id", "left")
    equal = F.concat(F.array("id"), F.coalesce("more", F.array().cast("array<bigint>")))
    whole = each.groupBy("query").agg(F.collect_list(F.transform(equal, lambda x: F.struct(F.col("less"), x.alias("vec_id")))).alias("hits"))
    whole = whole.select("query", F.array_sort(F.flatten("hits")).alias("hits"))
    once = F.size(F.array_distinct("hits.vec_id")) == F.size("hits")
    return whole.select("query", F.when(once, F.slice("hits", 1, k + 1)).otherwise(F.col("hits")).alias("hits"))


def _text(v: Column, *names: str) -> Column:
    """First present field as text or number text; blanks and other types give null."""
    found = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in names])
    kind = F.schema_of_variant(found)
    usable = kind.isin("STRING", "BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    return let(trim_all(found.cast("string")), lambda t: F.when(usable & (F.length(t) > 0), t))


def _list(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), F.array().cast("array<string>"))


def search_results(rows: DataFrame, column: str = "value") -> DataFrame:
    """Results of a search command (JSON array, or object with ``results``) in one shape; a result needs a path."""
    v = F.try_parse_json(column)
    items = F.coalesce(F.try_variant_get(v, "$.results", "array<variant>"), v.try_cast("array<variant>"))
    r = rows.select(F.posexplode(items).alias("pos", "r"))
    raw = lambda n: F.try_variant_get("r", f"$.{n}", "string")
    path, title = raw("path"), raw("title")
    is_text = F.schema_of_variant(F.try_variant_get("r", "$.path", "variant")) == "STRING"
    return r.where(is_text & (F.length(trim_all(path)) > 0)).select(
        "pos", path.alias("path"), F.when(F.length(trim_all(title)) > 0, title).otherwise(F.regexp_extract(path, r"([^/]*)$", 1)).alias("title"),
        F.coalesce(F.try_variant_get("r", "$.score", "double"), F.lit(0.0)).alias("score"), F.coalesce(raw("excerpt"), F.lit("")).alias("excerpt"),
        F.coalesce(raw("reason"), F.lit("")).alias("reason"), _text(F.col("r"), "citekey", "citation_key").alias("citekey"),
        _text(F.col("r"), "author", "authors").alias("author"), _text(F.col("r"), "year").alias("year"), _text(F.col("r"), "page", "locator").alias("page"),
        _text(F.col("r"), "source_type", "sourceType").alias("source_type"), _text(F.col("r"), "evidence_kind", "evidenceKind").alias("evidence_kind"),
        _list(F.col("r"), "suggested_tags").alias("suggested_tags"),
    )


def ingestion_results(rows: DataFrame, column: str = "value") -> DataFrame:
    """Ingestion logs in one shape; a line without a note path is marked invalid."""
    v = F.try_parse_json(column)
    x = rows.select(F.col(column).alias("raw"), v.alias("r"))
    note = _text(F.col("r"), "note_path", "notePath")
    full = lambda name: F.filter(_list(F.col("r"), name), lambda s: s != "")
    base = x.select("raw", note.alias("note_path"), _text(F.col("r"), "status").alias("status"), _text(F.col("r"), "source_type", "sourceType").alias("source_type"),
                    _text(F.col("r"), "source_id", "sourceId").alias("source_id"), _text(F.col("r"), "title").alias("title"),
                    full("attachment_paths").alias("attachment_paths"), full("warnings").alias("warnings"))
    stem = F.regexp_replace(F.regexp_extract("note_path", r"([^/]*)$", 1), r"(?i)\.md$", "")
    return base.select(
        "note_path", F.coalesce("status", F.lit("created")).alias("status"), F.coalesce("source_type", F.lit("")).alias("source_type"), "source_id",
        F.coalesce("title", stem).alias("title"), "attachment_paths", "warnings", F.when(F.col("note_path").isNull(), "invalid-response").alias("error"),
    )


def ingestion_rollup(results: DataFrame) -> DataFrame:
    """Ingested notes per status and source type."""
    return results.groupBy("status", "source_type").agg(F.count(F.lit(1)).alias("notes"), F.sum(F.size("warnings")).alias("warnings"))
