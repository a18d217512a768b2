"""Link candidates for a batch of requests, and recency lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import distinct_ci, let, trim_all
from .notes import note_facts, relation_table
from .settle import settle
from .skew import top_k
from .tags import note_tags

CANDIDATES = 40
BLOCK = 500
REQUEST = (
    "array<struct<request_id:string,path:string,q:string,loose:string,tags:array<string>,relations:array<string>,recent:array<string>>>"
)


def search_fields(facts: DataFrame, alias: DataFrame | None) -> DataFrame:
    """Everything a query is compared with: names, aliases, tags, metadata, and alias terms of the tags."""
    meta = [F.col(f"metadata.{c}") for c in ("citekey", "author", "year", "source_type", "locator", "evidence_kind")]
    base = F.concat(F.array("basename", "name", "path"), F.col("aliases"), F.col("tags"), F.array_compact(F.array(*meta)))
    if alias is None:
        return facts.withColumn("fields", distinct_ci(base))
    tags = note_tags(facts).select("path", "tag", "tag_key")
    forward = tags.join(alias.withColumnRenamed("canonical", "tag"), "tag").select("path", F.col("alias").alias("word"))
    reverse = tags.join(alias.select(F.lower("alias").alias("tag_key"), "canonical"), "tag_key").select("path", F.col("canonical").alias("word"))
    extra = forward.unionByName(reverse).groupBy("path").agg(F.array_sort(F.collect_set("word")).alias("extra"))
    joined = facts.join(extra, "path", "left")
    return joined.withColumn("fields", distinct_ci(F.concat(base, F.coalesce("extra", F.array().cast("array<string>"))))).drop("extra")


def _requests(requests: DataFrame, facts: DataFrame, relations: DataFrame, recent: DataFrame | None) -> DataFrame:
    """Requests with the tags, relation targets and recent targets of their note: all small lists."""
    query = F.lower(trim_all(F.coalesce("query", F.lit(""))))
    escaped = F.transform(F.filter(F.split(query, ""), lambda c: c != ""), lambda c: F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    rows = requests.select("request_id", "path", query.alias("q"), F.array_join(escaped, "[\\s\\S]*").alias("loose"))
    tags = facts.select("path", F.transform("tags", F.lower).alias("tags"))
    near = relations.groupBy("path").agg(F.collect_set(F.lower("target_raw")).alias("relations"))
    rows = rows.join(tags, "path", "left").join(near, "path", "left")
    none = F.array().cast("array<string>")
    if recent is None:
        rows = rows.withColumn("recent", none)
    else:
        lists = recent.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda x: x["target"]).alias("recent"))
        rows = rows.join(lists, "request_id", "left")
    fill = lambda c: F.coalesce(c, none).alias(c)
    return rows.select(F.col("request_id").cast("string").alias("request_id"), "path", "q", "loose", fill("tags"), fill("relations"), fill("recent"))


def _score(note: dict[str, Column], r: Column) -> Column:
    q = r["q"]
    field_points = F.aggregate(
        note["low_fields"], F.lit(0),
        lambda acc, low: acc + F.when(low == q, 100).when(F.contains(low, q), 45).when(F.regexp_like(low, r["loose"]), 25).otherwise(0),
    )
    shared = F.size(F.filter(note["low_tags"], lambda t: F.array_contains(r["tags"], t)))
    related = F.array_contains(r["relations"], note["low_path"]) | F.array_contains(r["relations"], note["low_name"])
    place = F.array_position(r["recent"], note["path"])
    return (
        F.when(q == "", 10).otherwise(field_points) + 8 * shared + F.when(related, 16).otherwise(0)
        + F.when(place > 0, F.greatest(F.lit(0), 19 - place)).otherwise(0)
    ).cast("bigint")


def link_candidates(
    notes: DataFrame, requests: DataFrame, alias: DataFrame | None = None, recent: DataFrame | None = None,
    k: int = CANDIDATES, block: int = BLOCK,
) -> DataFrame:
    """The ``k`` best notes for every request (request_id, path, query).

    Every note is scored against every request, which is the feature; so the batch of requests is what must stay small.
    Blocks of at most about ``block`` requests become a constant of the plan and the notes are scanned once per block, without a join
    and without pairs leaving the row unless they can be listed. A query without text gives every note the same base
    score, so only notes with another reason, and the first ``k`` by title, can reach the list. Every row says why it is listed: see ``with_reasons``.
    """
    facts = settle(note_facts(notes))
    prepared = _requests(requests, facts, relation_table(notes, fixed.RESEARCH_RELATION_KEYS), recent)
    lower_all = lambda c: F.transform(c, F.lower)
    fields = settle(search_fields(facts, alias).select(
        "path", "basename", F.lower("path").alias("low_path"), F.lower("basename").alias("low_name"), lower_all("tags").alias("low_tags"),
        lower_all("fields").alias("low_fields"), "tags", "fields",
    ))
    prepared = settle(prepared)
    total = prepared.count()
    blocks = max(1, -(-total // block))
    parts = []
    for n in range(blocks):
        chunk = prepared.where(F.pmod(F.xxhash64("request_id"), F.lit(blocks)) == n) if blocks > 1 else prepared
        listed = json.dumps([r.asDict() for r in chunk.collect()], ensure_ascii=False)
        constant = F.from_json(F.lit(listed), REQUEST)
        note = {c: F.col(c) for c in ("path", "low_path", "low_name", "low_tags", "low_fields")}
        scored = F.transform(constant, lambda r: F.struct(r["request_id"].alias("request_id"), r["q"].alias("q"), r["path"].alias("current"), _score(note, r).alias("score")))
        kept = F.filter(scored, lambda s: (s["current"].isNull() | (s["current"] != F.col("path"))) & ((s["q"] == "") | (s["score"] > 0)))
        parts.append(fields.select("path", F.col("basename").alias("title"), F.explode(kept).alias("s")).select("s.request_id", "path", "title", "s.score"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = [F.desc("score"), F.collate(F.col("title"), "zh"), F.col("path")]
    best = top_k(rows, ["request_id"], order, k).select("request_id", "rank", "path", "title", "score")
    return with_reasons(best, prepared, fields)


def with_reasons(best: DataFrame, prepared: DataFrame, fields: DataFrame) -> DataFrame:
    """Why a listed note is listed: ``reasons`` by field, then shared tags, relation and recency; and ``shared_tags`` in the note's spelling. Only the
    few notes of a list are explained, each joined to its fields and to its request by their keys."""
    asked = prepared.select("request_id", "q", "loose", F.col("tags").alias("my_tags"), "relations", "recent")
    joined = best.join(asked, "request_id").join(fields.drop("basename"), "path")
    q = F.col("q")

    def reason(field: Column) -> Column:
        return let(F.lower(field), lambda low: F.when(q == "", F.lit(None)).when(low == q, F.concat(F.lit("exact:"), field)).when(
            F.contains(low, q), F.concat(F.lit("contains:"), field)).when(F.regexp_like(low, F.col("loose")), F.concat(F.lit("fuzzy:"), field)))

    shared = F.filter("tags", lambda t: F.array_contains("my_tags", F.lower(t)))
    related = F.array_contains("relations", F.col("low_path")) | F.array_contains("relations", F.col("low_name"))
    told = F.array(
        F.when(F.size("shared_tags") > 0, F.concat(F.lit("shared-tags:"), F.array_join("shared_tags", ", "))),
        F.when(related, "relation-neighbor"), F.when(F.array_contains("recent", F.col("path")), "recent"))
    reasons = F.array_distinct(F.array_compact(F.concat(F.transform("fields", reason), told)))
    return joined.withColumn("shared_tags", shared).select("request_id", "rank", "path", "title", "score", reasons.alias("reasons"), "shared_tags")


def recency_list(visits: DataFrame, size: int = 24) -> DataFrame:
    """Most recent distinct targets per user from (user, target, ts, id); re-adding moves a target to the front."""
    last = visits.groupBy("user", "target").agg(F.max(F.struct("ts", "id")).alias("last"))
    return top_k(last, ["user"], [F.desc("last")], size).select("user", "rank", "target")
