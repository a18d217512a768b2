"""Web archive records: resolving "not modified" revisits to the full response they stand for.

An as-of join by canonical address finds the latest full response that is earlier than the revisit. Its validators must agree
with those of the revisit; then the revisit's permitted headers replace the stored ones. Records of one address are joined in slices
of time, with the last response of earlier slices carried over, so an address with any number of captures is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.settle import settle

# Headers that a "not modified" answer must not change in a stored response.
NOT_UPDATED = ["content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "keep-alive", "te", "trailer", "upgrade", "proxy-authenticate",
               "proxy-authentication-info", "proxy-authorization", "proxy-connection"]


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case without the scheme's own port, no fragment, no tracking parameters, parameters sorted, no slash at the end
    of a path. Null stays null."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    rest = F.regexp_replace(F.substring(url, F.length(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)) + 1, F.length(url)), r"#[\s\S]*$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"(?<=.)/$", "")
    path = F.when(path == "", "/").otherwise(path)
    kept = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?([\s\S]*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[a-z]+|gclid|fbclid)=")))
    return F.concat(head, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def parse_headers(block: Column) -> Column:
    """Header lines as a map with lower-case names; the first of a repeated name counts. Null gives an empty map."""
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"^[^\s:]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)$", 1)).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(names, p["k"]) == i + 1))


def resolve(records: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """One row for every revisit: record_id, url (canonical), date, refers_to, refers_to_date, outcome, headers (merged, or its own).

    ``records`` has record_id (long), url, date (timestamp), kind ('response' or 'revisit') and headers (raw text); other columns are ignored.
    outcome is 'resolved', 'no earlier response', 'no validator' (the two share none) or 'validator mismatch'. An entity tag decides, without
    regard to its weak mark; Last-Modified decides only if one side lacks a tag. Only strictly earlier responses count; of two at one
    instant the larger record_id does. A revisit without address or date finds nothing; null headers are empty. Repeated rows
    each come back.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), F.unix_micros(F.col("date").cast("timestamp")).alias("at"), "kind", parse_headers(F.col("headers")).alias("headers"))
    rows = rows.withColumn("slice", F.floor(F.col("at") / (slice_seconds * 1_000_000)))
    response = F.when((F.col("kind") == "response") & F.col("at").isNotNull() & F.col("url").isNotNull(), F.struct("at", F.coalesce("record_id", F.lit(-1)).alias("record_id"), F.map_entries("headers").alias("headers")))
    rows = settle(rows.withColumn("full", response))  # three branches read it
    inside = Window.partitionBy("url", "slice").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    per_slice = rows.where(F.col("full").isNotNull()).groupBy("url", "slice").agg(F.max("full").alias("last"))
    # how far a slice's last response reaches: to the next slice that has one
    following = Window.partitionBy("url").orderBy("slice")
    reach = per_slice.withColumn("until", F.lead("slice").over(following))
    wanted = rows.where("kind = 'revisit'").select("url", "slice").distinct()
    marks = wanted.select("url", "slice", F.lit(None).cast(reach.schema["last"].dataType).alias("last")).unionByName(reach.select("url", "slice", "last"))
    marks = marks.groupBy("url", "slice").agg(F.max("last").alias("last"))
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select("url", "slice", F.max("last").over(before).alias("carried"))
    met = rows.withColumn("near", F.max("full").over(inside)).where("kind = 'revisit'").drop("full")
    met = met.join(carried, ["url", "slice"], "left").withColumn("base", F.coalesce("near", "carried"))
    stored = F.map_from_entries("base.headers")
    tag = lambda m: F.regexp_replace(F.element_at(m, "etag"), "^[Ww]/", "")
    mine, theirs = tag(F.col("headers")), tag(F.col("stored"))
    my_date, their_date = F.element_at("headers", "last-modified"), F.element_at("stored", "last-modified")
    tags, dates = mine.isNotNull() & theirs.isNotNull(), my_date.isNotNull() & their_date.isNotNull()
    outcome = (
        F.when(F.col("base").isNull(), "no earlier response").when(tags, F.when(mine == theirs, "resolved").otherwise("validator mismatch"))
        .when(dates, F.when(my_date == their_date, "resolved").otherwise("validator mismatch")).otherwise("no validator")
    )
    met = met.withColumn("stored", F.when(F.col("base").isNotNull(), stored)).withColumn("outcome", outcome)
    named = F.transform(F.split(F.coalesce(F.element_at("headers", "connection"), F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    changed = F.map_filter("headers", lambda k, v: ~k.isin(*NOT_UPDATED) & ~F.array_contains(named, k))
    merged = F.map_concat(F.map_filter("stored", lambda k, v: ~F.map_contains_key(changed, k)), changed)
    found = F.col("outcome") == "resolved"
    return met.select(
        "record_id", "url", F.timestamp_micros("at").alias("date"), F.when(found, F.col("base.record_id")).alias("refers_to"),
        F.when(found, F.timestamp_micros("base.at")).alias("refers_to_date"), "outcome", F.when(found, merged).otherwise(F.col("headers")).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture log of a crawl that meets every page twice: a full response, and two hours later a "not modified" answer under another spelling
    of the address. One answer in sixteen (by the page's hash) carries another entity tag, one in sixteen only a date, one in sixteen neither."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    kind = F.substring(F.md5(F.concat(digest, F.col("page_id").cast("string"))), 1, 1)
    start = F.col("page_id").cast("long") * 17
    rows = pages.select("page_id", "url", digest.alias("d"), kind.alias("k"), start.alias("t"), F.length(F.coalesce("html", F.lit(""))).alias("n"))
    date = F.concat(F.lit("Last-Modified: day "), F.pmod("page_id", F.lit(1000)).cast("string"), F.lit("\r\n"))
    etag = lambda x: F.concat(F.lit('ETag: "'), x, F.lit('"\r\n'))
    full = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nCache-Control: max-age=60\r\nServer: one\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n"), etag(F.col("d")), date)
    validators = F.when(F.col("k") == "0", etag(F.reverse("d"))).when(F.col("k") == "1", date).when(F.col("k") == "2", F.lit("")).otherwise(etag(F.concat(F.lit(""), F.col("d"))))
    later = F.concat(F.lit("HTTP/1.1 304 Not Modified\r\nCache-Control: max-age=120\r\nContent-Length: 0\r\nConnection: X-Hop\r\nX-Hop: 1\r\n"), validators)
    pair = F.array(
        F.struct((F.col("page_id") * 2).alias("record_id"), F.col("url"), F.timestamp_seconds("t").alias("date"), F.lit("response").alias("kind"), full.alias("headers")),
        F.struct((F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#[\\s\\S]*$", ""), F.lit("#again")).alias("url"), F.timestamp_seconds(F.col("t") + 7200).alias("date"), F.lit("revisit").alias("kind"), later.alias("headers")))
    return rows.select(F.explode(pair).alias("r")).select("r.*")
