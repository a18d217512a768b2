"""Feeds, comments, profiles, posts: payload tables, search filters, checks and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import title_weight, trim_all
from .skew import top_k

# the payload spells the name in two cases, which a struct cannot hold side by side
USER = "map<string,string>"
INTERACT = "struct<liked:boolean,likedCount:string,sharedCount:string,commentCount:string,collectedCount:string,collected:boolean>"
FEED_ITEM = (
    f"struct<id:string,modelType:string,index:int,noteCard:struct<type:string,displayTitle:string,user:{USER},"
    f"interactInfo:{INTERACT},video:struct<capa:struct<duration:int>>>>"
)
REPLY = (
    f"struct<id:string,noteId:string,content:string,likeCount:string,createTime:bigint,userInfo:{USER},subCommentCount:string,"
    "subComments:array<variant>>"
)
COMMENT = REPLY.replace("array<variant>", f"array<{REPLY}>")
DETAIL = (
    f"map<string,struct<note:struct<noteId:string,title:string,desc:string,type:string,time:bigint,ipLocation:string,user:{USER},"
    f"interactInfo:{INTERACT}>,comments:struct<list:array<{COMMENT}>,cursor:string,hasMore:boolean>>>"
)
PROFILE = (
    "struct<interactions:array<struct<type:string,name:string,count:string>>,basicInfo:struct<nickname:string,redId:string,"
    f"ipLocation:string>,notes:array<array<{FEED_ITEM}>>>"
)


def number(text: Column) -> Column:
    """Counts arrive as text; what is not a number gives null."""
    return trim_all(text).try_cast("bigint")


def feed_items(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Feed lists or search results (JSON array per row) -> one row per item."""
    rows = payloads.select(F.explode(F.from_json(column, f"array<{FEED_ITEM}>")).alias("f"))
    card = F.col("f.noteCard")
    return rows.select(
        F.col("f.id").alias("feed_id"), F.col("f.index").alias("pos"), F.col("f.modelType").alias("model_type"), card["type"].alias("note_type"),
        card["displayTitle"].alias("title"), card["user"]["userId"].alias("user_id"), F.coalesce(card["user"]["nickname"], card["user"]["nickName"]).alias("nickname"),
        number(card["interactInfo"]["likedCount"]).alias("liked_count"), number(card["interactInfo"]["commentCount"]).alias("comment_count"),
        number(card["interactInfo"]["collectedCount"]).alias("collected_count"), card["video"]["capa"]["duration"].alias("duration"),
    )


def feed_details(payloads: DataFrame, column: str = "value") -> DataFrame:
    """Detail maps keyed by note id -> one row per note."""
    rows = payloads.select(F.explode(F.from_json(column, DETAIL)).alias("note_id", "d"))
    note = F.col("d.note")
    return rows.select(
        "note_id", note["title"].alias("title"), note["type"].alias("note_type"), F.timestamp_millis(note["time"]).alias("published_at"),
        number(note["interactInfo"]["likedCount"]).alias("liked_count"), F.col("d.comments.list").alias("comments"),
    )


def profiles(payloads: DataFrame, key: str, column: str = "value") -> DataFrame:
    """Profile payloads; the array of post arrays is flattened."""
    p = F.from_json(column, PROFILE)
    return payloads.select(key, p.alias("p")).select(
        key, F.col("p.basicInfo.nickname").alias("nickname"), F.col("p.interactions").alias("interactions"),
        F.flatten(F.coalesce("p.notes", F.array().cast(f"array<array<{FEED_ITEM}>>"))).alias("posts"),
    )


def profile_counts(profile: DataFrame, key: str) -> DataFrame:
    """Follows, fans and interaction counts side by side, with the number of posts."""
    pick = lambda t: F.max(F.when(F.col("i.type") == t, number(F.col("i.count")))).alias(t)
    counts = profile.select(key, F.explode_outer("interactions").alias("i")).groupBy(key).agg(pick("follows"), pick("fans"), pick("interaction"))
    return counts.join(profile.select(key, F.size("posts").alias("posts")), key)


# ------------------------------------------------------------------------------------------------------------- search

ORDERS = {"最新": "published_at", "最多点赞": "liked_count", "最多评论": "comment_count", "最多收藏": "collected_count"}
WINDOWS = {"一天内": "INTERVAL 1 DAY", "一周内": "INTERVAL 7 DAYS", "半年内": "INTERVAL 180 DAYS"}


def option_errors(requests: DataFrame) -> DataFrame:
    """One row per option with its group and place, or an error for unknown text. Empty options are skipped."""
    groups = list(fixed.SEARCH_OPTIONS)
    rows = requests.select(
        "request_id", F.explode(F.array(*[
            F.struct(F.lit(i + 1).alias("group_no"), F.lit(g).alias("option_group"), F.col(g).alias("text"),
                     F.array_position(F.array(*[F.lit(t) for t in fixed.SEARCH_OPTIONS[g]]), F.col(g)).alias("option_no"))
            for i, g in enumerate(groups)
        ])).alias("o")
    ).select("request_id", "o.*").where("text is not null and text <> ''")
    return rows.withColumn("error", F.when(F.col("option_no") == 0, "unknown-option"))


def search_filter(feed: DataFrame, now: Column, sort_by="综合", note_type="不限", publish_time="不限", search_scope="不限", location="不限") -> DataFrame:
    """Apply one validated filter set to a feed table; the result keeps a ``place`` order column to sort by."""
    chosen = {"sort_by": sort_by, "note_type": note_type, "publish_time": publish_time, "search_scope": search_scope, "location": location}
    for group, text in chosen.items():
        if text not in fixed.SEARCH_OPTIONS[group]:
            raise ValueError(f"unknown {group}: {text}")
    rows = feed
    if note_type != "不限":
        rows = rows.where(F.col("note_type") == ("video" if note_type == "视频" else "normal"))
    if publish_time != "不限":
        rows = rows.where(F.col("published_at") >= now - F.expr(WINDOWS[publish_time]))
    if search_scope != "不限":
        rows = rows.where({"已看过": F.col("seen"), "未看过": ~F.col("seen"), "已关注": F.col("followed")}[search_scope])
    if location != "不限":
        rows = rows.where(F.col("place") == ("local" if location == "同城" else "near"))
    return rows.withColumn("sort_key", F.col(ORDERS.get(sort_by, "pos")))


def ordered(rows: DataFrame, sort_by: str) -> DataFrame:
    if sort_by in ORDERS:
        return rows.orderBy(F.desc_nulls_last(ORDERS[sort_by]), F.asc("pos"))
    return rows.orderBy("pos")


def access_status(pages: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The first listed keyword a page text contains, ``unknown`` for other text, ``ok`` for none."""
    words = F.array(*[F.lit(w) for w in fixed.BLOCKED_PAGE_KEYWORDS])
    hit = F.get(F.filter(words, lambda w: F.contains(F.col(column), w)), F.lit(0))
    return pages.select(
        key, F.coalesce(hit, F.when(F.length(trim_all(F.coalesce(column, F.lit("")))) > 0, "unknown").otherwise("ok")).alias("status")
    )


def post_checks(posts: DataFrame, now: Column, max_weight: int = 20) -> DataFrame:
    """Title weight and schedule window of planned posts (post_id, title, schedule_at)."""
    at = F.col("schedule_at")
    return posts.select(
        "post_id", title_weight(F.col("title")).alias("title_weight"), (title_weight(F.col("title")) <= max_weight).alias("title_ok"),
        F.when(at.isNull(), "none").when(at < now + F.expr("INTERVAL 1 HOUR"), "too-early")
        .when(at > now + F.expr("INTERVAL 14 DAYS"), "too-late").otherwise("ok").alias("schedule"),
    )


def sampled_comments(comments: DataFrame, max_items: int = 0, max_replies: int = 10) -> DataFrame:
    """Top-level comments of every note with their replies. At most ``max_items`` threads (0 = all); the replies of a thread with
    more than ``max_replies`` of them stay folded (0 = never)."""
    top = comments.where("turn = 0")
    if max_items > 0:
        top = top_k(top, ["note_id"], [F.col("thread_no")], max_items).drop("rank")
    replies = comments.where("turn > 0").groupBy("thread_id").agg(F.count(F.lit(1)).alias("replies"))
    counted = top.select("note_id", "thread_id", "comment_id").join(replies, "thread_id", "left").withColumn("replies", F.coalesce("replies", F.lit(0)))
    folded = (F.col("replies") > max_replies) if max_replies > 0 else F.lit(False)
    return counted.select("note_id", "thread_id", "comment_id", "replies", folded.alias("folded"))


def image_urls(rows: DataFrame, column: str = "url") -> DataFrame:
    """P10: distinct URLs with a validity flag and a stable key."""
    url = F.col(column)
    host = F.regexp_extract(url, r"(?i)^https?://([^/?#\s]+)", 1)
    return rows.select(url.alias("url")).distinct().select(
        "url", (F.lower("url").rlike("^https?://") & (F.length(host) > 0)).alias("valid"), F.substring(F.sha2(F.col("url").cast("binary"), 256), 1, 16).alias("image_key")
    )


def comment_rollup(comments: DataFrame) -> DataFrame:
    """Threads, replies and likes per note from flat comment rows."""
    return comments.groupBy("note_id").agg(
        F.count_if(F.col("turn") == 0).alias("comments"), F.count_if(F.col("turn") > 0).alias("sub_comments"),
        F.sum(number(F.col("like_count"))).alias("likes"), F.count_if(number(F.col("like_count")).isNull()).alias("bad_counts"),
    )


def flatten_comments(details: DataFrame) -> DataFrame:
    """Comment trees of detail rows as flat rows, two levels deep."""
    top = details.select("note_id", F.posexplode("comments").alias("thread_no", "c"))
    flat = lambda c, turn: (F.col(f"{c}.id").alias("comment_id"), turn.cast("bigint").alias("turn"), F.col(f"{c}.likeCount").alias("like_count"), F.col(f"{c}.content").alias("content"))
    parents = top.select("note_id", F.col("c.id").alias("thread_id"), "thread_no", *flat("c", F.lit(0)))
    replies = top.select("note_id", F.col("c.id").alias("thread_id"), "thread_no", F.posexplode("c.subComments").alias("n", "s")).select(
        "note_id", "thread_id", "thread_no", *flat("s", F.col("n") + 1)
    )
    return parents.unionByName(replies)


def counts(feed: DataFrame) -> DataFrame:
    """Number of items per note type and in all."""
    return feed.rollup("note_type").agg(F.count(F.lit(1)).alias("count"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.text(path, wholetext=True)
