"""Queries over feeds, comments, posts, transcripts, vectors, streams: A9–A11, P6–P11, G11–G13, G15–G17, W2, C13, C16, C17, E1, R3–R6."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...functions import fixed
from ...operators import feeds, notebooks, notes, semantic, speech
from ...operators.settle import checkpoint_dir
from ...sources import dims
from ...sources.views import VIEWS, table
from ...streaming import artifacts, sessions
from .common import TAGS, TRIM, Query, oracle, plain, view


def a9(spark, sf):
    """Feed payloads per user, written by Spark as JSON arrays, read back through the A9 source."""
    v = view(spark, sf, "v_feed")
    item = F.struct(
        F.col("feed_id").alias("id"), F.lit("note").alias("modelType"), F.col("pos").cast("int").alias("index"),
        F.struct(F.col("note_type").alias("type"), F.col("title").alias("displayTitle"), F.struct(F.col("user_id").alias("userId"), F.lit("N").alias("nickName")).alias("user"),
                 F.struct(F.col("liked_count").alias("likedCount"), F.col("comment_count").alias("commentCount"), F.col("collected_count").alias("collectedCount")).alias("interactInfo")).alias("noteCard"),
    )
    # payloads of up to a day of one user: a payload is one document of the source, so it stays small
    payloads = v.groupBy("user_id", F.date_format("published_at", "yyyy-MM-dd").alias("day")).agg(F.to_json(F.collect_list(item)).alias("value"))
    return plain(feeds.feed_items(payloads).select("feed_id", "pos", "note_type", "title", "user_id", "nickname", "liked_count", "comment_count", "collected_count"))


A9 = oracle("""SELECT feed_id, pos, note_type, title, user_id, 'N' AS nickname, try_cast(liked_count AS BIGINT) AS liked_count, comment_count::BIGINT AS comment_count,
  collected_count::BIGINT AS collected_count FROM v_feed""", "v_feed")


def a9_details(spark, sf):
    """Detail maps, one per conversation, written by Spark as JSON and read back as flat comments: the first turn opens the thread."""
    item = F.struct("turn", "content", "comment_id", "like_count")
    threads = view(spark, sf, "v_comments").groupBy("thread_no").agg(F.array_sort(F.collect_list(item)).alias("all"))
    said = lambda x: (x["comment_id"].alias("id"), x["content"].alias("content"), x["like_count"].alias("likeCount"))
    rest = F.transform(F.slice("all", 2, F.size("all")), lambda x: F.struct(*said(x)))
    thread = F.struct(*said(F.col("all")[0]), rest.alias("subComments"))
    detail = F.struct(F.struct(F.lit("T").alias("title")).alias("note"), F.struct(F.array(thread).alias("list")).alias("comments"))
    payloads = threads.select(F.to_json(F.create_map(F.concat(F.lit("m"), F.col("thread_no").cast("string")), detail)).alias("value"))
    return plain(feeds.flatten_comments(feeds.feed_details(payloads)).select("note_id", "thread_id", "comment_id", "turn", "like_count", "content"))


A9_DETAILS = oracle("""SELECT 'm' || thread_no AS note_id, first_value(comment_id) OVER w AS thread_id, comment_id, row_number() OVER w - 1 AS turn, like_count, content
FROM v_comments WINDOW w AS (PARTITION BY thread_no ORDER BY turn, content)""", "v_comments")


def p6(spark, sf):
    v = view(spark, sf, "v_feed").withColumn("liked_count", feeds.number(F.col("liked_count")))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    rows = feeds.search_filter(v, now, sort_by="最多点赞", note_type="视频", publish_time="一周内", search_scope="未看过", location="同城")
    return plain(rows.select("feed_id", "liked_count", "published_at"))


P6 = oracle("""SELECT feed_id, try_cast(liked_count AS BIGINT) AS liked_count, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at FROM v_feed
WHERE note_type = 'video' AND published_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND NOT seen AND place = 'local'""", "v_feed")


def p6_options(spark, sf):
    e = view(spark, sf, "v_feed")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("pos") % n + 1).cast("int"))
    asked = e.select(
        F.col("feed_id").alias("request_id"), pick(["综合", "最新", "最贵"], 3).alias("sort_by"), pick(["视频", ""], 2).alias("note_type"),
        F.lit(None).cast("string").alias("publish_time"), F.lit("已关注").alias("search_scope"), pick(["同城", "附近", "不限", "远方"], 4).alias("location"),
    )
    return plain(feeds.option_errors(asked).select("request_id", "group_no", "option_group", "text", "option_no", "error"))


P6_OPTIONS = oracle("""WITH r AS (
  SELECT feed_id AS request_id, 1::BIGINT AS group_no, 'sort_by' AS option_group, ['综合', '最新', '最贵'][pos % 3 + 1] AS text, ['综合', '最新', '最多点赞', '最多评论', '最多收藏'] AS known FROM v_feed
  UNION ALL SELECT feed_id, 2, 'note_type', ['视频', ''][pos % 2 + 1], ['不限', '视频', '图文'] FROM v_feed
  UNION ALL SELECT feed_id, 4, 'search_scope', '已关注', ['不限', '已看过', '未看过', '已关注'] FROM v_feed
  UNION ALL SELECT feed_id, 5, 'location', ['同城', '附近', '不限', '远方'][pos % 4 + 1], ['不限', '同城', '附近'] FROM v_feed)
SELECT request_id, group_no, option_group, text, coalesce(list_position(known, text), 0)::BIGINT AS option_no,
  CASE WHEN NOT list_contains(known, text) THEN 'unknown-option' END AS error FROM r WHERE text <> ''""", "v_feed")


def p7(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("抱歉，该笔记已被删除"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("私密笔记 内容不存在"), "html"))
        .when(F.col("page_id") % 5 == 2, F.lit("  ")).otherwise(F.col("html")).alias("text")
    )
    return plain(feeds.access_status(pages, "page_id"))


P7 = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN '该笔记已被删除' WHEN 1 THEN '内容不存在' WHEN 2 THEN 'ok' ELSE 'unknown' END AS status FROM pages"""


def p8(spark, sf):
    posts = view(spark, sf, "v_feed").select(F.col("feed_id").alias("post_id"), "title", F.when(F.col("pos") % 3 > 0, F.col("published_at")).alias("schedule_at"))
    return plain(feeds.post_checks(posts, F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")))


P8 = oracle(r"""WITH p AS (SELECT feed_id AS post_id, length(regexp_replace(title, '[^\x00-\x7f]', '', 'g')) AS a, length(title) AS n, CASE WHEN pos % 3 > 0 THEN published_at END AS t FROM v_feed)
SELECT post_id, (a + 2 * (n - a) + 1) // 2 AS title_weight, (a + 2 * (n - a) + 1) // 2 <= 20 AS title_ok,
  CASE WHEN t IS NULL THEN 'none' WHEN t < TIMESTAMP '2024-01-05 01:00:00' THEN 'too-early' WHEN t > TIMESTAMP '2024-01-19' THEN 'too-late' ELSE 'ok' END AS schedule FROM p""", "v_feed")


def p9(spark, sf):
    return plain(feeds.sampled_comments(view(spark, sf, "v_comments"), max_items=4, max_replies=3))


P9 = oracle("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY thread_no) AS n FROM v_comments WHERE turn = 0),
r AS (SELECT thread_id, count(*) AS replies FROM v_comments WHERE turn > 0 GROUP BY 1)
SELECT t.note_id, t.thread_id, t.comment_id, coalesce(r.replies, 0) AS replies, coalesce(r.replies, 0) > 3 AS folded FROM t LEFT JOIN r USING (thread_id) WHERE n <= 4""", "v_comments")


def p10(spark, sf):
    urls = table(spark, sf, "pages").select(F.explode(F.array("url", F.concat(F.lit("ftp:"), "url"), "url")).alias("url"))
    return plain(feeds.image_urls(urls))


P10 = """SELECT url, starts_with(url, 'http') AS valid, substr(sha256(url), 1, 16) AS image_key FROM (SELECT url FROM pages UNION SELECT 'ftp:' || url FROM pages) u"""


def p11(spark, sf):
    """Search output per document, some as bare lists, some with missing or odd fields."""
    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    result = F.concat(
        F.lit('{"path":'), F.when(n % 7 == 0, F.lit("null")).otherwise(F.concat(F.lit('"Notes/'), "source", F.lit("/doc-"), n, F.lit('.md"'))),
        F.when(n % 3 == 0, F.lit(',"title":"T"')).otherwise(F.lit("")), F.when(n % 4 == 0, F.concat(F.lit(',"score":'), n)).otherwise(F.lit(',"score":"high"')),
        F.when(n % 2 == 0, F.lit(',"citation_key":"k"')).otherwise(F.lit(',"citekey":" "')), F.lit(',"year":'), (2000 + n % 20).cast("string"), F.lit(',"locator":"p. 3","sourceType":"book","suggested_tags":["a",1]}'),
    )
    text = F.when(n % 2 == 0, F.concat(F.lit('{"results":['), result, F.lit("]}"))).otherwise(F.concat(F.lit("["), result, F.lit("]")))
    return plain(semantic.search_results(d.select(text.alias("value"))).select("path", "title", "score", "citekey", "year", "page", "source_type", "suggested_tags"))


P11 = """SELECT 'Notes/' || source || '/doc-' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN 'T' ELSE 'doc-' || doc_id || '.md' END AS title,
  CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE 0 END::DOUBLE AS score, CASE WHEN doc_id % 2 = 0 THEN 'k' END AS citekey, (2000 + doc_id % 20)::VARCHAR AS year, 'p. 3' AS page, 'book' AS source_type,
  'a|1' AS suggested_tags FROM documents WHERE doc_id % 7 <> 0"""


def g11(spark, sf):
    return plain(speech.vocabulary_words(notes.note_facts(view(spark, sf, "v_notes"))))


G11 = oracle(r"""SELECT DISTINCT word FROM (SELECT regexp_replace(w, '[\[\]()#*_?]', '', 'g') AS word FROM (SELECT basename AS w FROM v_notes UNION ALL SELECT tag FROM tags) a) b
WHERE length(word) BETWEEN 2 AND 15 AND regexp_matches(word, '^[\x{4e00}-\x{9fa5}a-zA-Z0-9\s-]+$')""", "v_notes", using=(TAGS,))


def a10(spark, sf):
    lines = notes.note_facts(view(spark, sf, "v_notes")).select(F.concat("basename", F.lit(" :"), F.col("ord") % 4, F.lit(".5")).alias("value"))
    return plain(dims.vocabulary(lines))


A10 = oracle(r"SELECT regexp_replace(basename, '[ 0\-9.]+$', '') AS word, (ord % 4) + 0.5::DOUBLE AS score FROM v_notes", "v_notes")


def a11(spark, sf):
    lines = table(spark, sf, "events").select(F.concat("event_type", F.lit(" : "), "props").alias("value"))
    return plain(dims.corrections(lines))


A11 = "SELECT event_type AS wrong, props AS right FROM events"


def _recall_rows(spark, sf):
    c = table(spark, sf, "conversations")
    n = F.col("conv_id") * 7 + F.col("turn")
    words = F.array(*[F.lit(t) for t in fixed.RECALL_TERMS])
    term = lambda k: F.element_at(words, (F.pmod(n * k, F.lit(14)) + 1).cast("int"))
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("item_id"), F.col("role").alias("category"), F.concat("text", term(1), F.lit(" "), term(3)).alias("truth"),
        F.concat(term(1), "text", F.when(n % 2 == 0, term(3)).otherwise("")).alias("output"),
    )


_WORDS = "[" + ", ".join(f"'{t}'" for t in fixed.RECALL_TERMS) + "]"
_RECALL = f"""rows AS (SELECT conv_id || '-' || turn AS item_id, role AS category, text || {_WORDS}[(conv_id * 7 + turn) % 14 + 1] || ' ' || {_WORDS}[(conv_id * 7 + turn) * 3 % 14 + 1] AS truth,
  {_WORDS}[(conv_id * 7 + turn) % 14 + 1] || text || CASE WHEN (conv_id * 7 + turn) % 2 = 0 THEN {_WORDS}[(conv_id * 7 + turn) * 3 % 14 + 1] ELSE '' END AS output FROM conversations),
items AS (SELECT item_id, category, len(list_filter({_WORDS}, lambda t: contains(truth, t))) AS expected,
  len(list_filter({_WORDS}, lambda t: contains(truth, t) AND contains(output, t))) AS found FROM rows)"""


def g12(spark, sf):
    return plain(speech.recall_summary(speech.term_recall(_recall_rows(spark, sf))))


G12 = f"WITH {_RECALL} SELECT category, sum(expected)::BIGINT AS expected, sum(found)::BIGINT AS found, round(sum(found) * 100 / sum(expected), 1) AS percent FROM items GROUP BY ROLLUP (category)"
G12_ITEMS = f"""WITH {_RECALL} SELECT *, found / expected AS ratio, CASE WHEN found / expected >= 0.8 THEN 'good' WHEN found / expected >= 0.5 THEN 'fair' ELSE 'poor' END AS grade FROM items"""


def g13(spark, sf):
    clips = table(spark, sf, "embeddings").select(F.col("vec_id").alias("clip_id"), F.col("embedding").alias("samples"))
    rows = speech.level_sweep(clips, [-20, 0, 20])
    return plain(rows.select("clip_id", "gain_db", F.round("rms", 6).alias("rms"), F.round("dbfs", 4).alias("dbfs")))


G13 = """WITH g AS (SELECT vec_id AS clip_id, unnest([-20, 0, 20]::BIGINT[]) AS gain_db, embedding FROM embeddings),
s AS (SELECT clip_id, gain_db, list_transform(embedding, lambda x: greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x::DOUBLE * pow(10.0::DOUBLE, gain_db / 20)))) AS v FROM g),
r AS (SELECT clip_id, gain_db, sqrt(list_sum(list_transform(v, lambda x: x * x)) / len(v)) AS rms FROM s)
SELECT clip_id, gain_db, round(rms, 6) AS rms, round(20 * log10(rms), 4) AS dbfs FROM r"""


def g15(spark, sf):
    return plain(feeds.comment_rollup(view(spark, sf, "v_comments")))


G15 = oracle("""SELECT note_id, count(*) FILTER (WHERE turn = 0) AS comments, count(*) FILTER (WHERE turn > 0) AS sub_comments, sum(try_cast(like_count AS BIGINT))::BIGINT AS likes,
  count(*) FILTER (WHERE try_cast(like_count AS BIGINT) IS NULL) AS bad_counts FROM v_comments GROUP BY note_id""", "v_comments")


def g16(spark, sf):
    """Profile payloads of every customer."""
    c = table(spark, sf, "customer")
    n = F.col("c_custkey")
    text = F.concat(
        F.lit('{"interactions":[{"type":"follows","count":"'), n % 90, F.lit('"},{"type":"fans","count":"'), F.when(n % 10 == 0, F.lit("1.2w")).otherwise((n % 70).cast("string")),
        F.lit('"}],"basicInfo":{"nickname":"'), "c_name", F.lit('"},"notes":[[{"id":"a"},{"id":"b"}],[],[{"id":"c"}]]}'),
    )
    return plain(feeds.profile_counts(feeds.profiles(c.select("c_custkey", text.alias("value")), "c_custkey"), "c_custkey"))


G16 = "SELECT c_custkey, c_custkey % 90 AS follows, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 70 END AS fans, NULL::BIGINT AS interaction, 3::BIGINT AS posts FROM customer"


def g17(spark, sf):
    return plain(feeds.counts(view(spark, sf, "v_feed")))


G17 = oracle("SELECT note_type, count(*) AS count FROM v_feed GROUP BY ROLLUP (note_type)", "v_feed")


HIT_WORDS = ["the", "of", "data", "ing"]


def g13_hits(spark, sf):
    """Turns as texts recognised at four gain levels."""
    texts = table(spark, sf, "conversations").select(((F.col("conv_id") + F.col("turn")) % 4 * 10 - 20).alias("gain_db"), "text")
    return plain(speech.hit_sweep(texts, HIT_WORDS))


G13_HITS = f"""SELECT ((conv_id + turn) % 4 * 10 - 20)::BIGINT AS gain_db,
  sum({" + ".join(f"CASE WHEN contains(text, '{w}') THEN 1 ELSE 0 END" for w in HIT_WORDS)})::BIGINT AS hits, (count(*) * {len(HIT_WORDS)})::BIGINT AS possible
FROM conversations GROUP BY 1"""


def _ingestions(spark, sf):
    """Ingestion logs: one line per document, some in the other spelling, some without a note path, some no JSON at all."""
    d = table(spark, sf, "documents").withColumn("k", F.col("doc_id") % 5)
    path = F.concat(F.lit("Notes/doc-"), F.col("doc_id").cast("string"), F.lit(".md"))
    snake = F.to_json(F.struct(path.alias("note_path"), F.lit("updated").alias("status"), F.col("source").alias("source_type"), F.array(F.lit("w"), F.lit("")).alias("warnings")))
    camel = F.to_json(F.struct(path.alias("notePath"), F.col("source").alias("sourceType"), F.col("lang").alias("title")))
    none = F.to_json(F.struct(F.lit("failed").alias("status"), F.col("source").alias("source_type")))
    return d.select(F.when(F.col("k") < 2, snake).when(F.col("k") == 2, camel).when(F.col("k") == 3, none).otherwise("{broken").alias("value"), "doc_id")


def p12(spark, sf):
    rows = semantic.ingestion_results(_ingestions(spark, sf)).select("note_path", "status", "source_type", "title", F.size("warnings").alias("warnings"), "error")
    return plain(rows)


P12 = """SELECT CASE WHEN k < 3 THEN 'Notes/doc-' || doc_id || '.md' END AS note_path, CASE WHEN k < 2 THEN 'updated' WHEN k = 3 THEN 'failed' ELSE 'created' END AS status,
  CASE WHEN k < 4 THEN source ELSE '' END AS source_type, CASE WHEN k < 2 THEN 'doc-' || doc_id WHEN k = 2 THEN lang END AS title,
  CASE WHEN k < 2 THEN 1 ELSE 0 END::BIGINT AS warnings, CASE WHEN k > 2 THEN 'invalid-response' END AS error FROM (SELECT *, doc_id % 5 AS k FROM documents) d"""


def p12_rollup(spark, sf):
    return plain(semantic.ingestion_rollup(semantic.ingestion_results(_ingestions(spark, sf))))


P12_ROLLUP = f"SELECT status, source_type, count(*) AS notes, sum(warnings)::BIGINT AS warnings FROM ({P12}) r GROUP BY 1, 2"


def w2(spark, sf):
    jobs = view(spark, sf, "v_watch_jobs")
    found = view(spark, sf, "v_polls").select("notebook_id", "artifact_id", "type", "status", "created_at")
    return plain(notebooks.latest_artifacts(jobs, found))


W2 = oracle("""WITH n AS (SELECT notebook_id, type, artifact_id, status FROM v_polls QUALIFY row_number() OVER (PARTITION BY notebook_id, type ORDER BY created_at DESC, artifact_id DESC, status DESC) = 1)
SELECT j.job_id, n.artifact_id AS found_id, n.status FROM v_watch_jobs j LEFT JOIN n ON n.notebook_id = j.notebook_id AND n.type = j.artifact_type""", "v_polls", "v_watch_jobs")


def c13(spark, sf):
    """Conversation turns as exported notes: some with literal line breaks, CRLF or an id in the text."""
    c = table(spark, sf, "conversations")
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    content = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  a\\nb\\tc "), flat)).when(
        F.col("turn") % 3 == 1, F.concat(F.lit("# Own\r\nConversation ID: 0123abcd-0000-1111-2222-333344445555\r\n"), flat)
    ).otherwise(F.concat(F.lit("x\ny\nz\\n"), flat))
    rows = c.select(
        F.col("role").alias("notebook_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.concat(F.lit("Talk: "), F.col("conv_id") % 9).alias("title"), content.alias("content")
    )
    return plain(notebooks.normalised_notes(rows).select("notebook_id", "ord", "name", "conversation_id", F.md5("content").alias("digest")))


C13 = r"""WITH c AS (SELECT role, conv_id * 100 + turn AS ord, 'Talk ' || (conv_id % 9) AS stem, turn % 3 AS k, rtrim(replace(text, chr(10), ' ')) AS flat FROM conversations),
t AS (SELECT *, CASE k WHEN 0 THEN '# ' || stem || chr(10) || chr(10) || 'a' || chr(10) || 'b' || chr(9) || 'c ' || flat
  WHEN 1 THEN '# Own' || chr(10) || 'Conversation ID: 0123abcd-0000-1111-2222-333344445555' || chr(10) || flat
  ELSE '# ' || stem || chr(10) || chr(10) || 'x' || chr(10) || 'y' || chr(10) || 'z\n' || flat END || chr(10) AS content,
  row_number() OVER (PARTITION BY role, stem ORDER BY ord) AS n FROM c)
SELECT role AS notebook_id, ord, stem || CASE WHEN n > 1 THEN '-' || n ELSE '' END || '.md' AS name,
  CASE WHEN k = 1 THEN '0123abcd-0000-1111-2222-333344445555' END AS conversation_id, md5(content) AS digest FROM t"""


def _asr(spark, sf):
    return view(spark, sf, "v_asr").withColumn("session", F.col("session").cast("string"))


def c16(spark, sf):
    return plain(speech.correct(_asr(spark, sf)).select("session", "turn", "n", "is_endpoint", "text"))


C16 = oracle("SELECT session::VARCHAR AS session, turn, n::BIGINT AS n, is_endpoint, replace(text, '在显价值', '在险价值') AS text FROM v_asr", "v_asr")


def r3(spark, sf):
    return plain(sessions.sentences(_asr(spark, sf)))


R3 = oracle(f"SELECT session::VARCHAR AS session, turn, n::BIGINT AS n, {TRIM('''replace(text, '在显价值', '在险价值')''')} AS text FROM v_asr WHERE is_endpoint", "v_asr")


def c17(spark, sf):
    c = table(spark, sf, "conversations")
    rows = c.select("conv_id", "turn", F.col("role").alias("selection"), F.lit("whole {{x}}").alias("file"), F.lit("2024-01-01").alias("date"), F.col("text").alias("transcript"))
    out = speech.render_prompts(rows, {"slot": "S:{{selection}} F:{{file:whole}} T:{{transcription}}", "plain": "On {{date}} {{selection}}{{selection}}"})
    return plain(out.select("conv_id", "turn", "template_id", F.md5("prompt").alias("digest")))


C17 = """SELECT conv_id, turn, 'slot' AS template_id, md5('S:' || role || ' F:whole {{x}} T:' || text) AS digest FROM conversations
UNION ALL SELECT conv_id, turn, 'plain', md5('On 2024-01-01 ' || role || role || chr(10) || chr(10) || '待整理的转录文本：' || chr(10) || text) FROM conversations"""


def e1(spark, sf):
    """Every vector asks."""
    v = table(spark, sf, "embeddings")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("own_id"), "embedding")
    return plain(semantic.nearest(v.select("vec_id", "embedding"), asked).select("query_id", "rank", "vec_id", F.round("score", 4).alias("score")))


E1 = """WITH s AS (SELECT q.vec_id::VARCHAR AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score
  FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.embedding IS NOT NULL AND v.embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, round(score, 4) AS score FROM r WHERE rank <= 20"""


def _levels(df, *more):
    return df.select(*more, F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.lit(8000).alias("n_samples"), (F.col("value") / 500).alias("rms"))


def r4(spark, sf):
    """The events file as a stream of half-second audio levels."""
    checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/r4-{uuid.uuid4().hex}"
    events = table(spark, sf, "events")
    last = events.groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("ended", F.lit(True))
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    levels = _levels(stream.join(last, ["user_id", "event_id"], "left"), "ended")
    return plain(sessions.run_available(sessions.silence_segments(levels), f"{base}/out", f"{base}/state"))


R4 = """WITH RECURSIVE e AS (
  SELECT user_id::VARCHAR AS session, event_id AS seq, value / 500 < 0.02 AS quiet, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k,
    count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (
  SELECT DISTINCT session, 0::BIGINT AS k, 0::BIGINT AS num, 0::BIGINT AS first_seq, 0::BIGINT AS last_seq, 0::BIGINT AS held, 0::BIGINT AS silence, 0::BIGINT AS pre,
    NULL::VARCHAR AS reason, 0::BIGINT AS samples, 0::BIGINT AS out_pre FROM e
  UNION ALL
  SELECT session, k, num + (reason IS NOT NULL)::BIGINT, first_seq, seq, CASE WHEN reason IS NULL THEN b ELSE 0 END, CASE WHEN reason IS NULL THEN q ELSE 0 END,
    CASE WHEN reason IS NULL THEN pre WHEN reason <> 'end' AND b > 3200 THEN 3200 ELSE 0 END, reason, b, CASE WHEN reason = 'end' THEN 0 ELSE pre END
  FROM (SELECT *, CASE WHEN q >= 800 AND b >= 40000 THEN 'silence' WHEN b >= 240000 THEN 'limit' WHEN k = n THEN 'end' END AS reason
    FROM (SELECT s.session, e.k, e.n, e.seq, s.num, s.pre, s.held + 8000 AS b, CASE WHEN e.quiet THEN s.silence + 500 ELSE 0 END AS q,
        CASE WHEN s.held = 0 THEN e.seq ELSE s.first_seq END AS first_seq
      FROM s JOIN e ON e.session = s.session AND e.k = s.k + 1) x) y)
SELECT session, num AS segment_no, first_seq, last_seq, samples, out_pre AS pre_roll, reason FROM s WHERE reason IS NOT NULL"""


def r5(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), "ts")
    return plain(sessions.auto_stop(e, 28 * 86400))


R5 = """WITH s AS (SELECT user_id AS session, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1)
SELECT session, strftime(a, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(a + INTERVAL 28 DAY, '%Y-%m-%d %H:%M:%S') AS stop_at, z >= a + INTERVAL 28 DAY AS stopped FROM s"""


def r5_stream(spark, sf):
    """The events file as a stream: sessions whose countdown ended before the event-time clock (a minute behind the last event)."""
    checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/r5-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    inputs = stream.select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"))
    return plain(sessions.run_available(sessions.auto_stop_stream(inputs, 28 * 86400), f"{base}/out", f"{base}/state"))


R5_STREAM = """WITH s AS (SELECT user_id::VARCHAR AS session, min(ts) + INTERVAL 28 DAY AS stop_at FROM events GROUP BY 1)
SELECT session, strftime(stop_at, '%Y-%m-%d %H:%M:%S') AS stop_at FROM s WHERE stop_at < (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE"""


def r6(spark, sf):
    polls = view(spark, sf, "v_polls").withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp")))
    states = artifacts.poll_states(view(spark, sf, "v_watch_jobs"), polls)
    failed = view(spark, sf, "v_watch_jobs").where("notebook_id = 'nb3'")
    return plain(artifacts.job_states(states, failed=failed))


R6 = oracle("""WITH p AS (SELECT *, date_trunc('day', ts) AS d FROM v_polls),
n AS (SELECT notebook_id, d, type, status FROM p QUALIFY row_number() OVER (PARTITION BY notebook_id, d, type ORDER BY created_at DESC, artifact_id DESC, status DESC) = 1),
s AS (SELECT j.job_id, x.d, CASE WHEN j.notebook_id = 'nb3' AND n.status = 'completed' THEN 'download_failed' ELSE coalesce(n.status, 'waiting') END AS status
  FROM v_watch_jobs j JOIN (SELECT DISTINCT notebook_id, d FROM p) x ON x.notebook_id = j.notebook_id
  LEFT JOIN n ON n.notebook_id = j.notebook_id AND n.d = x.d AND n.type = j.artifact_type),
f AS (SELECT job_id, min(d) FILTER (WHERE status = 'completed') AS c, arg_max(status, d) AS last, max(d) AS z FROM s GROUP BY 1)
SELECT job_id, CASE WHEN c IS NOT NULL THEN 'completed' ELSE last END AS status, strftime(coalesce(c, z), '%Y-%m-%d %H:%M:%S') AS updated_at FROM f""", "v_polls", "v_watch_jobs")



def r6_stream(spark, sf):
    """The polls of the events file as a stream; some outputs are there already, the downloads of one notebook fail."""
    checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/r6-{uuid.uuid4().hex}"
    events = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    polls = spark.sql(VIEWS["v_polls"].replace("FROM events", "FROM {events}"), events=events).withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp")))
    jobs = view(spark, sf, "v_watch_jobs")
    artifacts.track(polls, jobs, f"{base}/out", f"{base}/state", jobs.where("notebook_id = 'nb5'"), jobs.where("notebook_id = 'nb3'")).awaitTermination()
    return plain(artifacts.read_jobs(spark, f"{base}/out"))


R6_STREAM = R6.replace("WHEN c IS NOT NULL THEN 'completed'", "WHEN c IS NOT NULL OR job_id LIKE 'nb5-%' THEN 'completed'")

QUERIES = {
    "A9_feed_items": Query(a9, A9),
    "A10_vocabulary": Query(a10, A10),
    "A11_corrections": Query(a11, A11),
    "A9_feed_details": Query(a9_details, A9_DETAILS),
    "P6_feed_filter": Query(p6, P6),
    "P6_filter_options": Query(p6_options, P6_OPTIONS),
    "P7_access_status": Query(p7, P7),
    "P8_post_checks": Query(p8, P8),
    "P9_comment_sampling": Query(p9, P9),
    "P10_image_urls": Query(p10, P10),
    "P11_search_results": Query(p11, P11),
    "G11_vocabulary_words": Query(g11, G11),
    "G12_recall_summary": Query(g12, G12),
    "G12_recall_items": Query(lambda s, d: plain(speech.term_recall(_recall_rows(s, d))), G12_ITEMS),
    "G13_level_sweep": Query(g13, G13),
    "G13_hit_sweep": Query(g13_hits, G13_HITS),
    "P12_ingestion_results": Query(p12, P12),
    "P12_ingestion_rollup": Query(p12_rollup, P12_ROLLUP),
    "G15_comment_rollup": Query(g15, G15),
    "G16_profile_counts": Query(g16, G16),
    "G17_feed_counts": Query(g17, G17),
    "W2_latest_artifacts": Query(w2, W2),
    "C13_notebook_notes": Query(c13, C13),
    "C16_corrections": Query(c16, C16),
    "C17_prompts": Query(c17, C17),
    "E1_nearest_vectors": Query(e1, E1),
    "R3_sentences": Query(r3, R3),
    "R4_silence_segments": Query(r4, R4),
    "R5_auto_stop": Query(r5, R5),
    "R5_auto_stop_stream": Query(r5_stream, R5_STREAM),
    "R6_job_states": Query(r6, R6),
    "R6_job_stream": Query(r6_stream, R6_STREAM),
}
