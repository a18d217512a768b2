"""Registered queries of this subpackage: every operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dialogue, merkle, pieces, pii, quality, revisits, secrets, simhash, substrings, suffixtree, topk, urlfilter


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"), 35)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, budget=3, seed=42)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(_table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 13)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(_table(spark, sf_dir, "pages")))
    entries = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select("record_id", "url", day("date").alias("date"), "refers_to", day("refers_to_date").alias("refers_to_date"), "outcome", F.array_join(entries, "; ").alias("headers"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), 3))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), "score",
        F.size("others").cast("long").alias("n_others"), F.try_element_at("others.score", F.lit(1)).alias("second_score"),
        F.try_element_at("others.score", F.lit(2)).alias("third_score"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same_text"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(_table(spark, sf_dir, "documents"), pii.session_key(spark, pii.INVENTED)).select("doc_id", "n_entities", "text")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(secrets.find(_table(spark, sf_dir, "documents")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"), merkle.lowered_third(), arity=8)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair_damaged(_table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT r, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
repeated AS (SELECT h FROM starts GROUP BY h HAVING count(*) > 1),
gone AS (SELECT r, list(i ORDER BY i) AS places FROM starts JOIN repeated USING (h) GROUP BY r),
covered AS (SELECT r, list(DISTINCT p) AS p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM (SELECT r, unnest(places) AS i FROM gone)) GROUP BY r),
kept AS (SELECT words.r, list(word ORDER BY i) AS k FROM (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words) words
  LEFT JOIN (SELECT r, unnest(p) AS p FROM covered) c ON c.r = words.r AND c.p = words.i WHERE c.p IS NULL GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(len(k), 0))::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM words LEFT JOIN kept USING (r)"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5"""

_OP5_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_OP5_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_OP5_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS t FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t FROM (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT r, i, n, item FROM dw JOIN bw USING (n, t)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""

OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT *, row_number() OVER () AS r, CASE WHEN doc_id IS NOT NULL AND (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 3) = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS told FROM documents),
f AS (SELECT r, doc_id, lang, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head, coalesce(strlen(text) || ':' || text, '-') AS own, coalesce(strlen(told) || ':' || told, '-') AS told FROM d),
leaves AS (SELECT r, doc_id, sha256(head || own) AS leaf, sha256(head || told) AS claimed, 1 + (dense_rank() OVER (ORDER BY lang NULLS FIRST))::BIGINT AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || own)) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM f),
lv(tree, level, i, n, digest) AS (SELECT tree, 0, i, n, leaf FROM leaves UNION ALL
    SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY tree, level, i // 8, n),
tops AS (SELECT tree, level, digest, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
up(level, i, n, digest) AS (SELECT 0, i, n, digest FROM tops UNION ALL
    SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY level, i // 8, n),
kids AS (SELECT tree, level, i // 8 AS p, list(digest ORDER BY i) AS kids FROM lv WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT 0, level, i // 8, list(digest ORDER BY i) FROM up WHERE n > 1 GROUP BY ALL),
climb(r, tree, level, i, folded, proof) AS (SELECT r, tree, 0, i, claimed, '' FROM leaves UNION ALL
    SELECT c.r, c.tree, c.level + 1, c.i // 8, sha256(array_to_string(kids[:c.i % 8] || [folded] || kids[c.i % 8 + 2:], '')), proof || array_to_string(kids[:c.i % 8] || kids[c.i % 8 + 2:], '')
    FROM climb c JOIN kids k ON k.tree = c.tree AND k.level = c.level AND k.p = c.i // 8),
crown(r, level, i, folded, proof) AS (SELECT c.r, 0, t.i, folded, proof FROM climb c JOIN tops t USING (tree, level) UNION ALL
    SELECT c.r, c.level + 1, c.i // 8, sha256(array_to_string(kids[:c.i % 8] || [folded] || kids[c.i % 8 + 2:], '')), proof || array_to_string(kids[:c.i % 8] || kids[c.i % 8 + 2:], '')
    FROM crown c JOIN kids k ON k.tree = 0 AND k.level = c.level AND k.p = c.i // 8)
SELECT doc_id, leaf, t.digest AS subroot, u.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.digest AS verified
FROM leaves JOIN tops t USING (tree) JOIN (SELECT r, folded, proof, level FROM crown) c USING (r) JOIN (SELECT level, digest FROM up WHERE n = 1) u ON u.level = c.level"""

ALL = {
    "op1_substring_dedup": Query(op1, OP1_SQL),
    "op2_simhash": Query(op2),
    "op3_top_k": Query(op3, OP3_SQL),
    "op4_suffix_tree": Query(op4),
    "op5_decontamination": Query(op5, OP5_SQL),
    "op6_revisits": Query(op6),
    "op7_url_filter": Query(op7),
    "op8_sentencepiece": Query(op8),
    "op9_pii": Query(op9),
    "op10_quality": Query(op10),
    "op11_secret_scan": Query(op11),
    "op12_merkle": Query(op12, OP12_SQL),
    "op13_conversation_repair": Query(op13),
}
