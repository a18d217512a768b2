"""Shared pieces of the registered queries: plain output columns and oracle building blocks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...sources.views import view, with_views


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None


def plain(df: DataFrame, sep: str = "|") -> DataFrame:
    """Whole numbers as BIGINT, lists as joined text, times as text: the forms both engines print alike."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, sep)
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(field.name))
    return df.select(*out)


def on_view(name: str, job: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plain(job(view(spark, sf_dir, name)))


BODY = r"regexp_replace(content, '^\s*---\n[\s\S]*?\n---\n?', '')"
OPEN_BODY = rf"regexp_replace({BODY}, '```[\s\S]*?```', '', 'g')"
TRIM = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

LINES = """lines AS (
  SELECT path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no
  FROM v_notes)"""

TAGS = rf"""tags AS (
  SELECT path, ord, ext, pos, tag, lower(tag) AS tag_key FROM (
    SELECT path, ord, ext, unnest(list) AS tag, generate_subscripts(list, 1) AS pos FROM (
      SELECT path, ord, ext, list_concat(
        regexp_extract(content, '\ntags: (\[[^\n]*\])', 1)::JSON::VARCHAR[],
        list_filter(regexp_extract_all({OPEN_BODY}, '(?m)(?:^|\s)#([\p{{L}}\p{{N}}_/-]+)', 1), lambda t: regexp_matches(t, '[^0-9]'))) AS list
      FROM v_notes) a) b
  QUALIFY row_number() OVER (PARTITION BY path, lower(tag) ORDER BY pos) = 1)"""

KEYS = r"""keys AS (
  SELECT key, path AS target_path, basename AS target_basename FROM (
    SELECT lower(path) AS key, 0 AS stage, path, basename, ext, ord FROM v_notes
    UNION ALL SELECT regexp_replace(lower(path), '\.md$', ''), 0, path, basename, ext, ord FROM v_notes
    UNION ALL SELECT lower(basename), 1, path, basename, ext, ord FROM v_notes
    UNION ALL SELECT lower(name), 1, path, basename, ext, ord FROM v_notes
    UNION ALL SELECT 'alias-' || ord, 1, path, basename, ext, ord FROM v_notes) k
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY stage, (ext = 'excalidraw')::INT, ord) = 1)"""

_LINE = r"<<\{?([^:}]+)\}?:\{?(\d+)\}?(?:-\{?(\d+)\}?)?>>"
_RANGE = r"\(\(\(([^#)]+)#(\d+)(?:-(\d+))?\)\)\)"
_NATIVE = r"\[\[([^\]|#]+)#\^([A-Za-z0-9-]+)(?:\|([^\]]+))?\]\]"


def _every(source: str, pattern: str, *names: str) -> str:
    cols = ", ".join(f"unnest(regexp_extract_all(seg, '{pattern}', {i})) AS {n}" for i, n in enumerate(names))
    return f"SELECT path, ord, content, {cols} FROM {source}"


REFS = f"""segs AS (
  SELECT path, ord, content, unnest(string_split(content, '`')) AS seg, generate_subscripts(string_split(content, '`'), 1) AS i,
    len(string_split(content, '`')) AS n FROM v_notes),
open_segs AS (SELECT path, ord, content, seg FROM segs WHERE (n - i) % 2 = 0),
whole AS (SELECT path, ord, content, content AS seg FROM v_notes),
refs AS (
  SELECT path, ord, content, kind, raw, trim(target) AS target, try_cast(nullif(s, '') AS BIGINT) AS start_line, try_cast(nullif(e, '') AS BIGINT) AS end_line,
    block_id, alias, instr(content, raw) - 1 AS pos_start FROM (
    SELECT path, ord, content, 'line' AS kind, raw, target, s, e, NULL AS block_id, NULL AS alias FROM ({_every("open_segs", _LINE, "raw", "target", "s", "e")}) a
    UNION ALL SELECT path, ord, content, 'block', raw, target, s, e, NULL, NULL FROM ({_every("open_segs", _RANGE, "raw", "target", "s", "e")}) b
    UNION ALL SELECT path, ord, content, 'native-block', raw, target, NULL, NULL, bid, nullif(al, '') FROM ({_every("whole", _NATIVE, "raw", "target", "bid", "al")}) c) r)"""

LINKS = rf"""host_links AS (
    SELECT path, trim(unnest(regexp_extract_all({OPEN_BODY}, '\[\[([^\]\[|#\n]+)(#[^\]|\n]*)?(?:\|([^\]\n]+))?\]\]', 1))) AS target FROM v_notes),
links AS (
  SELECT DISTINCT path, target FROM (
    SELECT path, target FROM host_links
    UNION ALL SELECT path, target FROM refs WHERE kind <> 'native-block') l),
edges AS (SELECT DISTINCT l.path, k.target_path, k.target_basename FROM links l JOIN keys k ON k.key = lower(trim(l.target)))"""

ISLANDS = r"""marked AS (
  SELECT path, line_no, line,
    sum(CASE WHEN regexp_matches(line, '^\s*---\s*$') AND line_no > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed
  FROM lines),
kinds AS (
  SELECT path, line_no, line, CASE WHEN coalesce(closed, 0) = 0 OR NOT regexp_matches(line, '\S') THEN 0
    WHEN regexp_matches(line, '^\s*#{1,6}\s+|^\s*(?:[-*+]\s+|\d+\.\s+)|^\s*>|^\s*```') THEN 1 ELSE 2 END AS kind FROM marked),
starts AS (
  SELECT *, CASE WHEN kind = 1 OR (kind = 2 AND coalesce(lag(kind) OVER (PARTITION BY path ORDER BY line_no), 0) <> 2) THEN 1 ELSE 0 END AS s FROM kinds),
islands AS (
  SELECT path, paragraph_no, min(line_no) AS start_line, max(line_no) AS end_line, string_agg(line, chr(10) ORDER BY line_no) AS text FROM (
    SELECT *, sum(s) OVER (PARTITION BY path ORDER BY line_no) AS paragraph_no FROM starts) x
  WHERE kind > 0 GROUP BY path, paragraph_no)"""


def oracle(body: str, *views: str, using: tuple[str, ...] = ()) -> str:
    """Oracle SQL: view CTEs, building blocks, then the body (which may open with its own WITH)."""
    text = body.strip()
    parts = list(using)
    if text.upper().startswith("WITH "):
        parts.append(text[5:])
        return with_views("WITH " + ", ".join(parts), *views)
    return with_views(("WITH " + ", ".join(parts) + " " + text) if parts else text, *views)


__all__ = ["Query", "plain", "on_view", "oracle", "view", "BODY", "OPEN_BODY", "TRIM", "LINES", "TAGS", "KEYS", "REFS", "LINKS", "ISLANDS"]
