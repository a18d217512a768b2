"""HTML pages to Markdown as a token plan: tokens, running depths, blocks, ordered text."""

from __future__ import annotations

import html as html_text
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fixed
from ..functions.paths import name_of, stem_of, suffix_of
from ..functions.text import collapse, let, safe_filename, trim_all
from .migrate import import_links, settled_names
from .settle import settle

DROPPED = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>|<\?.*?\?>"
TOKEN = r"(?s)<[A-Za-z/][^>]*>|[^<]+|<"
BLOCKS = (
    "html body div section article main header footer nav aside figure figcaption p h1 h2 h3 h4 h5 h6 ul ol li blockquote pre table thead "
    "tbody tr td th hr label"
).split()
HEADINGS = ["h1", "h2", "h3", "h4", "h5", "h6"]
PAGE_CHARS = 4_000_000  # characters of HTML dealt to one task, which sorts their tokens


# executors need no copy of this package: its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Named and numeric character references."""
    return text.map(html_text.unescape, na_action="ignore")


def plain(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(" "))


def attribute(tag: Column, name: str) -> Column:
    double = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*\"([^\"]*)\"", 1)
    single = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s\"'>]+)", 1)
    return F.when(double != "", double).when(single != "", single).otherwise(bare)


def language_of(class_name: Column) -> Column:
    """Code language from ``language-…``; editor prefixes and suffixes are cut."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(class_name, "^language-", ""), "^application-", ""), "^text-x-", "")
    bare = F.regexp_replace(bare, "-env-frontend$", "")
    return F.when(~class_name.startswith("language-"), "").when(bare.rlike("-auto$"), "text").otherwise(bare)


def page_titles(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Text of ``<title>``, else a safe name of the file."""
    raw = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    name = safe_filename(stem_of(name_of(F.col("path"))), "Untitled Note", 200)
    return pages.select(key, "path", unescape(raw).alias("t"), name.alias("fallback")).select(
        key, F.when(trim_all(F.col("t")) != "", trim_all(F.col("t"))).otherwise(F.col("fallback")).alias("title")
    )


def page_parts(pages: DataFrame) -> int:
    """Number of tasks the pages are dealt to: more pages make more tasks, not larger ones."""
    size = pages.agg(F.sum(F.length("html"))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // PAGE_CHARS))


def tokens(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per tag or text. The content root is ``div.ck-content`` when the page has one, else the whole tree."""
    clean = F.regexp_replace("html", DROPPED, "")
    clean = F.regexp_replace(clean, r"(?is)<title[^>]*>.*?</title>", "")
    clean = F.regexp_replace(clean, r"(?i)<hr\b[^>]*>", "<hr></hr>")
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(clean, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    tag = F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    rows = rows.withColumns({"tag": tag, "closing": F.col("token").startswith("</")})
    rows = rows.withColumn("css", F.when((F.col("tag") != "") & ~F.col("closing"), attribute(F.col("token"), "class")).otherwise(""))
    order = Window.partitionBy(key).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    is_root = (F.col("tag") == "div") & ~F.col("closing") & F.array_contains(F.split("css", r"\s+"), "ck-content")
    divs = F.sum(F.when(F.col("tag") != "div", 0).when(F.col("closing"), -1).otherwise(1)).over(so_far)
    rows = rows.withColumns({"divs": divs, "root_pos": F.min(F.when(is_root, F.col("pos"))).over(whole)})
    rows = rows.withColumn("root_depth", F.min(F.when(F.col("pos") == F.col("root_pos"), F.col("divs"))).over(whole))
    rows = rows.withColumn(
        "root_end", F.min(F.when((F.col("pos") > F.col("root_pos")) & (F.col("divs") < F.col("root_depth")), F.col("pos"))).over(whole)
    )
    inside = F.col("root_pos").isNull() | ((F.col("pos") > F.col("root_pos")) & (F.col("pos") < F.coalesce("root_end", F.lit(2_000_000_000))))
    return rows.where(inside).select(key, "pos", "token", "tag", "closing", "css")


def blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Text blocks of every page with their place in lists, quotes and tables."""
    t = tokens(pages, key)
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    tag, closing = F.col("tag"), F.col("closing")
    depth = lambda *names: F.sum(F.when(~tag.isin(*names), 0).when(closing, -1).otherwise(1)).over(so_far)
    opened = lambda *names: F.max(F.when(tag.isin(*names) & ~closing, F.col("pos"))).over(so_far)
    is_block = tag.isin(*BLOCKS)
    t = t.withColumns({
        "list_depth": F.greatest(depth("ul", "ol"), F.lit(0)), "quote_depth": F.greatest(depth("blockquote"), F.lit(0)),
        "in_pre": depth("pre") > 0, "table_depth": depth("table"), "block": F.sum(is_block.cast("int")).over(so_far),
        "table_pos": opened("table"), "row_pos": opened("tr"), "cell_pos": opened("td", "th"), "item_pos": opened("li"),
    })
    # the list an item belongs to is the last list opened at the same depth
    by_depth = Window.partitionBy(key, "list_depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_list = tag.isin("ul", "ol") & ~closing
    t = t.withColumn("list_info", F.max(F.when(is_list, F.struct("pos", "tag", "css"))).over(by_depth))
    in_list = Window.partitionBy(key, "list_depth", F.col("list_info.pos")).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_item = (tag == "li") & ~closing
    t = t.withColumn("item_no", F.sum(is_item.cast("int")).over(in_list))
    last = lambda c, cond: F.last(F.when(cond, c), ignorenulls=True).over(so_far)
    checked = (tag == "input") & (attribute(F.col("token"), "checked") == "checked")
    t = t.withColumns({
        "item": last(F.struct("list_depth", "list_info", "item_no", "pos"), is_item),
        "checked_pos": F.max(F.when(checked, F.col("pos"))).over(so_far),
        "href": F.last(F.when((tag == "a") & ~closing, attribute(F.col("token"), "href")), ignorenulls=True).over(so_far),
        # the outermost list and quote tell which neighbours stay close together
        "outer_list": F.max(F.when(is_list & (F.col("list_depth") == 1), F.col("pos"))).over(so_far),
        "outer_quote": F.max(F.when((tag == "blockquote") & ~closing & (F.col("quote_depth") == 1), F.col("pos"))).over(so_far),
        "code_css": F.last(F.when(tag.isin("pre", "code") & ~closing, F.col("css")), ignorenulls=True).over(so_far),
    })
    raw = F.col("token")
    text = F.when(tag != "", F.lit("")).when(F.col("in_pre"), raw).otherwise(collapse(plain(raw)))
    alt, src = attribute(raw, "alt"), trim_all(attribute(raw, "src"))
    mark = (
        F.when(tag == "", text)
        .when(tag == "br", "\n").when((tag == "img") & (src != ""), F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")")))
        .when(F.col("in_pre"), "")
        .when(tag == "strong", "**").when(tag == "em", "*").when(tag == "code", "`")
        .when(tag == "u", F.when(closing, "</u>").otherwise("<u>"))
        .when((tag == "a") & ~closing & (F.col("href") != ""), "[")
        .when((tag == "a") & closing & (F.col("href") != ""), F.concat(F.lit("]("), trim_all(F.col("href")), F.lit(")")))
        .when((tag == "hr") & ~closing, "---")
        .otherwise("")
    )
    t = t.withColumn("mark", mark)
    grouped = t.groupBy(key, "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mark"))), lambda x: x["mark"]), "").alias("raw"),
        F.min(F.struct("pos", "tag", "closing", "list_depth", "quote_depth", "in_pre", "table_depth", "table_pos", "row_pos", "cell_pos", "item", "outer_list", "outer_quote")).alias("b"),
        F.max("checked_pos").alias("checked_pos"), F.max_by("code_css", "pos").alias("code_css"),
    )
    return grouped.select(key, "block", unescape("raw").alias("raw"), "b.*", "checked_pos", "code_css")


def _spacing(text: Column) -> Column:
    tight = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(tight, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def _tables(rows: DataFrame, key: str) -> DataFrame:
    """Table blocks folded to one Markdown table each: cells, rows padded to the widest, header rule."""
    cells = rows.where(F.col("table_depth") > 0).where("cell_pos > row_pos and row_pos >= table_pos")
    cell = cells.groupBy(key, "table_pos", "row_pos", "cell_pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), " ").alias("text")
    ).withColumn("text", F.replace(trim_all(F.col("text")), F.lit("\n"), F.lit("<br>")))
    cell = cell.withColumn("text", F.when(F.col("text") == "", " ").otherwise(F.col("text")))
    row = cell.groupBy(key, "table_pos", "row_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell_pos", "text"))), lambda x: x["text"]).alias("cells")
    )
    table = row.groupBy(key, "table_pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row_pos", "cells"))), lambda x: x["cells"]).alias("rows"), F.max(F.size("cells")).alias("width")
    )
    line = lambda c: F.concat(F.lit("| "), F.array_join(F.concat(c, F.array_repeat(F.lit(" "), F.col("width") - F.size(c))), " | "), F.lit(" |"))
    lines = F.transform("rows", line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    text = F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")
    return table.select(key, F.col("table_pos").alias("pos"), text.alias("text"), F.lit("table").alias("kind"), F.lit(0).cast("bigint").alias("quote_depth"),
                        F.lit(None).cast("int").alias("outer_list"), F.lit(None).cast("int").alias("outer_quote"))


def markdown(pages: DataFrame, key: str = "page_id", parts: int | None = None) -> DataFrame:
    """(key, markdown) for every page, without the title line. A page's tokens are one window group; pages are rows.

    Whole pages are dealt to ``parts`` tasks (``page_parts``), so tokens are made where they are numbered and never shuffled. What meets
    their text is dealt alike, else a join moves the text to as few tasks as adaptive execution leaves.
    """
    parts = parts or page_parts(pages)
    b = settle(blocks(pages.select(key, "html").repartition(parts, key), key)).repartition(parts, key)
    with_cells = b.withColumn("body", trim_all(_spacing(F.col("raw"))))
    body = F.when(F.col("in_pre"), trim_all(F.col("raw"))).otherwise(trim_all(_spacing(F.col("raw"))))
    b = b.withColumn("body", body)
    level = F.when(F.col("tag").isin(*HEADINGS) & ~F.col("closing"), F.substring("tag", 2, 1).cast("int"))
    item = F.col("item")
    in_item = (F.col("list_depth") > 0) & item.isNotNull()
    # the first filled block of an item carries the marker, later ones are indented below it
    first_in_item = F.row_number().over(Window.partitionBy(key, item["pos"], in_item).orderBy("pos")) == 1
    b = b.where((F.col("body") != "") & ~(F.col("table_depth") > 0)).withColumns({"level": level, "in_item": in_item, "first_in_item": first_in_item})
    indent = F.repeat(F.lit("  "), F.greatest(item["list_depth"] - 1, F.lit(0)))
    todo = F.contains(item["list_info"]["css"], F.lit("todo-list"))
    is_checked = F.col("checked_pos") > item["pos"]
    marker = (
        F.when(todo & F.coalesce(is_checked, F.lit(False)), "- [x] ").when(todo, "- [ ] ")
        .when(item["list_info"]["tag"] == "ol", F.concat(item["item_no"].cast("string"), F.lit(". "))).otherwise("- ")
    )
    language = language_of(F.coalesce("code_css", F.lit("")))
    text = (
        F.when(F.col("in_pre"), F.concat(F.lit("```"), language, F.lit("\n"), F.col("body"), F.lit("\n```")))
        .when(F.col("in_item") & F.col("first_in_item"), F.concat(indent, marker, F.col("body")))
        .when(F.col("in_item"), F.concat(indent, F.lit("  "), F.col("body")))
        .when(F.col("level").isNotNull(), F.concat(F.expr("repeat('#', level)"), F.lit(" "), F.col("body")))
        .otherwise(F.col("body"))
    )
    kind = F.when(F.col("in_item") & ~F.col("in_pre"), "item").otherwise("block")
    rows = b.select(key, "pos", text.alias("text"), kind.alias("kind"), "quote_depth", "outer_list", "outer_quote")
    rows = rows.unionByName(_tables(with_cells, key))
    quoted = F.array_join(F.transform(F.split("text", "\n"), lambda x: F.when(x == "", ">").otherwise(F.concat(F.lit("> "), x))), "\n")
    rows = rows.withColumn("text", F.when(F.col("quote_depth") > 0, quoted).otherwise(F.col("text")))
    lists = rows.repartition(parts, key).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", "text", "kind", "quote_depth", "outer_list", "outer_quote"))).alias("x")
    )

    def gap(r: Column, p: Column) -> Column:
        same_list = (r["kind"] == "item") & (p["kind"] == "item") & (r["outer_list"] == p["outer_list"])
        same_quote = (r["quote_depth"] > 0) & (p["quote_depth"] > 0) & (r["outer_quote"] == p["outer_quote"])
        return F.when(same_list, "\n").when(same_quote, "\n>\n").otherwise("\n\n")

    joined = F.array_join(
        F.transform("x", lambda r, i: F.concat(F.when(i == 0, "").otherwise(gap(r, F.get("x", F.greatest(i - 1, F.lit(0))))), r["text"])), ""
    )
    return pages.select(key).repartition(parts, key).join(lists, key, "left").select(key, F.coalesce(joined, F.lit("")).alias("markdown"))


def convert_pages(pages: DataFrame, key: str = "page_id", parts: int | None = None) -> DataFrame:
    """(key, title, markdown) with the title line in front unless the body starts with it. Dealt by ``key`` to ``parts`` tasks,
    or as many as ``page_parts`` tells."""
    parts = parts or page_parts(pages)
    both = markdown(pages, key, parts).join(page_titles(pages, key).repartition(parts, key), key)
    head = F.concat(F.lit("# "), "title")
    full = F.when(F.col("markdown").startswith(head), F.col("markdown")).when(F.col("markdown") == "", head).otherwise(
        F.concat(head, F.lit("\n\n"), "markdown")
    )
    return both.select(key, "title", full.alias("markdown"))


# --------------------------------------------------------------------------------------------------------- full import


def path_map(files: DataFrame) -> DataFrame:
    """New path of every exported file: safe parts, ``.html`` becomes ``.md``. Equal results are numbered."""
    parts = F.transform(F.split("path", "/"), lambda p: safe_filename(p))
    safe = F.array_join(parts, "/")
    rows = files.select("ord", "path", F.explode(F.array(safe)).alias("safe"))
    name = name_of(F.col("safe"))
    rows = rows.select(
        "ord", "path", F.regexp_replace("safe", r"/?[^/]*$", "").alias("dir"), stem_of(name).alias("stem"),
        F.when(F.lower(suffix_of(name)) == ".html", ".md").otherwise(suffix_of(name)).alias("suffix"),
    )
    return settled_names(rows).select(
        "ord", F.col("path").alias("old_path"), F.when(F.col("dir") == "", F.col("name")).otherwise(F.concat_ws("/", "dir", "name")).alias("new_path")
    )


def import_pages(files: DataFrame, exported_at: str) -> DataFrame:
    """C14: converted notes of an HTML export as (old_path, new_path, content). Navigation pages are skipped.

    ``files``: (ord, path, html).
    """
    mapped = path_map(files)
    wanted = files.where(F.lower("path").endswith(".html") & ~name_of(F.col("path")).isin(*fixed.SKIPPED_IMPORT_PAGES)).withColumnRenamed("ord", "page_id")
    parts = page_parts(wanted)
    named = mapped.select(F.col("ord").alias("page_id"), F.col("old_path").alias("path"), "new_path").repartition(parts, "page_id")
    rows = convert_pages(wanted, parts=parts).join(named, "page_id").select("page_id", "path", "new_path", F.col("markdown").alias("content"))
    linked = import_links(rows, mapped, "page_id", parts)
    head = F.concat(
        F.lit('---\nimported_from: "html-export"\nsource_html: '), F.substring(F.to_json(F.array("path")), F.lit(2), F.length(F.to_json(F.array("path"))) - 2),
        F.lit(f'\nexported_at: "{exported_at}"\n---\n'),
    )
    body = let(F.regexp_replace("content", r"(?U)\s+$", ""), lambda c: F.concat(c, F.lit("\n")))
    return linked.select(F.col("path").alias("old_path"), "new_path", F.concat(head, body).alias("content"))
