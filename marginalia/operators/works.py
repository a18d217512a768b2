"""Literature works: sources, keys, citations, rule tags, topic aggregates and rendered notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import fixed
from ..functions.text import clean_list, collapse, distinct_ci, first_filled, first_sentence, is_in, let, slug, topic_hash, trim_all
from .skew import top_k

TEXT = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def doi_id(value: Column) -> Column:
    bare = F.regexp_replace(trim_all(TEXT(value)), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.lower(trim_all(F.regexp_replace(bare, r"(?i)^doi:\s*", "")))


def arxiv_id(value: Column) -> Column:
    bare = F.regexp_replace(trim_all(TEXT(value)), r"(?i)^https?://arxiv\.org/(abs|pdf)/", "")
    return trim_all(F.regexp_replace(bare, r"(?i)\.pdf$", ""))


def leading_int(value: Column) -> Column:
    return F.regexp_extract(value.cast("string"), r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def citation_key(authors: Column, author: Column, year: Column, title: Column) -> Column:
    """``surname`` + year + first title word, ASCII; empty when nothing is known."""
    first = trim_all(F.coalesce(F.get(authors, F.lit(0)), author, F.lit("")))
    surname = F.regexp_extract(F.get(F.split(first, ","), F.lit(0)), r"(\S*)$", 1)

    def build(x: Column) -> Column:
        who = F.replace(slug(x["surname"]), F.lit("-"), F.lit(""))
        when = F.substring(F.regexp_replace(x["year"], "[^0-9]", ""), 1, 4)
        what = F.get(F.split(slug(x["title"]), "-"), F.lit(0))
        key = F.concat(
            F.when(who != "", who).otherwise("source"), F.when(when != "", when).otherwise("undated"),
            F.when(what != "", what).otherwise("source"),
        )
        return F.when((x["first"] == "") & (x["year"] == "") & (x["title"] == ""), F.lit("")).otherwise(key)

    return let(
        F.struct(first.alias("first"), surname.alias("surname"), trim_all(TEXT(year)).alias("year"), trim_all(TEXT(title)).alias("title")),
        build,
    )


def source_key(w: dict[str, Column]) -> Column:
    kind = F.when(trim_all(TEXT(w["source_type"])) != "", w["source_type"]).otherwise("source")
    title = F.when(trim_all(TEXT(w["title"])) != "", w["title"]).otherwise("paper")
    filled = lambda c: trim_all(TEXT(c)) != ""
    return (
        F.when(filled(w["doi"]), F.concat(F.lit("doi-"), slug(w["doi"])))
        .when(filled(w["arxiv_id"]), F.concat(F.lit("arxiv-"), slug(w["arxiv_id"])))
        .when(filled(w["source_id"]), F.concat(slug(kind), F.lit("-"), slug(w["source_id"])))
        .otherwise(F.concat(slug(kind), F.lit("-"), slug(title)))
    )


def key_of(df: DataFrame) -> Column:
    return source_key({c: F.col(c) for c in ("source_type", "title", "doi", "arxiv_id", "source_id")})


def note_path(key: Column, folder: str = fixed.LITERATURE_FOLDER) -> Column:
    return F.concat(F.lit(folder + "/"), key, F.lit(".md"))


# ------------------------------------------------------------------------------------------------------- sources

WORK_SCHEMA = (
    "id string, doi string, display_name string, title string, publication_year string, publication_date string, type string, "
    "cited_by_count string, citation_count string, referenced_works array<string>, related_works array<string>, "
    "concepts array<string>, counts_by_year array<struct<year:string,cited_by_count:string,works_count:string>>, "
    "authorships array<struct<author:struct<display_name:string>>>, ids struct<openalex:string,doi:string>, "
    "best_oa_location struct<pdf_url:string,landing_page_url:string,source:struct<display_name:string>>, "
    "primary_location struct<pdf_url:string,landing_page_url:string,source:struct<display_name:string>>, "
    "locations array<struct<pdf_url:string,landing_page_url:string,source:struct<display_name:string>>>, "
    "abstract_inverted_index map<string,array<int>>"
)


def _abstract(index: Column) -> Column:
    """Tokens put back at their positions."""
    placed = F.flatten(
        F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("t"))))
    )
    ordered = F.transform(F.array_sort(F.filter(placed, lambda x: x["p"].isNotNull())), lambda x: x["t"])
    return trim_all(F.coalesce(F.array_join(ordered, " "), F.lit("")))


def _concept(raw: Column) -> Column:
    named = first_filled(
        F.get_json_object(raw, "$.display_name"), F.get_json_object(raw, "$.concept.display_name"), F.get_json_object(raw, "$.id")
    )
    return F.when(raw.startswith("{"), F.coalesce(named, F.lit(""))).otherwise(raw)


def normalise_works(works: DataFrame) -> DataFrame:
    """A5: works in the common shape. ``works`` follows ``WORK_SCHEMA``; first-filled chains settle URLs and venue."""
    c = F.col
    authors = distinct_ci(F.transform("authorships", lambda a: a["author"]["display_name"]))
    doi = doi_id(first_filled(c("doi"), c("ids.doi")))
    title = F.coalesce(first_filled(c("display_name"), c("title")), F.lit(""))
    year = F.substring(trim_all(F.coalesce(first_filled(c("publication_year"), c("publication_date")), F.lit(""))), 1, 4)
    other = lambda f: F.get(F.filter(F.transform("locations", f), lambda v: F.length(trim_all(v)) > 0), F.lit(0))
    pdf = first_filled(c("best_oa_location.pdf_url"), c("primary_location.pdf_url"), other(lambda x: x["pdf_url"]))
    landing = first_filled(
        c("primary_location.landing_page_url"), c("best_oa_location.landing_page_url"), other(lambda x: x["landing_page_url"]),
        c("ids.openalex"),
    )
    venue = first_filled(
        c("primary_location.source.display_name"), c("best_oa_location.source.display_name"), other(lambda x: x["source"]["display_name"])
    )
    counts = F.filter(
        F.transform(
            F.coalesce(c("counts_by_year"), F.array().cast("array<struct<year:string,cited_by_count:string,works_count:string>>")),
            lambda x: F.struct(
                leading_int(x["year"]).cast("int").alias("year"),
                leading_int(F.coalesce(x["cited_by_count"], x["works_count"])).cast("int").alias("cited_by_count"),
            ),
        ),
        lambda x: x["year"].isNotNull() & x["cited_by_count"].isNotNull(),
    )
    base = works.select(
        F.inline(F.array(F.struct(
            doi.alias("doi"), title.alias("title"), authors.alias("authors"), year.alias("year"), pdf.alias("pdf_url"),
            landing.alias("landing"), F.coalesce(venue, F.lit("")).alias("source_display_name"),
            distinct_ci(c("referenced_works")).alias("referenced_works"), distinct_ci(c("related_works")).alias("related_works"),
            distinct_ci(F.transform("concepts", _concept)).alias("concepts"), counts.alias("counts_by_year"),
            F.coalesce(leading_int(F.coalesce("cited_by_count", "citation_count")), F.lit(0)).alias("cited_by_count"),
            _abstract(c("abstract_inverted_index")).alias("abstract"), trim_all(TEXT("publication_date")).alias("publication_date"),
            F.coalesce(first_filled(c("id"), c("ids.openalex")), F.lit("")).alias("openalex_id"), trim_all(TEXT("id")).alias("raw_id"),
            F.coalesce(first_filled(c("type")), F.lit("journal-article")).alias("entry_type"),
        ))),
    )
    url = F.coalesce(c("landing"), F.when(c("doi") != "", F.concat(F.lit("https://doi.org/"), c("doi"))))
    author = F.array_join("authors", ", ")
    return base.select(
        F.lit("doi").alias("source_type"), F.when(c("doi") != "", c("doi")).otherwise(c("raw_id")).alias("source_id"), "entry_type",
        "title", "authors", author.alias("author"), "year", F.when(c("doi") != "", c("doi")).alias("doi"),
        F.lit(None).cast("string").alias("arxiv_id"), "pdf_url", url.alias("source_url"), "abstract",
        citation_key(c("authors"), author, c("year"), c("title")).alias("citation_key"), "openalex_id", "cited_by_count",
        "referenced_works", F.size("referenced_works").cast("bigint").alias("referenced_works_count"), "related_works",
        F.size("related_works").cast("bigint").alias("related_works_count"), "concepts", "counts_by_year", "publication_date",
        F.coalesce(url, F.lit("")).alias("primary_location_url"), "source_display_name",
    )


def works_from_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """A5 from a column of JSON texts."""
    return normalise_works(rows.select(F.from_json(column, WORK_SCHEMA).alias("w")).select("w.*"))


def read_works(spark, path: str) -> DataFrame:
    """A5 from files of works, one JSON document or array per file."""
    return normalise_works(spark.read.schema(WORK_SCHEMA).option("multiLine", True).json(path))


def normalise_entries(entries: DataFrame) -> DataFrame:
    """Atom entries in the common shape; whole-record duplicates are removed."""
    c = F.col
    arxiv = arxiv_id(c("id"))
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    base = entries.select(
        collapse(trim_all(TEXT("title"))).alias("title"), collapse(trim_all(TEXT("summary"))).alias("summary"),
        distinct_ci(F.transform("author", lambda a: a["name"])).alias("authors"),
        F.substring(trim_all(TEXT("published")), 1, 4).alias("year"), arxiv.alias("arxiv_id"),
        doi_id(c("`arxiv:doi`")).alias("doi"), c("`arxiv:primary_category`._term").alias("primary_category"), trim_all(pdf).alias("pdf"),
    )
    author = F.array_join("authors", ", ")
    known = lambda v: F.when(v != "", v)
    return base.select(
        F.lit("arxiv").alias("source_type"), c("arxiv_id").alias("source_id"), F.lit("preprint").alias("entry_type"), "title", "authors",
        author.alias("author"), "year", known(c("arxiv_id")).alias("arxiv_id"), known(c("doi")).alias("doi"),
        F.coalesce(known(c("pdf")), F.when(c("arxiv_id") != "", F.concat(F.lit("https://arxiv.org/pdf/"), c("arxiv_id"), F.lit(".pdf")))).alias("pdf_url"),
        F.when(c("arxiv_id") != "", F.concat(F.lit("https://arxiv.org/abs/"), c("arxiv_id"))).alias("source_url"),
        known(c("summary")).alias("abstract"), "primary_category",
        citation_key(c("authors"), author, c("year"), c("title")).alias("citation_key"),
    ).dropDuplicates()


def entries_from_xml(rows: DataFrame, column: str = "value") -> DataFrame:
    """A6 from a column that holds one ``<entry>`` each."""
    return normalise_entries(rows.select(F.from_xml(column, entry_type()).alias("e")).select("e.*"))


def read_entries(spark, path: str) -> DataFrame:
    """A6 from Atom files."""
    return normalise_entries(spark.read.format("xml").option("rowTag", "entry").schema(entry_type()).load(path))


def entry_type() -> StructType:
    text = StringType()
    return StructType([
        StructField("title", text), StructField("summary", text), StructField("published", text), StructField("id", text),
        StructField("author", ArrayType(StructType([StructField("name", text)]))), StructField("arxiv:doi", text),
        StructField("arxiv:primary_category", StructType([StructField("_term", text)])),
        StructField("link", ArrayType(StructType([StructField("_title", text), StructField("_href", text)]))),
    ])


# ---------------------------------------------------------------------------------------------------- enrichment


def enrich_by_doi(entries: DataFrame, works: DataFrame) -> DataFrame:
    """DOI fields win, except the source id, URLs and citation key of the entry; without a match the entry stays."""
    w = works.select(
        "doi", *[F.col(c).alias(f"w_{c}") for c in (
            "entry_type", "title", "authors", "author", "year", "pdf_url", "source_url", "abstract", "citation_key", "openalex_id",
            "cited_by_count",
        )]
    )
    # an entry without a DOI gets a key of its own, which matches nothing: such entries may be most of the table
    own = F.concat(F.lit("\0"), F.xxhash64("source_id", "title").cast("string"))
    joined = entries.withColumn("_key", F.coalesce("doi", own)).join(w.withColumnRenamed("doi", "_key"), "_key", "left")
    hit = F.col("w_title").isNotNull()
    doi_wins = lambda c: F.when(hit, F.col(f"w_{c}")).otherwise(F.col(c)).alias(c)
    entry_wins = lambda c: first_filled(F.col(c), F.col(f"w_{c}")).alias(c)
    return joined.select(
        "source_type", "source_id", doi_wins("entry_type"), doi_wins("title"), doi_wins("authors"), doi_wins("author"),
        doi_wins("year"), "arxiv_id", "doi", entry_wins("pdf_url"), entry_wins("source_url"), doi_wins("abstract"),
        entry_wins("citation_key"), F.coalesce("w_openalex_id", F.lit("")).alias("openalex_id"),
        F.coalesce("w_cited_by_count", F.lit(0)).cast("bigint").alias("cited_by_count"), hit.alias("enriched"),
    )


def pdf_sources(requests: DataFrame, works: DataFrame, entries: DataFrame) -> DataFrame:
    """PDF requests (source, metadata_doi, metadata_arxiv, title, authors, year) filled from a DOI or, without one,
    an arXiv record; explicit values win over both, the file name is the last title."""
    c = F.col
    fields = ["title", "authors", "year", "entry_type", "citation_key", "abstract"]
    # explicit values would be ambiguous next to looked-up ones, so they get their own prefix
    q = requests.select(
        trim_all(c("source")).alias("source"), doi_id(c("metadata_doi")).alias("q_doi"), arxiv_id(c("metadata_arxiv")).alias("q_arxiv"),
        trim_all(TEXT("title")).alias("q_title"), distinct_ci(F.split(TEXT("authors"), ",")).alias("q_authors"), trim_all(TEXT("year")).alias("q_year"),
    ).where("source <> ''")
    by_doi = works.select(c("doi").alias("q_doi"), F.struct(*fields).alias("d"))
    by_arxiv = entries.select(c("arxiv_id").alias("q_arxiv"), F.struct(*fields).alias("a"))
    # a request without an id gets a key of its own, which matches nothing
    key_of = lambda k: F.when(c(k) != "", c(k)).otherwise(F.concat(F.lit("\0"), c("source")))
    keyed = q.withColumns({"_doi": key_of("q_doi"), "_arxiv": key_of("q_arxiv")})
    joined = keyed.join(by_doi.withColumnRenamed("q_doi", "_doi"), "_doi", "left").join(by_arxiv.withColumnRenamed("q_arxiv", "_arxiv"), "_arxiv", "left")
    found = F.when(c("q_doi") != "", c("d")).when(c("q_arxiv") != "", c("a"))
    stem = F.regexp_replace(F.regexp_extract("source", r"([^/]*)/*$", 1), r"\.[^.]+$", "")
    base = joined.select("*", found.alias("f"))
    is_url = c("source").rlike("(?i)^https?://")
    title = F.when(c("q_title") != "", c("q_title")).otherwise(F.coalesce("f.title", stem))
    authors = F.when(F.size("q_authors") > 0, c("q_authors")).otherwise(F.coalesce("f.authors", F.array().cast("array<string>")))
    year = F.when(c("q_year") != "", c("q_year")).otherwise(F.coalesce("f.year", F.lit("")))
    hit = c("f").isNotNull()
    merged = base.select(
        F.lit("pdf").alias("source_type"),
        F.when(hit & (c("q_doi") != ""), c("q_doi")).when(hit, c("q_arxiv")).otherwise(c("source")).alias("source_id"),
        F.coalesce("f.entry_type", F.lit("pdf-document")).alias("entry_type"), title.alias("title"), authors.alias("authors"), year.alias("year"),
        F.when(c("q_doi") != "", c("q_doi")).alias("doi"), F.when(c("q_arxiv") != "", c("q_arxiv")).alias("arxiv_id"),
        F.when(is_url, c("source")).alias("pdf_url"), c("f.citation_key").alias("found_key"), c("source"),
    )
    author = F.array_join("authors", ", ")
    key = F.coalesce(first_filled(c("found_key")), citation_key(c("authors"), author, c("year"), c("title")))
    return merged.select("source", "source_type", "source_id", "entry_type", "title", author.alias("author"), "year", "doi", "arxiv_id", "pdf_url", key.alias("citation_key"))


def deduplicate(works: DataFrame, latest: str) -> DataFrame:
    """One work per source key, the one with the highest ``latest``; a key that repeats very often is folded map-side."""
    keyed = works.withColumn("source_key", key_of(works)).withColumn("note_path", note_path(F.col("source_key")))
    keep = [c for c in keyed.columns if c != "source_key"]
    return keyed.groupBy("source_key").agg(
        F.max_by(F.struct(*keep), latest).alias("w"), F.count(F.lit(1)).alias("copies")
    ).select("source_key", "copies", "w.*")


# ---------------------------------------------------------------------------------------------------- projections


def _surname(author: Column) -> Column:
    return let(trim_all(author), lambda a: F.regexp_extract(a, r"(\S+)$", 1))


def parenthetical(authors: Column, year: Column) -> Column:
    """C11: ``(Smith, 2024)``, ``(Smith & Lee, 2024)``, ``(Smith et al., 2024)``; unknown author or ``n.d.`` when missing."""
    when = F.coalesce(first_filled(year), F.lit("n.d."))

    def build(names: Column) -> Column:
        n = F.size(names)
        who = (
            F.when(n == 0, F.lit("Unknown")).when(n == 1, F.get(names, F.lit(0)))
            .when(n == 2, F.concat(F.get(names, F.lit(0)), F.lit(" & "), F.get(names, F.lit(1))))
            .otherwise(F.concat(F.get(names, F.lit(0)), F.lit(" et al.")))
        )
        return F.concat(F.lit("("), who, F.lit(", "), when, F.lit(")"))

    return let(F.transform(clean_list(authors), _surname), build)


def citation_author(authors: Column, author: Column) -> Column:
    first = F.coalesce(F.get(clean_list(authors), F.lit(0)), first_filled(author))
    return F.coalesce(_surname(first), F.lit("Unknown"))


def concept_list(concepts: Column, limit: int) -> Column:
    joined = F.array_join(F.slice(distinct_ci(concepts), 1, limit), ", ")
    return let(joined, lambda t: F.when(t != "", t).otherwise("not available"))


def citation_trend(counts: Column, limit: int = 3) -> Column:
    usable = F.filter(counts, lambda x: x["year"].isNotNull() & x["cited_by_count"].isNotNull())
    text = F.array_join(F.transform(F.slice(usable, 1, limit), lambda x: F.concat_ws(":", x["year"], x["cited_by_count"])), ", ")
    return let(text, lambda t: F.when(t != "", t).otherwise("not available"))


def research_tags(topic: Column, title: Column, abstract: Column, concepts: Column) -> Column:
    """Rule tags of a work under a topic. The test for ``ai`` is a plain substring."""
    concept_text = F.array_join(F.slice(distinct_ci(concepts), 1, 8), " ")
    body = F.lower(F.concat_ws(" ", trim_all(TEXT(title)), trim_all(TEXT(abstract)), concept_text))

    def rules(x: Column) -> Column:
        low, text, both = x["low"], x["text"], x["both"]
        data = F.contains(low, F.lit("data governance")) | both.rlike("数据治理|governance")
        digital = F.contains(low, F.lit("digital transformation")) | both.rlike("数智转型|数字化转型|digital transformation|transformation")
        clever = F.contains(low, F.lit("intelligent")) | both.rlike("数智|智能|intelligent|ai|artificial intelligence")
        method = (
            F.when(text.rlike("case study|case-study"), "case-study")
            .when(text.rlike("empirical|experiment|survey|dataset"), "empirical").otherwise("conceptual")
        )
        tags = F.array(
            F.lit("literature-note"), F.when(data, "data-governance"), F.when(data, "governance-mechanism"),
            F.when(digital, "digital-transformation"), F.when(clever, "intelligent-transformation"),
            F.when(text.rlike("platform"), "platform-governance"),
            F.when(text.rlike("organiz|enterprise|firm"), "organizational-capability"),
            F.when(text.rlike("framework|model|mechanism"), "framework"), method,
        )
        return F.array_distinct(F.array_compact(tags))

    return let(
        F.struct(F.lower(trim_all(topic)).alias("low"), body.alias("text"), F.concat_ws(" ", topic, body).alias("both")), rules
    )


def tagged(items: DataFrame) -> DataFrame:
    """Topic items (topic, pos, work columns) with their rule tags."""
    return items.withColumn("tags", research_tags(F.col("topic"), F.col("title"), F.col("abstract"), F.col("concepts")))


def topical(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~is_in(t, fixed.NON_TOPIC_TAGS))


def literature_map(items: DataFrame) -> DataFrame:
    """Works under each of their analytical tags, with the order of the groups (first seen)."""
    rows = tagged(items).select("topic", "pos", "citation", F.posexplode("tags").alias("tag_pos", "tag"))
    rows = rows.where(F.col("tag").isin(*fixed.MAP_TAGS))
    seen = rows.groupBy("topic", "tag").agg(F.min(F.struct("pos", "tag_pos")).alias("first_seen"), F.count(F.lit(1)).alias("works"))
    return rows.drop("tag_pos").join(seen, ["topic", "tag"]).select(
        "topic", "tag", "works", F.col("first_seen.pos").alias("first_pos"), F.col("first_seen.tag_pos").alias("first_tag_pos"), "pos", "citation"
    )


def matrix_rows(items: DataFrame) -> DataFrame:
    """One comparison row per work."""
    method = F.get(F.filter("tags", lambda t: is_in(t, fixed.METHOD_TAGS)), F.lit(0))
    slash = lambda v: F.replace(v, F.lit("|"), F.lit("/"))
    return tagged(items).select(
        "topic", "pos", slash(F.col("title")).alias("title"), TEXT("year").alias("year"),
        F.coalesce(method, F.lit("conceptual")).alias("method"), "cited_by_count", slash(concept_list(F.col("concepts"), 3)).alias("concepts"),
        slash(first_sentence(F.col("abstract"))).alias("contribution"),
        F.array_join(F.filter("tags", lambda t: t != "literature-note"), ", ").alias("tags"),
    )


def topic_tags(items: DataFrame) -> DataFrame:
    """Distinct topical tags per topic. At most a dozen different tags exist, so the set stays small."""
    own = topical(research_tags(F.col("topic"), F.col("topic"), F.lit(""), F.array().cast("array<string>")))
    rows = tagged(items).select(
        "topic", F.explode(F.array_distinct(F.concat(F.array(F.lit("topic-note")), own, topical(F.col("tags"))))).alias("tag")
    )
    return rows.distinct()


def citation_statistics(works: DataFrame) -> DataFrame:
    """G9 per work: counts (explicit ones win over list sizes), top concepts, recent trend."""
    explicit = lambda c, lst: F.coalesce(leading_int(F.col(c)), F.size(F.col(lst)).cast("bigint"), F.lit(0))
    return works.select(
        "source_id", F.coalesce(leading_int(F.col("cited_by_count")), F.lit(0)).alias("cited_by_count"),
        explicit("referenced_works_count", "referenced_works").alias("reference_count"),
        explicit("related_works_count", "related_works").alias("related_count"), concept_list(F.col("concepts"), 4).alias("concepts"),
        citation_trend(F.col("counts_by_year")).alias("trend"),
    )


def topic_statistics(items: DataFrame) -> DataFrame:
    """G9 per topic."""
    return items.groupBy("topic").agg(
        F.count(F.lit(1)).alias("works"), F.sum("cited_by_count").alias("cited_by_total"), F.max("cited_by_count").alias("cited_by_max"),
        F.round(F.avg("cited_by_count"), 4).alias("cited_by_avg"),
    )


def top_cited(items: DataFrame, k: int = 2) -> DataFrame:
    """Most cited works per topic, earlier position first on ties."""
    return top_k(items, ["topic"], [F.desc("cited_by_count"), F.asc("pos")], k)


def capped_sources(items: DataFrame, k: int = 3) -> DataFrame:
    """T4: the first ``k`` sources of a topic in list order."""
    return top_k(items, ["topic"], [F.asc("pos")], max(1, k))


def topic_slug(topic: Column) -> Column:
    plain = slug(topic)
    return (
        F.when(trim_all(topic) == "", "topic").when((plain != "item") | topic.rlike("(?i)[a-z0-9]"), plain)
        .otherwise(F.concat(F.lit("topic-"), topic_hash(trim_all(topic))))
    )


# ------------------------------------------------------------------------------------------------------ rendering


def _json(value: Column) -> Column:
    """One text as JSON, slashes and CJK as they are."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def literature_notes(works: DataFrame, imported_at: str, folder: str = fixed.LITERATURE_FOLDER) -> DataFrame:
    """K1: rendered note per work as (source_key, path, content). Empty lines are dropped, as in the source format."""
    c = F.col
    keyed = works.withColumn("source_key", key_of(works))
    text = lambda name: trim_all(TEXT(name))
    number = lambda name: F.coalesce(c(name), F.lit(0)).cast("string")
    none = F.array().cast("array<string>")
    front = [
        ("title", _json(F.when(text("title") != "", text("title")).otherwise("Untitled source"))), ("authors", F.to_json(distinct_ci(c("authors")))),
        ("author", _json(text("author"))), ("year", _json(text("year"))), ("source_id", _json(text("source_id"))),
        ("source_type", _json(text("source_type"))), ("entry_type", _json(text("entry_type"))), ("citekey", _json(text("citation_key"))),
        ("doi", _json(text("doi"))), ("arxiv_id", _json(text("arxiv_id"))), ("openalex_id", _json(text("openalex_id"))),
        ("cited_by_count", number("cited_by_count")), ("referenced_works", F.to_json(F.coalesce(c("referenced_works"), none))),
        ("referenced_works_count", number("referenced_works_count")), ("related_works", F.to_json(F.coalesce(c("related_works"), none))),
        ("related_works_count", number("related_works_count")), ("concepts", F.to_json(F.coalesce(c("concepts"), none))),
        ("counts_by_year", F.coalesce(F.to_json(c("counts_by_year")), F.lit("[]"))), ("publication_date", _json(text("publication_date"))),
        ("primary_location_url", _json(text("primary_location_url"))), ("source_display_name", _json(text("source_display_name"))),
        ("pdf", F.lit('""')), ("pdf_url", _json(text("pdf_url"))), ("source_url", _json(text("source_url"))), ("imported_at", F.lit(f'"{imported_at}"')),
    ]
    line = lambda label, name: F.when(text(name) != "", F.concat(F.lit(f"- {label}: "), text(name)))
    filled = lambda name, default: F.when(text(name) != "", text(name)).otherwise(default)
    concepts = F.array_join(distinct_ci(c("concepts")), ", ")
    trend = citation_trend(c("counts_by_year"), 5)
    body = [
        F.lit("---"), *[F.concat(F.lit(f"{k}: "), v) for k, v in front], F.lit("tags:"), F.lit("  - literature-note"), F.lit("---"),
        F.concat(F.lit("# "), filled("title", "Untitled source")), F.lit("## Source"),
        F.concat(F.lit("- Source ID: "), filled("source_id", "not-set")), F.concat(F.lit("- Source type: "), filled("source_type", "unknown")),
        F.concat(F.lit("- Entry type: "), filled("entry_type", "unknown")), line("DOI", "doi"), line("arXiv", "arxiv_id"),
        line("OpenAlex", "openalex_id"), line("Landing page", "source_url"), F.coalesce(line("PDF URL", "pdf_url"), F.lit("- PDF: Not attached")),
        F.lit("## Citation context"), F.concat(F.lit("- Cited by: "), number("cited_by_count")),
        F.concat(F.lit("- Referenced works tracked: "), number("referenced_works_count")),
        F.concat(F.lit("- Related works tracked: "), number("related_works_count")),
        F.concat(F.lit("- OpenAlex concepts: "), F.when(F.coalesce(concepts, F.lit("")) != "", concepts).otherwise("not available")),
        F.concat(F.lit("- Recent citation counts: "), F.coalesce(trend, F.lit("not available"))),
        F.lit("## Abstract"), filled("abstract", "No abstract captured."), F.lit("## Notes"), F.lit("## Exact references"),
        F.lit("## Relations"), F.lit("## Tags"),
    ]
    return keyed.select("source_key", note_path(c("source_key"), folder).alias("path"), F.concat_ws("\n", *body).alias("content"))
