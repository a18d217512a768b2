from pyspark.sql import functions as F

from marginalia.operators import works as W
from marginalia.plans import workspace
from marginalia.sources import dims

WORK = """{"id":"https://openalex.org/W1","doi":"https://doi.org/10.1145/123456.7890","display_name":"Coffee ratios","publication_year":2024,"type":"article",
"cited_by_count":12,"referenced_works":["a","b","A"],"related_works":["c"],"concepts":[{"display_name":"X"},"Y"],"counts_by_year":[{"year":2024,"cited_by_count":7},{"year":null}],
"authorships":[{"author":{"display_name":"Jane Smith"}},{"author":{"display_name":"Bo Lee"}}],"best_oa_location":{"pdf_url":"http://p.pdf"},
"primary_location":{"landing_page_url":"http://l","source":{"display_name":"Venue"}},"abstract_inverted_index":{"Hello":[0],"world":[1,3],"big":[2]}}"""
ENTRY = """<entry><id>http://arxiv.org/abs/2403.01234v2</id><published>2024-03-02T00:00:00Z</published><title>A
  title &amp; more</title><summary>S</summary><author><name>Jane Smith</name></author><author><name>Bo Lee</name></author><arxiv:primary_category term="cs.IR"/></entry>"""


def test_work_from_json(spark):
    r = W.works_from_json(spark.createDataFrame([(WORK,)], "value string")).first()
    assert (r.citation_key, r.doi, r.author, r.year) == ("smith2024coffee", "10.1145/123456.7890", "Jane Smith, Bo Lee", "2024")
    assert (r.referenced_works, r.related_works_count, r.concepts, r.abstract) == (["a", "b"], 1, ["X", "Y"], "Hello world big world")
    assert (r.pdf_url, r.source_url, r.source_display_name) == ("http://p.pdf", "http://l", "Venue") and len(r.counts_by_year) == 1


def test_entries_from_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f'<feed xmlns:arxiv="http://arxiv.org/schemas/atom">{ENTRY}{ENTRY}</feed>')
    rows = W.read_entries(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.arxiv_id, r.title, r.primary_category, r.year, r.pdf_url) == ("2403.01234v2", "A title & more", "cs.IR", "2024", "https://arxiv.org/pdf/2403.01234v2.pdf")


def test_keys_and_ids(spark):
    ids = spark.createDataFrame([("https://dx.doi.org/10.1/X",), ("DOI: 10.1/x",)], "v string").select(W.doi_id(F.col("v")).alias("d")).collect()
    assert {r.d for r in ids} == {"10.1/x"}
    r = spark.range(1).select(W.arxiv_id(F.lit("https://arxiv.org/pdf/2403.01234v2.pdf")).alias("a"), W.source_key(
        {"source_type": F.lit("doi"), "title": F.lit("t"), "doi": F.lit("10.1145/123456.7890"), "arxiv_id": F.lit(None).cast("string"), "source_id": F.lit("")}).alias("k")).first()
    assert (r.a, r.k) == ("2403.01234v2", "doi-10-1145-123456-7890")


def test_source_list(spark):
    t = spark.createDataFrame([("2403.01234, 10.1/ABC\npdf:/x y.pdf, http://h/a.pdf?x\narxiv:https://arxiv.org/abs/1.2",)], "text string")
    assert [(r.source_type, r.source) for r in dims.source_requests(t, []).collect()] == [
        ("arxiv", "2403.01234"), ("doi", "10.1/abc"), ("pdf", "/x y.pdf"), ("pdf", "http://h/a.pdf?x"), ("arxiv", "1.2")]


def test_citations(spark):
    rows = spark.createDataFrame([([],), (["J Smith"],), (["J Smith", "B Lee"],), (["J Smith", "B Lee", "C"],)], "a array<string>")
    assert [r.c for r in rows.select(W.parenthetical(F.col("a"), F.lit("2024")).alias("c")).collect()] == [
        "(Unknown, 2024)", "(Smith, 2024)", "(Smith & Lee, 2024)", "(Smith et al., 2024)"]
    assert spark.range(1).select(W.parenthetical(F.array().cast("array<string>"), F.lit("")).alias("c")).first().c == "(Unknown, n.d.)"


def test_rule_tags(spark):
    r = spark.range(1).select(W.research_tags(
        F.lit("数据治理与数智转型"), F.lit("Platform governance framework"), F.lit("An empirical study of digital transformation in firms with AI"), F.array(F.lit("x"))).alias("t")).first()
    assert {"literature-note", "data-governance", "digital-transformation", "intelligent-transformation", "platform-governance", "organizational-capability",
            "framework", "empirical", "governance-mechanism"} == set(r.t)


def test_literature_note_and_workspace(spark):
    works = W.works_from_json(spark.createDataFrame([(WORK,)], "value string"))
    note = W.literature_notes(works, "2024").first()
    assert note.path == "Knowledge/Research/Literature/doi-10-1145-123456-7890.md"
    assert '\ncitekey: "smith2024coffee"\n' in note.content and "\n\n" not in note.content and "- Recent citation counts: 2024:7" in note.content
    asked = spark.createDataFrame([("数据治理", 0, note.source_key)], "topic string, pos int, source_key string")
    out = {r.kind: r for r in workspace.workspaces(asked, works).collect()}
    assert set(out) == {"topic", "matrix", "map", "outline", "draft", "analysis"}
    assert "| Coffee ratios | 2024 | conceptual | 12 | X, Y | Hello world big world |" in out["matrix"].content
    assert "### data-governance\n- [[topic-" in out["map"].content and out["topic"].path.startswith("Knowledge/Research/Topics/topic-")
