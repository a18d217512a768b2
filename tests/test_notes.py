import itertools
import random
import re

from pyspark.sql import functions as F

from marginalia.functions import paths, text
from marginalia.functions.terms import candidate_terms
from marginalia.operators import evidence, graph, mentions, notes as N, refs, tags
from marginalia.sources import dims


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_supported_files_and_drawings(spark):
    df = spark.createDataFrame([("Notes/hello.md", "md"), ("D/diagram.excalidraw", "excalidraw"), ("D/测试.excalidraw.md", "md"), ("P/demo.pdf", "pdf")], "path string, ext string")
    rows = df.where(N.is_supported(F.col("path"))).select("path", N.is_drawing(F.col("path"), F.col("ext")).alias("d")).collect()
    assert [(r.path, r.d) for r in rows] == [("Notes/hello.md", False), ("D/diagram.excalidraw", True), ("D/测试.excalidraw.md", True)]


def test_frontmatter_facts(notes):
    n = notes(("a.md", '---\ntags:\n  - visual-note\naliases: [治理画布]\npage: 18\nentry_type: book\nsource_type: article\nauthors: ["Smith", "Lee"]\nyear: 2024\n---\ntext #Visual-Note #123 #ok\n```\n#no\n```\n'))
    r = N.note_facts(n).first()
    assert r.tags == ["visual-note", "ok"] and r.aliases == ["治理画布"]
    m = r.metadata
    assert (m.author, m.year, m.source_type, m.locator) == ("Smith, Lee", "2024", "book", "18")


def test_frontmatter_table_skips_tags_and_keeps_last(notes):
    rows = N.frontmatter_table(notes(("a.md", '---\nk: 1\ntags: x\nk: "two"\nempty:\nraw: a: b\n---\n'))).collect()
    assert {(r.key, r.kind, r.value) for r in rows} == {("k", "string", "two"), ("empty", "text", ""), ("raw", "text", "a: b")}


def test_references_and_backticks(notes):
    n = notes(("s.md", "alpha (((MyNote#12-15))) beta <<Other:9>> `<<no:1>>` [[MyNote#^abc123|quoted]] <<{Über}:{2}-{4}>>\nnext"))
    rows = {r.raw: r for r in refs.references(n).collect()}
    assert set(rows) == {"(((MyNote#12-15)))", "<<Other:9>>", "[[MyNote#^abc123|quoted]]", "<<{Über}:{2}-{4}>>"}
    assert (rows["(((MyNote#12-15)))"].start_line, rows["(((MyNote#12-15)))"].end_line, rows["(((MyNote#12-15)))"].kind) == (12, 15, "block")
    assert rows["<<Other:9>>"].end_line is None and rows["<<Other:9>>"].pos_start == 30
    assert rows["[[MyNote#^abc123|quoted]]"].block_id == "abc123" and rows["[[MyNote#^abc123|quoted]]"].alias == "quoted"
    assert rows["<<{Über}:{2}-{4}>>"].target == "Über"


def test_formatting(spark):
    t, a, b = F.lit("MyNote"), F.lit(12), F.lit(15)
    r = one(spark, refs.format_line(t, a, F.lit(None).cast("int")).alias("x"), refs.format_block(t, a, b).alias("y"))
    assert (r.x, r.y) == ("<<MyNote:12>>", "(((MyNote#12-15)))")


def test_graph_is_transposed_and_dangling(notes):
    n = notes(("a.md", "[[B]] <<c:1>> [[missing]] <<missing:2>>"), ("sub/b.md", "---\naliases: [bee]\n---\n[[b]]"), ("c.md", "[[bee|x]] line\nsecond ^blk\n"), ("d.excalidraw", "[[c#^blk]]"))
    edges = {(r.path, r.target_path) for r in graph.link_edges(n).collect()}
    assert edges == {("a.md", "sub/b.md"), ("a.md", "c.md"), ("sub/b.md", "sub/b.md"), ("c.md", "sub/b.md"), ("d.excalidraw", "c.md")}
    back = {(r.source_path, r.path) for r in graph.backlinks(graph.link_edges(n)).collect()}
    assert back == {(s, t) for s, t in edges if s != t}
    assert [(r.target, r.references, r.notes) for r in graph.dangling(n).collect()] == [("missing", 1, 1)]
    exact = {r.raw: r for r in graph.exact_references(n).collect()}
    assert exact["[[c#^blk]]"].target_preview == "[[bee|x]] line\nsecond" and exact["<<c:1>>"].target_preview == "[[bee|x]] line"


def test_mentions_need_whole_words_and_no_link(notes):
    n = notes(("art.md", "x"), ("p.md", "about art here"), ("q.md", "party time"), ("r.md", "[[art]] art"), ("治理.md", "y"), ("s.md", "数据治理与art"), ("über.md", "z"), ("t.md", "an über word, xüber"), ("u.md", "<<art:1>> and art"))
    rows = {(r.target_path, r.source_path) for r in mentions.unlinked_mentions(n).collect()}
    assert ("art.md", "p.md") in rows and ("治理.md", "s.md") in rows and ("art.md", "s.md") in rows
    assert not {("art.md", "q.md"), ("art.md", "r.md")} & rows
    assert ("art.md", "u.md") in rows  # a line reference is no link of the host
    # an edge that is not ASCII needs an ASCII word character outside
    assert ("über.md", "t.md") in rows


def test_mentions_of_a_shared_title_match_brute_force(notes):
    pairs = [(f"d{i}/index.md", f"see index {i}" if i % 2 else "none") for i in range(12)] + [("z.md", "the index and [[d0/index]]")]
    rows = mentions.unlinked_mentions(notes(*pairs), limit=3).collect()
    got = {}
    for r in rows:
        got.setdefault(r.target_path, []).append((r.rank, r.source_path))
    for target, _ in pairs[:12]:
        linked = {"z.md"} if target == "d0/index.md" else set()
        want = [p for p, c in pairs if "index" in c and p != target and p not in linked][:3]
        assert [p for _, p in sorted(got[target])] == want


def test_evidence(spark, notes):
    n = notes(
        ("a.md", "# Demo\nline two\nline three\nline four"),
        ("b.md", "---\ntitle: x\n---\n# H\nadaptive governance text\nmore\n\n- item adaptive\n> quote"),
        ("c.md", "mentions governance here\n\nalso mentions  GOVERNANCE there"), ("d.md", "---\nopen\ntext"),
    )
    q = spark.createDataFrame(
        [(1, "b.md", "adaptive governance", None, None, None), (2, "c", "mentions governance", "paragraph", None, "line"), (3, "c.md", "mentions governance", "", 2, "block"),
         (4, "c.md", "nothing", "line", None, None), (5, "no.md", "x", "line", None, None), (6, "d.md", "text", "paragraph", None, None), (7, "../x", "y", "line", None, None)],
        "query_id int, path string, query string, scope string, occurrence int, kind string",
    )
    found = {r.query_id: r for r in evidence.format_references(q, n).collect()}
    assert found[1].reference == "<<b:5-6>>" and found[2].error == "ambiguous-match" and found[2].match_count == 2
    assert found[3].reference == "(((c#3)))" and found[4].error == "no-match" and found[5].error == "note-not-found"
    assert found[6].error == "no-match" and found[7].error == "invalid-note-path"
    r = spark.createDataFrame([("a.md", 2, 3), ("a.md", 4, 9), ("a.md", 0, None)], "path string, start_line int, end_line int")
    rows = {x.start_line: x for x in evidence.inspect(r, n).collect()}
    assert rows[2].preview == "line two\nline three" and rows[2].total_lines == 4 and rows[2].warnings == ""
    assert rows[4].error == "line-out-of-bounds" and rows[0].error == "invalid-line-range"


def test_preview_limit(spark, notes):
    n = notes(("a.md", "\n".join(f"l{i}" for i in range(1, 11))))
    r = spark.createDataFrame([("a.md", 1, 8, 3)], "path string, start_line int, end_line int, max_preview_lines int")
    x = evidence.inspect(r, n).first()
    assert (x.preview, x.selected_line_count, x.preview_line_count, x.warnings) == ("l1\nl2\nl3", 8, 3, "preview_truncated")


def test_islands_cover_each_filled_line_once(notes):
    body = "p1\np1b\n\n# h\n- a\n- b\ntext\n```\ncode\n```\n\n> q\nend"
    rows = refs.island_table(notes(("a.md", body))).collect()
    covered = [i for r in rows for i in range(r.start_line, r.end_line + 1)]
    assert sorted(covered) == [i + 1 for i, x in enumerate(body.split("\n")) if x.strip()]


def test_dimensions(spark):
    t = spark.createDataFrame([('{ "手冲咖啡": ["pour-over", "coffee"], " ": 1 }',), ("not json",)], "text string")
    assert [(r.canonical, r.alias) for r in dims.alias_rows(t, []).collect()] == [("手冲咖啡", "pour-over"), ("手冲咖啡", "coffee")]
    f = spark.createDataFrame([('{ "method": { "experiment": ["实验", "experimental"] }, "status": ["draft"] }',)], "text string")
    assert {(r.facet, r.canonical, r.alias) for r in dims.facet_rows(f, []).collect()} == {
        ("method", "experiment", "实验"), ("method", "experiment", "experimental"), ("status", "draft", None)}


def test_terms(spark):
    r = one(spark, candidate_terms(F.lit("手冲咖啡萃取动力学与感官美学，适合 V60 与聪明杯。")).alias("t"))
    assert {"手冲咖啡", "萃取动力学", "v60", "聪明杯"} <= set(r.t)


def test_tag_edits(notes):
    n = notes(("a.md", "---\ntags: [Old, keep]\n---\nuse #old and #older\n```\n#old\n```"), ("b.md", "no tags"))
    deleted = {r.path: r.content for r in tags.replace_tag(n, "old", None).collect()}
    assert deleted == {"a.md": '---\ntags: ["keep"]\n---\nuse  and #older\n```\n#old\n```'}
    renamed = {r.path: r.content for r in tags.replace_tag(n, "OLD", "new").collect()}
    assert renamed["a.md"] == '---\ntags: ["keep","new"]\n---\nuse #new and #older\n```\n#old\n```'
    # a rename also lists the new tag in notes that never had the old one
    assert renamed["b.md"] == '---\ntags: ["new"]\n---\nno tags'


def test_text_helpers(spark):
    r = one(
        spark, text.slug(F.lit("Ünïcode Títle!")).alias("slug"), text.safe_filename(F.lit('A:B/C*D?"E<F>G|')).alias("f"), text.safe_filename(F.lit("CON")).alias("con"),
        paths.normalise(F.lit("a/./b/../c//d")).alias("n"), paths.normalise(F.lit("../x")).alias("up"), paths.relative(F.lit("a/b/c.md"), F.lit("a/d/e")).alias("rel"),
        text.topic_hash(F.lit("数据治理")).alias("h"), paths.decode_link(F.lit("a+b%20c")).alias("dec"),
    )
    assert (r.slug, r.f, r.con) == ("unicode-title", "A B C D E F G", "CON_")
    assert (r.n, r.up, r.rel, r.dec) == ("a/c/d", "../x", "../../b/c.md", "a+b c")
    h = 5381
    for c in "数据治理":
        h = ((h * 33) ^ ord(c)) & 0xFFFFFFFF
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    assert r.h == digits


def test_title_weights(spark):
    titles = ["", "abcdefgh", "你好吗", "hello!", "😀", "Ａ", "a"]
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select(text.title_weight(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [0, 4, 3, 3, 2, 1, 1]


def test_similar_tag_sets_match_all_pairs(spark):
    """A tag on every note, copies of whole sets, single tags and ties of frequency."""
    rnd = random.Random(3)
    rows = [(f"n{i:03}", ["Hot", *rnd.sample([f"t{j}" for j in range(25)], rnd.randint(0, 6))]) for i in range(150)] + [("z1", []), ("z2", ["x"]), ("z3", ["X", "x"])]
    facts = spark.createDataFrame(rows, "path string, tags array<string>")
    for threshold in (0.3, 0.5, 0.8, 1.0):
        classes = tags.tag_classes(facts)
        sets = {}
        for path, words in rows:
            sets.setdefault(frozenset(w.lower() for w in words), []).append(path)
        sets.pop(frozenset())
        assert {(r.path, r.class_path) for r in classes.collect()} == {(p, min(ps)) for ps in sets.values() for p in ps}
        want = {(*sorted((min(p), min(q))), tuple(sorted(a & b))) for (a, p), (b, q) in itertools.combinations(sets.items(), 2) if len(a & b) >= threshold * len(a | b) - 1e-12}
        got = [(r.path_a, r.path_b, tuple(r.shared)) for r in tags.similar_tag_sets(classes, threshold).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_mentions_of_signs_shared_heads_and_common_titles(notes):
    """Titles of signs only, titles that share their first four tokens, and one title of a third of the notes, against a loop over titles and texts."""
    heads = [f"the weekly report of team {i}" for i in range(12)]
    pairs = [(f"a/{h}.md", "x") for h in heads] + [("s/!!!.md", "x"), ("s/--.md", "y"), ("z/数据.md", "w")]
    pairs += [(f"same/{i}/common.md", f"see the weekly report of team {i % 14}, foo!!!bar and a--b" if i % 2 else "common 数据 only the weekly report of team") for i in range(20)]
    got = {(r.target_path, r.source_path) for r in mentions.unlinked_mentions(notes(*pairs), limit=100).collect()}
    want = set()
    for path, _ in pairs:
        title = path.rsplit("/", 1)[1][:-3]
        for other, body in pairs:
            found = title in body if re.search("[\u3400-\u9fff]", title) else re.search(r"(?ai)\b" + re.escape(title) + r"\b", body)
            if other != path and found:
                want.add((path, other))
    assert got == want and len(want) > 100 and any(t == "s/!!!.md" for t, _ in want)


def test_many_requests_share_a_note(spark, notes, monkeypatch):
    """Nearly all requests ask one note: in packs of three they get what a loop gives, repeated, pathless and unknown ones included."""
    lines = [f"line {i} {'odd' if i % 2 else 'even'}" for i in range(1, 30)]
    n = notes(("a.md", "\n".join(lines)), ("b.md", "odd"))
    asked = [(i, "a.md" if i % 5 else [None, "b.md", "no.md"][i // 5 % 3], f"line {i % 7 + 1}", "line") for i in range(40)] + [(7, "a.md", "line 1", "line")] * 3
    monkeypatch.setattr(evidence, "PACK", 3)
    q = spark.createDataFrame(asked, "query_id long, path string, query string, scope string")
    got = sorted((r.query_id, r.start_line, r.match_count) for r in evidence.match_numbers(q, n).collect())
    found = lambda w: [i + 1 for i, x in enumerate(lines) if w in x]
    assert got == sorted((i, at, len(found(w))) for i, p, w, _ in asked if p == "a.md" for at in found(w))
    errors = {(r.query_id, r.error) for r in evidence.format_references(q.selectExpr("*", "1 AS occurrence", "'line' AS kind"), n).collect()}
    assert {(0, "invalid-note-path"), (5, "no-match"), (10, "note-not-found")} <= errors
