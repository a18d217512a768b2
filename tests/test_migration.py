from pyspark.sql import functions as F

from marginalia.operators import html, migrate, notebooks


def test_hash_cleaning(spark):
    body = ("---\ntags: [#a]\n---\n##标题 一\nsee https://h/x#frag and #ff00aa and #root/abc #fn1\n```\n#ff00aa\n```\nkey: #注释 here #标签词 #123 #AbcDef #a1b url(#grad)\n# fine\n#plain")
    r = migrate.clean_hashes(spark.createDataFrame([("a.md", body)], "path string, content string")).first()
    assert r.content == ("---\ntags: [#a]\n---\n## 标题 一\nsee https://h/x\\#frag and \\#ff00aa and \\#root/abc \\#fn1\n```\n#ff00aa\n```\nkey: 注释 here  标签词 \\#123 \\#AbcDef \\#a1b url(\\#grad)\n# fine\n#plain")
    assert r.changed and r.replacements == 11


def test_conflict_free_names_match_brute_force(spark):
    stems = ["a", "a-2", "a", "b", "a", "a-2", "a-3", "b", "a", "c"]
    rows = spark.createDataFrame([(i, "d", s, ".md") for i, s in enumerate(stems)], "ord long, dir string, stem string, suffix string")
    got = {r.ord: r.name for r in migrate.conflict_free(rows).collect()}
    assert len(set(got.values())) == len(stems)
    taken, literal, want = set(), {s for s in stems}, {}
    for i, s in enumerate(stems):
        name, k = s, 2
        while name in taken or (name != s and name in literal):
            name, k = f"{s}-{k}", k + 1
        taken.add(name)
        want[i] = f"{name}.md"
    assert got == want


def test_flatten_and_links(spark):
    files = [
        (0, "R/C/K/p 1/q/n.md", "[a](../../m.md#x) [b](%E6%B5%8B.png) ![i](https://h/i.png) [gone](nope.md)"), (1, "R/C/K/m.md", "[n](p%201/q/n.md)"), (2, "R/C/K/p 1/q/测.png", ""),
        (3, "R/C/K/p 1__q__n.md", "x"), (4, "Archive/C/K/p/q.md", "y"), (5, "R/C/K/" + "长" * 80 + "/f.md", "z"),
    ]
    df = spark.createDataFrame(files, "ord long, path string, content string")
    plan = {r.old_path: r.new_path for r in migrate.flatten_plan(df).collect()}
    assert plan["R/C/K/p 1/q/n.md"] == "R/C/K/p 1__q__n--2.md" and plan["R/C/K/p 1/q/测.png"] == "R/C/K/p 1__q__测.png"
    clipped = plan["R/C/K/" + "长" * 80 + "/f.md"]
    assert len(clipped.rsplit("/", 1)[1].encode()) <= 153 and "Archive/C/K/p/q.md" not in plan
    moved = migrate.rewrite_links(df, migrate.flatten_plan(df).select("old_path", "new_path"))
    out = {r.path: r.content for r in moved.collect()}
    assert out["R/C/K/p 1/q/n.md"] == "[a](m.md#x) [b](p%201__q__测.png) ![i](https://h/i.png) [gone](nope.md)"
    assert out["R/C/K/m.md"] == "[n](p%201__q__n--2.md)"


def test_journal_names(spark):
    rows = [("2024/3 - March/7 - walk/x.md",), ("2024/11 - Nov/17 - run.md",), ("loose.md",)]
    got = [r.n for r in spark.createDataFrame(rows, "p string").select(migrate.journal_name(F.col("p"), F.lit("L-")).alias("n")).collect()]
    assert got == ["L-2024-03-07 walk", "L-2024-11-17 run", "L-loose"]


def test_sections_and_block_ids(spark, notes):
    n = notes(("a.md", "one\ntwo"), ("d.excalidraw.md", "draw\n%%\njson"), ("e.md", "x ^old\n\n"))
    add = spark.createDataFrame([("a.md", "T"), ("d.excalidraw.md", "T")], "path string, text string")
    out = {r.path: r.content for r in migrate.append_section(n, add).collect()}
    assert out == {"a.md": "one\ntwo\nT\n", "d.excalidraw.md": "draw\nT\n\n%%\njson"}
    asked = spark.createDataFrame([("a.md", 1, 2), ("a.md", 2, 9), ("e.md", 1, 3)], "path string, start_line int, end_line int")
    ids = migrate.assign_block_ids(n, asked).collect()
    assert {r.block_id for r in ids if r.path == "e.md"} == {"old"} and len({r.block_id for r in ids if r.path == "a.md"}) == 1
    new = {r.path: r.content for r in migrate.write_block_ids(n, migrate.assign_block_ids(n, asked)).collect()}
    assert list(new) == ["a.md"] and new["a.md"].startswith("one\ntwo ^ref-")


PAGE = """<html><head><title>T &amp; x</title><style>p{}</style></head><body><nav>no</nav><div class="ck-content"><h2>Head</h2><p>Some <strong>bold</strong> and <em>it</em>
<code>x&lt;1</code> <a href="c%20d.html#s">link</a><br>next</p><ul><li>one<ul><li>deep</li></ul></li><li>two</li></ul><ol><li>a</li><li>b</li></ol><ul class="todo-list"><li><label>
<input type="checkbox" checked="checked">done</label></li><li><label><input type="checkbox">open</label></li></ul><blockquote><p>q1</p><p>q2</p></blockquote>
<pre><code class="language-text-x-python">def f():
    return 1
</code></pre><figure class="table"><table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td></tr></tbody></table></figure><hr><img src="i.png" alt="pic"><p>end</p></div><p>outside</p></body></html>"""
MARKDOWN = """# T & x

## Head

Some **bold** and *it* `x<1` [link](c%20d.html#s)
next

- one
  - deep
- two

1. a
2. b

- [x] done
- [ ] open

> q1
>
> q2

```python
def f():
    return 1
```

| A | B |
| --- | --- |
| 1 |   |

---

![pic](i.png)

end"""


def test_html_page(spark):
    pages = spark.createDataFrame([(1, "a/b.html", PAGE)], "page_id long, path string, html string")
    assert html.convert_pages(pages).first().markdown == MARKDOWN


def test_more_pages_make_more_tasks(spark, monkeypatch):
    """Whole pages are dealt to tasks by their size, so a task's tokens do not grow with the input; tokens are not shuffled."""
    seen = []
    keep = html.settle
    # in a printed plan the input of a step stands below it
    early = lambda df: (lambda plan: plan.index("Generate") < plan.index("Exchange"))(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(html, "settle", lambda df: (seen.append((early(df), df.rdd.getNumPartitions())), keep(df))[1])
    pages = spark.createDataFrame([(i, f"a/{i}.html", PAGE) for i in range(40)] + [(40, "b.html", None), (41, "c.html", "")], "page_id long, path string, html string")
    for size, parts in ((html.PAGE_CHARS, 4), (len(PAGE) * 2, 20)):
        monkeypatch.setattr(html, "PAGE_CHARS", size)
        out = {r.page_id: r.markdown for r in html.convert_pages(pages).collect()}
        assert [out[i] for i in range(40)] == [MARKDOWN] * 40 and len(out) == 42 and out[41] == "# c"
        assert seen.pop() == (True, parts)
    assert html.convert_pages(pages.where("page_id < 0")).count() == 0


def test_html_import(spark):
    files = [(0, "a/b:1.html", '<p><a href="c%20d.html#s">l</a> <a href="/a/c d?q=1">r</a> <a href="f.pdf">f</a></p>'), (1, "a/c d.html", "<p>x</p>"), (2, "index.html", "<p>n</p>")]
    out = {r.new_path: r.content for r in html.import_pages(spark.createDataFrame(files, "ord long, path string, html string"), "now").collect()}
    assert set(out) == {"a/b 1.md", "a/c d.md"}
    assert out["a/b 1.md"].endswith("# b 1\n\n[l](c%20d.md#s) [r](c%20d.md?q=1) [f](f.pdf)\n")


def test_an_import_deals_its_pages_by_size(spark, monkeypatch):
    seen = []
    keep = html.settle
    monkeypatch.setattr(html, "settle", lambda df: (seen.append(df.rdd.getNumPartitions()), keep(df))[1])
    monkeypatch.setattr(html, "PAGE_CHARS", 100)
    files = [(i, f"a/p{i}.html", f'<p><a href="p{(i + 1) % 30}.html#s">l{i}</a> {"x" * 170}</p>') for i in range(30)]
    out = {r.new_path: r.content for r in html.import_pages(spark.createDataFrame(files, "ord long, path string, html string"), "now").collect()}
    assert len(out) == 30 and all(f"[l{i}](p{(i + 1) % 30}.md#s)" in out[f"a/p{i}.md"] for i in range(30))
    assert seen == [-(-sum(len(h) for _, _, h in files) // 100)]


def test_an_import_joins_its_texts_by_size(spark, monkeypatch):
    """Texts that meet titles, paths and links are dealt as the pages are, once; only the path map and the texts are written on the way."""
    seen = []
    keep = migrate.settle
    monkeypatch.setattr(migrate, "settle", lambda df: (seen.append(("content" in df.columns, df.rdd.getNumPartitions())), keep(df))[1])
    monkeypatch.setattr(html, "PAGE_CHARS", 100)
    files = [(i, f"a/p{i}.html", f'<p><a href="p{(i + 1) % 30}.html#s">l{i}</a> {"x" * 170}</p>') for i in range(30)]
    done = html.import_pages(spark.createDataFrame(files, "ord long, path string, html string"), "now")
    parts = -(-sum(len(h) for _, _, h in files) // 100)
    assert [n for text, n in seen if text] == [parts] and len(seen) == 2
    assert done.rdd.getNumPartitions() == parts and done.count() == 30


def test_import_targets(spark):
    """A target is a file's path, else the page that has it plus .html; the shorter name wins where both are there."""
    asked = ["x", "x.html", "v1.2", "v1.2.html", "/b/y", "/b/y?q#f", "gone", "f.pdf", "f", ".html", "https://h/x", "#s", "b/y.html", "x.HTML", "b", "z%20z", ""]
    page = "".join(f'<p><a href="{a}">t{i}</a></p>' for i, a in enumerate(asked))
    names = ["p.html", "x", "x.html", "v1.2.html", "b/y.html", "f.pdf", "z z.html", "b.html", "q.HTML"]
    files = [(i, n, page if n in ("p.html", "b/y.html") else "<p>none</p>") for i, n in enumerate(names)]
    out = {r.old_path: r.content for r in html.import_pages(spark.createDataFrame(files, "ord long, path string, html string"), "now").collect()}
    want = ["x", "x.md", "v1.2", "v1.2.md", "b/y.md", "b/y.md?q#f", "gone", "f.pdf", "f", ".html", "https://h/x", "#s", "b/y.md", "x.HTML", "b.md", "z%20z.md"]
    assert [line for line in out["p.html"].split("\n") if "](" in line] == [f"[t{i}]({w})" for i, w in enumerate(want)]
    assert "[t4](y.md)" in out["b/y.html"] and "[t0](x)" in out["b/y.html"] and "[t12](b/y.html)" in out["b/y.html"]
    assert set(out) == {n for n in names if n.lower().endswith(".html")} and out["x.html"].endswith("# x\n\nnone\n")


def test_notebooks(spark, tmp_path):
    text = """{"notebook_id":"n1","title":"Book: 1","source_count":2,"url":"u","notes":[{"id":"x","title":"A/B","content":"  l1\\\\nl2 conversation_id: 0123abcd-0000-1111-2222-333344445555"},
    {"id":"y","title":"A/B","content":""}],"artifacts":[{"id":"x","type":"mind_map","status":"completed"},{"id":"r1234567890","type":"report","status":"completed"},{"id":"q","type":"audio","status":"failed"}]}"""
    (tmp_path / "n.json").write_text(text)
    books = notebooks.read_notebooks(spark, str(tmp_path))
    exported = notebooks.exported_notes(books)
    done = {r.ord: r for r in notebooks.normalised_notes(exported.withColumn("ord", F.col("pos").cast("long"))).collect()}
    assert done[0].content == "# A B\n\nl1\nl2 conversation_id: 0123abcd-0000-1111-2222-333344445555\n" and done[0].conversation_id.startswith("0123abcd")
    assert (done[0].name, done[1].name, done[1].content) == ("A B.md", "A B-2.md", "# A B\n")
    made = notebooks.exported_artifacts(books, ["report", "audio"])
    assert [r.path for r in made.collect()] == ["artifacts/report/report-r1234567.md"]
    skipped = notebooks.skipped_artifacts(books, exported)
    assert skipped.first().covered_by_note_export is True
    index = notebooks.index_notes(books, exported.withColumn("path", F.concat(F.lit("notes/"), "note_id", F.lit(" .md"))), made, skipped, "now").first()
    assert index.path == "Book 1/_index.md" and "- [A/B](notes/x%20.md)" in index.content and "covered_by_note_export=`True`" in index.content
    assert len(notebooks.exported_notes(books, wanted=["y"]).collect()) == 1 and len(notebooks.exported_notes(books, limit=1).collect()) == 1
