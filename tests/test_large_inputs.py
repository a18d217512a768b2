"""Results and shapes that only showed on larger tables."""

import numpy as np
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import graph, mentions, notes as N, refs, semantic, suggest, tags, vectors
from marginalia.sinks import notes as sinks
from marginalia.sources import vault, walk


def test_prose_on_the_border_of_symbols(spark):
    """Symbols may be seven tenths of the letters, exactly: 63 of 90."""
    lines = [("a" * n + "+" * (n * 7 // 10 + more), more == 0) for n in (10, 90, 100, 110) for more in (0, 1) if n * 7 // 10 + more > 8]
    rows = spark.createDataFrame(lines, "line string, prose boolean").select("line", "prose", N.is_natural_line(F.col("line")).alias("found")).collect()
    assert [r.found for r in rows] == [r.prose for r in rows]


def test_terms_of_prose_on_the_border_of_symbols(spark, notes):
    n = notes(("a.md", "---\nx: 1\n---\n" + "marble lantern " * 6 + "copper copper" + "+" * 63 + "\n"))
    line = N.natural_line_table(n).first()
    assert line is not None and line.text.count("+") == 63
    assert {"marble", "lantern"} <= {r.term for r in suggest.term_table(n).where("source = 'body'").collect()}


def test_files_are_listed_by_tasks(spark, tmp_path):
    """Names and bytes of all files, at every depth, and no list of them in the driver."""
    root = tmp_path / "a%20b c"
    want = {}
    for i in range(60):
        path = f"d{i % 3}/e {i % 2}/f#{i}.md" if i % 4 else f"g%{i}.MD"
        want[path] = b"\xef\xbb\xbfx\r\n" * (i % 5) if i % 7 else b""
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(want[path])
    (root / "d0" / ".hidden.md").write_text("no")
    (root / "d0" / "z.md.gz").write_bytes(b"packed")
    (root / "none").mkdir()
    for at in (str(root), str(root) + "/"):
        found = vault.read_notes(spark, at)
        assert not found.inputFiles()
        rows = found.orderBy("path").collect()
        assert [(r.path, r.content.encode()) for r in rows] == sorted(want.items())
        assert [r.ord for r in rows] == sorted(r.ord for r in rows) and len({r.ord for r in rows}) == len(rows)
    files = vault.read_files(spark, str(root))
    assert not files.inputFiles()
    assert {r.path: (bytes(r.content), r.length) for r in files.collect()} == {p: (c, len(c)) for p, c in {**want, "d0/z.md.gz": b"packed"}.items()}
    assert {r.path for r in vault.read_attachments(spark, str(root), "*.{gz,pdf}").collect()} == {"d0/z.md.gz"}


def test_archive_reads_files_where_it_writes_them(spark, tmp_path, monkeypatch):
    """Tasks that get paths write their contents; no content is shuffled and none is listed by the driver."""
    made = []
    monkeypatch.setattr(sinks, "with_content", lambda *a: made.append(walk.with_content(*a)) or made[-1])
    raw = tmp_path / "raw"
    (raw / "sub").mkdir(parents=True)
    for i in range(40):
        (raw / ("sub" if i % 2 else "") / f"f{i}").write_bytes(b"x" * i)
    assert sinks.compact_archive(spark, str(raw), str(tmp_path / "archive"), 200) == 40
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("MapInArrow") and not made[0].inputFiles()
    assert {(r.path, r.length, len(r.content)) for r in spark.read.parquet(str(tmp_path / "archive")).collect()} == {(f"sub/f{i}" if i % 2 else f"f{i}", i, i) for i in range(40)}


def test_nearest_hands_workers_few_blocks(spark, monkeypatch):
    """Blocks of vectors reach Python a few at a time, requests leave it in small batches, and the session's setting is put back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, settle = spark.conf.get(name), [], vectors.settle
    monkeypatch.setattr(vectors, "settle", lambda df: seen.append(spark.conf.get(name)) or settle(df))
    monkeypatch.setattr(vectors, "BLOCK", 40)
    monkeypatch.setattr(vectors, "ASKED_BYTES", 500)
    m = np.random.default_rng(3).normal(size=(400, 8)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, embedding array<float>")
    got = {}
    for r in vectors.search(vectors.build_index(df, 5), df, 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    unit = m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :5]
    assert all([j for _, j in sorted(got[i])] == list(best[i]) for i in range(400))
    assert int(seen[-1]) <= 16 and spark.conf.get(name) == before


def _shuffled(spark) -> dict[str, int]:
    """Shuffle files of the session and their bytes."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName(): files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_nearest_writes_no_pairs_to_disk(spark):
    """Of vectors without clusters every query needs every cluster; what is written stays a small multiple of the vectors, also where no table is broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(name)
    m = np.random.default_rng(4).normal(size=(3000, 16)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, embedding array<float>")
    got = {}
    spark.conf.set(name, "-1")
    try:
        index, before = vectors.build_index(df, 5), _shuffled(spark)
        for r in vectors.search(index, df, 5).collect():
            got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    finally:
        spark.conf.set(name, threshold)
    assert sum(size for name, size in _shuffled(spark).items() if name not in before) < 10 * m.nbytes
    unit = m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :5]
    assert all([j for _, j in sorted(got[i])] == list(best[i]) for i in range(3000))


def test_nearest_in_many_parts(spark, monkeypatch):
    """Lists of several parts are put together; rows that come twice, multiples of a vector, copies and a row without id are among them, and a large cluster."""
    for name, value in (("BLOCK", 40), ("PART_BYTES", 4000), ("CELLS", 100), ("HITS", 50)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(260, 8)).astype("float32")
    m[200:] = m[200] + 0.01 * m[200:]
    m = [tuple(float(x) for x in row) for row in m]
    rows = [(i, x) for i, x in enumerate(m)] + [(i, m[i]) for i in range(20)] + [(300 + i, tuple(2 * x for x in m[i])) for i in range(30)] + [(400 + i, m[30 + i % 2]) for i in range(12)]
    v = spark.createDataFrame([*rows, (None, m[0])], "vec_id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(rows, "own_id long, embedding array<float>").select(F.col("own_id").alias("query_id"), "own_id", "embedding")
    asked = asked.unionByName(spark.createDataFrame([(1000, None, m[0])], "query_id long, own_id long, embedding array<float>"))
    got = {}
    for r in semantic.nearest(v, asked, k=4).collect():
        got.setdefault(int(r.query_id), []).append((r.rank, r.vec_id, round(r.score, 9)))
    unit = {x: np.array(x) / np.linalg.norm(x) for _, x in rows}
    want = {}
    for q, own, x in [*((i, i, x) for i, x in rows), (1000, None, m[0])]:
        want.setdefault(q, []).extend((-round(float(unit[x] @ unit[y]), 9), j) for j, y in rows if j != own)
    for q, found in want.items():
        best = sorted(found)[:4]
        assert [(n, -s) for _, n, s in sorted(got[q])] == [(j, s) for s, j in best]
    assert set(got) == set(want)


def test_title_terms_of_a_note_without_text(spark, notes):
    n = notes(("marble lantern.md", None), ("b.md", "copper\n"))
    found = {(r.path, r.source, r.term) for r in suggest.term_table(n).collect()}
    assert found == {("marble lantern.md", "title", "marble"), ("marble lantern.md", "title", "lantern"), ("b.md", "body", "copper")}


def test_shared_tags_are_counted_once_for_all_requests(spark, notes):
    n = notes(*[(f"{i}.md", f'---\ntags: ["{"Web" if i % 2 else "web"}","t{i % 3}"]\n---\nx\n') for i in range(9)], ("own.md", '---\ntags: ["alone"]\n---\n'))
    facts = N.note_facts(n)
    asked = spark.createDataFrame([("a", "0.md"), ("b", "1.md"), ("c", "own.md")], "request_id string, path string")
    rows = tags.shared_tags(asked, facts).groupBy("request_id", "tag").agg(F.count_distinct("path").alias("notes")).collect()
    counted = tags.shared_tag_counts(asked, facts)
    assert {tuple(r) for r in counted.collect()} == {tuple(r) for r in rows} and len(rows) == 6
    # notes of a tag are counted before requests meet them, so no row holds a note of another
    assert "path" not in counted.columns


def test_text_windows_are_sifted_by_the_first_words_of_titles(spark):
    text = F.lit("See doc-1 and doc 2, an alias-3 or doc; last doc")
    grams = lambda *more: {(g.size, g.gram) for g in spark.range(1).select(F.explode(mentions._text_grams(text, [("w", 1), ("w", 2), ("w", 3)], *more)).alias("g")).select("g.*").collect()}
    every, kept = grams(), grams(["alias", "doc"])
    assert kept == {(n, g) for n, g in every if g.split(" ")[0] in ("alias", "doc")} and (2, "doc 1") in kept and (2, "last doc") not in kept


def test_first_position_at_word_edges(spark):
    rows = [("xdoc-1 DOC-1.", "doc-1", 8), ("doc-12 doc-1", "doc-1", 8), ("a.b axb", "a.b", 1), ("_doc doc_", "doc", 0), ("c++ is", "c++", 0), ("x ++c++x", "++c", 0), ("docdoc doc", "doc", 8)]
    df = spark.createDataFrame(rows, "text string, term string, at int")
    old = F.regexp_instr("text", F.concat(F.lit("(?i)"), F.when(F.col("term").rlike("^[0-9A-Za-z_]"), T.WORD_START).otherwise(T.ASCII_BOUNDARY), F.regexp_replace("term", r"([.*+?^${}()|\[\]\\])", r"\\$1"), F.when(F.col("term").rlike("[0-9A-Za-z_]$"), T.WORD_END).otherwise(T.ASCII_BOUNDARY)))
    for r in df.select("*", mentions.first_position(F.col("text"), F.col("term")).alias("found"), old.alias("old")).collect():
        assert r.found == r.old, r


def test_targets_are_resolved_from_one_pass_without_surroundings(spark, notes):
    n = notes(("a.md", "See <<b:1-3>> and (((c#2))) and [[b#^x|q]] and [[c]] not `<<d:1>>`\n"), ("b.md", "x\n"))
    found = graph.resolution_table(n)
    assert {tuple(r) for r in found.collect()} == {("b", "b.md"), ("c", None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "source_context" not in plan and "citekey" not in plan
    assert sum(1 for r in graph.references(n, context=False).collect()) == 3 and "source_context" not in graph.references(n, context=False).columns


def test_blanks_are_trimmed_as_unicode_has_them(spark):
    every = [(chr(c),) for c in (*range(1, 0x300), *range(0x1680, 0x1690), *range(0x2000, 0x2070), 0x3000, 0xfeff)]
    df = spark.createDataFrame([(c + " a" + c + "b" + c + "\n",) for (c,) in every], "t string")
    assert not df.where(T.trim_all(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).take(1)


def test_works_are_not_joined_with_counts_that_are_not_shown(spark):
    from __spark_entry__ import queries

    for name in ("G5_literature_map", "J10_doi_enrichment"):
        plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "prev_line" not in plan and "counts_by_year" not in plan, name
    assert "prev_line" in queries()["G9_work_citations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_a_dashboard_reads_the_notes_once(spark, monkeypatch):
    """Frontmatter, fences and references of a text are looked at in one pass, and all its tokens nowhere when titles begin with few words."""
    from marginalia.plans.queries import ALL

    seen = {}

    def counted(module, name):
        real = getattr(module, name)

        def call(*args, **kwargs):
            seen[name] = seen.get(name, 0) + 1
            return real(*args, **kwargs)

        monkeypatch.setattr(module, name, call)

    for name in ("entries", "outside_fences", "line_targets"):
        counted(graph, name)
    assert ALL["G4_dashboard"].run(spark, "/root/testdata/sf0.001").count() == 200
    assert seen == {"entries": 1, "outside_fences": 1, "line_targets": 1}


def test_windows_that_begin_like_titles_are_those_of_all_tokens(spark):
    texts = [
        "doc doc-1, doc\u00e9 \u00e9doc x \u00e9 doc_1 doc", "Doc\u6570doc\u636e7 \U0001f600\U0001f600 a \U0001f600", "", "doc", "a doc. \u00c9t\u00e9 2 docs a1 a",
        "doc\u00e9\u00e9doc doc\n\n- \u00e9 a \u0130 a\u0307 a", "\u00e9a\u00e9 doc1doc a doc", "doc (doc) [[doc|doc]] doc",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    starts = ["a", "doc", "docs", "\u00e9", "\U0001f600", "i"]
    sizes = [("w", n) for n in (1, 2, 3, 4)]
    every = mentions._text_grams(F.col("t"), sizes)
    for r in rows.select("t", every.alias("every"), mentions._text_grams(F.col("t"), sizes, starts).alias("sifted")).collect():
        want = {(g.size, g.gram) for g in r.every if g.gram.split(" ")[0] in starts}
        assert {(g.size, g.gram) for g in r.sifted} == want and len(r.sifted) == len(want), r.t


def test_back_ticks_behind_references(spark):
    """References count when an even number of back-ticks follows, those inside later references included."""
    texts = ["<<a:1>> `<<b:2>>` <<c:3-4>>", "`<<a:1>> <<b`c:2>> (((d`e#3))) ` ((( f #4-5)))", "<<a:1>>`", "``", "", "<<{x}:{1}-{2}>>>> <<y:1>>`z`", "(((a#1)))<<:1>>((( #2)))<<b:1>>"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    hits = F.transform(refs.line_hits(F.col("t")), lambda m: refs._line_target(m["hit"]))
    for r in rows.select("t", hits.alias("want"), refs.line_targets(F.col("t")).alias("got")).collect():
        assert r.got == r.want, r.t
