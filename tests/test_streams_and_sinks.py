import datetime as dt
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.operators import feeds, rank, semantic, speech, suggest, vectors
from marginalia.operators.graph import link_edges
from marginalia.operators.notes import note_facts
from marginalia.sinks import files, notes as sinks
from marginalia.sources import dims, vault
from marginalia.streaming import artifacts, changes, sessions

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_change_merge(spark):
    rows = [(at(0), 1, "metadata", ["A"], None, False, True), (at(5), 2, "context", ["B", "A"], "s", True, False), (at(700), 3, "metadata", [], None, False, False)]
    df = spark.createDataFrame(rows, "ts timestamp, id long, reason string, changed_paths array<string>, focus string, force boolean, preserve_scroll boolean")
    merged = changes.coalesce_changes(df).orderBy("window_start").collect()
    assert [(r.merged, r.reason, r.focus, r.force, r.preserve_scroll) for r in merged] == [(2, "context", "s", True, True), (1, "metadata", None, False, False)]
    assert {r.path for r in changes.changed_paths(df).collect()} == {"A", "B"}
    deps = spark.createDataFrame([("A",)], "path string")
    assert {r.id: r.handle for r in changes.must_refresh(df, deps).collect()} == {1: True, 2: True, 3: True}
    others = spark.createDataFrame([("C",)], "path string")
    assert {r.id: r.handle for r in changes.must_refresh(df, others).collect()} == {1: False, 2: True, 3: True}
    assert {r.id: r.handle for r in changes.must_refresh(df, others.where("false")).collect()}[1] is True


def test_change_stream_equals_batch(spark, tmp_path):
    rows = [(at(i * 40), i, ["metadata", "context"][i % 2], [f"p{i % 3}"], None, False, False) for i in range(60)]
    schema = "ts timestamp, id long, reason string, changed_paths array<string>, focus string, force boolean, preserve_scroll boolean"
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = changes.coalesce_changes(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), watermark="1 hour")
    q = stream.writeStream.format("memory").queryName("merged").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("merged").collect())) == sorted(map(tuple, changes.coalesce_changes(df).collect()))


def test_sentences_ignore_partials(spark):
    rows = [("s", 1, "要", False), ("s", 2, "要求", False), ("s", 3, " 要求在显价值。 ", True), ("s", 4, "", True), ("s", 5, "尾", False)]
    df = spark.createDataFrame(rows, "session string, ts long, text string, is_endpoint boolean")
    assert [r.text for r in sessions.sentences(df).collect()] == ["要求在险价值。"]


def test_silence_stream_equals_loop(spark, tmp_path):
    # recordings s0 and s1 end, s2 stays open
    rows = [(f"s{k}", i, 8000, 0.5 if (i * (k + 3)) % 7 < 4 else 0.001, None if i < 94 else k < 2) for k in range(3) for i in range(95)]
    df = spark.createDataFrame(rows, "session string, seq long, n_samples int, rms double, ended boolean")
    for part in range(4):  # four files in order: state is carried from batch to batch
        df.where(f"seq div 30 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sessions.run_available(sessions.silence_segments(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    want = []
    for k in range(3):
        buffered = silence = pre = number = 0
        first = None
        for s, i, n, level, ended in [r for r in rows if r[0] == f"s{k}"]:
            first = i if buffered == 0 else first
            buffered += n
            silence = silence + n / 16 if level < 0.02 else 0
            if (silence >= 800 and buffered >= 40000) or buffered >= 240000:
                number += 1
                want.append((s, number, first, i, buffered, pre))
                pre, buffered, silence = (3200 if buffered > 3200 else 0), 0, 0
            if ended and buffered:
                want.append((s, number + 1, first, i, buffered, 0))
    assert sorted((r.session, r.segment_no, r.first_seq, r.last_seq, r.samples, r.pre_roll) for r in got.collect()) == sorted(want)
    assert {r.session for r in got.where("reason = 'end'").collect()} <= {"s0", "s1"} and got.where("reason = 'end'").count() > 0


def test_auto_stop(spark, tmp_path):
    rows = [("a", at(0)), ("a", at(50)), ("b", at(10)), ("z", at(4000))]
    df = spark.createDataFrame(rows, "session string, ts timestamp")
    assert {r.session: r.stopped for r in sessions.auto_stop(df, 30).collect()} == {"a": True, "b": False, "z": False}
    df.where("session <> 'z'").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.where("session = 'z'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = sessions.run_available(sessions.auto_stop_stream(stream, 30), str(tmp_path / "out"), str(tmp_path / "state"))
    assert {r.session for r in out.collect()} >= {"a", "b"}


def test_artifact_jobs(spark, tmp_path):
    jobs = spark.createDataFrame([("j1", "n", "infographic", None), ("j2", "n", "video", "v1"), ("j3", "n", "audio", None)], "job_id string, notebook_id string, artifact_type string, artifact_id string")
    polls = [(at(0), "n", "i1", "infographic", "in_progress", "1"), (at(0), "n", "i2", "infographic", "in_progress", "2"), (at(9), "n", "i2", "infographic", "completed", "2"), (at(9), "n", "v1", "video", "failed", "1")]
    df = spark.createDataFrame(polls, "ts timestamp, notebook_id string, artifact_id string, type string, status string, created_at string")
    states = artifacts.poll_states(jobs, df)
    assert {r.job_id: r.status for r in artifacts.job_states(states).collect()} == {"j1": "completed", "j2": "failed", "j3": "waiting"}
    failed, done = spark.createDataFrame([("j1",)], "job_id string"), spark.createDataFrame([("j3",)], "job_id string")
    assert {r.job_id: r.status for r in artifacts.job_states(states, done, failed).collect()} == {"j1": "download_failed", "j2": "failed", "j3": "completed"}
    for n, cond in enumerate(("ts = '2024-01-01 00:00:00'", "ts > '2024-01-01 00:00:00'")):
        df.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    artifacts.track(stream, jobs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {r.job_id: r.status for r in spark.read.parquet(str(tmp_path / "out/version=1")).collect()} == {"j1": "completed", "j2": "failed", "j3": "waiting"}


def test_edge_maintenance(spark, notes, tmp_path):
    n = notes(("a.md", "[[b]]"), ("b.md", "[[a]]")).withColumn("ts", F.lit(at(0)))
    n.coalesce(1).write.parquet(str(tmp_path / "in"))
    notes(("a.md", "[[a]] none")).withColumn("ts", F.lit(at(9))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(n.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes.maintain_edges(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = {(r.path, r.target_path) for r in changes.read_edges(spark, str(tmp_path / "out")).collect()}
    assert rows == {("a.md", "a.md"), ("b.md", "a.md")}
    assert link_edges(n).count() == 2


def test_edge_maintenance_follows_new_notes_and_lost_links(spark, notes, tmp_path):
    steps = [(("a.md", "[[b]] [[c]]"), ("b.md", "x")), (("c.md", "y"),), (("a.md", "none"),), (("d.md", "[[c]]"),)]
    want = [{("a.md", "b.md")}, {("a.md", "b.md"), ("a.md", "c.md")}, set(), {("d.md", "c.md")}]
    for i, (step, edges) in enumerate(zip(steps, want)):
        n = notes(*step).withColumn("ts", F.lit(at(i)))
        n.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(n.schema).parquet(str(tmp_path / "in"))
        changes.maintain_edges(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert {(r.path, r.target_path) for r in changes.read_edges(spark, str(tmp_path / "out")).collect()} == edges


def test_vault_sources(spark, tmp_path):
    root = tmp_path / "vault"
    (root / "Sub dir").mkdir(parents=True)
    (root / "b.md").write_text("B")
    (root / "Sub dir" / "a.excalidraw.md").write_text("A")
    (root / "x.pdf").write_bytes(b"pdf")
    rows = vault.read_notes(spark, str(root)).orderBy("ord").collect()
    assert [(r.path, r.basename, r.content, r.is_drawing) for r in rows] == [("Sub dir/a.excalidraw.md", "a.excalidraw", "A", True), ("b.md", "b", "B", False)]
    files = vault.read_attachments(spark, str(root), "*.pdf")
    import hashlib

    assert files.first().sha256 == hashlib.sha256(b"pdf").hexdigest()
    asked = spark.createDataFrame([("n1", "x.pdf"), ("n2", "y.pdf")], "path string, pdf string")
    assert {r.path: r.attachment_exists for r in vault.attachment_flags(asked, files).collect()} == {"n1": True, "n2": False}


def test_sinks(spark, tmp_path):
    target = str(tmp_path / "notes")
    make = lambda rows: spark.createDataFrame(rows, "path string, content string")
    sinks.write_notes(make([("a.md", "1"), ("b.md", "1")]), target)
    sinks.write_notes(make([("a.md", "2"), ("c.md", "2")]), target)
    assert {(r.path, r.content) for r in sinks.read_notes_table(spark, target).collect()} == {("a.md", "2"), ("b.md", "1"), ("c.md", "2")}
    base = make([("a.md", "1"), ("b.md", "1")])
    sinks.write_changed(base, make([("a.md", "9")]), str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    sinks.write_changed(base, make([("a.md", "9")]), str(tmp_path / "wet"))
    assert {(r.path, r.content) for r in spark.read.parquet(str(tmp_path / "wet")).collect()} == {("a.md", "9"), ("b.md", "1")}
    words = spark.createDataFrame([("alpha",), ("beta 9.",)], "word string")
    sinks.write_vocabulary(words, str(tmp_path / "words"))
    assert {(r.word, r.score) for r in dims.read_vocabulary(spark, str(tmp_path / "words")).collect()} == {("alpha", 3.0), ("beta", 3.0)}
    raw = tmp_path / "raw"
    raw.mkdir()
    for i in range(5):
        (raw / f"f{i}").write_bytes(bytes([i]) * i)  # the first one is empty
    assert sinks.compact_archive(spark, str(raw), str(tmp_path / "archive"), 2) == 5
    assert not raw.exists() and {(r.path, bytes(r.content)) for r in spark.read.parquet(str(tmp_path / "archive")).collect()} == {(f"f{i}", bytes([i]) * i) for i in range(5)}
    # another rewrite of the same corpus touches its own prefixes only, a moved note leaves its old place
    moved = spark.createDataFrame([("b.md", "c/b.md", "8")], "path string, new_path string, content string")
    sinks.write_changed(base, moved, str(tmp_path / "wet"))
    assert {(r.path, r.content) for r in spark.read.parquet(str(tmp_path / "wet")).collect()} == {("a.md", "9"), ("c/b.md", "8")}


def test_note_files(spark, tmp_path):
    """A version is seen whole or not at all; a write that fails leaves the one before."""
    target = str(tmp_path / "files")
    make = lambda rows: spark.createDataFrame(rows, "path string, content string").repartition(3)
    files.write_note_files(make([("a b.md", "é"), ("d/e/c.md", None), ("x.txt", "no note")]), target)
    first = files.current_version(target)
    assert first[1:] == (3, 9)
    assert {(r.path, r.content) for r in vault.read_notes(spark, first[0]).collect()} == {("a b.md", "é"), ("d/e/c.md", "")}
    with pytest.raises(Exception, match="below a folder"):
        files.write_note_files(make([("ok.md", "1"), ("../out.md", "2")]), target)
    assert files.current_version(target) == first and not (tmp_path / "out.md").exists()
    assert [p.name for p in (tmp_path / "files").iterdir() if p.is_dir()] == [first[0].rsplit("/", 1)[1]]
    files.write_note_files(make([("a b.md", "2")]), target)
    assert files.current_version(target)[1:] == (1, 1)


def test_watch_config_and_corrections(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"jobs":[{"notebook_id":"n","artifact_type":"report","output_path":"/o"},{"notebook_id":"","artifact_type":"x"},{"notebook_id":"n","artifact_type":"bad","output_path":"o"}],"poll_interval_seconds":0}')
    rows = dims.watch_jobs(spark, str(tmp_path / "w.json")).collect()
    assert [r.error for r in rows] == [None, "missing-notebook-id", "invalid-artifact-type"] and rows[0].poll_interval_seconds == 1 and rows[0].output_format == "json"
    (tmp_path / "c.txt").write_text("a:b\nbad\n:x\nb: c:d \n")
    got = dims.read_corrections(spark, str(tmp_path / "c.txt"))
    assert {(r.wrong, r.right) for r in got.collect()} == {("a", "b"), ("b", "c:d")}
    ordered = spark.createDataFrame([(0, "a", "b"), (1, "b", "c")], "pos int, wrong string, right string")
    assert speech.correct(spark.createDataFrame([("aab",)], "text string"), ordered).first().text == "ccc"


def test_phrase_hits_match_a_loop(spark):
    """One automaton, and one for nearly every phrase, find what a loop over all phrases and texts finds; the case of a phrase's first letter decides."""
    rnd = random.Random(4)
    texts = [("p", "body", "The Party of 数据治理 in Q4"), ("q", "title", "nothing"), ("r", "body", None), ("s", "body", ""), ("t", "body", "aAbB" * 50000 + "İstanbul end")]
    texts += [(f"x{i}", "body", "".join(rnd.choice("abAB数据 é") for _ in range(200))) for i in range(30)]
    phrases = ["art", "数据", "治理x", "Q4", "thing", "in", "Art", " in ", "", "é", "1", "bbaabb", "İst", "END", "End"]
    phrases += ["".join(rnd.choice("abAB数据 é") for _ in range(rnd.randint(1, 5))) for _ in range(80)]
    want = {
        (p, s, w.strip(" ")) for p, s, t in texts for w in phrases
        if w.strip(" ") and t and (w.strip(" ").lower() in t.lower() if re.match("[A-Za-z]", w.strip(" ")) else w.strip(" ") in t)}
    t = spark.createDataFrame(texts, "path string, source string, text string")
    w = spark.createDataFrame([(x,) for x in phrases], "phrase string")
    for limit in (1 << 20, 200):
        got = [tuple(r) for r in suggest.phrase_hits(t, w, limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert suggest.phrase_hits(t, w.where("false")).count() == 0


def test_suggestions(spark, notes):
    n = notes(
        ("Lab/实验设计.md", "---\ntags: [known]\n---\n# 感官美学\nA survey of 数据治理 work, see [[other]]\n"), ("Lab/other.md", "---\ntags: [Ctx-Tag]\naliases: [Espresso]\n---\nbody #known"),
    )
    alias = spark.createDataFrame([("数据治理", "data governance")], "canonical string, alias string")
    rows = {r.tag: r for r in suggest.suggest_tags(n, alias, dims.default_facets(spark)).where("path = 'Lab/实验设计.md'").collect()}
    assert "known" not in rows and rows["experiment"].kind == "facet-tag" and rows["experiment"].facet == "method"
    # the term 实验 stands in the title only: 54 + 4 + 10
    assert rows["experiment"].score == 68 and rows["数据治理"].kind == "alias" and rows["数据治理"].score == 50
    assert rows["Ctx-Tag"].score >= 24 and rows["感官美学"].bucket == "primary"


def test_redundant_terms_match_greedy_loop(spark):
    terms = [("ab", 30), ("abc", 28), ("xabcx", 28), ("zz", 25), ("z", 20), ("q", 10), ("abzz", 9)]
    df = spark.createDataFrame([("p", t, s, ["body"], 2) for t, s in terms], "path string, term string, score long, sources array<string>, occurrences long")
    kept = []
    for t, s in sorted(terms, key=lambda x: (-x[1], x[0])):
        if not any((t in a and b >= s - 2) or (a in t and s <= b + 2) for a, b in kept):
            kept.append((t, s))
    assert sorted((r.term, r.score) for r in suggest.without_redundant(df).collect()) == sorted(kept)
    # of equal scores the first in Chinese order (guan before shu) stays
    tied = spark.createDataFrame([("p", t, 20, ["body"], 2) for t in ("数据管理", "管理")], df.schema)
    assert [r.term for r in suggest.without_redundant(tied).collect()] == ["管理"]


def test_link_candidates_match_brute_force(spark, notes):
    n = notes(*[(f"d/n{i}.md", f"---\ntags: [t{i % 3}, u{i % 2}]\nsupports: [n{i + 1}]\n---\nx") for i in range(12)])
    asked = spark.createDataFrame([("r1", "d/n0.md", ""), ("r2", "d/n0.md", "n1"), ("r3", None, "t2")], "request_id string, path string, query string")
    recent = spark.createDataFrame([("r1", 1, "d/n5.md")], "request_id string, rank int, target string")
    got = {(r.request_id, r.path): r.score for r in rank.link_candidates(n, asked, recent=recent, block=2).collect()}

    def points(field, q):
        pos = -1
        for ch in q:
            pos = field.find(ch, pos + 1)
            if pos < 0:
                return 0
        return 100 if field == q else 45 if q in field else 25

    for i in range(12):
        shared = 8 * ((i % 3 == 0) + (i % 2 == 0))
        if i:
            assert got[("r1", f"d/n{i}.md")] == 10 + shared + (16 if i == 1 else 0) + (18 if i == 5 else 0)
        fields = [f"n{i}", f"n{i}.md", f"d/n{i}.md", f"t{i % 3}", f"u{i % 2}"]
        s3 = sum(points(f, "t2") for f in fields)
        assert got.get(("r3", f"d/n{i}.md"), 0) == s3
        if i:
            s2 = sum(points(f, "n1") for f in fields) + shared + (16 if i == 1 else 0)
            assert got.get(("r2", f"d/n{i}.md"), 0) == s2


def test_nearest_matches_brute_force(spark):
    """Every vector asks; copies, zero, null and shorter vectors are among them, and clusters are split over several blocks."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8)) * 4
    m = [[float(np.float32(x)) for x in centres[i % 12] + rng.normal(size=8)] for i in range(700)]
    m += [m[0]] * 30 + [[0.0] * 8, None, [1.0, 2.0], [2.0, 1.0], [1.0, None], [float("nan")] * 8]
    rows = [(i, x, "Archive/Imports/x" if i == 3 else "n") for i, x in enumerate(m)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, path string")
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("own_id"), "embedding")
    got = {}
    for r in semantic.nearest(v, asked, k=4).collect():
        got.setdefault(int(r.query_id), []).append((r.rank, r.vec_id))
    fine = [i for i, x in enumerate(m) if x and None not in x and any(x) and not np.isnan(x[0])]
    unit = {i: np.array(m[i]) / np.linalg.norm(m[i]) for i in fine}
    for i in fine:
        others = sorted((-float(round(unit[i] @ unit[j], 12)), j) for j in fine if j not in (i, 3) and len(m[i]) == len(m[j]))[:4]
        assert [j for _, j in sorted(got[i])] == [j for _, j in others]
    assert set(got) == set(fine)


def test_search_leaves_clusters_out(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 6
    m = (centres[np.arange(2000) % 20] + rng.normal(size=(2000, 16))).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, embedding array<float>").repartition(3)
    index = vectors.build_index(df, 5)
    got = {}
    for r in vectors.search(index, df, 5).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"]))
    unit = m.astype("float64") / np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    best = np.argsort(-(unit @ unit.T), axis=1, kind="stable")[:, :5]
    assert all([j for _, j in sorted(got[i])] == list(best[i]) for i in range(2000))
    assert vectors.pairs_scored(index, df, 5) < 2000 * 2000 / 4
    assert vectors.build_index(df.where("false"), 5) is None


def test_levels_and_recall(spark):
    clips = spark.createDataFrame([("a", [0.5, -0.5]), ("b", [])], "clip_id string, samples array<float>")
    rows = {(r.clip_id, r.gain_db): r for r in speech.level_sweep(clips, [0, 20]).collect()}
    assert abs(rows[("a", 0)].dbfs + 6.0206) < 1e-3 and rows[("a", 20)].rms == 1.0 and rows[("b", 0)].dbfs == float("-inf")
    assert pd.Series([1]).sum() == 1


def test_feeds(spark):
    item = '[{"id":"1","modelType":"note","index":0,"noteCard":{"type":"video","displayTitle":"t","user":{"userId":"u","nickName":"N"},"interactInfo":{"likedCount":"12"}}}]'
    r = feeds.feed_items(spark.createDataFrame([(item,)], "value string")).first()
    assert (r.feed_id, r.nickname, r.liked_count) == ("1", "N", 12)
    detail = '{"n1":{"note":{"noteId":"n1","title":"T","time":0},"comments":{"list":[{"id":"c","likeCount":"3","subComments":[{"id":"d","likeCount":"x","subComments":[]}]}]}}}'
    d = feeds.feed_details(spark.createDataFrame([(detail,)], "value string"))
    roll = feeds.comment_rollup(feeds.flatten_comments(d)).first()
    assert (roll.comments, roll.sub_comments, roll.likes, roll.bad_counts) == (1, 1, 3, 1)
    assert note_facts is not None


def test_write_notes_with_digits_as_prefix(spark, tmp_path):
    """Stored prefixes of digits only stay text, and a key that comes twice in a batch is stored once."""
    import hashlib

    from marginalia.sinks.notes import read_notes_table, write_notes

    keys = [k for k in (f"n{i}.md" for i in range(400)) if hashlib.sha1(k.encode()).hexdigest()[:2].isdigit()][:4]
    target = str(tmp_path / "digits")
    write_notes(spark.createDataFrame([(k, "a") for k in keys], "path string, content string"), target)
    write_notes(spark.createDataFrame([(keys[0], "b"), (keys[0], "c")], "path string, content string"), target)
    assert {r.path: r.content for r in read_notes_table(spark, target).collect()} == {k: "c" if k == keys[0] else "a" for k in keys}
    assert read_notes_table(spark, target).count() == len(keys)


def test_note_files_follow_prefixes_not_tasks(spark, tmp_path):
    """One file for each prefix of a small table, however many tasks hold its rows."""
    from marginalia.sinks.notes import write_changed, write_notes

    rows = spark.range(2000).select(F.concat(F.lit("n"), F.col("id"), F.lit(".md")).alias("path"), F.lit("x").alias("content")).repartition(4)
    files = lambda name: sum(1 for p in (tmp_path / name).rglob("*.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):
            write_notes(rows, str(tmp_path / "notes"))
            assert files("notes") <= 256
        write_changed(rows, rows.limit(1), str(tmp_path / "corpus"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files("corpus") <= 256
    for name in ("notes", "corpus"):
        assert spark.read.parquet(str(tmp_path / name)).select("path").distinct().count() == 2000


def test_edge_maintenance_keeps_no_text(spark, notes, tmp_path, monkeypatch):
    """Texts are read where they lie; only keys and targets are stored and shuffled. The latest version of a batch counts, and a deleted one has no edges."""
    seen = []
    monkeypatch.setattr(changes, "settle", lambda df: (seen.extend(df.columns), df.localCheckpoint())[1])
    old = notes(("a.md", "[[b]]"), ("b.md", "[[a]]"), ("c.md", "[[a]]")).withColumns({"ts": F.lit(at(0)), "deleted": F.lit(False)})
    new = notes(("a.md", "[[c]] and <<b:1>>"), ("b.md", "[[a]]")).withColumns({"ts": F.lit(at(9)), "deleted": F.col("path") == "b.md"})
    none = notes(("c.md", "")).withColumns({"ts": F.lit(at(3)), "deleted": F.lit(None).cast("boolean"), "content": F.lit(None).cast("string")})
    old.unionByName(new).unionByName(none).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(old.schema).parquet(str(tmp_path / "in"))
    changes.maintain_edges(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {(r.path, r.target_path) for r in changes.read_edges(spark, str(tmp_path / "out")).collect()} == {("a.md", "c.md")}
    assert seen and "content" not in seen
