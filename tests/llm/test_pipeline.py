import random

import corpus_pipeline
from marginalia.llm import pieces, pii, quality

from . import brute

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    """Every stage against its plain version, on documents with edge cases and an extra column."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in source.collect()]
    rnd = random.Random(1)
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = next(r for r in rows if r[2] == "en" and 500 < len(r[1]) < 3000)
    rows += [(9001, None, "en", "s", 0), (9002, "", None, None, None), (None, plain[1] + " some more words at the end", "en", "s", 1), (9003, plain[1], "en", "s", 1), (9003, plain[1], "en", "s", 1),
             (9004, " ".join(rnd.choice(bench)[1] for _ in range(3)), "en", "s", 1), (9005, plain[1][::2].replace("@", "") + " who@where.example.com", "en", "s", 1)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rid string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    def stage(i, docs):
        path = str(tmp_path / f"stage{i}")
        corpus_pipeline.STAGES[i][1](spark, docs, folder).write.parquet(path)
        return spark.read.parquet(path)

    def pairs(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    good = stage(0, docs)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = {(r.doc_id, r.predicted) for r in quality.classify(docs, labels).collect()}
    assert pairs(good) == [x for x in pairs(docs) if (x[0], 1) in judged] and good.columns == docs.columns
    single = stage(1, good)
    before = sorted(pairs(good), key=lambda x: (x[0] is None, x[0] or 0))
    seen, kept = set(), []
    for (d, t), g in zip(before, brute.components([brute.fingerprint(t) for _, t in before])):
        if g not in seen:
            seen.add(g)
            kept.append((d, t))
    assert pairs(single) == sorted(kept, key=repr) and single.columns == docs.columns
    clean = stage(2, single)
    want = [x for x, c in zip(pairs(single), brute.contamination(pairs(single), bench)) if not c[5]]
    assert pairs(clean) == want and not any(d == 9004 for d, _ in want)
    private = stage(3, clean)
    assert private.columns == docs.columns and pairs(private) == pairs(pii.replace_entities(clean, pii.INVENTED))
    assert all("who@where" not in (t or "") for _, t in pairs(private))
    coded = stage(4, private)
    p = pieces.load()
    assert sorted(((r.doc_id, pieces.decode_ids(p, list(r.ids))) for r in coded.collect()), key=repr) == sorted(((d, t or "") for d, t in pairs(private)), key=repr)
    assert sorted((repr(r) for r in corpus_pipeline.run(spark, folder).collect())) == sorted(repr(r) for r in coded.collect())
    assert "pipeline" in __import__("__spark_entry__").queries()
