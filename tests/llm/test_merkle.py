import hashlib
import random
import zlib

import pytest

from marginalia.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text=None):
    row = row[:4] + (row[4] if text is None else text,)
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def climb(digests, at, claimed, arity):
    """Root, siblings from the bottom and folded digest of one place."""
    path = []
    while len(digests) > 1:
        lo = at // arity * arity
        run = digests[lo : lo + arity]
        path += run[: at - lo] + run[at - lo + 1 :]
        claimed = h(*run[: at - lo], claimed, *run[at - lo + 1 :])
        digests, at = [h(*digests[i : i + arity]) for i in range(0, len(digests), arity)], at // arity
    return digests[0], path, claimed


def plain(rows, arity=8):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    tops = [climb([leaf(r) for r in trees[x]], 0, "", arity)[0] for x in langs]
    out = []
    for i, x in enumerate(langs):
        for at, r in enumerate(trees[x]):
            third = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            told = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if third else None
            top, low, folded = climb([leaf(q) for q in trees[x]], at, leaf(r, told), arity)
            root, high, folded = climb(tops, i, folded, arity)
            out.append((r[0], leaf(r), top, root, h(*low, *high), folded, folded == root))
    return sorted(out, key=repr)


def table(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    path = str(tmp_path / f"m{random.getrandbits(40)}")
    df.selectExpr("*", "'x' AS leaf", "1 AS tree", "2 AS at", "'y' AS root", "3 AS n", "4 AS group").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("arity, langs", [(8, 3), (2, 12)])
def test_manifest(spark, tmp_path, arity, langs):
    rnd = random.Random(arity)
    names = [None, "", "é", "z", "Z", *(f"l{i}" for i in range(20))][:langs]
    rows = [(i, rnd.choice(["s", None]), rnd.choice(names), rnd.choice([None, i]), rnd.choice(["Some Text", "low", "", None, "É x"])) for i in range(90)]
    rows += [(7, "s", names[0], 1, "Same")] * 3 + [(None, None, None, None, None), (None, "", "only", 0, "One Leaf"), (200, "s", names[1], 5, "Long " * 500000)]
    got = merkle.manifest(table(spark, tmp_path, rows), merkle.lowered_third(), arity).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain(rows, arity)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "A")], [(i, "s", "en", 1, "A") for i in range(9)]])
def test_small_tables(spark, tmp_path, rows):
    got = merkle.manifest(table(spark, tmp_path, rows), merkle.lowered_third()).collect()
    assert sorted((tuple(r) for r in got), key=repr) == (plain(rows) if rows else [])


def test_row_limit_stays(spark, tmp_path):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    assert merkle.manifest(table(spark, tmp_path, [(1, "s", "en", 1, "A")] * 3)).where("NOT verified").count() == 0
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
