import hashlib
import itertools
import random

import pytest

from marginalia.llm import dialogue

from . import brute

NOTHING = hashlib.sha256(b"").hexdigest()


def reported(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def table(spark, tmp_path, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)
    df = df.selectExpr("*", "'x' AS conv", "1 AS at", "'y' AS place", "true AS rid", "2 AS n")
    path = str(tmp_path / f"c{random.getrandbits(40)}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def expected(rows):
    made = brute.repair(brute.damaged(rows))
    return {c: made.get(c, (0, 0, 0, 0, 0, 0, "", NOTHING)) for c in {r[0] for r in rows}}


def some_rows(rnd, convs, longest):
    texts = ["Yes.", "No", "Well!", "", "  ", "Why?\n", "so so", "é…", None]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    out = []
    for c in convs:
        for t in range(rnd.randint(1, longest)):
            out.append((c, rnd.choice([t, t, t, t + 1, None]), rnd.choice(roles[:2] * 4 + roles), rnd.choice(texts) if rnd.random() < 0.5 else f"Word {rnd.randint(0, 999)}."))
    return out


@pytest.mark.parametrize("codes", ["".join(c) for k in range(4) for c in itertools.product("suaxSUq", repeat=k)][::7])
def test_search_proves_the_best(codes):
    faults = {"q": "blank", "S": "truncated", "U": "truncated"}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool", "q": "user"}
    cost, audit, state = dialogue.search(codes, 0, dialogue._END)
    want = brute.cheapest_edits([(names[c.lower()], "t", faults.get(c, "")) for c in codes])
    assert (cost, audit + "I" * (dialogue._END[state] // 2)) == want[:2]


@pytest.mark.parametrize("segment, fan", [(256, 64), (3, 2), (1, 3)])
def test_repair(spark, tmp_path, monkeypatch, segment, fan):
    """Short segments and spans put every conversation through the scans."""
    monkeypatch.setattr(dialogue, "SEGMENT", segment)
    monkeypatch.setattr(dialogue, "FAN", fan)
    rows = some_rows(random.Random(segment), [*range(40), None], 14)
    rows += [(50, 1, "user", "Twice.")] * 3 + [(51, None, "user", "A"), (51, None, "assistant", "B.")]
    assert reported(dialogue.repair_damaged(table(spark, tmp_path, rows))) == expected(rows)


def test_long_conversation_and_text(spark, tmp_path, monkeypatch):
    """A conversation with nearly all rows is digested from blocks; a text of two million characters is judged to its end."""
    monkeypatch.setattr(dialogue, "_BLOCK", 200)
    rows = some_rows(random.Random(5), [1] * 1, 10) + some_rows(random.Random(6), [2], 2)
    rows += [(7, t, ["user", "assistant"][t % 2], f"Turn {t} of many." if t % 11 else "cut") for t in range(1500)]
    rows += [(8, 0, "user", "long " * 400000 + "end."), (8, 1, "assistant", "long " * 400000 + "end")]
    assert reported(dialogue.repair_damaged(table(spark, tmp_path, rows, 5))) == expected(rows)


def test_lines_and_empty_table(spark, tmp_path):
    rows = [(1, 0, "user", "Hello there."), (1, 1, "user", "More."), (1, 2, "assistant", "Fine.")]
    report, lines = dialogue.repair(table(spark, tmp_path, rows))
    assert [(r.cost, r.audit, r.illegal) for r in report.collect()] == [(2, "KIKK", 1)]
    assert [(r.role, r.text) for r in lines.orderBy("place").collect()] == [("user", "Hello there."), ("assistant", ""), ("user", "More."), ("assistant", "Fine.")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair_damaged(empty).count() == 0
