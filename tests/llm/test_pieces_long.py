import random

import numpy as np
import pyarrow as pa

from marginalia.llm import pieces


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def best_score(p, word):
    """Score of the best segmentation of one word with its leading mark, built from its start."""
    low = [0.0]
    for e in range(1, len(word) + 1):
        options = [low[s] + float(p.scores[p.known[word[s:e]]]) for s in range(max(0, e - p.longest), e) if word[s:e] in p.known]
        if word[e - 1 : e] not in p.known:
            options.append(low[e - 1] + p.unknown)
        low.append(max(options))
    return low[-1]


def test_long_words_and_repeated_words():
    """Scores of words up to hundreds of characters match a plain table; words kept from an earlier block give what they give alone."""
    p = pieces.load(pieces.MODEL)
    rnd = random.Random(8)
    words = ["".join(rnd.choice(["tion", "er", "é", "字", "x", "Q", "the"]) for _ in range(rnd.choice([1, 2, 5, 12, 60, 150]))) for _ in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(60)]
    together = [r for b in pieces._encode(p, 3)(iter([batch(texts[:30]), batch(texts[30:]), batch(texts)])) for r in b.to_pylist()]
    for text, row in zip(texts + texts, together):
        alone = next(pieces._encode(p, 3)(iter([batch([text])]))).to_pylist()[0]
        assert (row["ids"], row["others"]) == (alone["ids"], alone["others"])
        assert abs(row["score"] - sum(best_score(p, chr(pieces.SPACE) + w) for w in text.split(" "))) < 1e-6 * abs(row["score"])
        assert pieces.decode_ids(p, row["ids"]) == text


def test_long_runs_of_one_character():
    """Many equal scores: the search goes on towards the start instead of widening."""
    p = pieces.load(pieces.MODEL)
    text = "a" * (1 << 20)
    row = next(pieces._encode(p, 2)(iter([batch([text])]))).to_pylist()[0]
    assert pieces.decode_ids(p, row["ids"]) == text and len(row["others"]) == 1 and row["others"][0]["score"] <= row["score"]


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "_KEPT_WORDS", 50)
    p = pieces.load(pieces.MODEL)
    texts = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(40)]
    rows = [r for b in pieces._encode(p, 1)(iter([batch([t]) for t in texts])) for r in b.to_pylist()]
    assert [pieces.decode_ids(p, r["ids"]) for r in rows] == texts
    assert np.isfinite([r["score"] for r in rows]).all()
