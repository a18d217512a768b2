"""Supervised subword embeddings: a text is the mean of the vectors of its hashed words, word pairs and character n-grams; a softmax over that
mean gives the class. Vectors and output weights are learned together by numpy stochastic gradient descent.

Training sees at most ``sample`` labelled texts, those with the smallest hash of their id; scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .textwords import Block, blocks, mix, separators

NGRAMS = (3, 4)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 12
    rate: float = 0.5
    sample: int = 4000
    seed: int = 7


def _features(block: Block, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word, word pair and n-gram of the block's words, and how many each text has, text by text."""
    words = block.hashes()
    of = block.of_words()
    lengths = block.ends - block.starts
    parts, owners = [(words % np.uint64(buckets)).astype(np.int32)], [of]
    if len(words) > 1:  # word pairs; a word after itself is the same pair whatever the word
        with np.errstate(over="ignore"):
            pairs = mix(words[1:] * np.uint64(3) + words[:-1])
        pairs[words[1:] == words[:-1]] = 1
        inside = of[1:] == of[:-1]
        parts.append((pairs[inside] % np.uint64(buckets)).astype(np.int32))
        owners.append(of[1:][inside])
    data = block.data.astype(np.uint64)
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            if len(data) < n:
                continue
            grams = np.zeros(len(data) - n + 1, np.uint64)
            for i in range(n):
                grams = grams * np.uint64(257) + data[i : len(data) - n + 1 + i]
            size = np.maximum(lengths - n + 1, 0)
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - block.starts, size)
            parts.append((mix(grams[at] + np.uint64(n << 56)) % np.uint64(buckets)).astype(np.int32))
            owners.append(np.repeat(of, size))
    return np.concatenate(parts), np.concatenate(owners)


def _bags(buckets: int):
    table = separators()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for block in blocks(batch.column("text"), table, limit=1 << 20):
                feature, owner = _features(block, buckets)
                code, count = np.unique(owner * buckets + feature, return_counts=True)
                cut = np.searchsorted(code, np.arange(len(block.rows) + 1) * buckets)
                for i in range(len(block.rows)):
                    part = slice(cut[i], cut[i + 1])
                    bags.append(np.column_stack([code[part] % buckets, count[part]]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(bags, pa.binary())], names=["label", "bag"])

    return run


def _learn(bags: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Gradient descent text by text, rate falling to zero, rarer class weighted up. Returns the difference of the two logits for every bucket
    and its constant: the output layer is linear in the mean, so each bucket's vector adds a fixed amount."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim))
    out, bias = np.zeros((s.dim, 2)), np.zeros(2)
    share = np.array([max(1, (labels == c).sum()) for c in (0, 1)]) / max(1, len(labels))
    weight = 0.5 / share
    steps, step = s.epochs * len(bags), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(bags)):
            rate = s.rate * (1 - step / steps)
            step += 1
            ids, share_of = bags[i][:, 0], bags[i][:, 1] / max(1, bags[i][:, 1].sum())
            mean = share_of @ vectors[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            vectors[ids] -= rate * np.outer(share_of, back)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Learn from labelled rows. ``labels`` has doc_id and label (0 or 1); other labels and null ids are left out. Without rows of both
    classes the score is the same for every text: the share of class 1, a half without rows."""
    rows = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    picked = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(settings.sample)  # bounded, so it may be broadcast
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    got = texts.select("label", "text").mapInArrow(_bags(settings.buckets), "label int, bag binary").collect()
    got.sort(key=lambda r: (r.label, r.bag))  # the order of rows must not decide
    known = np.array([r.label for r in got], np.int64)
    if len(set(known.tolist())) < 2:
        share = min(max(float(known.mean()), 1e-3), 1 - 1e-3) if len(known) else 0.5
        return np.zeros(settings.buckets, np.float32), float(np.log(share / (1 - share)))
    return _learn([np.frombuffer(r.bag, np.int32).reshape(-1, 2) for r in got], known, settings)


def _scores(table: np.ndarray, constant: float):
    cuts = separators()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for block in blocks(batch.column("text"), cuts, limit=1 << 20):
                feature, owner = _features(block, len(table))
                n = np.bincount(owner, minlength=len(block.rows))
                total = np.bincount(owner, weights=table[feature], minlength=len(block.rows))
                out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + constant, -700, 700))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, SCORE])

    return run


SCORE = "__score"


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """All rows and columns of ``docs`` (text is needed) and a column ``SCORE``, 0 to 1, higher for class 1. Null and empty texts get the constant
    alone."""
    return docs.mapInArrow(_scores(*model), StructType([*docs.schema.fields, StructField(SCORE, DoubleType())]))


def held_out(doc_id: str | Column = "doc_id", parts: int = 3, part: int = 1) -> Column:
    """True for rows kept from training: crc32 of the id as text leaves ``part``. A null id counts as held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts == part, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learns from ``labels`` (doc_id, quality) that are not held out.

    Only doc_id and text of ``docs`` are read. Null and empty texts, repeated rows and null ids each get a row; ties at 0.5 count as 1;
    empty tables give an empty result.
    """
    seen = labels.select("doc_id", F.col("quality").alias("label")).where(~held_out())
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, seen, settings))
    return scored.select("doc_id", held_out().alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= 0.5).cast("int").alias("predicted"))
