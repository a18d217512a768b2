"""Benchmark passages in training texts, by a distributed positional inverted index.

``build_index`` stores the postings of all tokens: each row is the index of one block of documents, its terms sorted, the positions of each
term sorted. ``match`` takes benchmark windows to every row; a window starts from the postings of its rarest term there, moved by the
term's place in the window, and is intersected with the moved postings of its other terms from rare to frequent. Texts are read once;
the stored index answers any number of benchmarks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.settle import settle
from .textwords import blocks, separators

WORD_BYTES = "0123456789abcdefghijklmnopqrstuvwxyz"
INDEX_BLOCK = 1 << 23
BENCHMARK_WORDS = 1_000_000


def _index():
    table = separators(WORD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for block in blocks(batch.column("text"), table, lower=True, limit=INDEX_BLOCK):
                words = block.hashes()
                order = np.argsort(words, kind="stable")
                ranked = words[order]
                at = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
                own = ids.slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([block.first.astype(np.int64).tobytes()]),
                    pa.array([ranked[at].tobytes()]), pa.array([np.append(at, len(ranked)).astype(np.int32).tobytes()]), pa.array([order.astype(np.int32).tobytes()]),
                ], names=["doc_ids", "first", "terms", "offsets", "positions"])

    return run


def build_index(docs: DataFrame) -> DataFrame:
    """The positional index of all words of all documents, written to the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _index(), f"doc_ids array<{kind}>, first binary, terms binary, offsets binary, positions binary")
    return settle(index)


def _windows(benchmark: DataFrame, size: int, most: int) -> Iterator[tuple[list[np.ndarray], list[list[str | None]]]]:
    """Distinct windows with their items, in blocks of at most ``most`` words, so the driver never holds a whole large benchmark."""
    table = separators(WORD_BYTES)
    found: dict[bytes, set] = {}
    words = 0

    def block() -> tuple[list[np.ndarray], list[list[str | None]]]:
        return [np.frombuffer(w, np.uint64) for w in found], [list(s) for s in found.values()]

    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in rows.toLocalIterator():
        for piece in blocks(pa.array([row.text], pa.string()), table, lower=True):
            hashes = piece.hashes()
            n = len(hashes)
            for i in range(max(1, n - size + 1) if n else 0):
                found.setdefault(hashes[i : i + size].tobytes(), set()).add(row.item_id)
                words += min(size, n)
            if words >= most:
                yield block()
                found, words = {}, 0
    if found:
        yield block()


def _match(windows: list[np.ndarray], items: list[list[str | None]], slop: int):
    lengths = np.array([len(w) for w in windows])
    vocabulary, flat = np.unique(np.concatenate(windows), return_inverse=True)
    begin = np.cumsum(lengths) - lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits_out, pairs_out, near_out = [], [], []
            for r in range(batch.num_rows):
                get = lambda c, t: np.frombuffer(batch.column(c)[r].as_buffer(), t)  # noqa: E731, B023
                first, terms, offsets, positions = get("first", np.int64), get("terms", np.uint64), get("offsets", np.int32), get("positions", np.int32)
                hits = np.unpackbits(get("hits", np.uint8)).astype(np.int64)[: len(positions)] if batch.column("hits")[r].is_valid else np.zeros(len(positions), np.int64)
                pairs = set(batch.column("pairs")[r].as_py() or [])
                near_pairs = set(batch.column("near")[r].as_py() or [])
                if len(terms):
                    place = np.minimum(np.searchsorted(terms, vocabulary), len(terms) - 1)
                    place[terms[place] != vocabulary] = -1
                    count = np.where(place < 0, 0, offsets[place + 1] - offsets[place])
                    least = np.minimum.reduceat(count[flat], begin)
                    posts = lambda v: positions[offsets[place[v]] : offsets[place[v] + 1]]  # noqa: E731, B023
                    for w in np.flatnonzero(least):
                        term = flat[begin[w] : begin[w] + lengths[w]]
                        order = np.argsort(count[term], kind="stable")
                        start = posts(term[order[0]]).astype(np.int64)
                        doc = np.searchsorted(first, start, "right") - 1
                        reach = lengths[w] - 1 + slop
                        near = np.ones(len(start), bool) if slop else None
                        if slop:  # all terms of the window close to its rarest one
                            for o in order[1:]:
                                p = posts(term[o])
                                lo = np.maximum(start - reach, first[doc])
                                at = np.searchsorted(p, lo)
                                ok = at < len(p)
                                ok[ok] = p[at[ok]] < np.minimum(start[ok] + reach + 1, first[doc[ok] + 1])
                                near &= ok
                                if not near.any():
                                    break
                            near_pairs.update(f"{d}:{i}" for d in np.unique(doc[near]).tolist() for i in items[w] if i is not None)
                        start = start - order[0]
                        start = start[(start >= first[doc]) & (start + lengths[w] <= first[doc + 1])]
                        for o in order[1:]:
                            if not len(start):
                                break
                            p = posts(term[o])
                            at = np.minimum(np.searchsorted(p, start + o), len(p) - 1)
                            start = start[p[at] == start + o]
                        if len(start):
                            hits[start[:, None] + np.arange(lengths[w])] = 1
                            pairs.update(f"{d}:{i}" for d in np.unique(np.searchsorted(first, start, "right") - 1).tolist() for i in items[w] if i is not None)
                hits_out.append(np.packbits(hits.astype(np.uint8)).tobytes())
                pairs_out.append(sorted(pairs))
                near_out.append(sorted(near_pairs))
            keep = [batch.column(c) for c in ("doc_ids", "first", "terms", "offsets", "positions")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(hits_out, pa.binary()), pa.array(pairs_out, pa.list_(pa.string())), pa.array(near_out, pa.list_(pa.string()))],
                                             names=["doc_ids", "first", "terms", "offsets", "positions", "hits", "pairs", "near"])

    return run


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            first = np.frombuffer(batch.column("first")[r].as_buffer(), np.int64)
            ids = batch.column("doc_ids")[r].values
            total = int(first[-1]) if len(first) else 0
            hits = np.zeros(total + 1, np.int64)
            if batch.column("hits")[r].is_valid:
                np.cumsum(np.unpackbits(np.frombuffer(batch.column("hits")[r].as_buffer(), np.uint8))[:total], out=hits[1:])
            lists = {"pairs": [[] for _ in range(len(ids))], "near": [[] for _ in range(len(ids))]}
            for name, out in lists.items():
                for pair in batch.column(name)[r].as_py() or []:
                    d, _, item = pair.partition(":")
                    out[int(d)].append(item)
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), pa.array(hits[first[1:]] - hits[first[:-1]]), pa.array([sorted(x) for x in lists["pairs"]], text), pa.array([sorted(x) for x in lists["near"]], text)],
                                             names=["doc_id", "n_words", "n_hit", "items", "near_items"])


def match(index: DataFrame, benchmark: DataFrame, size: int = 13, slop: int = 3, most: int = BENCHMARK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (with an exact window) and near_items (with a window whose words all stand close to its rarest word, within the
    window's length and ``slop``), sorted. The benchmark goes through in blocks of ``most`` words, each one more pass over the stored index."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    state = index.select("*", F.lit(None).cast("binary").alias("hits"), F.lit(None).cast("array<string>").alias("pairs"), F.lit(None).cast("array<string>").alias("near"))
    for windows, items in _windows(benchmark, size, most):
        state = state.mapInArrow(_match(windows, items, slop), state.schema)
    return state.mapInArrow(_per_document, f"doc_id {kind}, n_words long, n_hit long, items array<string>, near_items array<string>")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, slop: int = 3) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, near_items.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored. Null and empty texts have no words and no hits; a
    benchmark item of fewer than ``size`` words is one window; an item without words or an empty benchmark hits nothing; an item without an
    id hits words but is not listed. Repeated rows each come back.
    """
    found = match(build_index(docs), benchmark, size, slop)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items", "near_items",
    )
