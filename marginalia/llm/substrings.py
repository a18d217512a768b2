"""Removal of word windows that occur more than once, by level-wise doubling.

A window of ``size`` words can only repeat when the windows inside it do. So a quarter-length window is judged first, what
repeats there is extended to half length, and what repeats again is extended to the full length and compared there. A level
does not look at every position: from all short windows inside a full one it takes the one with the smallest hash (the first
of equals), the same choice in every copy. Each level therefore moves few rows: one per chosen short window, with the range of
full windows that chose it. The last level moves what is left window by window, each under its own hash, so no key gathers
different windows, however many documents share a line that is shorter than a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textwords import Block, blocks, mix, separators, window_hashes

_ROW = "k long, n int, rid long, lo int, span int, windows binary"
_FOUND = "rid long, lo int, mask binary"
_HELD = 1 << 20  # windows that one step of the last level holds


def _chosen(words: np.ndarray, first: np.ndarray, size: int, length: int, alive: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """Ranges of full windows that share their smallest short window: (hash, first window, number of windows)."""
    n = len(words) - size + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), empty, empty
    short = window_hashes(words, length, 0x2545F491 + 2 * length)
    reach = size - length + 1
    # first smallest hash of every reach, by doubling
    best = np.arange(len(short))
    width = 1
    while width < reach:
        step = min(width, reach - width)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(short[right] < short[left], right, left)
        width += step
    at = best[:n]
    ok = np.zeros(n, bool)
    counts = np.diff(first) - size + 1
    for a, c in zip(first[:-1][counts > 0], counts[counts > 0]):
        ok[a : a + c] = True
    if alive is not None:
        ok &= alive[:n]
    starts = np.flatnonzero(ok)
    if not len(starts):
        return np.zeros(0, np.uint64), empty, empty
    anchors = at[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (starts[1:] != starts[:-1] + 1)
    lo = np.flatnonzero(new)
    spans = np.diff(np.append(lo, len(starts)))
    return short[anchors[lo]], starts[lo], spans


def _lists(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _sliced(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Binary array of consecutive pieces of ``data``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.BinaryArray.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _ragged(starts: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """All indices of the ranges, one after the other."""
    total = int(spans.sum())
    begin = np.zeros(len(spans), np.int64)
    np.cumsum(spans[:-1], out=begin[1:])
    return np.arange(total) - np.repeat(begin - starts, spans)


def _alive(lists: pa.Array, block: Block, size: int) -> np.ndarray:
    """Flags of the block's full windows that the previous level left."""
    out = np.zeros(len(block.starts) + 1, bool)
    mine = lists.slice(block.rows.start, len(block.rows))
    pieces = mine.flatten()  # skips null lists
    if len(pieces):
        counts = np.nan_to_num(pc.list_value_length(mine).to_numpy(zero_copy_only=False)).astype(np.int64)
        sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        pairs = np.frombuffer(pieces.buffers()[2], np.int32, count=(int(offsets[-1]) - int(offsets[0])) // 4, offset=int(offsets[0])).reshape(-1, 2).astype(np.int64)
        base = np.repeat(np.repeat(np.asarray(block.first[: len(counts)]), counts), sizes)
        out[_ragged(base + pairs[:, 0], pairs[:, 1])] = True
    return out[:-1]


def _emit(size: int, length: int, full: bool):
    """Rows of one level; at the full one a row for each window, which keeps the short window that chose it for a second look. Equal rows of
    a batch are merged: their windows are known to repeat, so only one row without a place goes to the others, and the places travel
    under a key of their own, which spreads any hot window."""
    table = separators()

    def rows(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        key, rid, lo, span, packed = (np.concatenate(x) for x in zip(*parts))
        whole, kept = key, packed
        if full:
            kept, rid, lo = np.repeat(key, span), np.repeat(rid, span), _ragged(lo, span)
            key, whole, span = packed, mix(kept + mix(packed)), np.ones(len(packed), np.int64)
        _, one, inverse, count = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        repeated = count[inverse] > 1
        once = np.sort(one)
        known = np.flatnonzero(repeated)
        there = ~repeated[once]
        # rows to compare
        yield pa.RecordBatch.from_arrays([
            pa.array(key[once].view(np.int64)), pa.array(np.where(there, 1, 2).astype(np.int32)), pa.array(rid[once], mask=~there),
            pa.array(lo[once].astype(np.int32)), pa.array(span[once].astype(np.int32)), _sliced(kept[once] if full else kept, np.full(len(once), 8 if full else 0)),
        ], names=["k", "n", "rid", "lo", "span", "windows"])
        if len(known):  # places that are settled already, neighbours in one row
            rid, lo, span = rid[known], lo[known], span[known]
            new = np.ones(len(known), bool)
            new[1:] = (rid[1:] != rid[:-1]) | (lo[1:] != lo[:-1] + span[:-1])
            at = np.flatnonzero(new)
            rid, lo, span = rid[at], lo[at], np.add.reduceat(span, at)
            spread = mix(rid.astype(np.uint64) * np.uint64(31) + lo.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(spread), pa.array(np.zeros(len(at), np.int32)), pa.array(rid), pa.array(lo.astype(np.int32)),
                pa.array(span.astype(np.int32)), _sliced(packed[:0], np.zeros(len(at), np.int64)),
            ], names=["k", "n", "rid", "lo", "span", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            lists = batch.column("found") if "found" in batch.schema.names else None
            parts, held = [], 0
            for block in blocks(batch.column("text"), table):
                words = block.hashes()
                alive = None if lists is None else _alive(lists, block, size)
                key, lo, span = _chosen(words, block.first, size, length, alive)
                if not len(key):
                    continue
                doc = np.searchsorted(block.first, lo, "right") - 1
                packed = window_hashes(words, size, 0x5851F42D)[_ragged(lo, span)] if full else np.zeros(0, np.uint64)
                parts.append((key, rids[block.rows.start + doc], lo - block.first[doc], span, packed))
                held += len(packed)
                if held >= _HELD:
                    yield from rows(parts)
                    parts, held = [], 0
            if parts:
                yield from rows(parts)

    return run


def _pairs(lo: np.ndarray, span: np.ndarray) -> np.ndarray:
    return np.column_stack([lo, span]).astype(np.int32)


def _judge(full: bool):
    """Places whose windows repeat, as (document, first window and number of windows pairs). Rows come sorted by key; a key that
    continues in the next batch is held back."""

    def judged(t: pa.Table) -> pa.RecordBatch:
        k, n = t["k"].to_numpy(), t["n"].to_numpy()
        lo, span = t["lo"].to_numpy().astype(np.int64), t["span"].to_numpy().astype(np.int64)
        rid = t["rid"].fill_null(0).to_numpy()
        placed = ~np.asarray(t["rid"].is_null())
        known = n == 0
        cand = np.flatnonzero(~known)
        out_rid, out_lo, out_span = [rid[known]], [lo[known]], [span[known]]
        if len(cand):
            if full:
                column = t["windows"].take(pa.array(cand)).combine_chunks()
                column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
                values = np.frombuffer(b"".join(column.to_pylist()), np.uint64)
                spans = span[cand]
                row = np.repeat(np.arange(len(cand)), spans)
                _, inverse = np.unique(mix(values + mix(k[cand].view(np.uint64))[row]), return_inverse=True)
                total = np.bincount(inverse, weights=n[cand][row])
                hit = total[inverse] > 1
                start = np.repeat(lo[cand], spans) + _ragged(np.zeros(len(cand), np.int64), spans)
                keep = hit & placed[cand][row]
                row, start = row[keep], start[keep]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
                at = np.flatnonzero(new)
                out_rid.append(rid[cand][row[at]])
                out_lo.append(start[at])
                out_span.append(np.diff(np.append(at, len(row))))
            else:
                _, inverse = np.unique(k[cand], return_inverse=True)
                total = np.bincount(inverse, weights=n[cand])
                keep = cand[(total[inverse] > 1) & placed[cand]]
                out_rid.append(rid[keep])
                out_lo.append(lo[keep])
                out_span.append(span[keep])
        rid, lo, span = (np.concatenate(x) for x in (out_rid, out_lo, out_span))
        order = np.argsort(rid, kind="stable")
        rid, pairs = rid[order], _pairs(lo[order], span[order])
        at = np.flatnonzero(np.append(True, rid[1:] != rid[:-1])) if len(rid) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(at, len(rid))) * 8
        return pa.RecordBatch.from_arrays([pa.array(rid[at]), _sliced(pairs, lengths)], names=["rid", "piece"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column("k").to_numpy()
            cut = int(np.searchsorted(k, k[-1]))  # the last key may go on
            if cut == 0 and held and held[-1].column("k")[-1].as_py() == k[-1]:
                held.append(batch)
                continue
            held.append(batch.slice(0, cut))
            if sum(b.num_rows for b in held):
                yield judged(pa.Table.from_batches([b for b in held if b.num_rows]))
            held = [batch.slice(cut)]
        held = [b for b in held if b.num_rows]
        if held:
            yield judged(pa.Table.from_batches(held))

    return run


def _finish(size: int, with_text: bool):
    table = separators()
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 5 if with_text else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("found")
            words, removed, shas, kept_texts = [], [], [], []
            for block in blocks(batch.column("text"), table):
                starts = _alive(lists, block, size)
                depth = np.zeros(len(starts) + size + 1, np.int64)
                at = np.flatnonzero(starts)
                depth[at] += 1
                depth[at + size] -= 1
                gone = np.cumsum(depth)[: len(starts)] > 0
                keep = np.flatnonzero(~gone)
                lengths = block.ends[keep] - block.starts[keep]
                out = np.full(int(lengths.sum()) + len(keep), 32, np.uint8)
                to = np.zeros(len(keep) + 1, np.int64)
                np.cumsum(lengths + 1, out=to[1:])
                out[_ragged(to[:-1], lengths)] = block.data[_ragged(block.starts[keep], lengths)]
                edge = np.searchsorted(keep, block.first)
                counts = np.diff(block.first)
                left = np.diff(edge)
                for i in range(len(counts)):
                    text = out[to[edge[i]] : max(to[edge[i]], to[edge[i + 1]] - 1)].tobytes()
                    if with_text:
                        kept_texts.append(text)
                    shas.append(hashlib.sha256(text).hexdigest())
                words.append(counts)
                removed.append(counts - left)
            columns = [
                batch.column("doc_id"), pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(np.concatenate(removed) if removed else [], pa.int64()),
                pa.array(shas, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names=names)

    return run


def remove_repeats(docs: DataFrame, size: int = 35, with_text: bool = False) -> DataFrame:
    """Documents without the words of windows that start anywhere else too.

    ``docs`` has doc_id and text; other columns are ignored, whatever their names. Returns one row per input row: doc_id, n_words,
    n_removed, kept_sha256 and, with ``with_text``, the kept words joined by one space. Null and empty texts have no words and keep
    the empty text; documents shorter than ``size`` words lose nothing; a repeated row is a copy like any other, whatever its
    doc_id, null included. An empty table gives an empty result. ``docs`` must be a table that gives the same rows in the same order
    when it is read again, as a Parquet folder does.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), F.col("text").cast("string").alias("text"))
    base, half = -(-size // 4), -(-size // 2)

    def places(source: DataFrame, length: int, full: bool) -> DataFrame:
        level = source.mapInArrow(_emit(size, length, full), _ROW).repartition("k").sortWithinPartitions("k")
        return level.mapInArrow(_judge(full), "rid long, piece binary").groupBy("rid").agg(F.collect_list("piece").alias("found"))

    def with_found(level: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(level.hint("shuffle_hash"), "rid", how).select("rid", "doc_id", "text", "found")

    # all joins read one and the same exchange of the texts; the small side is hashed, so texts are never sorted
    level = places(with_found(places(rows, base, False)), half, False)
    found = places(with_found(level), half, True)
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    return with_found(found, "left").mapInArrow(_finish(size, with_text), schema)
