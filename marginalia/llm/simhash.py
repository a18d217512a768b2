"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries.

Two fingerprints with at most ``budget`` differing bits agree in one of ``budget + 1`` pieces. So the distinct fingerprints form one
trie for each piece and each value of it, and only nodes of the same trie meet. Pairs of nodes go down together, add up their
differing bits and end when these exceed the budget, or when all below both is linked already. A trie with more than
``SPLIT`` fingerprints is first divided in Spark into its pairs of nodes, four bits at a time, so no task meets a hot trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.settle import settle
from .components import connected
from .textwords import blocks, separators

SPLIT = 20_000
_STEP = 4
_U = np.uint64


def _fingerprints(shingle: int, seed: int):
    table = separators()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for block in blocks(batch.column("text"), table, lower=True):
                counts = np.diff(block.first)
                prints = np.zeros(len(counts), np.uint64)
                full = np.flatnonzero(counts)
                if len(full):
                    lengths = block.ends - block.starts
                    to = np.zeros(len(lengths) + 1, np.int64)
                    np.cumsum(lengths + 1, out=to[1:])
                    text = np.full(int(to[-1]), 32, np.uint8)
                    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                    text[np.repeat(to[:-1], lengths) + inside] = block.data[np.repeat(block.starts, lengths) + inside]
                    raw = text.tobytes()
                    shingles = np.maximum(counts[full] - shingle + 1, 1)
                    head = np.repeat(block.first[:-1][full], shingles) + np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles)
                    last = np.minimum(head + shingle, np.repeat(block.first[1:][full], shingles))
                    begin, end = to[head].tolist(), (to[last] - 1).tolist()
                    h = np.fromiter((xxh64_intdigest(raw[a:b], seed) for a, b in zip(begin, end)), np.uint64, len(begin))
                    at = np.cumsum(shingles) - shingles
                    for a in range(0, len(full), 4096):
                        part = slice(a, min(a + 4096, len(full)))
                        lo, hi = at[part][0], at[part][-1] + shingles[part][-1]
                        bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        ones = np.add.reduceat(bits, at[part] - lo, axis=0, dtype=np.int32)
                        more = (2 * ones > shingles[part][:, None]).astype(np.uint8)
                        prints[full[part]] = np.packbits(more, axis=1, bitorder="little").copy().view(np.uint64)[:, 0]
                found.append(prints)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and the 64-bit fingerprint ``fp`` of every row: bit set in more than half of the XXH64 hashes of its shingles."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(shingle, seed), f"doc_id {kind}, fp long")


def _merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give linked places one label, the smallest."""
    while True:
        a, b = label[x], label[y]
        open_ = a != b
        if not open_.any():
            return
        x, y, a, b = x[open_], y[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - lo, size)


def _trie_links(values: np.ndarray, group: np.ndarray, start: int, left: np.ndarray, right: np.ndarray, spent: np.ndarray, budget: int, leaf: int = 64, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """Links of the fingerprints ``values``, sorted inside the nodes given as ranges ``left`` and ``right`` (equal: a node with itself)
    of ``start`` known bits. Returns places (x, y), a spanning forest of the links."""
    n = len(values)
    label = np.arange(n)
    width = np.uint64(63)
    stack = [(start, left[:, 0], left[:, 1], right[:, 0], right[:, 1], spent)]
    while stack:
        depth, al, ah, bl, bh, d = stack.pop()
        # what is all in one component on both sides needs no visit
        turn = np.zeros(n + 1, np.int64)
        np.cumsum(label[1:] != label[:-1], out=turn[1:n])
        done = (turn[ah - 1] == turn[al]) & (turn[bh - 1] == turn[bl]) & (label[al] == label[bl])
        keep = ~done
        al, ah, bl, bh, d = al[keep], ah[keep], bl[keep], bh[keep], d[keep]
        if not len(al):
            continue
        if len(al) > most:
            h = len(al) // 2
            stack += [(depth, al[h:], ah[h:], bl[h:], bh[h:], d[h:]), (depth, al[:h], ah[:h], bl[:h], bh[:h], d[:h])]
            continue
        small = ((ah - al) * (bh - bl) <= leaf) | (depth >= 64)
        if small.any():
            sa, sb = (ah - al)[small], (bh - bl)[small]
            size = sa * sb
            bounds = np.append(0, np.cumsum(size))
            for lo in range(0, len(size), 16384):
                hi = min(lo + 16384, len(size))
                part = slice(lo, hi)
                inner = _ranges(np.zeros(hi - lo, np.int64), size[part])
                wide = np.repeat(sb[part], size[part])
                x = np.repeat(al[small][part], size[part]) + inner // wide
                y = np.repeat(bl[small][part], size[part]) + inner % wide
                near = np.bitwise_count(values[x] ^ values[y]) <= budget
                near &= x != y
                _merge(label, x[near], y[near])
        al, ah, bl, bh, d = al[~small], ah[~small], bl[~small], bh[~small], d[~small]
        if not len(al):
            continue
        # children: a node's second half starts where the next bit is set
        bit = (values >> (width - np.uint64(depth))) & _U(1)
        ones = np.append(0, np.cumsum(bit.astype(np.int64)))
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        near = [(al, am, bl, bm, d), (am, ah, bm, bh, d)]
        far = [(al, am, bm, bh, d + 1), (am[~same], ah[~same], bl[~same], bm[~same], d[~same] + 1)]
        for found in (far, near):
            parts = [np.concatenate(x) for x in zip(*found)]
            ok = (parts[1] > parts[0]) & (parts[3] > parts[2]) & (parts[4] <= budget)
            if ok.any():
                stack.append((depth + 1, *(p[ok] for p in parts)))
    x = np.flatnonzero(label != np.arange(n))
    return x, label[x]


def _links(budget: int):
    """Edges of the tries of a partition; rows come sorted by trie, so whole tries are joined as they come."""

    def joined(t: pa.Table) -> pa.RecordBatch:
        out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
        turn, depth, pa_, pb, spent, side, value = (t[c].to_numpy() for c in ("turn", "depth", "pa", "pb", "spent", "side", "value"))
        for level in np.unique(depth):
            for which in np.unique(turn[depth == level]):
                rows = np.flatnonzero((depth == level) & (turn == which))
                v = value[rows].view(np.uint64)
                order = np.lexsort((v, side[rows], pb[rows], pa_[rows]))
                rows, v = rows[order], v[order]
                key = np.column_stack([pa_[rows], pb[rows], side[rows]])
                new = np.append(True, (key[1:] != key[:-1]).any(axis=1))
                at = np.flatnonzero(new)
                to = np.append(at[1:], len(rows))
                own = pa_[rows[at]] == pb[rows[at]]
                left, right = [np.column_stack([at[own], to[own]])], [np.column_stack([at[own], to[own]])]
                cost = [spent[rows[at[own]]]]
                rest = np.flatnonzero(~own)
                two = rest[:-1][(pa_[rows[at[rest[:-1]]]] == pa_[rows[at[rest[1:]]]]) & (pb[rows[at[rest[:-1]]]] == pb[rows[at[rest[1:]]]])] if len(rest) > 1 else rest[:0]
                left.append(np.column_stack([at[two], to[two]]))
                right.append(np.column_stack([at[two + 1], to[two + 1]]))
                cost.append(spent[rows[at[two]]])
                x, y = _trie_links(v, key, int(level), np.concatenate(left), np.concatenate(right), np.concatenate(cost), budget)
                by = np.uint64(which)
                back = (v >> by) | (v << (_U(64) - by)) if which else v  # turn back
                out.append(np.column_stack([back[x].view(np.int64), back[y].view(np.int64)]))
        pairs = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(c).to_numpy() for c in ("turn", "depth", "pa", "pb")]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            last = [held[-1].column(c)[-1].as_py() for c in ("turn", "depth", "pa", "pb")] if held else None
            cut = int(change[-1]) if len(change) else 0
            if last is not None and last != [int(k[0]) for k in key] and not len(change):
                yield joined(pa.Table.from_batches(held))
                held, rows = [], 0
            if cut:
                held.append(batch.slice(0, cut))
                yield joined(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield joined(pa.Table.from_batches(held))

    return run


def _turned(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def links(prints: DataFrame, budget: int = 3, split: int = SPLIT) -> DataFrame:
    """Edges (a, b) that connect what the pairs of distinct fingerprints ``fp`` with at most ``budget`` differing bits connect."""
    pieces = budget + 1
    width = 64 // pieces
    tries = F.array(*[F.struct(F.lit(i * width).alias("turn"), _turned(F.col("fp"), i * width).alias("value")) for i in range(pieces)])
    head = F.shiftrightunsigned("value", 64 - width)
    rows = (
        prints.select("fp").distinct().select(F.explode(tries).alias("t")).select("t.*")
        .select("turn", F.lit(width).alias("depth"), head.alias("pa"), head.alias("pb"), F.lit(0).alias("spent"), F.lit(0).alias("side"), "value")
    )
    key = ["turn", "depth", "pa", "pb"]
    done = []
    while True:
        depth = width + _STEP * len(done)
        if depth > 64 - _STEP:
            break
        rows = settle(rows)
        hot = settle(rows.groupBy(*key).count().where(F.col("count") > split).select(*key))
        if hot.isEmpty():
            break
        done.append(rows.join(hot, key, "left_anti"))
        masks = F.array(*[F.lit(m).cast("long") for m in range(1 << _STEP)])
        child = F.shiftrightunsigned("value", 64 - depth - _STEP)
        own = F.col("pa") == F.col("pb")
        other = F.shiftleft(F.when(own, F.col("pa")).when(F.col("side") == 0, F.col("pb")).otherwise(F.col("pa")), _STEP).bitwiseOR(child.bitwiseAND(F.lit((1 << _STEP) - 1)).bitwiseXOR(F.col("mask")))
        first = F.when(own, child <= other).otherwise(F.col("side") == 0)
        rows = (
            rows.join(hot, key, "left_semi").withColumn("mask", F.explode(masks)).where(F.col("spent") + F.bit_count("mask") <= budget)
            .withColumn("child", child).withColumn("other", other).withColumn("first", first)
            .select("turn", (F.col("depth") + _STEP).alias("depth"), F.when(F.col("first"), F.col("child")).otherwise(F.col("other")).alias("pa"), F.when(F.col("first"), F.col("other")).otherwise(F.col("child")).alias("pb"), (F.col("spent") + F.bit_count("mask")).cast("int").alias("spent"), F.when(F.col("first"), 0).otherwise(1).alias("side"), "value")
        )
    for more in done:
        rows = rows.unionByName(more)
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(_links(budget), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links reach, for every row of ``docs``.

    Only doc_id and text are read, so other columns may have any name. Null, empty and blank texts have fingerprint zero, which links
    like any other; equal fingerprints are linked. A null doc_id stays null and never names a component, unless a whole component has
    no other: then component_id is null. Repeated rows each come back. An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, shingle, seed))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    member = connected(links(distinct, budget))
    named = distinct.join(member, distinct.fp == member.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    names = settle(named.join(lowest, "root").select("fp", "component_id"))
    return prints.join(names, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
