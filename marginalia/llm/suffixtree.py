"""Language-model scores by a probabilistic suffix tree over the bytes of a text.

The tree holds contexts of up to ``depth`` bytes. A context is kept when it makes up at least ``p_min`` of the training positions (so a level has
at most ``1 / p_min`` of them, whatever the corpus) and its next-byte distribution diverges from that of its suffix. Distributions are
smoothed with those of their suffixes. A text is its lower-cased words joined by one space, and an end; every byte is scored in the
state of the longest kept suffix of what precedes it.

The base score needs the count of every word. Words go to the counting tasks once per block of documents, not per document, and the
counts come back in the same order, so a frequent word is one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.settle import settle
from .textwords import Block, blocks, separators

END = 257
_SHIFT = 9
_END_WORD = np.uint64(0x656E64)
BLOCK_ROWS = 10  # a block has 2**10 rows at most
BLOCK_BYTES = 16 << 20  # and so many bytes of text, unless it is one row


@dataclass(frozen=True)
class Settings:
    depth: int = 5
    p_min: float = 2e-5
    divergence: float = 0.003
    smoothing: float = 4.0


def held_out(parts: int = 5, part: int = 1) -> Column:
    """True for rows that training leaves out; a null id counts as left out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(True))


def _symbols(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the block's texts, each after an end and closed by an end (bytes are 1 to 256), and the place of every text's opening end."""
    lengths = block.ends - block.starts
    counts = np.diff(block.first)
    size = np.bincount(block.of_words(), weights=lengths, minlength=len(counts)).astype(np.int64) + np.maximum(counts - 1, 0)
    opening = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()) + 1, END, np.int64)
    if len(lengths):
        extra = np.repeat(opening + 1, counts)
        before = np.cumsum(lengths + 1) - lengths - 1
        to = before - np.repeat(before[np.minimum(block.first[:-1], len(before) - 1)], counts) + extra
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[np.repeat(to, lengths) + inside] = block.data[np.repeat(block.starts, lengths) + inside].astype(np.int64) + 1
        gaps = np.ones(len(to), bool)
        gaps[block.first[:-1][counts > 0]] = False
        out[to[gaps] - 1] = 33  # a space between words
    return out, opening


def _grams(depth: int):
    """Counts of (depth bytes, next byte); what lies before a text's opening end is zero."""
    table = separators()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts, rows = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            code, inverse = np.unique(np.concatenate(kept), return_inverse=True)
            return code, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for block in blocks(batch.column("text"), table, lower=True):
                symbols, opening = _symbols(block)
                code, blank, stop = symbols.copy(), np.zeros(len(symbols), bool), np.zeros(len(symbols), bool)
                blank[opening] = True  # here the history ends
                for i in range(1, depth + 1):
                    earlier = np.zeros(len(symbols), np.int64)
                    earlier[i:] = symbols[:-i]
                    earlier[stop] = 0
                    code += earlier << (_SHIFT * i)
                    stop[i:] |= blank[:-i]
                code = np.delete(code, opening[0])  # the other openings close the text before
                found, n = np.unique(code, return_counts=True)
                kept.append(found)
                counts.append(n)
                rows += len(found)
                if rows > 4_000_000:
                    one, n = merged()
                    kept, counts, rows = [one], [n], len(one)
                    if rows > 3_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(n)], names=["code", "n"])
                        kept, counts, rows = [], [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["code", "n"])

    return run


def _contexts(docs: DataFrame, s: Settings) -> DataFrame:
    """(size, context, symbol, n) of the frequent contexts."""
    grams = settle(docs.select("text").mapInArrow(_grams(s.depth), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")))
    total = grams.agg(F.sum("n")).first()[0] or 0
    symbol = F.col("code").bitwiseAND(F.lit((1 << _SHIFT) - 1))
    levels = F.array(*[F.struct(F.lit(k).alias("size"), F.shiftright("code", _SHIFT).bitwiseAND(F.lit((1 << (_SHIFT * k)) - 1)).alias("context")) for k in range(s.depth + 1)])
    each = grams.select(F.explode(levels).alias("c"), symbol.alias("symbol"), "n").select("c.*", "symbol", "n")
    each = each.where((F.col("size") == 0) | F.expr(f"shiftright(context, {_SHIFT} * (size - 1)) > 0"))  # none that begins before its text
    counts = settle(each.groupBy("size", "context", "symbol").agg(F.sum("n").alias("n")))
    often = counts.groupBy("size", "context").agg(F.sum("n").alias("m")).where((F.col("size") == 0) | (F.col("m") >= max(2, s.p_min * total))).select("size", "context")
    return counts.join(often, ["size", "context"])


@dataclass
class Automaton:
    """``following[state * width + symbol]`` and ``gain`` (log10 probability) at the same place; ``classes`` maps symbols to columns."""

    classes: np.ndarray
    width: int
    following: np.ndarray
    gain: np.ndarray
    start: int


def learn(docs: DataFrame, s: Settings = Settings()) -> Automaton:
    """The tree as an automaton. At most ``depth / p_min`` contexts reach the driver; the counts behind them are made by Spark."""
    rows = _contexts(docs, s).toPandas()
    counts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for (size, context), g in rows.groupby(["size", "context"]):
        counts[(int(size), int(context))] = (g["symbol"].to_numpy(), g["n"].to_numpy(float))
    seen = np.unique(counts[(0, 0)][0]) if (0, 0) in counts else np.zeros(0, np.int64)
    classes = np.full(END + 1, len(seen), np.int64)
    classes[seen] = np.arange(len(seen))
    if END not in seen:
        seen = np.append(seen, END)
        classes = np.full(END + 1, len(seen), np.int64)
        classes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    root = np.full(width, 0.5)
    for symbol, n in zip(*counts.get((0, 0), ((), ()))):
        root[classes[int(symbol)]] += n
    root /= root[:-1].sum() + 0.5 * (END - len(seen))  # the last column is any one of the unseen bytes
    shorter = lambda k, c: (k - 1, c & ((1 << (_SHIFT * (k - 1))) - 1))
    kept = {(0, 0)}
    for size, context in sorted(counts):
        if size == 0:
            continue
        symbol, n = counts[(size, context)]
        parent = dict(zip(*counts[shorter(size, context)])) if shorter(size, context) in counts else {}
        p = n / n.sum()
        total = sum(parent.values())
        q = np.array([parent.get(x, 1) for x in symbol]) / max(total, 1)
        if float((p * np.log(p / q)).sum()) >= s.divergence:
            node = (size, context)
            while node not in kept:  # the suffixes belong to the tree
                kept.add(node)
                node = shorter(*node)
    states = set(kept)
    for size, context in kept:  # and the beginnings, so that a walk finds every state
        while size:
            size, context = size - 1, context >> _SHIFT
            states.add((size, context))
    order = sorted(states)
    number = {node: i for i, node in enumerate(order)}
    following, prob = np.zeros((len(order), width), np.int32), np.zeros((len(order), width))
    heirs: dict[int, list[tuple[int, int]]] = {}
    for (size, context), i in number.items():
        if size:
            heirs.setdefault(number[(size - 1, context >> _SHIFT)], []).append((int(classes[context & ((1 << _SHIFT) - 1)]), i))
    for node in order:
        i = number[node]
        if node == (0, 0):
            prob[i] = root
        else:
            up = shorter(*node)
            while up not in number:
                up = shorter(*up)
            following[i], prob[i] = following[number[up]], prob[number[up]]
            if node in kept and node in counts:
                symbol, n = counts[node]
                own = s.smoothing * prob[i]
                np.add.at(own, classes[symbol], n)
                prob[i] = own / (n.sum() + s.smoothing)
        for column, child in heirs.get(i, ()):
            following[i, column] = child
    start = int(following[number[(0, 0)], classes[END]])
    return Automaton(classes, width, (following.astype(np.int64) * width).astype(np.int32).ravel(), np.log10(prob).astype(np.float32).ravel(), start * width)


def _walk(a: Automaton, symbols: np.ndarray, depth: int, piece: int = 256) -> np.ndarray:
    """log10 probability of every symbol. The stream is walked in pieces side by side; a state depends on ``depth`` symbols only, so each
    piece starts that much earlier."""
    columns = a.classes[symbols].astype(np.int32)
    n = -(-len(columns) // piece)
    padded = np.full(depth + n * piece, a.classes[END], np.int32)
    padded[depth : depth + len(columns)] = columns
    state = np.zeros(n, np.int32)
    out = np.empty((piece, n), np.float32)
    at = np.arange(n) * piece
    for t in range(depth + piece):
        place = state + padded[at + t]
        if t >= depth:
            out[t - depth] = a.gain[place]
        state = a.following[place]
    return out.T.ravel()[: len(columns)]


def _block_words(table: np.ndarray, column: pa.Array) -> Iterator[tuple[Block, np.ndarray]]:
    for block in blocks(column, table, lower=True):
        yield block, block.hashes()


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)


def _ask(buckets: int):
    """For every block of documents its distinct words with their training counts, cut by bucket."""
    table = separators()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def asked() -> pa.RecordBatch:
            words, inverse = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            bucket = _bucket(words, buckets)
            order = np.argsort(bucket, kind="stable")
            at = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0))
            to = np.append(at[1:], len(order))
            return pa.RecordBatch.from_arrays([
                pa.array(bucket[order][at]), pa.array(np.full(len(at), now)), pa.array([words[order[i:j]].tobytes() for i, j in zip(at, to)]),
                pa.array([n[order[i:j]].tobytes() for i, j in zip(at, to)])], names=["bucket", "block", "words", "n"])

        for batch in batches:
            of = batch.column("block").to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])), len(of)) if len(of) else [0]
            for i, j in zip(edges[:-1], edges[1:]):
                if parts and of[i] != now:
                    yield asked()
                    parts = []
                now = int(of[i])
                piece = batch.slice(i, j - i)
                train = ~np.asarray(piece.column("held_out"))
                for block, words in _block_words(table, piece.column("text")):
                    learned = train[block.rows.start : block.rows.stop]
                    flag = learned[block.of_words()].astype(np.float64)
                    one, inverse = np.unique(np.append(words, _END_WORD), return_inverse=True)
                    parts.append((one, np.bincount(inverse, weights=np.append(flag, learned.sum()))))
        if parts:
            yield asked()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Total counts for every asked word, in the asked order; rows come sorted by bucket."""

    def answered(t: pa.Table) -> pa.RecordBatch:
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in t["words"]]
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in t["n"]])
        one, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, weights=n).astype(np.int64)
        cut = np.cumsum([len(w) for w in words])[:-1]
        bucket = t["bucket"].to_numpy()
        first = np.append(True, bucket[1:] != bucket[:-1])
        own = _bucket_of_group(inverse, cut, bucket, first, total)
        return pa.RecordBatch.from_arrays([
            t["block"].combine_chunks(), t["bucket"].combine_chunks(), pa.array([x.tobytes() for x in np.split(total[inverse], cut)]),
            pa.array(own[0]), pa.array(own[1])], names=["block", "bucket", "counts", "known", "total"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        cut = int(np.searchsorted(bucket, bucket[-1]))
        if cut == 0 and held and held[-1].column("bucket")[-1].as_py() != bucket[0]:
            yield answered(pa.Table.from_batches(held))
            held = []
        if cut:
            held.append(batch.slice(0, cut))
            yield answered(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield answered(pa.Table.from_batches(held))


def _bucket_of_group(inverse: np.ndarray, cut: np.ndarray, bucket: np.ndarray, first: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct learned words and their tokens of every bucket, on its first row; zero on its other rows."""
    row = np.repeat(np.arange(len(bucket)), np.diff(np.concatenate([[0], cut, [len(inverse)]])))
    group = np.cumsum(first) - 1
    where = np.zeros(len(total), np.int64)
    where[inverse] = group[row]  # a word has one bucket
    known = np.bincount(where, weights=total > 0, minlength=group[-1] + 1).astype(np.int64)
    tokens = np.bincount(where, weights=total, minlength=group[-1] + 1).astype(np.int64)
    return np.where(first, known[group], 0), np.where(first, tokens[group], 0)


def _cut(rows: int, size: int):
    """Number the blocks: consecutive rows of a partition, at most ``rows`` of them and ``size`` bytes of text; a longer text is a block of
    its own. A block has the number of its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, many, held = 0, 0, 0
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for i, (row, length) in enumerate(zip(batch.column("block").to_pylist(), lengths)):
                if not many or many == rows or held + length > size:
                    now, many, held = row, 0, 0
                out[i], many, held = now, many + 1, held + length
            yield pa.RecordBatch.from_arrays([pa.array(out), *batch.columns[1:]], names=batch.schema.names)

    return run


def _score(model: Automaton, depth: int, buckets: int, tokens: int, distinct: int):
    table = separators()

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        right = right.sort_by("bucket")
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in right["counts"]])
        column = left["text"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        pieces = [(b, b.hashes()) for b in blocks(column, table, lower=True)]
        asked = np.unique(np.concatenate([*(h for _, h in pieces), [_END_WORD]]).astype(np.uint64))
        asked = asked[np.argsort(_bucket(asked, buckets), kind="stable")]
        order = np.argsort(asked)
        sorted_words, sorted_counts = asked[order], counts[order]
        floor = tokens + 0.5 * (distinct + 1)
        gain = np.log10((sorted_counts + 0.5) / floor) if floor else np.zeros(len(order))
        end = np.searchsorted(sorted_words, _END_WORD)
        out = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for block, words in pieces:
            n = len(block.rows)
            at, of = np.searchsorted(sorted_words, words), block.of_words()
            out["n_tokens"].append(np.diff(block.first) + 1)
            out["n_known"].append((np.bincount(of, weights=sorted_counts[at] > 0, minlength=n) + (sorted_counts[end] > 0)).astype(np.int64))
            out["base_score"].append(np.bincount(of, weights=gain[at], minlength=n) + gain[end])
            symbols, opening = _symbols(block)
            each = _walk(model, symbols, depth).astype(np.float64)
            each[opening[0]] = 0.0
            sums = np.append(0.0, np.cumsum(each))
            to = np.append(opening[1:], len(symbols) - 1)
            out["score"].append(sums[to + 1] - sums[opening + 1])
        return pa.table({"doc_id": left["doc_id"], "held_out": left["held_out"], **{k: pa.array(np.concatenate(v)) for k, v in out.items()}})

    return run


def score(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs`` (doc_id, text; other columns are ignored).

    Null and empty texts are the end token alone. Repeated rows each count and come back. With nothing to learn from, all probabilities come
    from smoothing. An empty table gives an empty result. ``docs`` must give the same rows in the same order when read again, as a
    Parquet folder does.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("block"), "doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    model = learn(rows.where(~F.col("held_out")), settings)
    rows = rows.mapInArrow(_cut(1 << BLOCK_ROWS, BLOCK_BYTES), f"block long, doc_id {kind}, held_out boolean, text string")
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.select("block", "held_out", "text").mapInArrow(_ask(buckets), "bucket long, block long, words binary, n binary")
    answers = settle(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "block long, bucket long, counts binary, known long, total long"))
    sums = answers.agg(F.sum("known"), F.sum("total")).first()
    distinct, tokens = int(sums[0] or 0), int(sums[1] or 0)
    scored = rows.groupBy("block").cogroup(answers.select("block", "bucket", "counts").groupBy("block")).applyInArrow(
        _score(model, settings.depth, buckets, tokens, distinct), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
