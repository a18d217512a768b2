"""SentencePiece encoding with the n best segmentations, and exact decoding.

A text is a lattice of vocabulary pieces. No piece spans the start of a word, so the lattice falls into one small lattice for each
word with the spaces before it, and equal words of a batch share one. Forward and backward Viterbi scores are computed for all
words of a batch side by side. They give the best segmentation and, for every word, what its second best costs. The n best of a text
can only change the n - 1 words with the least cost; for these a backward A* search, with the forward scores as exact estimates
of what is left, lists the alternatives, and a second search combines the words.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textwords import blocks, mix, separators

SPACE, LITERAL = 0x2581, 0x110000  # the word mark, and the same character where a text has it itself
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WIDTHS = (8, 16, 32, 64)


@dataclass
class Pieces:
    """The vocabulary: text, score and code points of every piece, and hash tables from a piece's hash to its id."""

    texts: list[str]
    scores: np.ndarray
    byte_ids: list[int]
    tables: list[tuple[np.ndarray, np.ndarray]]
    known: dict[str, int]
    longest: int
    unknown: float


def _hash(points: np.ndarray) -> np.uint64:
    h = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for p in points:
            h = h * _BASE + np.uint64(int(p) + 1)
    return mix(h)[0]


def load(path: str = MODEL) -> Pieces:
    """Read a model file. Its vocabulary is bounded, so it may travel with the tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    texts = [model.id_to_piece(i) for i in range(size)]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if len(set(byte_ids)) != 256:
        raise ValueError("the model has no byte pieces")
    normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and texts[i]]
    mark = chr(SPACE)
    if any(mark in t.lstrip(mark) for t in (texts[i] for i in normal)):
        raise ValueError("the model has pieces across words")
    scores = np.array([model.get_score(i) for i in range(size)])
    known = {texts[i]: i for i in normal}
    left = [(_hash(np.frombuffer(texts[i].encode("utf-32-le"), np.uint32)), i) for i in known.values()]
    tables = []
    while left:
        keys, ids, again = np.zeros(1 << 18, np.uint64), np.full(1 << 18, -1, np.int32), []
        shift = np.uint64(14 * len(tables))
        for h, i in left:
            slot = int((h >> shift) & np.uint64((1 << 18) - 1))
            if ids[slot] < 0:
                keys[slot], ids[slot] = h, i
            else:
                again.append((h, i))
        tables.append((keys, ids))
        left = again
    return Pieces(texts, scores, byte_ids, tables, known, max(len(texts[i]) for i in normal), float(min(scores[normal])) - 10.0)


def _find(p: Pieces, h: np.ndarray) -> np.ndarray:
    out = np.full(h.shape, -1, np.int32)
    for i, (keys, ids) in enumerate(p.tables):
        slot = (h >> np.uint64(14 * i)) & np.uint64((1 << 18) - 1)
        hit = keys[slot] == h
        out[hit] = ids[slot][hit]
    return out


def _text(points: np.ndarray) -> str:
    return np.where(points == LITERAL, SPACE, points).astype(np.uint32).tobytes().decode("utf-32-le")


def _edges(p: Pieces, points: np.ndarray) -> list[list[tuple[int, int, float]]]:
    """For every end, the pieces (start, id, score) that end there; id -1 is a character spelled in bytes."""
    text = "".join("\U0010ffff" if c == LITERAL else chr(c) for c in points.tolist())
    out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(points) + 1)]
    known, scores, literal = p.known, p.scores, "\U0010ffff"
    for e in range(1, len(points) + 1):
        here = out[e]
        for s in range(max(0, e - p.longest), e - 1):
            i = known.get(text[s:e])
            if i is not None:
                here.append((s, i, float(scores[i])))
        i = known.get(text[e - 1], -1) if text[e - 1] != literal else -1
        here.append((e - 1, i, float(scores[i]) if i >= 0 else p.unknown))
    return out


def _spell(p: Pieces, points: np.ndarray, spans: list[tuple[int, int, int]]) -> tuple[int, ...]:
    ids: list[int] = []
    for s, e, i in spans:
        ids += [i] if i >= 0 else [p.byte_ids[b] for b in _text(points[s:e]).encode()]
    return tuple(ids)


def n_best(p: Pieces, points: np.ndarray, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The ``n`` best segmentations of one word, best first: A* from the end, guided by the forward scores."""
    edges = _edges(p, points)
    forward = [0.0] + [-np.inf] * len(points)
    for e in range(1, len(points) + 1):
        forward[e] = max(forward[s] + w for s, _, w in edges[e])
    kept: dict[int, list[tuple[float, int, int, float]]] = {}

    def ways(at: int) -> list[tuple[float, int, int, float]]:
        """(best score up to ``at`` by this piece, start, id, score), best first, of equal ones the longest piece."""
        if at not in kept:
            kept[at] = sorted(((forward[s] + w, s, i, w) for s, i, w in edges[at]), key=lambda x: (-x[0], x[1]))
        return kept[at]

    # a node waits with its best way only; taking a way brings in the next one and the node it leads to. Equal scores go on where less is left.
    end = len(points)
    heap = [(-forward[-1], end, 0, end, 0, 0.0, ())] if end else []
    out, count = [(0.0, ())] if not end else [], 1
    while heap and len(out) < n:
        _, _, _, at, j, behind, path = heapq.heappop(heap)
        options = ways(at)
        if j + 1 < len(options):
            heapq.heappush(heap, (-(options[j + 1][0] + behind), at, -count, at, j + 1, behind, path))
        _, s, i, w = options[j]
        path, behind = ((s, at, i), path), behind + w
        if s:
            count += 1
            heapq.heappush(heap, (-(ways(s)[0][0] + behind), s, -count, s, 0, behind, path))
            continue
        spans = []
        while path:
            spans.append(path[0])
            path = path[1]
        out.append((behind, _spell(p, points, spans)))
    return out


def _side_by_side(p: Pieces, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Viterbi over words of up to as many characters as ``words`` has columns (padded with -1). Returns the best scores, what the second best costs,
    and the pieces of the best path, last piece first: ends and ids by step."""
    n, width = words.shape
    length = (words >= 0).sum(axis=1)
    words = np.ascontiguousarray(words.T)  # characters first, so that every step below reads and writes whole rows
    reach = min(p.longest, width)
    score = np.full((reach, width, n), -np.inf)  # by piece length and start
    ids = np.full((reach, width, n), -1, np.int32)
    h = np.zeros((width, n), np.uint64)
    sizes = []  # piece lengths that occur
    with np.errstate(over="ignore"):
        for k in range(1, reach + 1):
            tail = words[k - 1 :]
            h = h[: width - k + 1] * _BASE + (tail + 1).astype(np.uint64)
            ok = tail >= 0
            if not ok.any():
                break
            found = np.full(ok.shape, -1, np.int32)
            found[ok] = _find(p, mix(h[ok]))
            if k == 1 or (found >= 0).any():
                sizes.append(k)
                ids[k - 1, : width - k + 1] = found
                score[k - 1, : width - k + 1] = np.where(found >= 0, p.scores[np.maximum(found, 0)], -np.inf)
    score[0][(ids[0] < 0) & (words >= 0)] = p.unknown
    forward = np.full((width + 1, n), -np.inf)
    forward[0] = 0.0
    back = np.ones((width + 1, n), np.int64)
    for e in range(1, width + 1):
        for k in sizes:
            if k <= e:
                option = forward[e - k] + score[k - 1, e - k]
                better = option > forward[e]
                back[e][better] = k
                np.maximum(forward[e], option, out=forward[e])
    backward = np.full((width + 1, n), -np.inf)
    for s in range(width, -1, -1):
        for k in sizes:
            if s + k <= width:
                np.maximum(backward[s], score[k - 1, s] + backward[s + k], out=backward[s])
        backward[s][length == s] = 0.0
    every = np.arange(n)
    best = forward[length, every]
    # the best path, from its end
    at, steps, used = length.copy(), [], np.zeros((reach, width, n), bool)
    while (at > 0).any():
        on = np.flatnonzero(at > 0)
        k = back[at[on], on]
        start = at[on] - k
        step = np.full((n, 3), -2, np.int64)
        step[on] = np.column_stack([start, at[on], ids[k - 1, start, on]])
        used[k - 1, start, on] = True
        steps.append(step)
        at[on] = start
    second = np.full(n, -np.inf)
    for k in sizes:
        through = forward[: width - k + 1] + score[k - 1, : width - k + 1] + backward[k:]
        through[used[k - 1, : width - k + 1]] = -np.inf
        np.maximum(second, through.max(axis=0), out=second)
    return best, best - second, length, steps


def _merge(choices: list[tuple[int, list[tuple[float, tuple[int, ...]]]]], n: int) -> list[tuple[float, list[tuple[int, tuple[int, ...]]]]]:
    """The ``n`` least total costs over independent words, each a list of (score, ids) best first. Gives (cost, changed words)."""
    heap: list[tuple[float, tuple[int, ...]]] = [(0.0, (0,) * len(choices))]
    seen, out = {heap[0][1]}, []
    while heap and len(out) < n:
        cost, pick = heapq.heappop(heap)
        out.append((cost, [(w, c[j][1]) for (w, c), j in zip(choices, pick) if j]))
        for x in range(len(choices)):
            if pick[x] + 1 < len(choices[x][1]):
                near = (*pick[:x], pick[x] + 1, *pick[x + 1 :])
                if near not in seen:
                    seen.add(near)
                    c = choices[x][1]
                    heapq.heappush(heap, (cost + c[pick[x]][0] - c[pick[x] + 1][0], near))
    return out


_KEPT_WORDS = 200_000


class _Words:
    """Segmented words of earlier blocks of a task, by hash; emptied when ``_KEPT_WORDS`` are exceeded."""

    def __init__(self):
        self.keys, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.best, self.cost = np.zeros(0), np.zeros(0)
        self.begin, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.choices: dict[int, list] = {}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys`` among the kept words, -1 for new ones."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1) if len(self.keys) else np.full(len(keys), -1)

    def keep(self, keys: np.ndarray, best: np.ndarray, cost: np.ndarray, begin: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Add words whose pieces are ``ids`` (all kept ids and new ones behind them) from ``begin`` on."""
        if len(self.keys) + len(keys) > _KEPT_WORDS:
            self.__init__()
            return
        order = np.argsort(np.append(self.keys, keys))
        self.keys, self.best, self.cost, self.begin, self.count = (
            np.append(a, b)[order] for a, b in ((self.keys, keys), (self.best, best), (self.cost, cost), (self.begin, begin), (self.count, count)))
        self.ids = ids


def _encode(p: Pieces, n: int):
    table = separators()
    words = _Words()

    def batch_of(points: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, float, list]]:
        """Encode the texts ``edges`` cut out of ``points``."""
        start = points == SPACE
        start[1:] &= points[:-1] != SPACE
        start[edges[:-1][np.diff(edges) > 0]] = True
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(points)))
        with np.errstate(over="ignore"):
            place = np.arange(len(points)) - np.repeat(at, size)
            key = mix(mix((points.astype(np.uint64) + np.uint64(1)) + (place.astype(np.uint64) << np.uint64(32))) * np.uint64(3))
            whole = mix(np.add.reduceat(key, at)) if len(at) else np.zeros(0, np.uint64)
        keys, first, word_of = np.unique(whole, return_index=True, return_inverse=True)
        kept = words.find(keys)
        new = kept < 0
        lengths = np.where(new, size[first], 0)
        best, cost = np.zeros(len(first)), np.full(len(first), np.inf)
        best[~new], cost[~new] = words.best[kept[~new]], words.cost[kept[~new]]
        flat: list[tuple[np.ndarray, np.ndarray]] = []  # (word, ids) of all pieces of the best paths, in order
        low = 0
        for width in (*_WIDTHS, None):
            those = np.flatnonzero((lengths > low) & (lengths <= width)) if width else np.flatnonzero(lengths > low)
            low = width or low
            if not width:
                for w in those:
                    found = n_best(p, points[at[first[w]] : at[first[w]] + lengths[w]], 2)
                    best[w], cost[w] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf
                    flat.append((np.full(len(found[0][1]), w), np.array(found[0][1], np.int32)))
                continue
            chunk = max(1, (1 << 21) // (width * min(p.longest, width)))
            for a in range(0, len(those), chunk):
                own = those[a : a + chunk]
                padded = np.full((len(own), width), -1, np.int64)
                inside = np.arange(width) < lengths[own][:, None]
                padded[inside] = points[(at[first[own]][:, None] + np.arange(width))[inside]]
                best[own], cost[own], _, steps = _side_by_side(p, padded)
                on = np.concatenate([np.full(len(own), j) for j in range(len(steps))])
                step = np.concatenate(steps)
                word = np.tile(np.arange(len(own)), len(steps))
                real = step[:, 2] > -2
                on, step, word = on[real], step[real], word[real]
                order = np.lexsort((-on, word))
                step, word = step[order], word[order]
                ids = step[:, 2].astype(np.int32)
                spelled = np.flatnonzero(ids < 0)
                if len(spelled):
                    repeat = np.ones(len(ids), np.int64)
                    more = [[p.byte_ids[b] for b in _text(padded[word[x], step[x, 0] : step[x, 1]].astype(np.uint32)).encode()] for x in spelled]
                    repeat[spelled] = [len(m) for m in more]
                    to = np.cumsum(repeat) - repeat
                    wide = np.repeat(ids, repeat)
                    for x, m in zip(spelled, more):
                        wide[to[x] : to[x] + len(m)] = m
                    ids, word = wide, np.repeat(word, repeat)
                flat.append((own[word], ids))
        word = np.concatenate([w for w, _ in flat]) if flat else np.zeros(0, np.int64)
        ids = np.concatenate([i for _, i in flat]) if flat else np.zeros(0, np.int32)
        count = np.bincount(word, minlength=len(first))
        begin = np.zeros(len(first), np.int64)
        if len(word):
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            begin[word[head]] = head
        begin += len(words.ids)
        begin[~new], count[~new] = words.begin[kept[~new]], words.count[kept[~new]]
        ids = np.append(words.ids, ids)
        many = count[word_of]
        gather = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - begin[word_of], many)
        stream, to = ids[gather], np.append(0, np.cumsum(many))
        words.keep(keys[new], best[new], cost[new], begin[new], count[new], ids)
        cut = np.searchsorted(at, edges)
        known = words.choices
        for i in range(len(edges) - 1):
            own = word_of[cut[i] : cut[i + 1]]
            total = float(best[own].sum())
            pieces = stream[to[cut[i]] : to[cut[i + 1]]]
            others = []
            if n > 1 and len(own):
                least = cost[own]
                near = np.argsort(least, kind="stable")[: n - 1] if len(least) <= 4 * n else (lambda c: c[np.argsort(least[c], kind="stable")][: n - 1])(np.flatnonzero(least <= np.partition(least, n - 2)[n - 2]))
                choices = []
                for x in near[np.isfinite(least[near])]:
                    w = int(own[x])
                    key = int(keys[w])
                    if key not in known:
                        known[key] = n_best(p, points[at[first[w]] : at[first[w]] + size[first[w]]], n)
                    if len(known[key]) > 1:
                        choices.append((int(x), known[key]))
                for extra, changed in _merge(choices, n)[1:]:
                    base = int(to[cut[i]])
                    edits = sorted((int(to[cut[i] + x]) - base, int(to[cut[i] + x + 1]) - base, list(new)) for x, new in changed)
                    others.append({"score": total - extra, "edits": [{"start": s, "stop": e, "ids": new} for s, e, new in edits]})
            yield pieces, total, others

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edit = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
        for batch in batches:
            column = batch.column("text")
            for block in blocks(column, table, limit=1 << 20):
                rows = column.slice(block.rows.start, len(block.rows))
                points, edges = [], [0]
                for text in rows.to_pylist():
                    if text:
                        own = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
                        own = np.where(own == SPACE, LITERAL, own)
                        points.append(np.append(SPACE, np.where(own == 32, SPACE, own)))
                        edges.append(edges[-1] + len(points[-1]))
                    else:
                        edges.append(edges[-1])
                found = list(batch_of(np.concatenate(points) if points else np.zeros(0, np.int64), np.array(edges)))
                offsets = np.append(0, np.cumsum([len(x) for x, _, _ in found])).astype(np.int32)
                flat = np.concatenate([x for x, _, _ in found]) if found else np.zeros(0, np.int32)
                own = batch.slice(block.rows.start, len(block.rows))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array([s for _, s, _ in found], pa.float64()), pa.array([o for _, _, o in found], edit)],
                                                 names=[*own.schema.names, "ids", "score", "others"])

    return run


_OTHERS = "array<struct<score: double, edits: array<struct<start: int, stop: int, ids: array<int>>>>>"


def encode(docs: DataFrame, n: int = 3, model: str | Pieces = MODEL) -> DataFrame:
    """doc_id, text, ids, score and others for every row of ``docs`` (doc_id, text; other columns are ignored).

    ids is the best segmentation, score the sum of its pieces' scores, others the next ``n - 1`` by falling score, each as edits: ids to put
    in place of ``ids[start:stop]``. A character outside the vocabulary is spelled in byte pieces at one fixed low score. Null and empty texts
    have no pieces and score 0. Of equal scores the search order decides, the same on every run. Repeated rows each come back.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    p = model if isinstance(model, Pieces) else load(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    bc = docs.sparkSession.sparkContext.broadcast(p)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encode(bc.value, n)(batches)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, text string, ids array<int>, score double, others {_OTHERS}")


def decode_ids(p: Pieces, ids: list[int]) -> str:
    """The text of a list of ids."""
    values = {i: b for b, i in enumerate(p.byte_ids)}
    mark = chr(SPACE)
    out = bytearray()
    for i in ids:
        out += bytes([values[i]]) if i in values else p.texts[i].replace(mark, " ").encode()
    text = out.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def decode(encoded: DataFrame, column: str = "ids", model: str | Pieces = MODEL) -> DataFrame:
    """``encoded`` with a column decoded, the text of ``column``; null ids give null."""
    p = model if isinstance(model, Pieces) else load(model)
    values = {i: bytes([b]) for b, i in enumerate(p.byte_ids)}
    spelled = [values.get(i, t.replace(chr(SPACE), " ").encode()) for i, t in enumerate(p.texts)]
    bc = encoded.sparkSession.sparkContext.broadcast(spelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = bc.value
        for batch in batches:
            out = []
            for ids in batch.column(column):
                if not ids.is_valid:
                    out.append(None)
                    continue
                text = b"".join([of[i] for i in ids.values.to_numpy()]).decode("utf-8", "replace")
                out.append(text[1:] if text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
