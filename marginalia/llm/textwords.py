"""Words of whole Arrow text columns as numpy arrays, shared by the operators of this subpackage.

Texts of a batch stay one UTF-8 byte buffer. Separators are ASCII bytes, so words can be cut on bytes. Batches are split into
blocks of about ``BLOCK`` bytes (a longer text is its own block), which bounds the memory of every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_WORD_BASE = _U(0x9E3779B97F4A7C15)
_POWERS_KEPT = 1 << 12


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_WORD_BASE, _POWERS_KEPT)


def separators(ascii_word: str | None = None) -> np.ndarray:
    """Table of 256 flags, true for bytes outside words. Default: space and bytes 9 to 13 separate. Otherwise every ASCII byte
    that is not in ``ascii_word`` separates and bytes above 127 belong to words."""
    table = np.zeros(256, bool)
    if ascii_word is None:
        table[9:14] = True
        table[32] = True
    else:
        table[:128] = True
        table[np.frombuffer(ascii_word.encode(), np.uint8)] = False
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


@dataclass
class Block:
    """Some texts of a batch: ``rows`` in the batch, their bytes, and the words as byte ranges. ``first[i]:first[i + 1]`` are
    the words of the i-th text."""

    rows: range
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            lengths = self.ends - self.starts
            total = int(lengths.sum())
            at = np.zeros(len(lengths), np.int64)
            np.cumsum(lengths[:-1], out=at[1:])
            inside = np.arange(total, dtype=np.int64) - np.repeat(at, lengths)
            values = _BYTE[self.data[inside + np.repeat(self.starts, lengths)]]
            if int(lengths.max()) > _POWERS_KEPT:
                values *= _POW[inside % _POWERS_KEPT] + (inside // _POWERS_KEPT).astype(np.uint64)
            else:
                values *= _POW[inside]
            return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64))

    def of_words(self) -> np.ndarray:
        """Index of the text each word belongs to."""
        return np.repeat(np.arange(len(self.rows)), np.diff(self.first))


def blocks(column: pa.Array, table: np.ndarray, lower: bool = False, limit: int = BLOCK) -> Iterator[Block]:
    """Cut a text column into blocks. Null texts have no words."""
    if len(column) == 0:
        return
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, len(column), a + 50_000)
        data = whole[offsets[a] : offsets[b]]
        if lower:
            data = LOWER[data]
        edges = offsets[a : b + 1] - offsets[a]
        word = ~table[data]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        inner = edges[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = word[inner]  # a word never continues into the next text
        stops[inner - 1] = word[inner - 1]
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero(stops) + 1
        yield Block(range(a, b), data, starts, ends, np.searchsorted(starts, edges))
        a = b


def window_hashes(words: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of the ``length`` words from every position, composed by doubling; shorter than ``words`` by ``length - 1``."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, done, part, size = None, 0, words, 1
        base = _U(base | 1)
        power = base
        need = length
        scale = _U(1)
        while True:
            if need & 1:
                piece = part[done : done + n]
                out = piece * scale if out is None else out + piece * scale
                done += size
                scale = scale * power
            need >>= 1
            if not need:
                return mix(out)
            part = part[:-size] + part[size:] * power
            power = power * power
            size *= 2
