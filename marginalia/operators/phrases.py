"""Phrases of a dictionary in texts: one automaton for each block of the dictionary, every text read once by each."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import settle

# the functions below travel to the executors by value, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 8 << 20  # of phrases in one automaton


def _automaton(words: list[str]) -> ahocorasick.Automaton:
    """Automaton over ``words``; its values are their places in the list, as several phrases may share a lower-case form."""
    found: dict[str, list[int]] = {}
    for i, word in enumerate(words):
        found.setdefault(word, []).append(i)
    out = ahocorasick.Automaton()
    for word, places in found.items():
        out.add_word(word, tuple(places))
    out.make_automaton()
    return out


def _finder(block: Broadcast, keys: list[str]):
    """Job over (keys, text, low): rows (keys, phrase) for the distinct phrases of every text. A Python worker builds a block's automata once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = block.value
        if "automata" not in told:
            told["automata"] = [_automaton(told["folded"]), _automaton(told["exact"])]
        for b in batches:
            rows, phrases = [], []
            for i, texts in enumerate(zip(b.column("low").to_pylist(), b.column("text").to_pylist())):
                for name, machine, text in zip(("shown", "exact"), told["automata"], texts):
                    if len(machine):
                        hits = {places for _, places in machine.iter(text)}
                        shown = [told[name][p] for places in hits for p in places]
                        rows += [i] * len(shown)
                        phrases += shown
            at = pa.array(rows, pa.int64())
            columns = [b.column(k).take(at) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(phrases, pa.string())], names=[*keys, "phrase"])

    return find


def phrase_hits(texts: DataFrame, phrases: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, source, phrase) for every phrase a text (path, source, text) contains, once. Phrases that begin with an ASCII letter ignore case, others do not.

    The dictionary is dealt into blocks of about ``block_bytes``. Each is broadcast and read by one scan of the texts, which find all of its
    phrases in a single pass, whatever their number; texts are not shuffled. Null and empty texts hold nothing.
    """
    wanted = phrases.select(F.trim("phrase").alias("phrase")).where("phrase <> ''").distinct()
    wanted = settle(wanted.select("phrase", F.when(F.col("phrase").rlike("^[A-Za-z]"), F.lower("phrase")).alias("low")))
    size = wanted.agg(F.coalesce(F.sum(F.octet_length("phrase") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    asked = texts.select("path", "source", "text", F.lower("text").alias("low")).where("text <> ''")
    schema = "path string, source string, phrase string"
    out = None
    for n in range(blocks):
        told: dict[str, list[str]] = {"folded": [], "shown": [], "exact": []}
        for r in wanted.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == n).toLocalIterator():
            if r.low is None:
                told["exact"].append(r.phrase)
            else:
                told["folded"].append(r.low)
                told["shown"].append(r.phrase)
        block = texts.sparkSession.sparkContext.broadcast(told)
        part = asked.mapInArrow(_finder(block, ["path", "source"]), schema)
        out = part if out is None else out.unionByName(part)
    return out
