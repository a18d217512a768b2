"""Exact nearest vectors for many queries at once, over clusters with distance bounds.

Vectors are unit vectors here. With centre c and radius r of a cluster, no member x has q.x above q.c + r, so a query that already
knows k vectors of at least t needs only the clusters with q.c + r >= t. Vectors of neighbouring clusters are packed into blocks of bounded size, queries
too. A block of queries meets the blocks that one of its queries needs in a product of partitions, which writes no pair to disk, and holds only the ``k``
best of each query while it does; in a block that it meets, a query is scored in the clusters it still needs.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settle import settle

# the functions below travel to the executors by value, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLUSTERS = 4096  # at most; centres are the only part of the index that the driver holds
BLOCK = 4096  # vectors of a block, or queries
BLOCK_BYTES = 4 << 20  # of vectors that a block holds
ASKED_BYTES = 4 << 20  # of queries that a block holds
PART_BYTES = 64 << 20  # of vectors that a task of the product holds, and of queries that it is handed one block after the other
ROWS = 1024  # scored against all centres at once
CELLS = 1 << 20  # scores at once
HITS = 1 << 18  # that wait for their exact score
PAIRS = 4  # pairs of blocks that a Python worker is handed at once
_SLACK = 1e-9  # between sums of different order
_PACKED = "ids binary, clusters binary, vectors binary"


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(packed: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(packed, np.float32).reshape(-1, dims).astype(np.float64)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


@dataclass
class Index:
    """Centres (a bounded table; neighbours follow each other), size and radius of every cluster, the first block of every cluster and how many it is dealt over, and
    the blocks (block, ids, clusters, vectors)."""

    centres: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    blocks: DataFrame

    @property
    def dims(self) -> int:
        return self.centres.shape[1]


def _assigned(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` (id, embedding) with their nearest centre and the distance to it."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = (centres * centres).sum(axis=1) / 2
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.iloc[at:at + ROWS]
                u = _unit(_stacked(part["embedding"]))
                cluster = np.argmax(u @ centres.T - half, axis=1)
                far = np.linalg.norm(u - centres[cluster], axis=1)
                yield pd.DataFrame({"cluster": cluster.astype("int32"), "far": far, "id": part["id"].to_numpy(), "embedding": part["embedding"].to_numpy()})

    return rows.select("id", "embedding").mapInPandas(assign, "cluster int, far double, id long, embedding array<float>")


def _moved(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Means of the members of every centre; sums are made in every task before they are shuffled."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for b in batches:
            cluster = b["cluster"].to_numpy()
            np.add.at(total, cluster, _unit(_stacked(b["embedding"])))
            np.add.at(count, cluster, 1)
        some = np.flatnonzero(count)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype("int32"), "n": count[some], "total": list(total[some])})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        mean = np.stack(part["total"].to_numpy()).sum(axis=0) / part["n"].sum()
        return pd.DataFrame({"cluster": part["cluster"].iloc[:1], "mean": [mean]})

    partial = _assigned(rows, centres).mapInPandas(sums, "cluster int, n long, total array<double>")
    out = centres.copy()
    for r in partial.groupBy("cluster").applyInPandas(add, "cluster int, mean array<double>").collect():  # one row a centre
        out[r.cluster] = r.mean
    return out


def _chained(centres: np.ndarray) -> np.ndarray:
    """The same centres, each followed by the nearest of those that are left."""
    left, order = np.ones(len(centres), bool), [0]
    half = (centres * centres).sum(axis=1) / 2
    for _ in range(len(centres) - 1):
        left[order[-1]] = False
        order.append(int(np.argmax(np.where(left, centres @ centres[order[-1]] - half, -np.inf))))
    return centres[order]


def _dealt(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First block of every cluster and the number of blocks it is dealt over: neighbours share a block of ``most`` rows, a larger cluster has blocks of its own."""
    first, parts, block, held = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), 0, 0
    for c, n in enumerate(sizes):
        if held and held + n > most:
            block, held = block + 1, 0
        first[c], parts[c] = block, max(1, -(-n // most))
        if parts[c] > 1:
            block += parts[c]
        else:
            held += n
    return first, parts


def _of_cluster(values: np.ndarray, column: str = "cluster"):
    """The value of a row's cluster."""
    return F.expr(f"element_at(array({','.join(f'{v}L' for v in values)}), {column} + 1)")


def _packed(assigned: DataFrame, *keys: str) -> DataFrame:
    """One row for every block of ``assigned`` (keys, cluster, id, embedding), whose vectors lie in the order of their clusters."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cluster", kind="stable")
        vectors = np.stack(g["embedding"].to_numpy()).astype(np.float32).tobytes()
        return pd.DataFrame({k: g[k].iloc[:1] for k in keys} | {"ids": [g["id"].to_numpy(np.int64).tobytes()], "clusters": [g["cluster"].to_numpy(np.int32).tobytes()], "vectors": [vectors]})

    return assigned.select(*keys, "cluster", "id", "embedding").groupBy(*keys).applyInPandas(pack, ", ".join([*(f"{k} long" for k in keys), _PACKED]))


def build_index(rows: DataFrame, k: int, rounds: int = 2) -> Index | None:
    """Index over ``rows`` (id, embedding): distinct vectors of one length, none of them zero. Centres start at a fixed sample, the ids with the smallest hashes, and
    move ``rounds`` times; their number grows with the root of the rows, up to ``CLUSTERS``, and leaves about ``4 * k`` rows to each. None without rows."""
    n = rows.count()
    if n == 0:
        return None
    wanted = max(1, min(CLUSTERS, math.isqrt(n), n // (4 * k)))
    centres = _unit(np.array([r.embedding for r in rows.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()], np.float64))
    for _ in range(rounds):
        centres = _moved(rows, centres)
    centres = _chained(centres)
    assigned = settle(_assigned(rows, centres))
    sizes, radii = np.zeros(wanted, np.int64), np.zeros(wanted)
    for r in assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("r")).collect():
        sizes[r.cluster], radii[r.cluster] = r.n, r.r
    first, parts = _dealt(sizes, max(1, min(BLOCK, BLOCK_BYTES // (4 * centres.shape[1]))))
    block = _of_cluster(first) + F.pmod(F.xxhash64("id"), _of_cluster(parts))
    return Index(centres, sizes, radii, first, parts, settle(_packed(assigned.withColumn("block", block), "block")))


def _in_small_batches(df: DataFrame) -> DataFrame:
    """``df`` computed while Python workers get at most ``PAIRS`` rows at a time: its rows hold blocks of vectors, and Spark counts rows, not bytes. The session's
    setting is put back."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, str(PAIRS))
    try:
        return settle(df)
    finally:
        conf.set(name, before)


def _first(who: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of every ``who`` with the highest scores, ties to smaller ids, in order; and their places from 0."""
    order = np.lexsort((ids, -scores, who))
    who = who[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    some = place < k
    return who[some], ids[order][some], scores[order][some], place[some]


class _Lists:
    """The ``k`` best for every query of a block among the vectors that it has met so far. ``floors``: what a vector needs at least."""

    def __init__(self, vectors: bytes, centres: np.ndarray, radii: np.ndarray, k: int):
        self.centres, self.radii, self.k, self.dims = centres, radii, k, centres.shape[1]
        q = _matrix(vectors, self.dims)
        self.unit = _unit(q)
        self.short = self.unit.astype(np.float32)
        self.across = np.ascontiguousarray(q.T)
        self.length = self._length(self.across)
        self.error = (self.dims + 8) * 2.0**-23  # of a product of short unit vectors, twice its bound
        self.floors = np.full(len(q), -2.0)
        self.who, self.ids, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    @staticmethod
    def _length(across: np.ndarray) -> np.ndarray:
        total = np.zeros(across.shape[1])
        for x in across:
            total += x * x
        return np.sqrt(total)

    def meet(self, ids: bytes, clusters: bytes, vectors: bytes) -> None:
        v, told, of = _matrix(vectors, self.dims), np.frombuffer(ids, np.int64), np.frombuffer(clusters, np.int32)
        short, across = _unit(v).astype(np.float32), np.ascontiguousarray(v.T)
        length = self._length(across)
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        reach = self.unit @ self.centres[of[starts]].T + self.radii[of[starts]]
        waiting, held = [], 0
        for s, (a, b) in enumerate(zip(starts, [*starts[1:], len(of)])):
            for x in range(a, b, ROWS):
                y = min(b, x + ROWS)
                asks = np.flatnonzero(reach[:, s] >= self.floors - _SLACK)
                for at in range(0, len(asks), max(1, CELLS // (y - x))):
                    rows = asks[at:at + max(1, CELLS // (y - x))]
                    i, j = self._likely(rows, short[x:y])
                    waiting.append((rows[i], x + j))
                    held += len(i)
                    if held >= HITS:
                        self._add(waiting, told, across, length)
                        waiting, held = [], 0
        if held:
            self._add(waiting, told, across, length)

    def _likely(self, rows: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that can be in a list; no other pair can."""
        fast = self.short[rows] @ short.T
        least = self.floors[rows] - self.error
        hits = fast >= least.astype(np.float32)[:, None]
        if len(short) >= self.k and np.count_nonzero(hits) > 4 * self.k * len(rows):  # floors are loose yet
            least = np.maximum(least, np.partition(fast, -self.k, axis=1)[:, -self.k] - 2 * self.error)
            hits = fast >= least.astype(np.float32)[:, None]
        return np.nonzero(hits)

    def _add(self, waiting: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, across: np.ndarray, length: np.ndarray) -> None:
        """Scores are summed in the order of the dimensions."""
        i, j = (np.concatenate(x) for x in zip(*waiting))
        dot = np.zeros(len(i))
        for q, v in zip(self.across, across):
            dot += q[i] * v[j]
        cosine = dot / (length[j] * self.length[i])
        self.who, self.ids, self.scores, place = _first(np.concatenate([self.who, i]), np.concatenate([self.ids, ids[j]]), np.concatenate([self.scores, cosine]), self.k)
        full = place == self.k - 1
        self.floors[self.who[full]] = np.maximum(self.floors[self.who[full]], self.scores[full])


def needed(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """Blocks of queries (block, chunk, ids, vectors, floors, needs, pairs): with the score that a query has ``k`` vectors for already, found in the first block of its
    own cluster, the blocks of the index that one of them needs, and how many vectors are in clusters that a query needs."""
    centres, sizes, radii, first, parts = index.centres, index.sizes, index.radii, index.first, index.parts
    assigned, counts = _assigned(queries, centres), np.zeros(int((first + parts).max()), np.int64)
    for r in assigned.groupBy("cluster").count().collect():
        counts[first[r["cluster"]]] += r["count"]
    cores = queries.sparkSession.sparkContext.defaultParallelism
    most = max(1, min(BLOCK, ASKED_BYTES // (4 * index.dims), max(ROWS // 4, -(-int(counts.sum()) // (3 * cores)))))
    chunks = np.maximum(1, -(-counts // most))[first]
    dealt = assigned.withColumn("block", _of_cluster(first)).withColumn("chunk", F.pmod(F.xxhash64("id"), _of_cluster(chunks)))
    packed = settle(_packed(dealt, "block", "chunk").drop("clusters"))
    own = index.blocks.select("block", F.col("ids").alias("own_ids"), F.col("clusters").alias("own_clusters"), F.col("vectors").alias("own"))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, chunk, ids, vectors, own_ids, own_clusters, own in b.itertuples(index=False):
                lists = _Lists(vectors, centres, radii, k)
                if own is not None:
                    lists.meet(own_ids, own_clusters, own)
                reach = lists.unit @ centres.T + radii >= lists.floors[:, None] - _SLACK
                needs = sorted({int(first[c] + i) for c in np.flatnonzero(reach.any(axis=0) & (sizes > 0)) for i in range(parts[c])})
                yield pd.DataFrame({"block": [block], "chunk": [chunk], "ids": [ids], "vectors": [vectors], "floors": [lists.floors.tobytes()], "needs": [needs], "pairs": [int((reach @ sizes).sum())]})

    rows = packed.join(own, "block", "left").select("block", "chunk", "ids", "vectors", "own_ids", "own_clusters", "own")
    return rows.mapInPandas(ask, "block long, chunk long, ids binary, vectors binary, floors binary, needs array<long>, pairs long")


def lists(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of the index with the highest cosine for every query (id, embedding), ties to smaller ids: (query, ids, scores), best first. Exact: clusters are
    left out by their bound alone. Its tasks hold ``PART_BYTES`` of vectors each, and every one of them gives each query one list at most."""
    centres, radii = index.centres, index.radii
    width, cores = 4 * index.dims, queries.sparkSession.sparkContext.defaultParallelism
    held = max(1, -(-int(index.sizes.sum()) * width // PART_BYTES))
    handed = max(-(-queries.count() * width // PART_BYTES), -(-4 * cores // held))
    asked = needed(index, queries, k).drop("pairs").withColumnsRenamed({"block": "asked", "ids": "asked_ids", "vectors": "asked_vectors"})
    met = asked.repartition(handed, "asked", "chunk").join(index.blocks.coalesce(held).hint("shuffle_replicate_nl"), F.array_contains("needs", F.col("block")))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, mine = None, None
        told = lambda: pd.DataFrame({"asked": [key[0]], "chunk": [key[1]], "asked_ids": [key[2]], "n": [np.bincount(mine.who, minlength=len(mine.floors)).tobytes()], "ids": [mine.ids.tobytes()], "scores": [mine.scores.tobytes()]})
        for b in batches:
            for block, chunk, asked_ids, asked_vectors, floors, ids, clusters, vectors in b.itertuples(index=False):
                if key is None or key[:2] != (block, chunk):  # a block of queries meets its blocks one after the other
                    if key is not None:
                        yield told()
                    key, mine = (block, chunk, asked_ids), _Lists(asked_vectors, centres, radii, k)
                    mine.floors = np.frombuffer(floors, np.float64).copy()
                mine.meet(ids, clusters, vectors)
        if key is not None:
            yield told()

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        queries = np.frombuffer(g["asked_ids"].iloc[0], np.int64)
        who = np.concatenate([np.repeat(np.arange(len(queries)), np.frombuffer(n, np.int64)) for n in g["n"]])
        who, ids, scores, _ = _first(who, *(np.concatenate([np.frombuffer(x, kind) for x in g[name]]) for name, kind in (("ids", np.int64), ("scores", np.float64))), k)
        ends = np.cumsum(np.bincount(who, minlength=len(queries)))[:-1]
        return pd.DataFrame({"query": queries, "ids": np.split(ids, ends), "scores": np.split(scores, ends)})

    found = met.select("asked", "chunk", "asked_ids", "asked_vectors", "floors", "ids", "clusters", "vectors").mapInPandas(score, "asked long, chunk long, asked_ids binary, n binary, ids binary, scores binary")
    return _in_small_batches(found.groupBy("asked", "chunk").applyInPandas(merge, "query long, ids array<long>, scores array<double>"))


def search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """``lists`` with a row for each of them: (query, rank, id, score)."""
    hits = lists(index, queries, k).select("query", F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "hit"))
    return hits.select("query", (F.col("place") + 1).alias("rank"), F.col("hit.ids").alias("id"), F.col("hit.scores").alias("score"))


def pairs_scored(index: Index, queries: DataFrame, k: int) -> int:
    """How many (query, vector) pairs ``search`` scores at most, for reports."""
    return needed(index, queries, k).agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
