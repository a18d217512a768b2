"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Vectors and queries meet in blocks, every pair of blocks in one group. A block of vectors sorts each dimension once. A query goes down the
lists of its dimensions together, from the end that its sign favours, scores what it meets, and stops when the sum of the values it
has reached, the best score of anything unseen, is below its k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.settle import settle
from ..operators.skew import top_k

VECTORS, QUERIES = 2048, 1024


def scaled(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component; null for a vector that is null or holds a null or a non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _search(matrix: np.ndarray, lists: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all vectors that score at least as much as the k-th best, and the scores."""
    n = len(matrix)
    dims = np.flatnonzero(query)
    own = lists[:, dims]
    own = np.where(query[dims] > 0, own[::-1], own)  # best first
    seen, scores = np.zeros(n, bool), np.zeros(n, np.int64)
    depth, step = 0, 16
    while depth < n and len(dims):
        to = min(n, depth + step)
        met = np.zeros(n, bool)
        met[own[depth:to]] = True
        new = np.flatnonzero(met & ~seen)
        seen[new] = True
        scores[new] = matrix[new] @ query
        depth, step = to, step * 2
        found = scores[seen]
        if len(found) >= k:
            bound = int((matrix[own[depth - 1], dims] * query[dims]).sum())
            if np.partition(found, len(found) - k)[len(found) - k] > bound:
                break
    else:
        seen[:] = True  # nothing tells the vectors apart, or all lists are read
    places = np.flatnonzero(seen)
    found = scores[places]
    if len(found) > k:
        keep = found >= np.partition(found, len(found) - k)[len(found) - k]
        places, found = places[keep], found[keep]
    return places, found


def _group(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "vec_id": [], "score": [], "rid": []}
        if left.num_rows and right.num_rows:
            def matrix(column: pa.ChunkedArray) -> np.ndarray:
                return np.array(column.combine_chunks().flatten(), np.int64).reshape(len(column), -1)

            vectors, queries = matrix(left["vector"]), matrix(right["q_vector"])
            ids, rids = left["vec_id"].to_numpy(), left["rid"].to_numpy()
            # equal vectors once, each with its first k + 1 rows (one may be the query itself)
            _, first, inverse = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
            order = np.lexsort((rids, ids, inverse.ravel()))
            begin = np.searchsorted(inverse.ravel()[order], np.arange(len(first) + 1))
            distinct = vectors[first]
            lists = np.argsort(distinct, axis=0, kind="stable")
            for q, (rid, qid) in enumerate(zip(right["q_rid"].to_pylist(), right["q_vec_id"].to_pylist())):
                places, scores = _search(distinct, lists, queries[q], k + 1)
                rows = [(-int(s), int(ids[r]), int(rids[r])) for p, s in zip(places, scores) for r in order[begin[p] : min(begin[p + 1], begin[p] + k + 1)] if rids[r] != rid]
                for s, i, r in sorted(rows)[:k]:
                    for name, value in zip(out, (rid, qid, i, -s, r)):
                        out[name].append(value)
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` best other rows of every row that ``is_query`` selects, ties to the smaller vec_id.

    ``vectors`` has vec_id and embedding; other columns are ignored. Rows with a null vec_id, a null vector or a null or non-finite
    component take no part; vectors of another length than the query's do not meet it. Repeated rows are rows of their own: each is
    a candidate for the other. An empty table, or a query without others, gives no rows.
    """
    rows = settle(
        vectors.where(F.col("vec_id").isNotNull()).select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("vector"), is_query.alias("asks"))
        .where(F.col("vector").isNotNull()).withColumn("dim", F.size("vector")))
    counts = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    left_blocks, right_blocks = max(1, -(-counts[0] // VECTORS)), max(1, -(-counts[1] // QUERIES))
    part = lambda n: F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.withColumn("a", part(left_blocks)).withColumn("b", each(right_blocks))
    asked = rows.where("asks").withColumn("b", part(right_blocks)).withColumn("a", each(left_blocks))
    keys = ["dim", "a", "b"]
    base = base.select(*keys, "rid", "vec_id", "vector")
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in [*keys, "rid", "vec_id", "vector"]])
    met = base.groupBy(*keys).cogroup(asked.groupBy(*[f"q_{c}" for c in keys])).applyInArrow(_group(k), "query long, query_id long, vec_id long, score long, rid long")
    best = top_k(met, ["query"], [F.desc("score"), F.asc("vec_id"), F.asc("rid")], k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
