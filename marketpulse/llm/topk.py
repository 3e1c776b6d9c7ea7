"""Exact search for the largest inner products, pruned by segment statistics at several resolutions.

Vectors are cut into segments; of each segment the mean and the deviation are kept. For two vectors the squared distance is at
least the sum over segments of length * ((difference of means)^2 + (difference of deviations)^2); with the norms known this
bounds the inner product from above by the sum of length * (product of means + product of deviations). Few long segments
are tried first, then many short ones, and only candidates that can still reach the k-th best score get their exact score.

Queries and candidates are packed into blocks and meet in a grid, each cell of which is one bounded group: a few blocks
of either side. A cell returns k rows per query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.session import configure, materialize

K = 20
SCALE = 64.0
#: Segment lengths, coarse to fine.
SEGMENTS = (16, 4)
QUERY_ROWS, CORPUS_ROWS = 1024, 4096
#: Blocks of either side that a cell of the grid holds.
GROUP = 8
#: Above this share of survivors the next level is computed for all pairs of the blocks at once.
DENSE = 0.1


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, vectors = zip(*held.pop(dim))
            number += 1
            return pa.RecordBatch.from_pydict({
                "block": [part * (1 << 32) + number], "dim": pa.array([dim], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()],
                "vectors": [np.floor(SCALE * np.array(vectors, np.float64)).tobytes()]})

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
                vector = vector.values.to_numpy()
                held.setdefault(len(vector), []).append((key, vector))
                if len(held[len(vector)]) == rows:
                    yield block(len(vector))
        for dim in list(held):
            yield block(dim)

    return run


def statistics(vectors: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of their lengths: two such rows' product bounds the inner product."""
    starts = np.arange(0, vectors.shape[1], length)
    sizes = np.diff(np.append(starts, vectors.shape[1]))
    means = np.add.reduceat(vectors, starts, axis=1) / sizes
    squares = np.add.reduceat(vectors * vectors, starts, axis=1) / sizes
    return np.concatenate([means, np.sqrt(np.maximum(0.0, squares - means * means))], axis=1) * np.sqrt(np.tile(sizes, 2))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact while they fit into 64 bits."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        return a.astype(np.int64) @ b.astype(np.int64)
    return (a @ b).astype(np.int64)


def best_of(queries: np.ndarray, query_ids: np.ndarray, corpus: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, ...]:
    """(query row, candidate id, score): the k best candidates of each query, ties to the smaller id, not itself.

    Repeated candidate ids count once, with their best score.
    """
    n = len(queries)
    every = np.concatenate([candidates for _, candidates in corpus]) if corpus else np.empty(0, np.int64)
    repeated = len(np.unique(every)) < len(every)
    row, ids, scores = (np.empty(0, np.int64) for _ in range(3))
    least = np.full(n, -np.inf)
    levels = [statistics(queries, s) for s in SEGMENTS]
    for vectors, candidates in corpus:
        alive = None  # (query rows, candidate rows); None: all pairs
        if np.isfinite(least).any():
            slack = 1e-3 + 1e-9 * np.linalg.norm(queries, axis=1) * np.linalg.norm(vectors, axis=1).max(initial=0.0)
            for own, length in zip(levels, SEGMENTS):
                other = statistics(vectors, length)
                if alive is None or len(alive[0]) > DENSE * n * len(vectors):
                    fit = own @ other.T + slack[:, None] >= least[:, None]
                    if alive is not None:
                        seen = np.zeros_like(fit)
                        seen[alive] = True
                        fit &= seen
                    alive = np.nonzero(fit)
                else:
                    bound = np.einsum("ij,ij->i", own[alive[0]], other[alive[1]])
                    fit = bound + slack[alive[0]] >= least[alive[0]]
                    alive = alive[0][fit], alive[1][fit]
        if alive is None or len(alive[0]) > DENSE * n * len(vectors):
            whole = _exact(queries, vectors.T)
            alive = np.nonzero(whole >= least[:, None]) if alive is not None else tuple(x.ravel() for x in np.indices(whole.shape))
            score = whole[alive]
        else:
            score = _exact_pairs(queries[alive[0]], vectors[alive[1]])
        other = candidates[alive[1]]
        fit = (score >= least[alive[0]]) & (other != query_ids[alive[0]])
        row, ids, scores = np.append(row, alive[0][fit]), np.append(ids, other[fit]), np.append(scores, score[fit])
        if repeated:
            order = np.lexsort((-scores, ids, row))
            row, ids, scores = row[order], ids[order], scores[order]
            best = np.append(True, (row[1:] != row[:-1]) | (ids[1:] != ids[:-1]))[: len(row)]
            row, ids, scores = row[best], ids[best], scores[best]
        order = np.lexsort((ids, -scores, row))
        row, ids, scores = row[order], ids[order], scores[order]
        begin = np.searchsorted(row, np.arange(n))
        kept = np.arange(len(row)) - begin[row] < k
        row, ids, scores = row[kept], ids[kept], scores[kept]
        count = np.bincount(row, minlength=n)
        ends = np.cumsum(count) - 1
        least = np.where(count >= k, scores[np.maximum(ends, 0)] if len(scores) else -np.inf, -np.inf)
    return row, ids, scores


def _exact_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**53:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.einsum("ij,ij->i", a, b).astype(np.int64)


def _unpack(block: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(block["vectors"], np.float64).reshape(-1, block["dim"]), np.frombuffer(block["ids"], np.int64)


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        corpus = [_unpack(b) for b in right.to_pylist()]
        out = []
        for block in left.to_pylist() if corpus else []:
            vectors, ids = _unpack(block)
            row, found, scores = best_of(vectors, ids, corpus, k)
            out.append(pa.table({"query_id": ids[row], "vec_id": found, "score": scores}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})

    return run


def exact_topk(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row with `queries`, its k highest inner products over all other rows.

    vectors: vec_id, embedding. Components count as floor(64 x). Vectors that are null, empty or hold a null or non-finite
    component, and rows without vec_id, take no part. Vectors of different lengths do not meet. Rows of one vec_id are not candidates
    of each other; of such a candidate or query each row counts, an equal (query, candidate) pair with its best score, once. Ties go to the smaller
    vec_id. Fewer than k candidates: all. An empty table gives an empty result.
    """
    configure(vectors.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = "block long, dim int, ids binary, vectors binary"
    left = materialize(rows.where(queries).mapInArrow(_pack(QUERY_ROWS), schema), "query-blocks")
    right = materialize(rows.mapInArrow(_pack(CORPUS_ROWS), schema), "corpus-blocks")
    groups = [max(1, -(-side.count() // GROUP)) for side in (left, right)]
    own = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("*", own(groups[0]).alias("q"), every(groups[1]).alias("c"))
    right = right.select("*", every(groups[0]).alias("q"), own(groups[1]).alias("c"))
    cell = ["dim", "q", "c"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
