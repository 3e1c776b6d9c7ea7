"""Cosine top-k: exact, and over inverted lists.

Both work in blocks. A block of queries meets a block of the corpus in one matrix product, which hands on at most k
rows per query; the final ranking sees only these. Pairs of vectors are never rows of a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.functions.vectors import l2_normalize
from marketpulse.operators.sizes import broadcast_if_small, is_small
from marketpulse.session import materialize

# A query set up to this many numbers is sent to all tasks; a larger one is shuffled in blocks.
BROADCAST_NUMBERS = 4_000_000
# Vectors per block side in the shuffled form.
BLOCK_ROWS = 20_000
# Scores held at a time within a task.
PRODUCT_NUMBERS = 4_000_000


def _result(corpus: DataFrame) -> str:
    return f"query_id string, vec_id {corpus.schema['vec_id'].dataType.simpleString()}, score double"


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1.0)


def _best(query_ids: np.ndarray, units: np.ndarray, corpus_ids: np.ndarray, corpus: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of this block per query; scores to nine places, ties by id."""
    parts = []
    step = max(1, PRODUCT_NUMBERS // max(1, len(corpus_ids)))
    for start in range(0, len(query_ids), step):
        scores = np.round(units[start:start + step] @ corpus.T, 9)
        if scores.shape[1] > k:
            kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
            q, c = np.nonzero(scores >= kth)
        else:
            q, c = np.nonzero(np.ones_like(scores, dtype=bool))
        parts.append(_top(pd.DataFrame({
            "query_id": query_ids[start:start + step][q], "vec_id": corpus_ids[c], "score": scores[q, c]}), k))
    return pd.concat(parts) if parts else _nothing()


def _top(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
    return found.groupby("query_id", sort=False).head(k)


def _nothing() -> pd.DataFrame:
    # Objects, as an empty column of floats does not become one of texts.
    return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=object)


def _final_rank(partial: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _top_rows(partial: DataFrame, k: int) -> DataFrame:
    return _final_rank(partial, k).drop("rank")


def cosine_topk(
    queries: DataFrame, corpus: DataFrame, k: int, broadcast_numbers: int = BROADCAST_NUMBERS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k nearest corpus vectors per query, exactly.

    queries: (query_id string, vector); corpus: (vec_id long, vector).
    Returns (query_id, vec_id, score, rank).
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if size["n"] * (size["dim"] or 0) <= broadcast_numbers:
        return _final_rank(_with_sent_queries(queries, corpus, k), k)
    one_list = F.lit(0)
    return _final_rank(_blocked(queries.withColumn("list_id", one_list), corpus.withColumn("list_id", one_list), k, block_rows), k)


def _with_sent_queries(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Few queries: every task holds them all and keeps its own best k."""
    rows = queries.select("query_id", "vector").collect()
    ids = np.array([r["query_id"] for r in rows], dtype=object)
    units = _unit_rows(pd.Series([r["vector"] for r in rows])) if rows else np.zeros((0, 1))
    sent = queries.sparkSession.sparkContext.broadcast((ids, units))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_units = sent.value
        kept = _nothing()
        for batch in batches:
            if len(batch) and len(query_ids):
                found = _best(query_ids, query_units, batch["vec_id"].to_numpy(), _unit_rows(batch["vector"]), k)
                kept = _top(pd.concat([kept, found]), k) if len(kept) else found
        yield kept

    return corpus.select("vec_id", "vector").mapInPandas(search, _result(corpus))


def _blocked(queries: DataFrame, corpus: DataFrame, k: int, block_rows: int) -> DataFrame:
    """Queries and corpus vectors meet per list, in blocks of bounded size.

    A list, however large its share of all vectors, is cut into blocks by the hash of the id. Each query row is
    repeated per corpus block and each corpus row per query block, so no task gets more than one block of each side.
    """
    def blocks(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))

    # One row per list; lists that only one side has find no partner. Broadcast, as the rows of a list must not meet
    # in one task for this join.
    sizes = broadcast_if_small(blocks(queries, "q_blocks").join(blocks(corpus, "c_blocks"), "list_id"))

    def spread(side: DataFrame, own: str, other: str, row_id: Column) -> DataFrame:
        block = F.pmod(F.xxhash64(row_id), F.col(f"{own}_blocks").cast("bigint")).cast("int")
        everywhere = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        return side.join(sizes, "list_id").withColumn(f"{own}_block", block).withColumn(f"{other}_block", everywhere)

    left = spread(queries, "q", "c", F.col("query_id")).select(
        "list_id", "q_block", "c_block", "query_id", "vector")
    right = spread(corpus, "c", "q", F.col("vec_id")).select(
        "list_id", "q_block", "c_block", "vec_id", "vector")

    def meet(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return _nothing()
        return _best(q["query_id"].to_numpy(), _unit_rows(q["vector"]), c["vec_id"].to_numpy(), _unit_rows(c["vector"]), k)

    key = ["list_id", "q_block", "c_block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, _result(corpus))


def train_lists(corpus: DataFrame, lists: int = 100, seed: int = 7) -> DataFrame:
    """Centroids of `lists` k-means clusters over the unit vectors: (list_id, centroid)."""
    points = corpus.select(array_to_vector(l2_normalize(F.col("vector"))).alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=20).fit(points)
    centers = [(i, [float(x) for x in center]) for i, center in enumerate(model.clusterCenters())]
    return corpus.sparkSession.createDataFrame(centers, "list_id int, centroid array<double>")


def _centroids(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and unit vectors of the lists, in order of the numbers."""
    if not is_small(centroids):
        raise ValueError("centroids are sent to all tasks: at most a million of them, and 64 MB")
    rows = sorted(centroids.select("list_id", "centroid").collect())
    if not rows:
        return np.empty(0, np.int32), np.empty((0, 0))
    return np.array([r["list_id"] for r in rows]), _unit_rows(pd.Series([r["centroid"] for r in rows]))


def nearest_lists(vectors: DataFrame, id_column: str, centroids: DataFrame, probes: int, *carry: str) -> DataFrame:
    """The `probes` nearest lists of each vector by cosine, with the columns to carry. The centroids, one per list, are sent to all tasks."""
    ids, units = _centroids(centroids)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, units))
    kept = [id_column, *carry, "vector"]
    schema = ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in kept)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        list_ids, list_units = sent.value
        for batch in batches:
            if not len(batch):
                continue
            scores = np.round(_unit_rows(batch["vector"]) @ list_units.T, 9)
            nearest = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
            each = batch.loc[batch.index.repeat(nearest.shape[1])]
            yield pd.DataFrame({c: each[c].to_numpy() for c in kept} | {"list_id": list_ids[nearest.ravel()].astype("int32")})

    return vectors.select(*kept).mapInPandas(assign, f"{schema}, list_id int")


def assign_lists(corpus: DataFrame, centroids: DataFrame) -> DataFrame:
    """The index: each vector with its nearest list. To be stored once, by list, and searched many times."""
    return nearest_lists(corpus, "vec_id", centroids, 1)


def _sent_to_lists(placed: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Few queries: every task holds them all, and rows of a list meet the queries that look into it. The index is not shuffled."""
    sent_rows: dict[int, list] = {}
    for r in placed.select("query_id", "vector", "list_id").collect():
        sent_rows.setdefault(r["list_id"], []).append(r)
    lists = {i: (np.array([r["query_id"] for r in rows], dtype=object), _unit_rows(pd.Series([r["vector"] for r in rows])))
             for i, rows in sent_rows.items()}
    sent = placed.sparkSession.sparkContext.broadcast(lists)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = _nothing()
        for batch in batches:
            for list_id, rows in batch.groupby("list_id", sort=False):
                if list_id in sent.value:
                    found = _best(*sent.value[list_id], rows["vec_id"].to_numpy(), _unit_rows(rows["vector"]), k)
                    kept = _top(pd.concat([kept, found]), k) if len(kept) else found
        yield kept

    return index.select("list_id", "vec_id", "vector").mapInPandas(search, _result(index))


def _look(placed: DataFrame, index: DataFrame, k: int, block_rows: int, broadcast_numbers: int) -> DataFrame:
    """Per query and task, the k best rows of the lists it is placed in. Only these lists are read: their numbers, at most one per
    centroid, go into the filter of the index, so that an index stored by list is read only where a query looks."""
    probed = sorted(row["list_id"] for row in placed.select("list_id").distinct().collect())
    index = index.filter(F.col("list_id").isin(probed))
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim")).first()
    if size["n"] * (size["dim"] or 0) <= broadcast_numbers:
        return _sent_to_lists(placed, index, k)
    return _blocked(placed, index, k, block_rows)


def ivf_topk(
    queries: DataFrame, index: DataFrame, centroids: DataFrame, k: int, probes: int, block_rows: int = BLOCK_ROWS,
    broadcast_numbers: int = BROADCAST_NUMBERS,
) -> DataFrame:
    """Approximate top-k: each query looks only into its `probes` nearest lists. All lists give the exact answer.

    `ivf_exact` looks into as many as it takes.
    """
    return _final_rank(_look(nearest_lists(queries, "query_id", centroids, probes), index, k, block_rows, broadcast_numbers), k)


def list_measures(index: DataFrame, centroids: DataFrame) -> DataFrame:
    """Per list that has vectors: n, radius (the widest angle between centroid and vector), cosines (their sum)."""
    ids, units = _centroids(centroids)
    sent = index.sparkSession.sparkContext.broadcast(dict(zip(ids.tolist(), units)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for list_id, rows in batch.groupby("list_id", sort=False):
                near = np.clip(_unit_rows(rows["vector"]) @ sent.value[list_id], -1.0, 1.0)
                yield pd.DataFrame({"list_id": [list_id], "n": [len(rows)], "radius": [np.arccos(near.min())], "cosines": [near.sum()]})

    parts = index.select("list_id", "vector").mapInPandas(measure, "list_id int, n long, radius double, cosines double")
    return parts.groupBy("list_id").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("cosines").alias("cosines"))


def list_radii(index: DataFrame, centroids: DataFrame) -> DataFrame:
    """The centroids with the sizes and radii of their lists; lists without vectors have no row."""
    return centroids.select("list_id", "centroid").join(F.broadcast(list_measures(index, centroids).drop("cosines")), "list_id")


def list_bounds(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """(query_id, list_id, n, bound, angle): bound is what no vector of the list can exceed in cosine with the query.

    The angle to a vector is at least the angle to its centroid less the radius of the list. One narrow row per query and list.
    """
    ids, units = _centroids(lists)
    rows = {r["list_id"]: (r["n"], r["radius"]) for r in lists.select("list_id", "n", "radius").collect()}
    sizes, radii = (np.array([rows[i][j] for i in ids.tolist()]) for j in (0, 1))
    sent = queries.sparkSession.sparkContext.broadcast((ids, units, sizes, radii))

    def bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        list_ids, list_units, n, radius = sent.value
        for batch in batches:
            if len(batch) and len(list_ids):
                angle = np.arccos(np.clip(_unit_rows(batch["vector"]) @ list_units.T, -1.0, 1.0))
                bound = np.cos(np.maximum(0.0, angle - radius))
                each = batch.loc[batch.index.repeat(len(list_ids))]
                yield pd.DataFrame({
                    "query_id": each["query_id"].to_numpy(), "list_id": np.tile(list_ids, len(batch)).astype("int32"),
                    "n": np.tile(n, len(batch)), "bound": bound.ravel(), "angle": angle.ravel()})

    return queries.select("query_id", "vector").mapInPandas(
        bounds, "query_id string, list_id int, n long, bound double, angle double")


@dataclass(frozen=True)
class ListSearch:
    """The answer of an exact search over lists, and which lists each query looked into: (query_id, list_id, n, round)."""

    found: DataFrame
    looked: DataFrame

    def share_read(self, lists: DataFrame) -> float:
        """Rows of the lists that were looked into, as a share of queries times all rows."""
        total = lists.agg(F.sum("n")).first()[0] or 0
        read = self.looked.agg(F.sum("n").alias("n"), F.count_distinct("query_id").alias("q")).first()
        return read["n"] / (total * read["q"]) if total and read["q"] else 0.0


#: Rounding of angles and of scores to nine places.
_SLACK = 2e-9


def ivf_exact(
    queries: DataFrame, index: DataFrame, lists: DataFrame, k: int, first: int = 2, block_rows: int = BLOCK_ROWS,
    broadcast_numbers: int = BROADCAST_NUMBERS,
) -> ListSearch:
    """Exact top-k over inverted lists: the same rows as `cosine_topk`.

    lists: the centroids with sizes and radii (`list_radii`). A query looks into its `first` nearest lists, and into the next ones as
    long as these hold fewer than k vectors. With its k-th best score so far, the radii then exclude all lists whose bound
    is below it; the others are looked into as well.
    """
    nearest = Window.partitionBy("query_id").orderBy("angle", "list_id")
    before = F.coalesce(F.sum("n").over(nearest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bounds = list_bounds(queries, lists).withColumn("_at", F.row_number().over(nearest)).withColumn("_held", before)
    bounds = materialize(bounds.withColumn("_first", (F.col("_at") <= first) | (F.col("_held") < k)), "list-bounds")
    sides = broadcast_if_small(queries.select("query_id", "vector"))
    look = lambda pairs: _look(pairs.select("query_id", "list_id").join(sides, "query_id"), index, k, block_rows, broadcast_numbers)
    start = bounds.filter("_first")
    partial = materialize(_top_rows(look(start), k), "first-lists")
    kth = partial.groupBy("query_id").agg(F.count(F.lit(1)).alias("_found"), F.min("score").alias("_kth"))
    rest = bounds.filter("not _first").join(broadcast_if_small(kth), "query_id", "left")
    rest = rest.filter((F.coalesce("_found", F.lit(0)) < k) | (F.col("bound") >= F.col("_kth") - _SLACK)).select(*bounds.columns)
    rest = materialize(rest, "further-lists")
    found = partial.unionByName(look(rest))
    looked = start.withColumn("round", F.lit(1)).unionByName(rest.withColumn("round", F.lit(2))).select("query_id", "list_id", "n", "round")
    return ListSearch(_final_rank(found, k), looked)
