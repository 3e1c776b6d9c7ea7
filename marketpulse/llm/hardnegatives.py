"""Hard negatives from an inverted multi-index.

Each half of the vectors has a codebook of its own; the pair of the nearest codewords is a vector's cell. For an anchor, a codeword's bound
is its inner product with that half of the anchor plus the half's norm times the radius (the distance of the codeword's farthest member):
no member scores more in that half. Sums of two bounds order the cells, best first, without sorting all of them: a heap walks the
two sorted lists of bounds (the multi-sequence algorithm).

1. Codebooks are fitted on at most SAMPLE_ROWS rows; every row is indexed. They decide how much is read, never what is found.
2. Rows are cut into shards by the hash of their id, each with the index of its rows; blocks of anchors meet the shards in a grid.
3. Positives: cells are visited until the next sum is below the score of the last wanted positive. The sample, known to
   all tasks, gives each anchor a first lower bound on it.
4. Negatives: each positive has a window of scores. Cells are visited until every window is certified: the next sum is below
   its lower end, or below the last wanted negative found in it. Cells that lie above all windows as a whole are passed over.
5. The best of all shards are merged per anchor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.llm.common import one_row_per_id
from marketpulse.session import configure, materialize

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 5
LEAST_PERCENT = 80
#: Rows the codebooks are fitted on, the codewords of a half, and rounds of fitting.
SAMPLE_ROWS, CODEWORDS, ROUNDS = 20_000, 16, 8
SHARD_ROWS, ANCHOR_ROWS = 1 << 14, 256
#: Members of visited cells that are scored at once.
TOGETHER = 2048
#: Largest sum of squares whose products still fit into a long.
EXACT_LONG, EXACT_DOUBLE = 2.0**62, 2.0**53


def fit(vectors: np.ndarray, codewords: int = CODEWORDS) -> np.ndarray:
    """Codewords of one half by k-means, started from rows that are far apart."""
    if not len(vectors):
        return np.zeros((1, vectors.shape[1]))
    centers = [vectors[0]]
    away = ((vectors - centers[0]) ** 2).sum(axis=1)
    while len(centers) < codewords and away.max() > 0:
        centers.append(vectors[int(away.argmax())])
        away = np.minimum(away, ((vectors - centers[-1]) ** 2).sum(axis=1))
    found = np.array(centers)
    for _ in range(ROUNDS):
        own = nearest(vectors, found)
        n = np.bincount(own, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def nearest(vectors: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    return np.argmin((codewords**2).sum(axis=1) - 2 * vectors @ codewords.T, axis=1)


def longest(vectors: np.ndarray) -> float:
    return float(np.sqrt((vectors**2).sum(axis=1).max(initial=0.0)))


def scores(corpus: np.ndarray, anchor: np.ndarray, length: float) -> np.ndarray:
    """Inner products of whole numbers with vectors of `length` or shorter, exact as long as they fit into 64 bits."""
    if length * np.sqrt((anchor**2).sum()) >= EXACT_DOUBLE / 2:
        return corpus.astype(np.int64) @ anchor.astype(np.int64)
    return (corpus @ anchor).astype(np.int64)


class Shard:
    """The inverted multi-index of some vectors of one length. books: codewords of either half."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> None:
        self.half = vectors.shape[1] // 2
        self.books = books
        halves = vectors[:, : self.half], vectors[:, self.half :]
        own = [nearest(h, book) for h, book in zip(halves, books)]
        self.radius = []
        for h, book, o in zip(halves, books, own):
            radius = np.zeros(len(book))
            np.maximum.at(radius, o, np.sqrt(((h - book[o]) ** 2).sum(axis=1)))
            self.radius.append(radius)
        cell = own[0] * len(books[1]) + own[1]
        order = np.lexsort((ids, cell))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.longest = longest(vectors)
        self.begin = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))

    def cells(self, anchor: np.ndarray) -> Iterator[tuple[float, float, int]]:
        """(upper bound, lower bound, cell) of the cells in descending order of the upper bound, by the multi-sequence heap."""
        parts = anchor[: self.half], anchor[self.half :]
        middle = [book @ part for book, part in zip(self.books, parts)]
        spread = [np.sqrt((part**2).sum()) * radius for part, radius in zip(parts, self.radius)]
        high = [m + s for m, s in zip(middle, spread)]
        low = [m - s for m, s in zip(middle, spread)]
        order = [np.argsort(-h, kind="stable") for h in high]
        # Rounding of the bounds themselves.
        slack = 1e-6 + 1e-9 * sum(float(np.abs(h).max(initial=0.0)) for h in (*high, *low))
        sizes = len(order[0]), len(order[1])
        heap, waiting = [(-(high[0][order[0][0]] + high[1][order[1][0]]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            a, b = order[0][i], order[1][j]
            yield -bound + slack, low[0][a] + low[1][b] - slack, int(a) * sizes[1] + int(b)
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < sizes[0] and y < sizes[1] and (x, y) not in waiting:
                    waiting.add((x, y))
                    heapq.heappush(heap, (-(high[0][order[0][x]] + high[1][order[1][y]]), x, y))

    def visit(self, anchor: np.ndarray, needed, above: float = np.inf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, scores) of members, some cells at a time, until the next bound is below needed().

        Cells whose scores are all over `above` are passed over.
        """
        held, rows = [], 0
        for high, low, cell in self.cells(anchor):
            if high < needed():
                break
            begin, end = self.begin[cell], self.begin[cell + 1]
            if begin == end or low > above:
                continue
            held.append(np.arange(begin, end))
            rows += end - begin
            if rows >= TOGETHER:
                places = np.concatenate(held)
                yield places, scores(self.vectors[places], anchor, self.longest)
                held, rows = [], 0
        if held:
            places = np.concatenate(held)
            yield places, scores(self.vectors[places], anchor, self.longest)

    def _best(self, places: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[places], -found))[:k]
        return places[order], found[order]

    def positives(self, anchor_id: int, label: int, anchor: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best other rows of the label. least: at least k rows of the label score that much."""
        best = np.empty(0, np.int64), np.empty(0, np.int64)
        for places, found in self.visit(anchor, lambda: max(least, best[1][-1] if len(best[1]) == k else -np.inf)):
            fit = (self.labels[places] == label) & (self.ids[places] != anchor_id)
            best = self._best(np.append(best[0], places[fit]), np.append(best[1], found[fit]), k)
        return self.ids[best[0]], best[1]

    def negatives(self, label: int, anchor: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (lowest, highest score): (ids, scores) of the k best rows of other labels in it."""
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in windows]

        def needed() -> float:
            return min((float(f[-1]) if len(f) == k else float(low) for (low, _), (_, f) in zip(windows, best)), default=np.inf)

        for places, found in self.visit(anchor, needed, max((h for _, h in windows), default=-np.inf)):
            other = self.labels[places] != label
            places, found = places[other], found[other]
            for w, (low, high) in enumerate(windows):
                fit = (found >= low) & (found <= high)
                if fit.any():
                    best[w] = self._best(np.append(best[w][0], places[fit]), np.append(best[w][1], found[fit]), k)
        return [(self.ids[p], f) for p, f in best]


def window(positive: int, least_percent: int) -> tuple[int, int]:
    """Whole scores between least_percent of the positive's score and that score; empty (lowest over highest) below zero."""
    return -(-least_percent * positive // 100), positive


def _scaled(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.floor(SCALE * np.asarray(v, np.float64)) for v in column.to_pylist()]


def _shards(table: pa.Table, books: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, Shard]:
    """One index per vector length in the table."""
    vectors = _scaled(table.column("embedding"))
    lengths = np.array([len(v) for v in vectors], np.int64)
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    out = {}
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        # A length that the sample does not hold has one codeword.
        own = books.get(dim) or (np.zeros((1, dim // 2)), np.zeros((1, dim - dim // 2)))
        out[dim] = Shard(ids[at], labels[at], np.array([vectors[i] for i in at]).reshape(len(at), dim), own)
    return out


def _positives(books, sample, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("anchor_id", "positive_id", "positive_score")}
        if left.num_rows and right.num_rows:
            shards = _shards(right, books.value)
            for anchor_id, label, anchor in zip(left.column("vec_id").to_pylist(), left.column("label").to_pylist(), _scaled(left.column("embedding"))):
                shard = shards.get(len(anchor))
                if shard is None:
                    continue
                ids, same = sample.value.get((len(anchor), label), (np.empty(0, np.int64), np.empty((0, len(anchor)))))
                known = np.sort(scores(same[ids != anchor_id], anchor, longest(same)))
                found, score = shard.positives(anchor_id, label, anchor, k, float(known[-k]) if len(known) >= k else -np.inf)
                out["anchor_id"] += [anchor_id] * len(found)
                out["positive_id"] += found.tolist()
                out["positive_score"] += score.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def _negatives(books, k: int, least_percent: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        out = {c: [] for c in names}
        if left.num_rows and right.num_rows:
            shards = _shards(right, books.value)
            for row, anchor in zip(left.select(["vec_id", "label", "positives"]).to_pylist(), _scaled(left.column("embedding"))):
                shard = shards.get(len(anchor))
                # Positives of one score share a window.
                by_window: dict[tuple[int, int], list[dict]] = {}
                for p in row["positives"]:
                    low, high = window(p["positive_score"], least_percent)
                    if low <= high:
                        by_window.setdefault((low, high), []).append(p)
                if shard is None or not by_window:
                    continue
                for same, (found, score) in zip(by_window.values(), shard.negatives(row["label"], anchor, list(by_window), k)):
                    for p in same:
                        out["anchor_id"] += [row["vec_id"]] * len(found)
                        out["positive_id"] += [p["positive_id"]] * len(found)
                        out["positive_score"] += [p["positive_score"]] * len(found)
                        out["negative_id"] += found.tolist()
                        out["negative_score"] += score.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def _grid(anchors: DataFrame, rows: DataFrame, meet, schema: str) -> DataFrame:
    """Every block of anchors meets every shard of rows in a task of its own."""
    blocks = max(1, -(-anchors.count() // ANCHOR_ROWS))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    own = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", own(blocks, 1).alias("block")).select("*", every(shards).alias("shard"))
    right = rows.select("*", own(shards, 2).alias("shard")).select("*", every(blocks).alias("block"))
    return left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard")).applyInArrow(meet, schema)


def _top(found: DataFrame, by: list[str], score: str, ties: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), ties))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def _sample(rows: DataFrame) -> tuple[dict, dict]:
    """Codebooks per vector length, and vectors by length and label, of SAMPLE_ROWS rows at most, chosen by the hash of the id."""
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    vectors = _scaled(taken.column("embedding"))
    ids, labels = taken.column("vec_id").to_pylist(), taken.column("label").to_pylist()
    grouped: dict[tuple[int, int], list[int]] = {}
    for i, (v, label) in enumerate(zip(vectors, labels)):
        grouped.setdefault((len(v), label), []).append(i)
    sample = {k: (np.array([ids[i] for i in at], np.int64), np.array([vectors[i] for i in at]).reshape(len(at), k[0])) for k, at in grouped.items()}
    books = {}
    for dim in {d for d, _ in sample}:
        all_rows = np.concatenate([v for (d, _), (_, v) in sample.items() if d == dim])
        books[dim] = fit(all_rows[:, : dim // 2]), fit(all_rows[:, dim // 2 :])
    return books, sample


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: vec_id, embedding, label. A score is the inner product of the components floor(256 x). An anchor's positives are its best
    `positives` other rows of its label; per positive, the best `negatives` rows of other labels that score least_percent to 100 percent
    of it. Ties go to the smaller vec_id; too few rows: all there are. An anchor without positives, and a positive without rows in its window,
    give no rows; a negative positive score has no window.

    Rows without vec_id or label, and vectors that are null or hold null or non-finite components, take no part; nor do vectors whose
    scaled squares add up to 2**62 or more, whose scores may leave a long. Vectors of different lengths do not meet; empty ones score 0. Of
    several rows with one vec_id one stays. An empty table gives an empty result. Other columns are not read.
    """
    spark = configure(vectors.sparkSession)
    vector = F.col("embedding").cast("array<double>")
    squares = F.aggregate(vector, F.lit(0.0), lambda done, x: done + F.floor(x * SCALE).cast("double") * F.floor(x * SCALE).cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < 2.0**31))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("embedding"),
                          anchors.alias("anchor"))
    rows = rows.where("vec_id is not null and label is not null and embedding is not null")
    rows = rows.where(F.when(finite, squares < EXACT_LONG).otherwise(False))
    rows = materialize(one_row_per_id(rows, "vec_id"), "vectors")
    found_anchors = materialize(rows.where("anchor").drop("anchor"), "anchors")
    rows = rows.drop("anchor")
    books, sample = (spark.sparkContext.broadcast(x) for x in _sample(rows))
    near = _grid(found_anchors, rows, _positives(books, sample, positives), "anchor_id long, positive_id long, positive_score long")
    near = materialize(_top(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    held = near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = found_anchors.join(held.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    hard = _grid(asked, rows, _negatives(books, negatives, least_percent),
                 "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    hard = _top(hard, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return hard.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
