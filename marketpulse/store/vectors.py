"""A maintained index over the stored vectors: inverted lists that follow what ingestion adds.

A generation is one set of centroids, and the runs of vectors that were assigned to them: one folder per list, so that a search reads the
lists it looks into. New runs of the store are assigned as they come. A vector that replaces an older one may lie in another list: the run
says which posts it replaces, and a search leaves out their older rows. When the vectors drift away from the centroids, the lists
are trained anew as the next generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions.vectors import l2_normalize
from marketpulse.operators import similarity
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.schemas import POST_KEY
from marketpulse.store.log import Snapshot, exists, folders, remove, snapshot
from marketpulse.store.tables import latest

#: Vectors that the lists are trained on at most, chosen by the hash of the key. Every vector is indexed.
TRAINING_ROWS = 200_000
#: The lists are trained anew when new vectors lie this much farther from their centroids, in mean cosine, than those trained on did.
DRIFT = 0.1
#: Leading bits of a key's hash by which keys are counted to find the training rows.
_HASH_BITS = 16
_ROWS = "vec_id string, vector array<float>, batch_id bigint, list_id int"


@dataclass(frozen=True)
class VectorIndex:
    """One generation as of now."""

    spark: SparkSession
    path: str
    runs: list[str]

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/centroids")

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{name}/{run}" for run in self.runs]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    @property
    def rows(self) -> DataFrame:
        """(vec_id, vector, list_id) of the vectors that count: rows that a later batch has replaced are left out."""
        replaced = self._table("replaced", "vec_id string, batch_id bigint").groupBy("vec_id").agg(F.max("batch_id").alias("_newest"))
        rows = self._table("rows", _ROWS)
        rows = rows.join(broadcast_if_small(replaced), "vec_id", "left")
        return rows.filter(F.col("_newest").isNull() | (F.col("batch_id") >= F.col("_newest"))).select("vec_id", "vector", "list_id")

    @property
    def lists(self) -> DataFrame:
        """Centroids with sizes and radii; replaced rows only make a radius wider than it need be."""
        sizes = self._table("sizes", "list_id int, n long, radius double, cosines double").groupBy("list_id").agg(
            F.sum("n").alias("n"), F.max("radius").alias("radius"))
        return self.centroids.join(F.broadcast(sizes), "list_id")

    def closeness(self) -> list[tuple[str, float]]:
        """Mean cosine of the vectors with their centroid, per run in order."""
        sizes = self._table("sizes", "list_id int, n long, radius double, cosines double, run string")
        rows = sizes.groupBy("run").agg((F.sum("cosines") / F.sum("n")).alias("mean")).collect()
        return sorted(((r["run"], r["mean"]) for r in rows), key=lambda r: int(r[0].split("_")[0]))

    def search(self, queries: DataFrame, k: int, first: int = 2) -> similarity.ListSearch:
        """The k stored vectors nearest to each query (query_id, vector), exactly; vec_id is source:platform_id."""
        return similarity.ivf_exact(queries, self.rows, self.lists, k, first)


def vector_id() -> Column:
    """Source and platform_id as one text; sources have no colon."""
    return F.concat_ws(":", *POST_KEY)


def _vectors(store: Snapshot) -> DataFrame:
    rows = latest(store.read("embeddings"), "embeddings")
    return rows.select(vector_id().alias("vec_id"), F.col("emb").alias("vector"), "batch_id")


def _last(run: str) -> int:
    return int(run.rsplit("_", 1)[1])


def _add(index: VectorIndex, vectors: DataFrame, run: str) -> None:
    """Assign vectors to the lists as one run; written last, the sizes make it count."""
    spark, path = index.spark, index.path
    rows = similarity.nearest_lists(vectors, "vec_id", index.centroids, 1, "batch_id")
    rows.select("vec_id", "vector", "batch_id", "list_id").hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/rows/{run}")
    written = spark.read.schema(_ROWS).parquet(f"{path}/rows/{run}")
    keys = written.select("vec_id", "batch_id")
    # The new keys are the few: the index is only scanned for them, and only its keys.
    again = index._table("rows", _ROWS).select("vec_id").join(broadcast_if_small(keys.select("vec_id")), "vec_id", "left_semi").distinct()
    keys.join(again, "vec_id", "left_semi").write.mode("overwrite").parquet(f"{path}/replaced/{run}")
    similarity.list_measures(written, index.centroids).write.mode("overwrite").parquet(f"{path}/sizes/{run}")


def training_rows(store: Snapshot, rows: int | None = None) -> DataFrame:
    """(vec_id, vector) of the posts that come first by the hash of their key.

    The last of them is found among the keys alone, by counts per range of hashes, so vectors are neither sorted nor brought together.
    """
    rows = TRAINING_ROWS if rows is None else rows
    number = F.xxhash64("vec_id")
    part = F.shiftright(number, 64 - _HASH_BITS)  # ranges in the order of the hashes, negative ones first
    vectors = _vectors(store).select("vec_id", "vector")
    keys = store.read("embeddings").select(vector_id().alias("vec_id")).distinct()
    before = 0
    for r in keys.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").toLocalIterator():
        if before + r["n"] > rows:
            break
        before += r["n"]
    else:
        return vectors
    if before == rows:
        return vectors.filter(part < r["part"])
    last = keys.filter(part == r["part"]).select(number.alias("number"), "vec_id").orderBy("number", "vec_id").limit(rows - before).collect()[-1]
    return vectors.filter((number < last["number"]) | ((number == last["number"]) & (F.col("vec_id") <= last["vec_id"])))


def build(spark: SparkSession, store: str, lists: int = 100) -> VectorIndex:
    """A new generation: lists trained on what is stored now, all stored vectors assigned."""
    now = snapshot(spark, store)
    vectors = _vectors(now)
    numbers = _generations(spark, store)
    path = f"{store}/ivf/generation={numbers[-1] + 1 if numbers else 0}"
    # In order within a task, as the first centroids are drawn by place.
    some = training_rows(now).select("vec_id", l2_normalize(F.col("vector").cast("array<double>")).alias("vector")).sortWithinPartitions("vec_id")
    similarity.train_lists(some, lists).write.mode("overwrite").parquet(f"{path}/centroids")
    _add(VectorIndex(spark, path, []), vectors, f"run=-1_{now.runs[-1][1]}")
    for old in numbers[:-1]:  # the one before stays for those who search it
        remove(spark, f"{store}/ivf/generation={old}")
    return current(spark, store)


def _generations(spark: SparkSession, store: str) -> list[int]:
    found = [name for name in folders(spark, f"{store}/ivf") if name.startswith("generation=")]
    return sorted(int(name.split("=")[1]) for name in found if _runs(spark, f"{store}/ivf/{name}"))


def _runs(spark: SparkSession, path: str) -> list[str]:
    found = [name for name in folders(spark, f"{path}/sizes") if exists(spark, f"{path}/sizes/{name}/_SUCCESS")]
    return sorted(found, key=_last)


def current(spark: SparkSession, store: str) -> VectorIndex:
    path = f"{store}/ivf/generation={_generations(spark, store)[-1]}"
    return VectorIndex(spark, path, _runs(spark, path))


def update(spark: SparkSession, store: str, drift: float = DRIFT) -> VectorIndex:
    """Bring the index up to what is stored: new runs are assigned; drifted lists are trained anew."""
    index, now = current(spark, store), snapshot(spark, store)
    done = _last(index.runs[-1])
    # A run that was put together since holds older rows too; they are as good, and replace themselves.
    new = Snapshot(spark, store, [r for r in now.runs if r[1] > done], now.buckets)
    if not new.runs:
        return index
    _add(index, _vectors(new).filter(F.col("batch_id") > done), f"run={done + 1}_{new.runs[-1][1]}")
    index = current(spark, store)
    means = index.closeness()
    if len(means) > 1 and means[-1][1] is not None and means[-1][1] < means[0][1] - drift:
        return build(spark, store, index.centroids.count())
    return index
