"""The index over stored vectors follows ingestion and answers as a new one would."""

import numpy as np
from pyspark.sql import functions as F
from test_store import GOOD, NOW, pages

from marketpulse.operators import similarity
from marketpulse.store import compact, log, vectors
from marketpulse.streaming import ingest


def embedder(angle):
    """Vectors in the plane near `angle` degrees, spread by the post's number."""
    def step(posts):
        at = F.radians(F.lit(float(angle)) + F.col("platform_id").cast("int") % 7 * 2)
        return posts.withColumn("emb", F.array(F.cos(at), F.sin(at)).cast("array<float>"))
    return step


def test_index_follows_the_store(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.create_store(spark, store, buckets=2)

    def add(batch_id, ids, angle):
        ingest.write_batch(pages(spark, batch_id, [(str(i), GOOD, 1) for i in ids]), batch_id, store, NOW, embedder=embedder(angle))

    queries = spark.createDataFrame([("a", [1.0, 0.1]), ("b", [-1.0, 0.0]), ("c", [0.0, 0.0])], "query_id string, vector array<double>")
    rows = lambda found: [tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]

    def check(index):
        stored = ingest.latest_of(spark, store, "embeddings").select(vectors.vector_id().alias("vec_id"), F.col("emb").alias("vector"))
        assert index.rows.count() == stored.count()
        wanted = rows(similarity.cosine_topk(queries, stored, 4))
        got = rows(index.search(queries, 4).found)
        assert got == wanted and len(set(got) & set(wanted)) >= 0.9 * len(wanted)

    add(0, range(1, 30), 0)
    index = vectors.build(spark, store, 3)
    check(index)
    add(1, [*range(20, 25), *range(40, 50)], 10)  # new posts, and others that move a little
    assert vectors.update(spark, store).path == index.path
    check(vectors.current(spark, store))
    assert vectors.update(spark, store).runs == ["run=-1_0", "run=1_1"]  # nothing new: nothing done
    compact.compact(spark, store, fan_in=2)
    assert log.snapshot(spark, store).runs == [(-1, 1)]
    add(2, [1, 2, 3, 60, 61], 170)  # far from every centroid
    assert vectors.update(spark, store).path.endswith("generation=1")
    moved = vectors.current(spark, store)
    check(moved)
    assert min(np.array([m for _, m in moved.closeness()])) > 0.9 and moved.runs == ["run=-1_2"]


def test_training_rows_are_not_brought_together(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.create_store(spark, store, buckets=2)
    for batch_id, ids in enumerate((range(1, 40), range(20, 60))):
        ingest.write_batch(pages(spark, batch_id, [(str(i), GOOD, 1) for i in ids]), batch_id, store, NOW, embedder=embedder(0))
    now = log.snapshot(spark, store)
    stored = ingest.latest_of(spark, store, "embeddings").select(vectors.vector_id().alias("vec_id"), F.col("emb").alias("vector"))
    by_hash = [tuple(r) for r in stored.orderBy(F.xxhash64("vec_id"), "vec_id").collect()]
    for n in (1, 7, len(by_hash) - 1, len(by_hash), len(by_hash) + 5):
        some = vectors.training_rows(now, n)
        assert sorted(tuple(r) for r in some.collect()) == sorted(by_hash[:n])
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "GlobalLimit" not in plan and "SinglePartition" not in plan
    assert vectors.build(spark, store, 3).rows.count() == len(by_hash)
