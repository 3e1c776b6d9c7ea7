import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marketpulse.functions import vectors as V
from marketpulse.operators import models
from marketpulse.operators import similarity as Y

# The models below run in workers, which cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(400, 12)).astype(np.float32)
    corpus[100:250] = corpus[7]  # copies: a third of all rows, equal scores
    queries = np.vstack([rng.normal(size=(7, 12)), corpus[7:8]]).astype(np.float32)
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, vector array<float>").repartition(6)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vector array<float>")

    def unit(m):
        m = m.astype(np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    scores = np.round(unit(queries) @ unit(corpus).T, 9)
    expected = {f"q{i}": [int(j) for j in np.lexsort((np.arange(400), -s))[:9]] for i, s in enumerate(scores)}
    return q, c, expected


def answer(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got


def test_sent_and_blocked_forms_match_brute_force(data):
    q, c, expected = data
    assert answer(Y.cosine_topk(q, c, 9)) == expected
    assert answer(Y.cosine_topk(q, c, 9, broadcast_numbers=0, block_rows=60)) == expected


def test_small_products_give_the_same(data, monkeypatch):
    q, c, expected = data
    monkeypatch.setattr(Y, "PRODUCT_NUMBERS", 500)
    assert answer(Y.cosine_topk(q, c, 9)) == expected


def test_all_lists_probed_is_exact_and_few_are_a_part(data):
    q, c, expected = data
    lists = Y.train_lists(c, 6)
    index = Y.assign_lists(c, lists)
    assert answer(Y.ivf_topk(q, index, lists, 9, probes=6, block_rows=60)) == expected
    part = answer(Y.ivf_topk(q, index, lists, 9, probes=2, block_rows=60))
    recall = sum(len(set(part[k]) & set(expected[k])) for k in expected) / (9 * len(expected))
    assert 0.3 < recall <= 1


def test_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [list(r[0]) for r in df.select(V.l2_normalize(F.col("v"))).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_hash_embedding(texts):
    rows = texts(["same text", "same text", "other", "", None]).select("i", V.hash_embedding(F.col("text")).alias("e")).orderBy("i").collect()
    a, b, c, d, e = [r["e"] for r in rows]
    assert a == b and a != c and len(a) == len(d) == 384 and e is None
    assert np.linalg.norm(a) == pytest.approx(1.0, abs=1e-6)
    assert abs(np.mean(a)) < 0.02 and np.std(a) == pytest.approx(1 / np.sqrt(384), rel=0.1)


def test_vectors_are_drawn_a_few_at_a_time(spark, monkeypatch):
    drawn = []
    rows = V._gaussian_rows
    monkeypatch.setattr(V, "_gaussian_rows", lambda seeds, dim: drawn.append(len(seeds)) or rows(seeds, dim))
    seeds = pd.Series([None if i % 5 == 0 else f"{i}" for i in range(1000)])
    parts = list(V._units(iter([seeds, seeds[:0], seeds[:3]]), 8))
    assert max(map(len, parts)) <= V.DRAWN_ROWS and max(drawn) <= V.DRAWN_ROWS
    out = pd.concat(parts, ignore_index=True)
    assert len(out) == 1003 and out.isna().tolist() == [i % 5 == 0 for i in [*range(1000), 0, 1, 2]]
    monkeypatch.undo()
    # In one task, more rows than are drawn at a time: each keeps its own vector.
    texts = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("text"))
    got = {r["id"]: r["e"] for r in texts.select("id", V.hash_embedding(F.col("text"), 8).alias("e")).collect()}
    one = {r["id"]: r["e"] for r in texts.filter("id = 999 or id = 256").select("id", V.hash_embedding(F.col("text"), 8).alias("e")).collect()}
    assert len(got) == 1000 and got[0] is None and got[999] == one[999] and got[256] == one[256]


def working():
    return lambda batch: np.array([[t.count("a"), t.count("b")] for t in batch], dtype=float)


def picky():
    def model(batch):
        if any("bad" in t for t in batch):
            raise ValueError("bad text")
        return np.array([[t.count("a"), t.count("b")] for t in batch], dtype=float)
    return model


def missing():
    raise OSError("no model file")


def test_model_scores_and_fallbacks(texts):
    df = texts(["aab", "bbbb", "bad bullish", "", None])
    by_model = [r["score"] for r in models.score_with_model(df, working).orderBy("i").collect()]
    assert [s["model"] for s in by_model] == ["distilbert", "distilbert", "distilbert", "empty", "empty"]
    assert by_model[0]["polarity"] < 0 < by_model[1]["polarity"]
    some = [r["score"]["model"] for r in models.score_with_model(df, picky).orderBy("i").collect()]
    assert some == ["distilbert", "distilbert", "heuristic", "empty", "empty"]
    none = [r["score"]["model"] for r in models.score_with_model(df, missing).orderBy("i").collect()]
    assert none == ["heuristic", "heuristic", "heuristic", "empty", "empty"]


def test_model_reads_whole_texts_unless_told_its_limit(texts):
    df = texts(["a" * 1024 + "b" * 3000])
    whole = models.score_with_model(df, working).first()["score"]["polarity"]
    cut = models.score_with_model(df, working, max_chars=1024).first()["score"]["polarity"]
    assert whole > 0 > cut


def test_model_vectors_and_fallback(texts):
    rows = models.embed_with_model(texts(["aab", "bad", "xyz"]), picky, dim=2).orderBy("i").collect()
    assert rows[0]["emb"] == pytest.approx([2 / 5 ** 0.5, 1 / 5 ** 0.5])
    assert len(rows[1]["emb"]) == 2 and np.linalg.norm(rows[1]["emb"]) == pytest.approx(1, abs=1e-6)
    assert rows[2]["emb"] == [0.0, 0.0]


def test_ivf_reads_probed_lists_only(spark, tmp_path):
    points = spark.createDataFrame([(i, [float(i % 4 == j) for j in range(4)]) for i in range(40)], "vec_id long, vector array<double>")
    lists = spark.createDataFrame([(j, [float(j == i) for i in range(4)]) for j in range(4)], "list_id int, centroid array<double>")
    Y.assign_lists(points, lists).write.partitionBy("list_id").parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    found = Y.ivf_topk(points.where("vec_id = 6").selectExpr("'q' AS query_id", "vector"), index, lists, 3, probes=1)
    assert [r["vec_id"] for r in found.orderBy("rank").collect()] == [2, 6, 10]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters" in line and "list_id" in line and "= 2" in line for line in plan.splitlines())


@pytest.fixture(scope="module")
def clustered(spark):
    """Tight groups, some vectors of length zero, and copies: (corpus, queries)."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(12, 8))
    corpus = centers[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 8))
    corpus[50:60] = 0.0
    corpus[300:340] = corpus[7]
    queries = np.vstack([centers[:4] + 0.05 * rng.normal(size=(4, 8)), corpus[7:8], np.zeros((1, 8))])
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)], "vec_id long, vector array<double>").repartition(4)
    return c, spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "query_id string, vector array<double>")


@pytest.mark.parametrize("k, numbers", [(5, Y.BROADCAST_NUMBERS), (60, 0)])
def test_exact_search_over_lists(clustered, k, numbers):
    corpus, queries = clustered
    centroids = Y.train_lists(corpus, 12)
    index = Y.assign_lists(corpus, centroids).cache()
    lists = Y.list_radii(index, centroids).cache()
    search = Y.ivf_exact(queries, index, lists, k, first=1, block_rows=50, broadcast_numbers=numbers)
    rows = lambda df: [tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").orderBy("query_id", "rank").collect()]
    assert rows(search.found) == rows(Y.cosine_topk(queries, corpus, k))
    assert search.share_read(lists) < (0.5 if k == 5 else 1.0)
    assert lists.agg(F.sum("n")).first()[0] == 600


def test_exact_search_with_fewer_vectors_than_wanted(clustered):
    corpus, queries = clustered
    few = corpus.filter("vec_id < 3")
    centroids = Y.train_lists(few, 2)
    index = Y.assign_lists(few, centroids)
    search = Y.ivf_exact(queries, index, Y.list_radii(index, centroids), 5)
    assert search.found.count() == 6 * 3 and search.share_read(Y.list_radii(index, centroids)) == 1.0
    empty = Y.ivf_exact(queries.limit(0), index, Y.list_radii(index, centroids), 5)
    assert empty.found.count() == 0
