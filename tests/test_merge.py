import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import merge as M
from marketpulse.operators import sizes

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "source string, platform_id string, text string, ingested_at timestamp, seq int"


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture
def batches(spark):
    first = spark.createDataFrame([("x", "1", "one", at(0), 0), ("x", "2", "two", at(0), 0)], SCHEMA)
    second = spark.createDataFrame(
        [("x", "2", "two again", at(5), 1), ("x", "2", "two once more", at(6), 2), ("reddit", "2", "other", at(5), 2),
         ("reddit", "2", "newer", at(7), 3)], SCHEMA)
    return first, second


def posts_of(df):
    return {(r["source"], r["platform_id"]): (r["text"], r["ingested_at"]) for r in df.collect()}


EXPECTED = {("x", "1"): ("one", at(0)), ("x", "2"): ("two", at(6)), ("reddit", "2"): ("other", at(7))}


def merged(*batches):
    stored = None
    for batch in batches:
        stored = M.merge_posts(stored, batch, F.col("seq"), drop=("seq",))
    return stored


def test_first_write_stays_and_time_moves(batches):
    assert posts_of(merged(*batches)) == EXPECTED
    assert posts_of(merged(*batches, batches[1])) == EXPECTED


def test_the_shuffled_form_gives_the_same(batches, monkeypatch):
    monkeypatch.setattr(M, "broadcast_if_small", lambda df: df)
    assert posts_of(merged(*batches)) == EXPECTED


def test_size_check(spark):
    df = spark.range(100).selectExpr("cast(id as string) as k")
    assert "broadcast" in sizes.broadcast_if_small(df)._jdf.queryExecution().logical().toString().lower()
    for kept in (sizes.broadcast_if_small(df, max_rows=99), sizes.broadcast_if_small(df, max_bytes=50)):
        assert "hint" not in kept._jdf.queryExecution().logical().toString().lower()


def test_last_write_wins(batches):
    def texts(df):
        return {(r["source"], r["platform_id"]): r["text"] for r in df.collect()}

    first, second = batches
    stored = M.merge_latest(None, first, M.POST_KEY, F.col("seq"), drop=("seq",))
    once = M.merge_latest(stored, second, M.POST_KEY, F.col("seq"), drop=("seq",))
    expected = {("x", "1"): "one", ("x", "2"): "two once more", ("reddit", "2"): "newer"}
    assert texts(once) == expected
    assert texts(M.merge_latest(once, second, M.POST_KEY, F.col("seq"), drop=("seq",))) == expected


def test_children_and_complete_posts(spark, batches):
    posts = merged(*batches)
    child = spark.createDataFrame([("x", "1", 0.5), ("x", "9", 0.1), ("reddit", "2", 0.2)], "source string, platform_id string, v double")
    assert M.only_with_post(child, posts).count() == 2
    vectors = child.filter("platform_id != '1'")
    assert [tuple(r) for r in M.complete_posts(posts, child, vectors).collect()] == [("reddit", "2")]


def test_account_rollup(spark):
    rows = [("x", "a", "old", 5, at(1), "1"), ("x", "a", "new", 7, at(3), "2"), ("reddit", "a", "r", None, at(2), "3")]
    df = spark.createDataFrame(rows, "source string, author_id string, author_handle string, follower_count int, created_at timestamp, platform_id string")
    got = {(r["source"], r["author_id"]): tuple(r)[2:] for r in M.account_rollup(df).collect()}
    assert got == {("x", "a"): ("new", 7, at(3)), ("reddit", "a"): ("r", None, at(2))}
