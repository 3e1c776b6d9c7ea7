"""The store: commits, compaction, pruned key folders, the cube and the ledger."""

import datetime as dt
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import aggregate as A
from marketpulse.operators import resolve as R
from marketpulse.plans.report import report_from_store
from marketpulse.schemas import LANDED_PAGE
from marketpulse.sources import stocktwits, x
from marketpulse.store import colocated, compact, cube, log
from marketpulse.store.tables import TABLES
from marketpulse.streaming import ingest

NOW = dt.datetime(2025, 1, 20)


def pages(spark, hour, posts, symbol="AAPL", source="x"):
    """One page of posts (id, text, age in hours)."""
    if source == "x":
        body = {"data": [{"id": i, "text": t, "author_id": "a", "created_at": f"{NOW - dt.timedelta(hours=h):%Y-%m-%dT%H:%M:%SZ}"} for i, t, h in posts]}
    else:
        body = {"messages": [{"id": int(i), "body": t, "user": {"id": 7}, "created_at": f"{NOW - dt.timedelta(hours=h):%Y-%m-%dT%H:%M:%SZ}"} for i, t, h in posts]}
    row = (source, "search", symbol, "Apple", symbol, 0, 0, None, NOW + dt.timedelta(hours=hour), json.dumps(body))
    return spark.createDataFrame([row], LANDED_PAGE)


GOOD, BAD, PLAIN = "$AAPL bullish moon rally, all in", "$AAPL bearish crash, all out of it", "$AAPL and $TSLA, nothing to add here"


def deliveries(spark):
    """New posts, posts again with other words (scored anew), posts that fail a filter they passed, posts for another instrument."""
    yield pages(spark, 0, [(str(i), (GOOD, BAD, PLAIN)[i % 3], i % 5) for i in range(1, 13)])
    yield pages(spark, 1, [(str(i), BAD, i % 5) for i in range(1, 5)] + [("30", "no ticker in this text here", 1)])
    yield pages(spark, 2, [("5", GOOD, 0), ("6", "$AAPL", 1), ("31", GOOD, 3)]).unionByName(pages(spark, 2, [("7", PLAIN, 2)], "TSLA"))
    yield pages(spark, 3, [("40", BAD, 2), ("41", GOOD, 200)], source="stocktwits")
    yield pages(spark, 4, [("30", GOOD, 1), ("1", GOOD, 1)])


def rows(df):
    return sorted(map(str, df.collect()))


def everything(spark, store):
    return [rows(ingest.scored_store(spark, store)), rows(ingest.ledger(spark, store)), rows(cube.cells(log.snapshot(spark, store)))]


def files(store):
    return sum(name.endswith(".parquet") for _, _, names in os.walk(store) for name in names)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    ingest.create_store(spark, path, buckets=4)
    for i, batch in enumerate(deliveries(spark)):
        ingest.write_batch(batch, i, path, NOW, embed=False)
    return path


def test_cube_equals_a_recount(spark, store):
    now = log.snapshot(spark, store)
    assert rows(cube.cells(now)) == rows(cube.recount(now))
    scored = ingest.scored_store(spark, store)
    wanted = {(r["symbol"], r["source"]): (r["n"], pytest.approx(r["avg_polarity"])) for r in A.sentiment_by_source(scored).collect()}
    assert {(r["symbol"], r["source"]): (r["n"], r["avg_polarity"]) for r in cube.by_source(cube.cells(now)).collect()} == wanted
    found = {r["source"]: r for r in cube.filter_stats(cube.cells(now).filter("symbol = 'AAPL'"), "source").collect()}
    # Fourteen posts for AAPL on X; the sixth is too short by its latest text.
    assert (found["x"]["total_input"], found["x"]["no_symbols"], found["x"]["probable_bots"], found["x"]["processed"]) == (14, 0, 1, 13)


def test_a_repeated_batch_and_an_unfinished_one_change_nothing(spark, store, tmp_path, monkeypatch):
    before = everything(spark, store)
    ingest.write_batch(pages(spark, 9, [("1", BAD, 1)]), 4, store, NOW, embed=False)
    with monkeypatch.context() as broken:
        broken.setattr(log, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest.write_batch(pages(spark, 9, [("1", BAD, 1), ("90", GOOD, 0)]), 5, store, NOW, embed=False)
    assert everything(spark, store) == before


def test_compaction_killed_half_way_and_done(spark, store, monkeypatch):
    before = everything(spark, store)
    reader = log.snapshot(spark, store)
    with monkeypatch.context() as broken:
        broken.setattr(compact, "commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            compact.compact(spark, store, fan_in=3)
    assert everything(spark, store) == before and len(log.snapshot(spark, store).runs) == 6
    many = files(store)
    assert compact.compact(spark, store, fan_in=3)
    after = log.snapshot(spark, store)
    assert after.runs == [(-1, 4)] and everything(spark, store) == before
    # Who read the log before goes on reading; then the old runs go.
    assert rows(cube.cells(reader)) == before[2]
    compact.vacuum(spark, store)
    assert files(store) < many / 2 and everything(spark, store) == before
    state = after.read("state")
    assert state.count() == state.select("source", "platform_id").distinct().count() == 16
    ingest.write_batch(pages(spark, 9, [("1", BAD, 1)]), 5, store, NOW, embed=False)
    now = log.snapshot(spark, store)
    assert rows(cube.cells(now)) == rows(cube.recount(now)) != before[2]


def test_keys_are_read_by_bucket_and_the_cube_without_texts(spark, store):
    now = log.snapshot(spark, store)
    plan = now.read("state", [1, 3])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN \(1,3\)", plan)
    asked = R.resolve_symbols(R.with_window(spark.createDataFrame([("AAPL", "2h"), ("TSLA", "1d"), ("NVDA", "7d")], "query string, window string")))
    for as_of, tables in ((NOW, {"cube"}), (NOW + dt.timedelta(minutes=20), {"state", "collected"})):
        read = report_from_store(asked, store, None, as_of).inputFiles()
        assert {path.split(store, 1)[1].split("/")[1] for path in read} == tables
        assert not any("text" in TABLES[table] for table in tables)


@pytest.mark.parametrize("late", [0, 20])
def test_reports_from_the_store(spark, store, late):
    """Counted from the cube on the hour, from the rows' times within it; both as counted from the posts."""
    as_of = NOW + dt.timedelta(minutes=late)
    asked = R.resolve_symbols(R.with_window(spark.createDataFrame(
        [("AAPL", "1h"), ("AAPL", "3h"), ("TSLA", "1d"), ("AAPL", "30d"), ("NVDA", "7d")], "query string, window string")))
    got = {(r["query"], r["window"]): r for r in report_from_store(asked, store, None, as_of).collect()}
    scored = ingest.scored_store(spark, store)
    for (query, window), row in got.items():
        hours = {"1h": 1, "3h": 3, "1d": 24, "30d": 720, "7d": 168}[window]
        recent = scored.filter(F.col("created_at") >= F.lit(as_of - dt.timedelta(hours=hours)))
        mean = A.weighted_sentiment(A.sentiment_by_source(recent)).filter(F.col("symbol") == query).first()
        if row["error"] is None:
            assert (row["count"], row["weighted_sentiment"]) == (mean["count"], pytest.approx(mean["weighted_sentiment"]))
    assert got["NVDA", "7d"]["error"] and got["AAPL", "30d"]["sources"].asDict() == {"x": 14, "reddit": 0, "stocktwits": 2}


def test_failed_posts_are_tried_again(spark, tmp_path):
    """A scorer that misses one post, one that fails as a whole, then one that works; the report counts complete posts only."""
    store = str(tmp_path / "store")
    ingest.create_store(spark, store, buckets=2)
    asked = R.resolve_symbols(R.with_window(spark.createDataFrame([("AAPL", "2d")], "query string, window string")))

    def failing(posts):
        raise RuntimeError("no model")

    def state():
        row = report_from_store(asked, store, None, NOW).first()
        return row["posts_found"], row["posts_processed"], {r["platform_id"]: r["reason"] for r in ingest.ledger(spark, store).collect()}

    ingest.write_batch(pages(spark, 0, [("1", GOOD, 1), ("2", BAD, 1)]), 0, store, NOW, embed=False,
                       scorer=lambda posts: A.scored(posts.filter("platform_id != '2'")))
    assert state() == (2, 1, {"1": None, "2": "no score: none given"})
    ingest.write_batch(pages(spark, 1, [("3", GOOD, 1)]), 1, store, NOW, embed=False, scorer=failing)
    assert state() == (3, 1, {"1": None, "2": "no score: RuntimeError", "3": "no score: RuntimeError"})
    ingest.write_batch(pages(spark, 2, []), 2, store, NOW, embed=False)
    assert state() == (3, 3, {"1": None, "2": None, "3": None})
    now = log.snapshot(spark, store)
    assert rows(cube.cells(now)) == rows(cube.recount(now))
    polarity = {r["platform_id"]: r["polarity"] for r in ingest.scored_store(spark, store).collect()}
    assert polarity == {"1": 1.0, "2": -1.0, "3": 1.0}
    compact.compact(spark, store, fan_in=2)
    assert log.snapshot(spark, store).read("pending").count() == 0 and set(TABLES) <= set(os.listdir(store))


def test_a_parser_that_fails_on_the_data_costs_its_own_source(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.create_store(spark, store, buckets=2)
    both = pages(spark, 0, [("1", GOOD, 1)]).unionByName(pages(spark, 0, [("2", GOOD, 1)], source="stocktwits"))
    broken = lambda raw, as_of, since: stocktwits.posts(raw, as_of, since).withColumn("text", F.raise_error(F.lit("odd")).cast("string"))
    ingest.write_batch(both, 0, store, NOW, embed=False, parsers={"x": x.posts, "stocktwits": broken})
    assert [r["platform_id"] for r in ingest.stored_posts(spark, store).collect()] == ["1"]
    with pytest.raises(ValueError):
        ingest.write_batch(both, 1, store, NOW, embed=False, parsers={"stocktwits": broken})
    assert log.snapshot(spark, store).runs == [(-1, -1), (0, 0)]


def test_which_runs_are_read_and_put_together():
    assert log.live([(0, 0), (1, 1), (2, 2), (0, 1), (3, 3)]) == [(0, 1), (2, 2), (3, 3)]
    assert log.live([(0, 1), (0, 3), (2, 3), (2, 2), (4, 4)]) == [(0, 3), (4, 4)]
    assert compact.due([(0, 2), (3, 3), (4, 4)], 3) == [] and compact.due([(0, 2), (3, 3), (4, 4), (5, 5)], 3) == [(3, 3), (4, 4), (5, 5)]
    # However many batches come in, few runs are live and a row is rewritten a few times.
    runs, written = [], 0
    for i in range(1000):
        runs.append((i, i))
        while some := compact.due(runs, 4):
            runs = runs[: -len(some)] + [(some[0][0], some[-1][1])]
            written += some[-1][1] - some[0][0] + 1
        assert len(runs) <= 3 * 5
    assert written <= 1000 * 5


def test_published_tables_join_without_a_shuffle(spark, store):
    name = f"published_{os.getpid()}"
    base = colocated.publish(spark, store, name, 4)
    whole = colocated.current(spark, store, base)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    columns = ["source", "platform_id", "text", "polarity", "model"]
    same = lambda: rows(colocated.current(spark, store, base).select(columns)) == rows(ingest.scored_store(spark, store).select(columns))
    assert same()
    last = log.snapshot(spark, store).runs[-1][1]
    ingest.write_batch(pages(spark, 20, [("2", GOOD, 1), ("50", BAD, 0)]), last + 1, store, NOW, embed=False)
    assert same()
    plan = colocated.current(spark, store, base)._jdf.queryExecution().executedPlan().toString()
    # What came in since is sent to the bucketed tables; they are joined as they lie, but for the few rows that it touches.
    above, scan = [], re.compile(r"Scan parquet \S*published_")
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, text) for d, text in above if d < depth] + [(depth, line)]
        if scan.search(line):
            below = [text for _, text in above][max([i for i, (_, text) in enumerate(above) if "Exchange hashpartitioning" in text], default=-1) + 1:]
            assert len(below) == len(above) or any("LeftSemi" in text for text in below)
    compact.compact(spark, store, fan_in=2)
    assert same()
    for part in colocated.PARTS:
        spark.sql(f"DROP TABLE {name}_{part}")


def test_tables_without_folders_are_written_without_a_shuffle(spark, tmp_path):
    key = [F.lit("x").alias("source"), F.col("id").cast("string").alias("platform_id")]
    rows = spark.range(0, 90, 1, 3).select(*key, F.array(F.col("id").cast("float")).alias("emb"), F.lit(0).cast("bigint").alias("batch_id"))
    log.write_run(rows, str(tmp_path), "embeddings", 0, 0)
    files = list(tmp_path.glob("embeddings/run=0_0/part-*.parquet"))
    assert len(files) == 3 and spark.read.parquet(*map(str, files)).count() == 90


def test_texts_are_not_dealt_out_again_to_tell_what_is_known(spark, tmp_path, monkeypatch):
    """New posts are told where their texts lie by key; of the texts that wait only the keys are looked up."""
    store, plans, write_run = str(tmp_path / "store"), {}, log.write_run

    def seen(rows, where, table, *run):
        plans[table] = rows._jdf.queryExecution().optimizedPlan().toString()
        write_run(rows, where, table, *run)

    ingest.create_store(spark, store, buckets=2)
    monkeypatch.setattr(log, "write_run", seen)
    for batch, posts in enumerate(([("1", GOOD, 1), ("2", PLAIN, 1)], [("1", PLAIN, 1), ("3", GOOD, 1)])):
        ingest.write_batch(pages(spark, batch, posts), batch, store, NOW, embed=False)
    assert "Join" not in plans["posts"] and "strategy=broadcast" in plans["pending"]
    found = ingest.read_table(spark, store, "posts").select("platform_id", "batch_id").collect()
    assert sorted(map(tuple, found)) == [("1", 0), ("2", 0), ("3", 1)]
    assert ingest.read_table(spark, store, "pending").count() == 0
