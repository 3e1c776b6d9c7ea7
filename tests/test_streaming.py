import datetime as dt
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketpulse.functions.vectors import hash_embedding
from marketpulse.operators import aggregate as A
from marketpulse.schemas import LANDED_PAGE
from marketpulse.sources import landed
from marketpulse.streaming import first, ingest, rolling

NOW = dt.datetime(2025, 1, 20)


def page(no, fetched, *posts):
    body = json.dumps({"data": [{"id": i, "text": t, "created_at": "2025-01-19T10:00:00Z", "author_id": "a"} for i, t in posts]})
    return ("x", "search", "AAPL", "Apple", "AAPL", 0, no, None, fetched, body)


LONG = "$AAPL is going up, and up it goes"


@pytest.fixture
def land(spark, tmp_path):
    def write(name, *pages):
        spark.createDataFrame(list(pages), LANDED_PAGE).coalesce(1).write.mode("append").json(str(tmp_path / "landed" / name))
    return write


def test_ingest_in_steps_equals_the_batch_result(spark, tmp_path, land):
    store, check = str(tmp_path / "store"), str(tmp_path / "check")

    def run():
        ingest.start_ingest(spark, str(tmp_path / "landed" / "*"), store, check, NOW, files_per_batch=1).awaitTermination()

    later = NOW + dt.timedelta(hours=2)
    land("a", page(0, NOW, ("1", LONG), ("2", "no ticker in this text here")), page(1, NOW, ("3", LONG + "!")))
    run()
    land("b", page(0, later, ("1", "changed " + LONG), ("4", "$TSLA and $AAPL crash together")))
    land("c", page(1, later, ("4", "$TSLA and $AAPL crash together")))
    run()
    run()
    stored = {r["platform_id"]: r for r in ingest.stored_posts(spark, store).collect()}
    assert sorted(stored) == ["1", "3", "4"]
    assert stored["1"]["text"] == LONG and stored["1"]["ingested_at"] == later and stored["3"]["ingested_at"] == NOW
    assert ingest.latest_of(spark, store, "sentiment").count() == 3 and ingest.latest_of(spark, store, "embeddings").count() == 3
    everything = A.clean(landed.collect_posts(landed.scan_landed(spark, str(tmp_path / "landed" / "*")), NOW)).filter("outcome = 'processed'")
    batch = {r["platform_id"]: r["polarity"] for r in A.scored(landed.dedupe_keep_first(everything, "source", "platform_id")).collect()}
    got = {r["platform_id"]: r["polarity"] for r in ingest.scored_store(spark, store).collect()}
    assert got == batch


def test_scores_and_vectors_follow_the_latest_text(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.create_store(spark, store)
    texts = ("$AAPL bullish moon rally, all in", "$AAPL bearish crash, all out of it")
    for batch_id, text in enumerate(texts):
        pages = spark.createDataFrame([page(0, NOW + dt.timedelta(hours=batch_id), ("1", text))], LANDED_PAGE)
        ingest.write_batch(pages, batch_id, store, NOW)
    row = ingest.scored_store(spark, store).first()
    assert row["text"] == texts[0] and row["polarity"] == -1.0 and row["ingested_at"] == NOW + dt.timedelta(hours=1)
    wanted = spark.createDataFrame([(texts[1],)], "text string").select(hash_embedding(F.col("text")).alias("emb")).first()["emb"]
    assert list(ingest.latest_of(spark, store, "embeddings").first()["emb"]) == pytest.approx(list(wanted), abs=1e-6)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.create_store(spark, store)
    pages = spark.createDataFrame([page(0, NOW, ("1", LONG))], LANDED_PAGE)
    for batch_id in (0, 0, 1):
        ingest.write_batch(pages, batch_id, store, NOW, embed=False)
    assert ingest.stored_posts(spark, store).count() == 1
    assert ingest.latest_of(spark, store, "sentiment").count() == 1
    assert ingest.read_table(spark, store, "sentiment").count() == 2  # one row per batch, the repeated one replaced


def test_stored_posts_prunes_by_date(spark, tmp_path):
    store = str(tmp_path / "store")
    ingest.create_store(spark, store)
    ingest.write_batch(spark.createDataFrame([page(0, NOW, ("1", LONG))], LANDED_PAGE), 0, store, NOW, embed=False)
    assert ingest.stored_posts(spark, store, since=dt.datetime(2025, 1, 19)).count() == 1
    recent = ingest.stored_posts(spark, store, since=dt.datetime(2025, 1, 19, 11))
    assert recent.count() == 0
    assert "created_date" in recent._jdf.queryExecution().executedPlan().toString().split("PartitionFilters", 1)[1][:200]


def test_streams(spark, tmp_path):
    posts = spark.range(400).select(
        F.lit("x").alias("source"), F.col("id").cast("string").alias("platform_id"), F.array(F.lit("A")).alias("symbols"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 1800).alias("created_at"), (F.col("id") % 3 - 1).cast("float").alias("polarity"))
    source = str(tmp_path / "posts")
    posts.union(posts.limit(50)).write.parquet(source)
    stream = spark.readStream.schema(posts.schema).parquet(source)
    rolling.write_available(rolling.dedupe_stream(stream, "30 days"), str(tmp_path / "once"), str(tmp_path / "c1")).awaitTermination()
    once = spark.read.parquet(str(tmp_path / "once"))
    assert once.count() == once.select("platform_id").distinct().count() == 400
    windows = rolling.rolling_stream(spark.readStream.schema(posts.schema).parquet(str(tmp_path / "once")))
    rolling.write_available(windows, str(tmp_path / "rolled"), str(tmp_path / "c2")).awaitTermination()
    final = {r["window_start"]: (r["n"], r["avg_polarity"]) for r in spark.read.parquet(str(tmp_path / "rolled")).collect()}
    batch = {r["window_start"]: (r["n"], r["avg_polarity"]) for r in A.rolling_sentiment(posts).collect()}
    assert 150 < len(final) < len(batch)
    assert all(batch[k][0] == n and batch[k][1] == pytest.approx(m) for k, (n, m) in final.items())


def test_first_by_place_whatever_the_arrival(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [("x", str(i % 40), int(rng.integers(0, 3)), int(rng.integers(0, 3)), int(rng.integers(0, 5)), f"{i} ü\n", NOW + dt.timedelta(minutes=int(rng.integers(0, 60)), microseconds=i))
            for i in range(300)]
    schema = "source string, platform_id string, term_no int, page_no int, pos int, text string, fetched_at timestamp"
    batch = {(r["platform_id"], r["term_no"], r["page_no"], r["pos"]) for r in landed.dedupe_keep_first(
        spark.createDataFrame(rows, schema), "source", "platform_id").collect()}
    for seed in (1, 2):
        root = tmp_path / str(seed)
        order = np.random.default_rng(seed).permutation(len(rows))
        parts = [[rows[i] for i in order[n::3]] for n in range(3)] + [[("end", "", 0, 0, 0, "", NOW + dt.timedelta(days=d))] for d in (5, 9)]
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(root / "in" / f"d={i}"))
            stream = spark.readStream.schema(schema).parquet(str(root / "in" / "*"))
            kept = first.keep_first_stream(stream, "source", "platform_id", delay="2 hours")
            rolling.write_available(kept, str(root / "out"), str(root / "check")).awaitTermination()
        got = spark.read.parquet(str(root / "out")).filter("source = 'x'").collect()
        assert len(got) == 40 and {(r["platform_id"], r["term_no"], r["page_no"], r["pos"]) for r in got} == batch
        by = {r[5]: r[6] for r in rows}
        assert all(by[r["text"]] == r["fetched_at"] for r in got)


def test_a_key_is_handed_to_python_as_one_text_per_row(spark):
    class State:
        exists, hasTimedOut, get = False, False, None

        def update(self, row):
            self.get, self.exists = row, True

        def setTimeoutTimestamp(self, at):
            self.until = at

        def getCurrentWatermarkMs(self):
            return 0

    state, keep = State(), first._keep(1000)
    for rows in (['2,0,1,50,{"t":"a,b"}', '1,3,0,90,{"t":"z"}', '1,3,0,70,{"t":"c,1"}'], ['1,2,9,60,{"t":"late"}'], ['10,0,0,5,{"t":"no"}']):
        assert not list(keep((), iter([pd.DataFrame({"row": rows})]), state))
        if len(rows) == 3:
            assert state.get == (1, 3, 0, 1050, '{"t":"c,1"}')
    assert state.get == (1, 2, 9, 1005, '{"t":"late"}') and state.until == 1005


def test_the_keys_of_a_bucket_are_handed_to_python_at_once():
    class Store(dict):
        get, update, clear = (lambda self: dict.get(self, 0)), (lambda self, value: self.__setitem__(0, value)), dict.clear
        getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__

    class Handle:
        def __init__(self):
            self.index, self.rows, self.timers = Store(), Store(), set()
            self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

        def getValueState(self, *_):
            return self.index

        def getMapState(self, *_):
            return self.rows

    class At(int):
        getCurrentWatermarkInMs = getExpiryTimeInMs = int.__int__

    handle, keep = Handle(), first._KeepInBuckets(1000)
    keep.init(handle)

    def arrive(now, **rows):
        frame = pd.DataFrame([(k, row) for k, found in rows.items() for row in found], columns=["k", "row"])
        assert not list(keep.handleInputRows((0,), iter([frame[:2], frame[2:]]), At(now)))
        assert len(handle.timers) == 1

    def expire(now):
        at = handle.timers.pop()
        return sorted(row for part in keep.handleExpiredTimer((0,), At(now), At(at)) for row in part["payload"])

    arrive(0, a=['2,0,1,50,{"t":"a,b"}', '1,3,0,90,{"t":"z"}', '1,3,0,70,{"t":"c,1"}'], b=['1,0,0,400,{"t":"b"}'], c=['0,0,0,10,{"t":"c"}'])
    assert list(handle.rows) == [(1,)] and handle.timers == {1010}
    arrive(20, a=['1,2,9,60,{"t":"late"}', '10,0,0,30,{"t":"no"}'], b=['1,0,0,410,{"t":"a"}', '1,0,0,420,{"t":"c"}'])
    # A row is written where it was better than what was held, and not again.
    assert [keep._piece(piece, {}) for piece, in handle.rows] == [['{"t":"c,1"}', '{"t":"b"}', '{"t":"c"}'], ['{"t":"late"}', '{"t":"a"}']]
    assert expire(1011) == ['{"t":"c"}'] and handle.timers == {1030} and list(handle.rows) == [(2,)]
    # A row that comes when its key is due is waited for; the other key is not.
    arrive(2000, a=['0,0,0,1990,{"t":"again"}'])
    assert expire(2000) == ['{"t":"a"}'] and expire(2002) == ['{"t":"again"}']
    assert not handle.rows and not handle.index and not handle.timers


def test_buckets_give_what_a_state_per_key_gives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(first, "PIECE", 40)
    rng = np.random.default_rng(1)
    schema = "source string, platform_id string, term_no int, page_no int, text string, fetched_at timestamp"
    for b in range(6):
        rows = [(str(rng.integers(0, 2)), None if i % 20 == 0 else str(rng.integers(0, 15)), None if i % 9 == 0 else int(rng.integers(0, 2)), int(rng.integers(0, 2)),
                 f"{b} {i} ü\n", NOW + dt.timedelta(minutes=int(b * 40 + rng.integers(-150, 90)), microseconds=i)) for i in range(60)]
        path = tmp_path / "in" / str(b)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        for file in path.glob("part*"):  # files are taken in the order of their times
            os.utime(file, (1_700_000_000 + b,) * 2)
    store, got = spark.conf.get(rolling.STATE_STORE), []
    for buckets in (0, 3):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        kept = first.keep_first_stream(stream, "source", "platform_id", delay="1 hour", buckets=buckets)
        rolling.write_available(kept, str(tmp_path / f"out{buckets}"), str(tmp_path / f"check{buckets}")).awaitTermination()
        assert spark.conf.get(rolling.STATE_STORE) == store
        got.append(sorted(map(str, spark.read.schema(kept.schema).parquet(str(tmp_path / f"out{buckets}")).collect())))
    keys = [row.split("term_no")[0] for row in got[0]]
    assert got[0] == got[1] and len(set(keys)) < len(keys)
