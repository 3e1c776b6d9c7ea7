"""What the physical plans over stored tables must look like."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import aggregate as A
from marketpulse.operators import merge as M
from marketpulse.plans import views as v
from marketpulse.plans.queries import REGISTRY
from marketpulse.sources import landed

SINCE = dt.datetime(2024, 1, 24)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "posts")
    A.scored(A.clean(v.collected(spark, sf_dir)).filter("outcome = 'processed'")).write.parquet(path)
    return spark.read.parquet(path)


def test_time_filter_reaches_the_scan(stored):
    plan = plan_of(landed.since_filter(stored, SINCE))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(created_at", plan)
    plan = plan_of(landed.since_filter(stored, SINCE + dt.timedelta(milliseconds=5)))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(created_at", plan)


def test_aggregates_read_few_columns_and_shuffle_once(stored):
    plan = plan_of(A.sentiment_by_source(landed.since_filter(stored, SINCE)))
    assert plan.count("Exchange") == 1 and "partial_avg" in plan
    columns = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert "text" not in columns and "company_name" not in columns


def test_cleaning_and_scoring_need_no_shuffle(stored):
    plan = plan_of(A.scored(A.clean(stored.select("source", "platform_id", "text"))))
    assert "Exchange" not in plan


def test_a_small_delivery_does_not_shuffle_the_stored_table(spark, stored):
    kept = stored.select("source", "platform_id", "text").withColumn("ingested_at", F.lit(SINCE).cast("timestamp"))
    delivery = spark.createDataFrame([("x", "3", "new", SINCE, 1)], "source string, platform_id string, text string, ingested_at timestamp, seq int")
    plan = plan_of(M.merge_posts(kept, delivery, F.col("seq"), drop=("seq",)))
    above_scans = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    # Shuffles are of the delivery and of the keys it shares with the table, never of the table itself.
    assert "BroadcastHashJoin [source" in plan
    touched = plan.split("Union", 1)[1].split("BroadcastExchange", 1)[0]
    assert "Exchange hashpartitioning" not in touched, above_scans


def test_latest_rows_replace_without_shuffling_the_table(spark, stored):
    scores = stored.select("source", "platform_id", "polarity")
    delivery = spark.createDataFrame([("x", "3", 0.5, 1)], "source string, platform_id string, polarity float, seq int")
    plan = plan_of(M.merge_latest(scores, delivery, M.POST_KEY, F.col("seq"), drop=("seq",)))
    assert "BroadcastHashJoin [source" in plan and "SortMergeJoin" not in plan


def test_bucketed_tables_join_as_they_lie(spark, sf_dir):
    plan = plan_of(REGISTRY["posts_sentiment_bucketed"](spark, sf_dir))
    assert "SortMergeJoin [source" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
