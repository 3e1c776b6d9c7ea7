import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import aggregate as A
from marketpulse.operators import resolve as R
from marketpulse.operators import trends as TR
from marketpulse.plans.report import NO_POSTS, NO_VALID_POSTS, report_json, sentiment_report

NOW = dt.datetime(2024, 1, 31)


def h(hours):
    return NOW - dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def collected(spark):
    rows = [
        ("x", "1", "AAPL", "Apple", h(1), "$AAPL looking bullish today"),
        ("x", "2", "AAPL", "Apple", h(30), "$AAPL will crash, says everyone"),
        ("reddit", "3", "AAPL", "Apple", h(2), "nothing of interest in this text"),
        ("reddit", "4", "AAPL", "Apple", h(24), "$AAPL"),
        ("stocktwits", "5", "TSLA", "Tesla", h(3), "$TSLA"),
        ("x", "6", "TSLA", "Tesla", h(5), "just $AAPL moon, nothing else here"),
    ]
    return spark.createDataFrame(rows, "source string, platform_id string, symbol string, company_name string, created_at timestamp, text string")


@pytest.fixture(scope="module")
def trends(spark):
    points = spark.createDataFrame(
        [("AAPL", "AAPL", 1, h(30), 1, 10.0), ("AAPL", "AAPL", 1, h(26), 2, 20.0), ("AAPL", "apple", 2, h(26), 3, 99.0)],
        "symbol string, term string, term_no int, ts timestamp, point_no long, value double")
    related = spark.createDataFrame([("AAPL", "top", 1, "aapl stock"), ("AAPL", "rising", 1, "aapl stock"), ("AAPL", "rising", 2, "aapl news")],
                                    "symbol string, kind string, position int, query string")
    regions = spark.createDataFrame([("AAPL", "AAPL", 1, "Ohio", 5.0), ("AAPL", "AAPL", 1, "Maine", 9.0)],
                                    "symbol string, term string, term_no int, region string, value double")
    return TR.trends_record(points, related, regions, NOW)


def ask(spark, *requests):
    asked = spark.createDataFrame(list(requests), "query string, window string")
    return R.resolve_symbols(R.with_window(asked))


@pytest.fixture(scope="module")
def rows(spark, collected, trends):
    cleaned = A.clean(collected)
    stored = A.scored(cleaned.filter("outcome = 'processed'"))
    report = sentiment_report(ask(spark, ("AAPL", "24h"), ("aapl", "2d"), ("TSLA", "24h"), ("NVDA", "7d"), ("Microsoft", "1h")), cleaned, stored, trends, NOW)
    return {(r["query"], r["window"]): r for r in report.collect()}, report


def test_counts_and_weighted_sentiment(rows):
    day, two_days = rows[0]["AAPL", "24h"], rows[0]["aapl", "2d"]
    assert (day["posts_found"], day["posts_processed"], day["count"]) == (3, 1, 2)
    assert day["sources"].asDict() == {"x": 1, "reddit": 2, "stocktwits": 0}
    assert day["filter_stats"].asDict() == {"total_input": 3, "no_symbols": 1, "probable_bots": 1, "processed": 1}
    # Stored posts that mention the symbol count, whoever they were collected for.
    assert day["weighted_sentiment"] == pytest.approx(1.0)
    assert (two_days["count"], two_days["posts_found"]) == (3, 4)
    assert two_days["weighted_sentiment"] == pytest.approx(1 / 3)
    assert day["window_since"] == "2024-01-30T00:00:00" and day["symbol"] == two_days["symbol"] == "AAPL"


def test_trends_are_last_value_per_day(rows):
    interest = rows[0]["AAPL", "24h"]["search_interest"]
    assert interest["interest_over_time"] == {"2024-01-29": 20.0}
    assert interest["related_queries"] == ["aapl stock", "aapl news"]
    assert list(interest["interest_by_region"].items()) == [("Maine", 9.0), ("Ohio", 5.0)]


def test_early_ends(rows):
    none, filtered = rows[0]["NVDA", "7d"], rows[0]["Microsoft", "1h"]
    assert none["error"] == filtered["error"] == NO_POSTS
    assert none["filter_stats"] is None and none["search_interest"] is None and none["count"] is None
    assert none["posts_found"] == none["posts_processed"] == 0
    assert filtered["symbol"] == "Microsoft" and filtered["instrument"]["symbol"] == "MSFT"
    assert rows[0]["TSLA", "24h"]["error"] is None


def test_nothing_survives_the_filters(spark, collected):
    cleaned = A.clean(collected.filter("platform_id = '5'"))
    row = sentiment_report(ask(spark, ("TSLA", "24h")), cleaned, A.scored(cleaned), None, NOW).first()
    assert row["error"] == NO_VALID_POSTS and row["filter_stats"]["probable_bots"] == 1 and row["search_interest"] is None


def test_dry_run(spark, collected, trends):
    row = sentiment_report(ask(spark, ("AAPL", "24h")), A.clean(collected), None, trends, NOW, dry_run=True).first()
    assert (row["avg_polarity"], row["avg_subjectivity"], row["avg_confidence"], row["total_posts"], row["dry_run"]) == (0.0, 0.0, 0.0, 1, True)
    assert row["search_interest"] is not None


def test_wire_form(rows):
    body = json.loads(report_json(rows[1]).filter("query = 'AAPL'").first()["body"])
    assert body["sources"] == {"x": 1, "reddit": 2, "stocktwits": 0} and body["resolved_instrument"]["company_name"] == "AAPL"
    assert body["resolved_instrument"]["cik"] is None and "search_interest" in body and "dry_run" not in body and "error" not in body


def test_two_level_mean(spark):
    rows = [("x", 1.0), ("x", None), ("stocktwits", 0.0), ("reddit", None)]
    df = spark.createDataFrame([(s, ["A"], p) for s, p in rows], "source string, symbols array<string>, polarity float")
    by_source = A.sentiment_by_source(df)
    row = A.weighted_sentiment(by_source).first()
    # (1.0 * 2 + 0 * 1 + 0 * 1) / 4: a source without scores adds nothing but counts.
    assert (row["count"], row["weighted_sentiment"]) == (4, pytest.approx(0.5))
    assert {r["source"]: r["stddev_polarity"] for r in by_source.collect()} == {"x": None, "stocktwits": None, "reddit": None}


def test_hot_symbol_and_rolling_windows(spark):
    df = spark.range(2000).select(
        F.lit("x").alias("source"), F.array(F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("S"), F.col("id") % 50))).alias("symbols"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 600).alias("created_at"), (F.col("id") % 5 / 5).cast("float").alias("polarity"))
    pdf = df.toPandas()
    hot = pdf[pdf["symbols"].map(lambda s: s[0] == "HOT")]
    got = {r["window_start"]: (r["n"], r["avg_polarity"]) for r in A.rolling_sentiment(df).filter("symbol = 'HOT'").collect()}
    for start, (n, mean) in list(got.items())[::17]:
        inside = hot[(hot.created_at >= start) & (hot.created_at < start + dt.timedelta(hours=24))]
        assert n == len(inside) and mean == pytest.approx(inside.polarity.astype(float).mean())


def test_regions_and_related_limits(spark):
    regions = spark.createDataFrame([("A", "other", 2, f"r{i:02d}", float(i % 7)) for i in range(30)],
                                    "symbol string, term string, term_no int, region string, value double")
    got = [(r["region"], r["value"]) for r in TR.ranked_regions(regions).orderBy("rank").collect()]
    assert got == sorted(((f"r{i:02d}", float(i % 7)) for i in range(30)), key=lambda x: (-x[1], x[0]))[:10]
    related = spark.createDataFrame([("A", k, i, f"{'q' if i % 2 else k}{i}") for k in ("top", "rising") for i in range(1, 9)],
                                    "symbol string, kind string, position int, query string")
    assert TR.related_queries(related).first()["related_queries"] == ["q1", "top2", "q3", "top4", "q5", "rising2", "rising4"]


def test_partial_flag_is_no_series(spark):
    points = spark.createDataFrame([("A", "isPartial", 1, NOW, 1, 1.0), ("B", "b", 2, NOW, 1, 2.0), ("B", "isPartial", 3, NOW, 2, 1.0)],
                                   "symbol string, term string, term_no int, ts timestamp, point_no long, value double")
    assert [tuple(r) for r in TR.pick_series(points).collect()] == [("B", "b")]
    assert {r["symbol"] for r in TR.interest_over_time(points).collect()} == {"B"}
