import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketpulse.functions import windows as W
from marketpulse.operators import resolve as R

AS_OF = dt.datetime(2024, 1, 31)
WINDOWS = [("24h", 24), ("7d", 168), ("1w", 168), ("2W", 336), ("5x", 24), ("0h", 0), ("-5h", -5), (" 3d", 72), ("1_0h", 10),
           ("invalid", None), ("h", None), ("", None), ("1.5h", None), ("_1h", None)]


@pytest.mark.parametrize("window,hours", WINDOWS)
def test_parse_window(window, hours):
    if hours is None:
        with pytest.raises(ValueError):
            W.parse_window(window)
    else:
        assert W.parse_window(window) == dt.timedelta(hours=hours)


def test_window_column_agrees(spark):
    df = spark.createDataFrame([(w,) for w, _ in WINDOWS], "window string")
    assert [r[0] for r in df.select(W.window_hours(F.col("window"))).collect()] == [h for _, h in WINDOWS]


def test_age_counts_every_whole_window(spark):
    offsets = [0, 1, 3_600_000_000 - 1, 3_600_000_000, 3_600_000_001, 86_400_000_000, -1, -3_600_000_000]
    df = spark.createDataFrame([(o,) for o in offsets], "o bigint")
    as_of = F.timestamp_micros(F.lit(1_706_659_200_000_000))
    created = F.timestamp_micros(F.lit(1_706_659_200_000_000) - F.col("o"))
    for row in df.select("o", W.age_hours(created, as_of).alias("age")).collect():
        for hours in (0, 1, 2, 24, 25):
            assert (row["age"] <= hours) == (row["o"] <= hours * 3_600_000_000)


def test_validate_requests(spark):
    rows = [("AAPL", "24h"), ("aapl", "7d"), (None, "24h"), ("", "24h"), ("A" * 20, "24h"), ("AAPL", "invalid"), ("AAPL", "1w"), ("AAPL", None)]
    got = R.validate_requests(spark.createDataFrame(rows, "symbol string, window string")).collect()
    assert [r["reason"] for r in got] == [
        None, None, "symbol_missing", "symbol_missing", "symbol_too_long", "window_invalid", "window_invalid", "window_invalid"]
    assert [r["query"] for r in got[:3]] == ["AAPL", "AAPL", None]


RESOLVED = {
    "AAPL": ("AAPL", "AAPL"), "aapl": ("AAPL", "AAPL"), "Apple": ("APPLE", "APPLE"), "$TSLA": ("TSLA", "TSLA"),
    "$$nvda$": ("NVDA", "NVDA"), "Microsoft": ("MSFT", "Microsoft"), "amazon": ("AMZN", "amazon"), "Google": ("GOOGL", "Google"),
    "NVIDIA": ("NVDA", "NVIDIA"), "BRK.B": ("BRK.B", "BRK.B"), "Some Company": ("SOME COMPANY", "Some Company"), "A1": ("A1", "A1"),
    "éé": ("ÉÉ", "ÉÉ"), "": ("", ""),
}


def test_resolve(spark):
    got = R.resolve_symbols(spark.createDataFrame([(q,) for q in RESOLVED], "query string")).collect()
    assert {r["query"]: (r["instrument"]["symbol"], r["instrument"]["company_name"]) for r in got} == RESOLVED
    assert all(r["instrument"]["cik"] is None and not r["cache_hit"] for r in got)


@pytest.fixture
def cache(spark):
    rows = [("ONE", "C1", "One", AS_OF - dt.timedelta(days=1)), ("SEVEN", "C7", "Seven", AS_OF - dt.timedelta(days=7)),
            ("EIGHT", "C8", "Eight", AS_OF - dt.timedelta(days=8)), ("$X", "CX", "X", AS_OF)]
    df = spark.createDataFrame(rows, "query string, symbol string, company_name string, cached_at timestamp")
    for name in ("cik", "isin", "figi"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def test_cache_life_is_strict(spark, cache):
    asked = spark.createDataFrame([("one",), ("seven",), ("eight",), ("$x",), ("x",)], "query string")
    got = {r["query"]: (r["cache_hit"], r["instrument"]["symbol"]) for r in R.resolve_symbols(asked, cache, AS_OF).collect()}
    assert got == {"one": (True, "C1"), "seven": (False, "SEVEN"), "eight": (False, "EIGHT"), "$x": (True, "CX"), "x": (False, "X")}


def test_cache_update_writes_only_misses(spark, cache):
    asked = spark.createDataFrame([("one",), ("seven",), ("seven",), ("new",)], "query string")
    rows = {r["query"]: (r["symbol"], r["cached_at"]) for r in R.updated_cache(cache, asked, AS_OF).collect()}
    assert rows["ONE"] == ("C1", AS_OF - dt.timedelta(days=1))
    assert rows["SEVEN"] == ("SEVEN", AS_OF) and rows["NEW"] == ("NEW", AS_OF)
    assert rows["EIGHT"][0] == "C8" and len(rows) == 5
    again = R.updated_cache(R.updated_cache(cache, asked, AS_OF), asked, AS_OF)
    assert {r["query"]: (r["symbol"], r["cached_at"]) for r in again.collect()} == rows


def test_windows_beyond_any_time(spark):
    from marketpulse.functions.windows import parse_window, request_reason, window_hours

    wild = ["9000000000000000000w", "99999999999999999999h", "9999999999h", "-9999999999h", "7d", "99999999999999999999x"]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(wild)], "i int, w string").orderBy("i").select(window_hours(F.col("w"))).collect()]
    assert got == [None, None, None, None, 168, 24]
    for w, hours in zip(wild, got):
        if hours is None:
            with pytest.raises(ValueError):
                parse_window(w)
        else:
            assert parse_window(w).total_seconds() == 3600 * hours
    refused = spark.sql("SELECT 'A' AS s, '9999999999h' AS w").select(request_reason(F.col("s"), F.col("w"))).first()[0]
    assert refused == "window_invalid"


def test_checks_are_not_repeated_for_each_use(spark):
    """What makes symbol and window is computed once per request, and the result of a check is a column for what follows."""
    made = spark.range(40).select(
        F.col("id").alias("o_orderkey"), F.concat(F.lit("$"), F.upper(F.char(F.col("id") % 26 + 97))).alias("symbol"),
        F.concat((F.col("id") % 30).cast("string"), F.lit("h")).alias("window"))
    accepted = R.with_window(R.validate_requests(made).filter("reason is null").select("o_orderkey", "query", "window"))
    asked = R.resolve_symbols(accepted)
    assert {(r["hours"], r["instrument"]["symbol"]) for r in asked.collect()} == {(i % 30, chr(65 + i % 26)) for i in range(40)}
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    # The accepted form, the number in the check and in the hours, and the ticker's form.
    assert plan.count("RLIKE") == 4 and plan.count("regexp_replace") == 1
