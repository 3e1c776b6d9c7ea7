"""Requests and symbol resolution, for whole tables of queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.constants import CACHE_TTL_DAYS, COMPANY_TICKERS
from marketpulse.functions.binding import bind
from marketpulse.functions.windows import request_reason, window_hours
from marketpulse.operators.merge import merge_latest
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.sources.parsing import literal_time

_FIELDS = ("symbol", "cik", "isin", "figi", "company_name")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add the reason a request is refused (null where accepted) and the upper-cased symbol to look up.

    Each check reads the symbol and the window as values: the expressions that make them are not repeated in every test.
    """
    reason = bind(F.struct("symbol", "window"), lambda r: F.struct(
        request_reason(r["symbol"], r["window"]).alias("reason"), F.upper(r["symbol"]).alias("query")))
    checked = bind(reason, lambda c: F.struct(c["reason"].alias("reason"), F.when(c["reason"].isNull(), c["query"]).alias("query")))
    # Out of a generator, so that the filters and columns that follow do not check once for each use.
    return requests.select(*[c for c in requests.columns if c not in ("reason", "query")], F.inline(F.array(checked)))


def with_window(requests: DataFrame) -> DataFrame:
    """Add the window's length in hours; null marks a window that cannot be read."""
    return requests.withColumn("hours", window_hours(F.col("window")))


def normalize_query(query: Column) -> Column:
    return F.regexp_replace(F.upper(query), r"^\$+|\$+$", "")


def resolve_query(query: Column) -> Column:
    """Up to five letters are a ticker; then the company names count; anything else stands for itself."""
    names = F.create_map(*[F.lit(part) for pair in COMPANY_TICKERS.items() for part in pair])
    unknown = F.lit(None).cast("string")

    def resolved(q: Column) -> Column:
        name, is_ticker = q["name"], q["is_ticker"]
        return F.struct(
            F.when(is_ticker, name).otherwise(F.coalesce(F.try_element_at(names, name), name)).alias("symbol"),
            unknown.alias("cik"), unknown.alias("isin"), unknown.alias("figi"),
            F.when(is_ticker, name).otherwise(q["query"]).alias("company_name"),
        )

    named = F.struct(query.alias("query"), normalize_query(query).alias("name"))
    told = bind(named, lambda q: F.struct(
        q["query"].alias("query"), q["name"].alias("name"), F.rlike(q["name"], F.lit(r"^\p{L}{1,5}$")).alias("is_ticker")))
    return bind(told, resolved)


def resolve_symbols(requests: DataFrame, cache: DataFrame | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """Add `instrument` and `cache_hit`. A fresh cache row, keyed by the upper-cased query, comes before the rules."""
    computed = resolve_query(F.col("query"))
    if cache is None:
        return requests.withColumn("instrument", computed).withColumn("cache_hit", F.lit(False))
    fresh = cache.filter(F.col("cached_at") > literal_time(as_of - dt.timedelta(days=CACHE_TTL_DAYS))).select(
        F.col("query").alias("_key"), F.struct(*_FIELDS).alias("_cached"))
    fresh = broadcast_if_small(fresh)
    return (
        requests.join(fresh, F.upper("query") == F.col("_key"), "left")
        .withColumn("cache_hit", F.col("_cached").isNotNull())
        .withColumn("instrument", F.coalesce("_cached", computed))
        .drop("_key", "_cached")
    )


def updated_cache(cache: DataFrame, requests: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The cache after these requests: every miss is written with `as_of`, replacing an expired row."""
    asked = requests.select(F.col("query")).distinct()
    missed = (
        resolve_symbols(asked, cache, as_of).filter(~F.col("cache_hit"))
        .select(F.upper("query").alias("query"), "instrument.*", literal_time(as_of).alias("cached_at"),
                F.col("query").alias("_asked"))
    )
    columns = ["query", *_FIELDS, "cached_at"]
    return merge_latest(cache.select(*columns), missed, ("query",), F.col("_asked"), drop=("_asked",)).select(*columns)
