"""Search-interest tables to one trends record per symbol."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketpulse.constants import RELATED_PER_KIND, RELATED_TOTAL, TOP_REGIONS, TREND_DAYS
from marketpulse.sources.parsing import literal_time

_PARTIAL = "isPartial"
_RECORD = (
    "struct<interest_over_time:map<string,double>,related_queries:array<string>,"
    "interest_by_region:map<string,double>,fetched_at:timestamp>"
)


def _rank_of_series() -> Column:
    """The symbol's own series first, then the others in column order."""
    return F.struct((F.col("term") != F.col("symbol")).alias("other"), "term_no", "term")


def recent_points(points: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Points of the last seven days: the time frame for which interest is looked up."""
    return points.filter(F.col("ts").between(literal_time(as_of - dt.timedelta(days=TREND_DAYS)), literal_time(as_of)))


def pick_series(points: DataFrame) -> DataFrame:
    """The series used per symbol: its own, else the first one unless that is the flag for partial data."""
    best = F.min(_rank_of_series()).alias("best")
    return points.groupBy("symbol").agg(best).filter(F.col("best.term") != _PARTIAL).select("symbol", "best.term")


def _keep_picked(rows: DataFrame) -> DataFrame:
    """Rows of the picked series. For already reduced rows: a few terms times days or regions per symbol."""
    best = F.min(_rank_of_series()).over(Window.partitionBy("symbol"))
    return rows.withColumn("_best", best).filter(
        (F.col("term") == F.col("_best.term")) & (F.col("term") != _PARTIAL)).drop("_best")


def daily_interest(points: DataFrame) -> DataFrame:
    """Last value per symbol and calendar date of the picked series. `point_no` orders points of one instant."""
    last = F.max_by("value", F.struct("ts", "point_no"))
    daily = points.groupBy("symbol", "term_no", "term", F.to_date("ts").alias("date")).agg(last.alias("value"))
    return _keep_picked(daily).select("symbol", "date", "value")


def interest_over_time(points: DataFrame) -> DataFrame:
    """The daily values as one map per symbol."""
    entries = F.array_sort(F.collect_list(F.struct(F.date_format("date", "yyyy-MM-dd"), "value")))
    return daily_interest(points).groupBy("symbol").agg(F.map_from_entries(entries).alias("interest_over_time"))


def related_queries(related: DataFrame) -> DataFrame:
    """First five top queries, then first five rising ones, each query once at its first place, ten in all.

    `position` counts from one within symbol and kind.
    """
    first = related.filter((F.col("position") <= RELATED_PER_KIND) & F.col("kind").isin("top", "rising"))
    place = F.col("position") + F.when(F.col("kind") == "rising", RELATED_PER_KIND).otherwise(0)
    once = first.groupBy("symbol", "query").agg(F.min(place).alias("place"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "query")))
    listed = F.transform(F.slice(ordered, 1, RELATED_TOTAL), lambda entry: entry["query"])
    return once.groupBy("symbol").agg(listed.alias("related_queries"))


def ranked_regions(regions: DataFrame) -> DataFrame:
    """Ten regions per symbol with the highest interest."""
    best = Window.partitionBy("symbol").orderBy(F.desc("value"), "region")
    return (
        _keep_picked(regions).withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= TOP_REGIONS).select("symbol", "rank", "region", "value")
    )


def interest_by_region(regions: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "region", "value")))
    entries = F.transform(ordered, lambda e: F.struct(e["region"], e["value"]))
    return ranked_regions(regions).groupBy("symbol").agg(F.map_from_entries(entries).alias("interest_by_region"))


def trends_record(points: DataFrame, related: DataFrame, regions: DataFrame, fetched_at: dt.datetime) -> DataFrame:
    """The three parts per symbol; a missing part is an empty map or list. The empty symbol has no record."""
    record = (
        interest_over_time(points)
        .join(related_queries(related), "symbol", "full")
        .join(interest_by_region(regions), "symbol", "full")
        .filter(F.col("symbol") != "")
    )
    no_entries = F.create_map().cast("map<string,double>")
    return record.select(
        "symbol",
        F.coalesce("interest_over_time", no_entries).alias("interest_over_time"),
        F.coalesce("related_queries", F.array().cast("array<string>")).alias("related_queries"),
        F.coalesce("interest_by_region", no_entries).alias("interest_by_region"),
        literal_time(fetched_at).alias("fetched_at"),
    )


def enrich_trends(reports: DataFrame, trends: DataFrame | None) -> DataFrame:
    """Add `search_interest`; null for a symbol without a record, or where trends are switched off."""
    if trends is None:
        return reports.withColumn("search_interest", F.lit(None).cast(_RECORD))
    record = trends.select("symbol", F.struct(
        "interest_over_time", "related_queries", "interest_by_region", "fetched_at").alias("search_interest"))
    return reports.join(record, "symbol", "left")
