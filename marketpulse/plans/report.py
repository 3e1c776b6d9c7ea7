"""The sentiment report: one row per request, many requests at once."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.constants import SOURCES
from marketpulse.operators.aggregate import collected_by_age, sentiment_by_age
from marketpulse.operators.trends import enrich_trends
from marketpulse.sources.parsing import literal_time
from marketpulse.store import cube as stored_cube
from marketpulse.store import log

# Messages of the two early ends.
NO_POSTS = "No posts found for this symbol"
NO_VALID_POSTS = "No valid posts after filtering"

_COUNTS = ("total_input", "no_symbols", "probable_bots", "processed", "complete", "n", "n_scored")


def measures(cleaned: DataFrame, scored_posts: DataFrame | None, as_of: dt.datetime) -> DataFrame:
    """Everything a report counts, per symbol, source and age in hours.

    Posts are read once whatever the number of requests; its size depends on symbols and hours, not on posts.
    """
    # Nothing is stored here that could be incomplete: what passes the filters counts as processed.
    parts = [collected_by_age(cleaned, as_of).withColumn("complete", F.col("processed"))]
    if scored_posts is not None:
        parts.append(sentiment_by_age(scored_posts, as_of))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if scored_posts is None:
        union = union.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("n", "n_scored")],
                             F.lit(None).cast("double").alias("sum_polarity"))
    return union


def sentiment_report(
    requests: DataFrame, cleaned: DataFrame, scored_posts: DataFrame | None, trends: DataFrame | None,
    as_of: dt.datetime, dry_run: bool = False,
) -> DataFrame:
    """Answer every request.

    requests: (query, window, hours, instrument), resolved and with readable windows; further columns are kept.
    cleaned: the collected posts with instrument symbol and outcome. scored_posts: everything stored, with scores; not
    looked at in a dry run. trends: one record per symbol, or None.
    """
    return answer(requests, measures(cleaned, None if dry_run else scored_posts, as_of), trends, as_of, dry_run)


def answer(requests: DataFrame, cube: DataFrame, trends: DataFrame | None, as_of: dt.datetime, dry_run: bool = False) -> DataFrame:
    """Answer every request from sums per symbol, source and age in hours."""
    own = [c for c in requests.columns if c not in ("query", "window", "hours", "instrument", "symbol", "cache_hit")]
    requests = requests.select(
        *own, "query", "window", "hours", "instrument", F.col("instrument.symbol").alias("symbol"))
    cube = cube.withColumnRenamed("symbol", "_symbol")

    # Requests that ask the same are answered once; the cube holds a row per hour at most, so this join stays small.
    asked = requests.select("symbol", "hours").distinct()
    in_window = (F.col("symbol") == F.col("_symbol")) & (F.col("age_hours") <= F.col("hours"))
    per_source = (
        asked.join(cube, in_window).groupBy("symbol", "hours", "source")
        .agg(*[F.sum(c).alias(c) for c in _COUNTS], F.sum("sum_polarity").alias("sum_polarity"))
    )
    mean = F.coalesce(F.col("sum_polarity") / F.nullif(F.col("n_scored"), F.lit(0)), F.lit(0.0))
    answers = per_source.groupBy("symbol", "hours").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS],
        F.sum(mean * F.col("n")).alias("weighted"),
        *[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("total_input"))), F.lit(0)).alias(s) for s in SOURCES],
    )

    found = F.coalesce("total_input", F.lit(0))
    processed = F.coalesce("processed", F.lit(0))
    answered = F.col("error").isNull()
    stored = F.coalesce("n", F.lit(0))
    report = enrich_trends(requests.join(answers, ["symbol", "hours"], "left"), trends)
    report = report.withColumn(
        "error", F.when(found == 0, NO_POSTS).when(processed == 0, NO_VALID_POSTS))
    zero = F.lit(0.0)
    if dry_run:
        results = [F.when(answered, zero).alias(f"avg_{c}") for c in ("polarity", "subjectivity", "confidence")]
        results.append(F.when(answered, processed).alias("total_posts"))
    else:
        results = [
            F.when(answered, F.date_format(
                literal_time(as_of) - F.make_dt_interval(hours=F.col("hours")), "yyyy-MM-dd'T'HH:mm:ss")
            ).alias("window_since"),
            F.when(answered, stored).alias("count"),
            F.when(answered, F.coalesce(F.col("weighted") / F.nullif(F.col("n"), F.lit(0)), zero)).alias("weighted_sentiment"),
        ]
    return report.select(
        *own, "query", "window",
        # An early end names the symbol as asked for.
        F.when(answered, F.col("symbol")).otherwise(F.col("query")).alias("symbol"),
        *results,
        "instrument",
        found.alias("posts_found"),
        F.coalesce("complete", F.lit(0)).alias("posts_processed"),
        F.struct(*[F.coalesce(s, F.lit(0)).alias(s) for s in SOURCES]).alias("sources"),
        F.when(answered, F.col("search_interest")).alias("search_interest"),
        F.when(found > 0, F.struct("total_input", "no_symbols", "probable_bots", "processed")).alias("filter_stats"),
        "error",
        F.lit(dry_run).alias("dry_run"),
    )


def report_from_store(requests: DataFrame, store: str, trends: DataFrame | None, as_of: dt.datetime) -> DataFrame:
    """Answer every request from the cube that ingestion keeps in `store`; no post is read.

    Found and filtered posts are all that were collected for the instrument, each by its latest delivery and counted once, however
    often it came in. Processed are those of them with post, score and vector. Hours before the longest window are not read.
    """
    longest = requests.agg(F.max("hours")).first()[0]
    try:
        since = as_of - dt.timedelta(hours=longest or 0)
    except OverflowError:  # a window from before the calendar: all hours
        since = None
    return answer(requests, stored_cube.by_age(log.snapshot(requests.sparkSession, store), as_of, since), trends, as_of)


def report_json(report: DataFrame) -> DataFrame:
    """The report in wire form: one JSON text per request.

    Fields depend on how the request ended: an answer, an early end without posts or without valid posts, or a dry run. A
    field of the branch that has no value is an explicit null.
    """
    common = ("symbol", "posts_found", "posts_processed", "sources", "search_interest")
    extra = [c for c in ("window_since", "count", "weighted_sentiment", "avg_polarity", "avg_subjectivity", "avg_confidence", "total_posts")
             if c in report.columns]

    def body(*names: str) -> Column:
        fields = [*names, *common, F.col("instrument").alias("resolved_instrument")]
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    answer = F.when(F.col("dry_run"), body(*extra, "filter_stats", "dry_run")).otherwise(body(*extra, "filter_stats"))
    early = F.when(F.col("filter_stats").isNull(), body("error")).otherwise(body("error", "filter_stats"))
    own = report.columns[:report.columns.index("query")]
    return report.select(*own, "query", "window", F.when(F.col("error").isNull(), answer).otherwise(early).alias("body"))
