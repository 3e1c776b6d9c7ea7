"""Roll-ups of scored and collected posts, for all symbols at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.constants import SOURCES
from marketpulse.functions.scoring import score_posts, stored_score
from marketpulse.functions.text import cleaned, outcome
from marketpulse.functions.windows import age_hours
from marketpulse.schemas import POST_KEY
from marketpulse.sources.parsing import literal_time


def clean(posts: DataFrame) -> DataFrame:
    """Normalize the text, find the symbols, and mark the first filter each post fails.

    Uses the instrument columns `symbol` and `company_name` where the posts carry them.
    """
    own = [F.col(c) if c in posts.columns else None for c in ("symbol", "company_name")]
    rest = [c for c in posts.columns if c not in ("text", "symbols")]
    return (
        posts.select(*rest, F.inline(cleaned(F.col("text"), *own)))
        .withColumn("outcome", outcome(F.col("text"), F.col("symbols")))
    )


def scored(posts: DataFrame) -> DataFrame:
    """Score fields beside each post, in stored precision."""
    return score_posts(posts).select(*posts.columns, *stored_score(F.col("score")))


def with_scores(posts: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Stored posts with their stored scores; posts without a score drop out. One row per key on both sides."""
    return posts.join(sentiment, list(POST_KEY), "inner")


def posts_for_symbol(posts: DataFrame, symbol: str, since: dt.datetime | None = None) -> DataFrame:
    """Stored posts that carry the symbol, from `since` on."""
    if since is not None:
        posts = posts.filter(F.col("created_at") >= literal_time(since))
    return posts.filter(F.array_contains("symbols", symbol))


def per_symbol(posts: DataFrame, *columns: str) -> DataFrame:
    """One narrow row per post and symbol."""
    return posts.select(F.explode("symbols").alias("symbol"), *columns)


def sentiment_by_source(scored_posts: DataFrame) -> DataFrame:
    """Count, mean and sample deviation of polarity per symbol and source."""
    return per_symbol(scored_posts, "source", F.col("polarity").cast("double").alias("polarity")).groupBy(
        "symbol", "source"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("polarity").alias("avg_polarity"),
        F.stddev_samp("polarity").alias("stddev_polarity"),
    )


def weighted_sentiment(by_source: DataFrame) -> DataFrame:
    """Source means weighted by all rows of the source; a source without any score counts as zero."""
    weighted = F.sum(F.coalesce("avg_polarity", F.lit(0.0)) * F.col("n"))
    return by_source.groupBy("symbol").agg(
        F.sum("n").alias("count"), F.coalesce(weighted / F.sum("n"), F.lit(0.0)).alias("weighted_sentiment"))


def sources_map(by_source: DataFrame) -> DataFrame:
    """Stored posts per source as a map; one entry per source, so the list is short."""
    entries = F.array_sort(F.collect_list(F.struct("source", "n")))
    return by_source.groupBy("symbol").agg(F.map_from_entries(entries).alias("sources"))


def avg_scores(scored_posts: DataFrame) -> DataFrame:
    names = ("polarity", "subjectivity", "confidence")
    df = per_symbol(scored_posts, *[F.col(c).cast("double").alias(c) for c in names])
    return df.groupBy("symbol").agg(*[F.avg(c).alias(f"avg_{c}") for c in names])


def source_counts(collected: DataFrame) -> DataFrame:
    """Collected posts per symbol and source, zeros included."""
    counts = collected.groupBy("symbol").agg(*[F.count_if(F.col("source") == s).alias(s) for s in SOURCES])
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("n")) for s in SOURCES])
    return counts.select("symbol", F.inline(pairs))


def filter_stats(cleaned: DataFrame, *by: str) -> DataFrame:
    """How many posts came in and where each went, in one pass."""
    return cleaned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_input"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("no_symbols", "probable_bots", "processed")],
    )


def collected_by_age(cleaned: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Collected posts per symbol, source and age in hours, by outcome."""
    aged = cleaned.select("symbol", "source", "outcome", age_hours(
        F.col("created_at"), literal_time(as_of)).alias("age_hours"))
    return filter_stats(aged, "symbol", "source", "age_hours")


def sentiment_by_age(scored_posts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Stored posts per symbol, source and age in hours: rows, scored rows and the sum of polarity."""
    aged = per_symbol(
        scored_posts, "source", F.col("polarity").cast("double").alias("polarity"),
        age_hours(F.col("created_at"), literal_time(as_of)).alias("age_hours"))
    return aged.groupBy("symbol", "source", "age_hours").agg(
        F.count(F.lit(1)).alias("n"), F.count("polarity").alias("n_scored"), F.sum("polarity").alias("sum_polarity"))


def rolling_sentiment(scored_posts: DataFrame, hours: int = 24) -> DataFrame:
    """Mean polarity per symbol over windows of `hours` hours, one starting each hour.

    Posts are first added up per hour; only these sums are copied into the windows that hold the hour.
    """
    hour = F.date_trunc("hour", "created_at")
    hourly = (
        per_symbol(scored_posts, hour.alias("hour"), F.col("polarity").cast("double").alias("polarity"))
        .groupBy("symbol", "hour")
        .agg(F.count(F.lit(1)).alias("n"), F.count("polarity").alias("n_scored"), F.sum("polarity").alias("total"))
    )
    # In microseconds: a day may not be 24 hours long, an hour is fixed.
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(hours - 1)),
        lambda back: F.timestamp_micros(F.unix_micros("hour") - back.cast("bigint") * 3_600_000_000))
    return (
        hourly.select("symbol", F.explode(starts).alias("window_start"), "n", "n_scored", "total")
        .groupBy("symbol", "window_start")
        .agg(F.sum("n").alias("n"), (F.sum("total") / F.nullif(F.sum("n_scored"), F.lit(0))).alias("avg_polarity"))
    )
