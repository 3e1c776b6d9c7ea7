"""The incremental cube: sums per symbol, source and hour that every batch corrects."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.windows import age_hours
from marketpulse.schemas import POST_KEY
from marketpulse.sources.parsing import literal_time
from marketpulse.store.log import Snapshot
from marketpulse.store.tables import COUNTS, POLARITY, latest, summed

_OUTCOMES = ("no_symbols", "probable_bots", "processed")


def contributions(state: DataFrame, collected: DataFrame) -> DataFrame:
    """One narrow row per stored post and symbol, and per collected post and instrument: what each adds, and when it was made.

    state: one row per post. collected: one row per post and instrument.
    """
    one = lambda yes: F.coalesce(yes.cast("bigint"), F.lit(0).cast("bigint"))
    none = {c: F.lit(0).cast("bigint") for c in COUNTS}
    stored = state.select(F.explode("symbols").alias("symbol"), "source", "created_at", "polarity")
    polarity = F.col("polarity").cast("double").cast(POLARITY)
    counted = none | {"n": F.lit(1).cast("bigint"), "n_scored": one(F.col("polarity").isNotNull())}
    stored = stored.select("symbol", "source", "created_at", *[c.alias(k) for k, c in counted.items()],
                           F.coalesce(polarity, F.lit(0).cast(POLARITY)).alias("sum_polarity"))
    done = state.filter("scored and embedded").select(*POST_KEY, F.lit(True).alias("_done"))
    met = collected.select(*POST_KEY, "symbol", "created_at", "outcome").join(done, list(POST_KEY), "left")
    counted = none | {"total_input": F.lit(1).cast("bigint")} | {o: one(F.col("outcome") == o) for o in _OUTCOMES}
    counted["complete"] = one((F.col("outcome") == "processed") & F.col("_done"))
    met = met.select("symbol", "source", "created_at", *[c.alias(k) for k, c in counted.items()], F.lit(0).cast(POLARITY).alias("sum_polarity"))
    return stored.unionByName(met)


def _hourly(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hour", F.date_trunc("hour", "created_at")).drop("created_at")


def delta(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """What a batch changes: the contributions of its posts as they are now, less what they were. Each side: (state, collected)."""
    old = _hourly(contributions(*before))
    taken = [(-F.col(c)).cast(old.schema[c].dataType).alias(c) for c in (*COUNTS, "sum_polarity")]
    return summed(_hourly(contributions(*after)).unionByName(old.select("symbol", "source", "hour", *taken)))


def cells(store: Snapshot) -> DataFrame:
    """The cube as of the snapshot: one row per symbol, source and hour that has anything."""
    return summed(store.read("cube"))


def recount(store: Snapshot) -> DataFrame:
    """The same, counted anew from every stored and collected post."""
    return summed(_hourly(contributions(latest(store.read("state"), "state"), latest(store.read("collected"), "collected"))))


def by_age(store: Snapshot, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    """Sums per symbol, source and age in hours, of posts from `since` on: what reports add up. No text is read.

    Hours of the cube are whole. An `as_of` within an hour cuts them, so ages are then counted from the rows of the posts, texts left out.
    """
    now = literal_time(as_of)
    if (as_of.minute, as_of.second, as_of.microsecond) == (0, 0, 0):
        rows, at = store.read("cube"), "hour"
    else:
        rows, at = contributions(latest(store.read("state"), "state"), latest(store.read("collected"), "collected")), "created_at"
    if since is not None:
        rows = rows.filter(F.col(at) >= literal_time(since))
    sums = rows.groupBy("symbol", "source", age_hours(F.col(at), now).alias("age_hours")).agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.sum("sum_polarity").cast("double").alias("sum_polarity"))
    return sums.filter(" or ".join(f"{c} != 0" for c in COUNTS))


def by_source(cube: DataFrame) -> DataFrame:
    """Count and mean polarity per symbol and source over stored posts."""
    mean = F.sum("sum_polarity").cast("double") / F.nullif(F.sum("n_scored"), F.lit(0))
    return cube.groupBy("symbol", "source").agg(F.sum("n").alias("n"), mean.alias("avg_polarity")).filter("n > 0")


def filter_stats(cube: DataFrame, *by: str) -> DataFrame:
    """How many posts came in and where each went."""
    return cube.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("total_input", *_OUTCOMES)]).filter("total_input > 0")
