"""Keyed merges over snapshots.

A merge is a function of the stored table and the incoming rows. The incoming side is first reduced to one row per
key, by an aggregation that combines copies before the shuffle, and written, as it is measured and used more than once.
The stored side is only joined: if the incoming keys
are few, by a count, they are broadcast and the stored table is not shuffled at all.
Stored tables keep one row per key. The key is the natural one: a 64-bit surrogate would collide at this scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.schemas import POST_KEY
from marketpulse.session import materialize


def latest(incoming: DataFrame, key: tuple[str, ...], order: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """The last row per key in the given order."""
    rest = [c for c in incoming.columns if c not in key and c not in drop]
    return incoming.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def earliest(incoming: DataFrame, key: tuple[str, ...], order: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """The first row per key in the given order."""
    rest = [c for c in incoming.columns if c not in key and c not in drop]
    return incoming.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*key, "_row.*")


def merge_latest(
    existing: DataFrame | None, incoming: DataFrame, key: tuple[str, ...], order: Column, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Last write wins: incoming rows replace stored rows of the same key."""
    newest = latest(incoming, key, order, drop)
    if existing is None:
        return newest
    newest = materialize(newest, "delivery")
    replaced = broadcast_if_small(newest.select(*key))
    return existing.join(replaced, list(key), "left_anti").unionByName(newest)


def first_writes(incoming: DataFrame, order: Column, drop: tuple[str, ...] = ()) -> DataFrame:
    """Incoming posts reduced to one row per key: the content first written, the latest `ingested_at`."""
    content = [c for c in incoming.columns if c not in (*POST_KEY, "ingested_at", *drop)]
    return (
        incoming.groupBy(*POST_KEY)
        .agg(F.min_by(F.struct(*content), order).alias("_row"), F.max("ingested_at").alias("ingested_at"))
        .select(*POST_KEY, "_row.*", "ingested_at")
    )


def unseen(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming rows whose key is not stored.

    Stored keys are first cut down to those that come in again: there the incoming side is the one that can be
    broadcast, so the stored keys are only scanned. The anti join then has two small sides.
    """
    key = list(POST_KEY)
    again = existing.select(*key).join(broadcast_if_small(incoming.select(*key)), key, "left_semi")
    return incoming.join(again, key, "left_anti")


def merge_posts(
    existing: DataFrame | None, incoming: DataFrame, order: Column, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Content stays as first written; a repeated delivery only moves `ingested_at`."""
    first = first_writes(incoming, order, drop)
    if existing is None:
        return first
    first = materialize(first, "delivery")
    seen = broadcast_if_small(first.select(*POST_KEY, F.col("ingested_at").alias("_seen")))
    touched = (
        existing.join(seen, list(POST_KEY), "left")
        .withColumn("ingested_at", F.greatest("ingested_at", "_seen")).drop("_seen")
    )
    return touched.unionByName(unseen(first, existing))


def only_with_post(children: DataFrame, posts: DataFrame) -> DataFrame:
    """Drop scores or vectors whose post is gone."""
    return children.join(posts.select(*POST_KEY), list(POST_KEY), "left_semi")


def complete_posts(posts: DataFrame, sentiment: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Keys of posts that have both a score and a vector. All three sides are narrow and share one partitioning."""
    key = list(POST_KEY)
    return (
        posts.select(*key)
        .join(sentiment.select(*key), key, "left_semi")
        .join(embeddings.select(*key), key, "left_semi")
    )


def account_rollup(posts: DataFrame) -> DataFrame:
    """Per account: handle and followers as of its latest post, and when that was."""
    last = F.struct("created_at", "platform_id")
    return posts.groupBy("source", "author_id").agg(
        F.max_by("author_handle", last).alias("handle"),
        F.max_by("follower_count", last).alias("follower_count"),
        F.max("created_at").alias("last_seen"),
    )
