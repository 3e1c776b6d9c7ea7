"""Recent-search pages of X."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.functions.binding import bind
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.schemas import X_PAGE, X_POST, X_USER
from marketpulse.sources.parsing import accepted, as_candidates, literal_time, missing, page_items
from marketpulse.sources.timestamps import x_created_at


def item(post: Column, author: Column, as_of: dt.datetime, since: dt.datetime | None = None) -> tuple[Column, dict[str, Column]]:
    """Why a post is refused (null where it is not), and its fields."""
    handle = F.coalesce(author["username"], F.lit(""))
    created_at = x_created_at(post["created_at"], literal_time(as_of))
    reason = F.when(missing(post["id"]), "missing_id").when(missing(post["text"]), "missing_text")
    if since is not None:
        # The search takes its start in whole seconds.
        reason = reason.when(created_at < literal_time(since.replace(microsecond=0)), "too_old")
    return reason, dict(
        source=F.lit("x"),
        platform_id=post["id"],
        author_id=F.coalesce(post["author_id"], F.lit("")),
        author_handle=handle,
        created_at=created_at,
        text=post["text"],
        lang=F.coalesce(post["lang"], F.lit("en")),
        like_count=post["public_metrics"]["like_count"],
        reply_count=post["public_metrics"]["reply_count"],
        repost_count=post["public_metrics"]["retweet_count"],
        follower_count=author["public_metrics"]["followers_count"],
        permalink=F.when(handle != "", F.concat(
            F.lit("https://twitter.com/"), handle, F.lit("/status/"), post["id"])),
    )


def candidates(raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    page = F.col("page")
    read = F.struct(
        F.transform(page["data"], lambda text: F.from_json(text, X_POST)).alias("posts"),
        F.transform(page["includes"]["users"], lambda text: F.from_json(text, X_USER)).alias("users"),
    )
    # A page lists its authors beside the posts; the last entry of an id counts. A page holds at most a hundred posts.
    with_author = bind(read, lambda p: F.transform(p["posts"], lambda post: F.struct(
        post.alias("post"),
        F.try_element_at(F.filter(p["users"], lambda user: user["id"] == post["author_id"]), F.lit(-1)).alias("author"),
    )))
    df = page_items(raw, X_PAGE, with_author)
    reason, fields = item(F.col("item")["post"], F.col("item")["author"], as_of, since)
    return as_candidates(df, reason, **fields)


def posts(raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    return accepted(candidates(raw, as_of, since))


def with_authors(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """Author lookup across pages: `users` has one row per id, and posts of unknown authors stay.

    While the users are few, by a count, busy authors' posts need not meet in one task.
    """
    authors = broadcast_if_small(users.select(
        F.col("id").alias("author_id"), F.col("username").alias("_handle"), F.col("followers_count").alias("_followers")))
    return (
        tweets.join(authors, "author_id", "left")
        .withColumn("author_handle", F.coalesce("_handle", F.lit("")))
        .withColumn("follower_count", F.col("_followers"))
        .drop("_handle", "_followers")
    )
