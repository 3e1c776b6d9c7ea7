"""Search listings and comment threads of Reddit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.constants import COMMENTS_PER_POST
from marketpulse.functions.text import strip
from marketpulse.schemas import REDDIT_COMMENT, REDDIT_LISTING, REDDIT_POST, REDDIT_THREAD
from marketpulse.sources.parsing import accepted, as_candidates, literal_time, missing, page_items
from marketpulse.sources.timestamps import reddit_created_at


def _too_old(created_utc: Column, since: dt.datetime | None) -> Column:
    if since is None:
        return F.lit(False)
    return F.coalesce(created_utc, F.lit(0.0)) < F.unix_micros(literal_time(since)) / 1_000_000


def _permalink(path: Column) -> Column:
    return F.when(~missing(path), F.concat(F.lit("https://reddit.com"), path))


def post_item(post: Column, as_of: dt.datetime, since: dt.datetime | None = None) -> tuple[Column, dict[str, Column]]:
    """Why a submission is refused (null where it is not), and its fields."""
    author = F.coalesce(post["author"], F.lit("[deleted]"))
    selftext = F.coalesce(post["selftext"], F.lit(""))
    text = strip(F.concat(F.coalesce(post["title"], F.lit("")), F.lit("\n"), selftext))
    created_utc = F.coalesce(post["created_utc"], F.lit(0.0))
    reason = (
        F.when(reddit_created_at(created_utc).isNull(), "bad_time")
        .when(_too_old(created_utc, since), "too_old")
        .when(author == "[deleted]", "deleted")
        .when(selftext == "[removed]", "removed")
        .when(text == "", "missing_text")
        .when(missing(post["id"]), "missing_id")
    )
    return reason, dict(
        source=F.lit("reddit"),
        platform_id=F.concat(F.lit("post_"), post["id"]),
        author_id=author,
        author_handle=author,
        created_at=reddit_created_at(created_utc),
        text=text,
        lang=F.lit("en"),
        like_count=F.coalesce(post["ups"], F.lit(0)),
        reply_count=F.coalesce(post["num_comments"], F.lit(0)),
        permalink=_permalink(post["permalink"]),
    )


def post_candidates(raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    df = page_items(raw, REDDIT_LISTING, F.col("page")["data"]["children"], REDDIT_POST)
    reason, fields = post_item(F.col("item")["data"], as_of, since)
    return as_candidates(df, reason, **fields)


def posts(raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    return accepted(post_candidates(raw, as_of, since))


def comment_item(comment: Column, as_of: dt.datetime, since: dt.datetime | None = None) -> tuple[Column, dict[str, Column]]:
    """Why a comment is refused (null where it is not), and its fields; uses the column `post_id`."""
    author = F.coalesce(comment["author"], F.lit("[deleted]"))
    created_utc = F.coalesce(comment["created_utc"], F.lit(0.0))
    reason = (
        F.when(reddit_created_at(created_utc).isNull(), "bad_time")
        .when(_too_old(created_utc, since), "too_old")
        .when(author == "[deleted]", "deleted")
        .when(comment["body"].isin("[removed]", "[deleted]"), "removed")
        .when(missing(comment["body"]), "missing_text")
        .when(missing(comment["id"]), "missing_id")
    )
    return reason, dict(
        source=F.lit("reddit"),
        platform_id=F.concat(F.lit("comment_"), comment["id"]),
        author_id=author,
        author_handle=author,
        created_at=reddit_created_at(created_utc),
        text=comment["body"],
        lang=F.lit("en"),
        reply_to_id=F.col("post_id"),
        like_count=F.coalesce(comment["ups"], F.lit(0)),
        permalink=_permalink(comment["permalink"]),
    )


def first_children(thread: Column, per_post: int = COMMENTS_PER_POST) -> Column:
    return F.slice(F.try_element_at(thread, F.lit(2))["data"]["children"], 1, per_post)


def comment_candidates(
    threads: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None, per_post: int = COMMENTS_PER_POST
) -> DataFrame:
    """Comments of landed threads. The first `per_post` children are looked at, then those that are comments kept.

    A response is a thread as it was fetched once: the limit holds for each response, as for a client that asks again.
    """
    df = page_items(threads, REDDIT_THREAD, first_children(F.col("page"), per_post), REDDIT_COMMENT, "post_id").filter(F.col("item")["kind"] == "t1")
    reason, fields = comment_item(F.col("item")["data"], as_of, since)
    return as_candidates(df, reason, **fields)


def comments(threads: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    return accepted(comment_candidates(threads, as_of, since))


def thread_comments(
    threads: DataFrame, submissions: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None
) -> DataFrame:
    """Comments of accepted submissions only."""
    kept = submissions.select(F.regexp_replace("platform_id", "^post_", "").alias("reply_to_id"))
    return comments(threads, as_of, since).join(kept, "reply_to_id", "left_semi")
