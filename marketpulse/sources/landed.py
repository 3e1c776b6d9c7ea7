"""Landed responses: scan, per-source parsers, union, paging rules and the quarantine."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.constants import MAX_PAGES, SOURCES
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.schemas import LANDED_PAGE, REDDIT_LISTING, REDDIT_THREAD, REQUIRED_POST_FIELDS, STOCKTWITS_STREAM, X_PAGE
from marketpulse.sources import reddit, stocktwits, x
from marketpulse.sources.parsing import bad_pages, literal_time

log = logging.getLogger(__name__)

Parser = Callable[[DataFrame, dt.datetime, "dt.datetime | None"], DataFrame]


def _reddit(raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None) -> DataFrame:
    listings = raw.filter(F.coalesce(F.col("kind"), F.lit("search")) == "search")
    threads = raw.filter(F.col("kind") == "comments")
    submissions = reddit.posts(listings, as_of, since)
    found = reddit.thread_comments(threads, submissions, as_of, since)
    return submissions.unionByName(found, allowMissingColumns=True)


PARSERS: dict[str, Parser] = {"x": x.posts, "reddit": _reddit, "stocktwits": stocktwits.posts}


def register_parser(source: str, parser: Parser) -> None:
    """Add or replace the parser of one source."""
    PARSERS[source] = parser


def write_landed(pages: DataFrame, path: str) -> None:
    """Append responses as JSON lines, by source, so that each parser reads only its own."""
    pages.write.mode("append").partitionBy("source").json(path)


def scan_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one JSON object per line."""
    return spark.read.schema(LANDED_PAGE).json(path)


def collect_posts(
    raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None, parsers: dict[str, Parser] | None = None
) -> DataFrame:
    """Posts of all sources with their origin. A parser that fails leaves its source out; the others go on."""
    parts = []
    for source, parser in (PARSERS if parsers is None else parsers).items():
        try:
            posts = parser(raw.filter(F.col("source") == source), as_of, since)
            # Searches for several terms of an instrument find a post more than once.
            parts.append(dedupe_keep_first(posts, "source", "symbol", "platform_id") if source == "reddit" else posts)
        except Exception as error:  # noqa: BLE001 - one source must not stop the rest
            log.warning("source %s left out: %s", source, error)
    if not parts:
        raise ValueError("no source could be parsed")
    return union_posts(*parts)


def union_posts(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def dedupe_keep_first(posts: DataFrame, *key: str) -> DataFrame:
    """One row per key: the first by term, then page, then place on the page.

    An aggregation rather than a window, so copies of a post are combined before the shuffle and a much-copied post
    costs no task more than a row per input partition.
    """
    rest = [c for c in posts.columns if c not in key]
    order = F.struct(*[
        F.coalesce(F.col(c), F.lit(0)) for c in ("term_no", "page_no", "pos") if c in posts.columns])
    first = F.min_by(F.struct(*rest), order)
    return posts.groupBy(*key).agg(first.alias("_first")).select(*key, "_first.*")


def since_filter(posts: DataFrame, since: dt.datetime) -> DataFrame:
    """Keep posts from `since` on. X counts from the whole second, the others exactly.

    The plain comparison comes first because it can be pushed into a scan.
    """
    whole = since.replace(microsecond=0)
    df = posts.filter(F.col("created_at") >= literal_time(whole))
    if whole == since:
        return df
    return df.filter((F.col("source") == "x") | (F.col("created_at") >= literal_time(since)))


def next_cursor(raw: DataFrame) -> Column:
    """Whether a page names a following page: a token, a name or a non-zero number, by source."""
    body = F.col("body")
    token = (
        F.when(F.col("source") == "x", F.get_json_object(body, "$.meta.next_token"))
        .when(F.col("source") == "reddit", F.get_json_object(body, "$.data.after"))
        .otherwise(F.nullif(F.get_json_object(body, "$.cursor.max"), F.lit("0")))
    )
    return F.coalesce(token != "", F.lit(False))


PAGE_KEY = ("source", "symbol", "term_no")


def _until(pages: DataFrame, stops: Column) -> DataFrame:
    """Pages up to and including the first one that stops its sequence.

    Only sequences that go on after a stop can lose pages. These are found by a narrow pre-aggregated pass; while
    there are few of them, by a count, the page bodies need no shuffle.
    """
    marked = pages.withColumn("_stops", stops)
    cut = (
        marked.groupBy(*PAGE_KEY)
        .agg(F.min(F.when(F.col("_stops"), F.col("page_no"))).alias("_last"), F.max("page_no").alias("_max"))
        .filter(F.col("_max") > F.col("_last"))
        .select(*[F.col(c).alias(f"_{c}") for c in PAGE_KEY], "_last")
    )
    return pages.join(broadcast_if_small(cut), _same(PAGE_KEY) & (F.col("page_no") > F.col("_last")), "left_anti")


def _same(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])


def page_cap(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """The pages a paging client would have read: at most `max_pages`, none after one without a next cursor."""
    return _until(pages.filter(F.col("page_no") < max_pages), ~next_cursor(pages))


def page_take_while(pages: DataFrame, yields: Column) -> DataFrame:
    """Pages up to and including the first that yields no accepted post. `yields` is tested on the page itself."""
    return _until(pages, ~yields)


def validate_posts(posts: DataFrame) -> DataFrame:
    """Add `is_valid`: a known source and no required field missing."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in REQUIRED_POST_FIELDS])
    return posts.withColumn("is_valid", present & F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)))


def quarantine(raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    """Everything refused, with the reason: whole pages (no place) and items (with their place).

    A page is refused if it is unreadable, of a source without parser, or of a kind its source does not have. Items are posts
    and the comments of every thread; those of a thread have its `post_id`.
    """
    kind = F.coalesce(F.col("kind"), F.lit("search"))
    own = lambda source: F.col("source") == source
    forms = [
        (own("x"), X_PAGE, x.candidates),
        (own("reddit") & (kind == "search"), REDDIT_LISTING, reddit.post_candidates),
        (own("reddit") & (kind == "comments"), REDDIT_THREAD, reddit.comment_candidates),
        (own("stocktwits"), STOCKTWITS_STREAM, stocktwits.candidates),
    ]
    known = F.coalesce(F.col("source").isin(*PARSERS), F.lit(False))
    refused = F.when(~known, "unknown_source").when(own("reddit") & ~kind.isin("search", "comments"), "unknown_kind")
    where = ["source", "symbol", "page_no"]
    whole = lambda pages, reason: pages.select(
        *where, "post_id", F.lit(None).cast("int").alias("pos"), reason.alias("reason"))
    parts = [whole(raw.filter(refused.isNotNull()), refused)]
    for mine, schema, candidates in forms:
        pages = raw.filter(mine)
        parts.append(whole(bad_pages(pages, schema), F.lit("bad_json")))
        post_id = F.col("reply_to_id") if schema is REDDIT_THREAD else F.lit(None).cast("string")
        parts.append(candidates(pages, as_of, since).filter(F.col("reason").isNotNull()).select(
            *where, post_id.alias("post_id"), "pos", "reason"))
    return union_posts(*parts)
