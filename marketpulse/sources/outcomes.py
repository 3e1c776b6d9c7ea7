"""Everything that comes of landed pages, in one pass: posts, refused items and refused pages, kept by outcome.

Each page is parsed once, whatever its source. Refused pages are kept with their body: dead letters, which leave the list when a
corrected page of the same identity is replayed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions.binding import bind
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.schemas import (
    CORRUPT, LANDED_PAGE, REDDIT_COMMENT, REDDIT_LISTING, REDDIT_POST, REDDIT_THREAD, REQUIRED_POST_FIELDS, SOCIAL_POST,
    STOCKTWITS_MESSAGE, STOCKTWITS_STREAM, X_PAGE, X_POST, X_USER,
)
from marketpulse.sources import reddit, stocktwits, x
from marketpulse.sources.landed import PARSERS, dedupe_keep_first

POST, ITEM, PAGE = "post", "refused_item", "refused_page"
_PERMISSIVE = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
_IDENTITY = ("source", "kind", "symbol", "term_no", "page_no", "post_id", "fetched_at")
_FIELDS = [f for f in SOCIAL_POST if f.name not in ("symbols", "urls")]
_PAGE = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LANDED_PAGE)
SCHEMA = (f"{_PAGE}, page_key string, pos int, item string, reason string, "
          + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _FIELDS if f.name != "source") + ", batch bigint, tag string")


def page_key() -> Column:
    """The identity of a page: for whom, when and from where it was fetched, not what it holds."""
    return F.sha2(F.to_json(F.struct(*_IDENTITY), {"ignoreNullFields": "false"}), 256)


def _with_authors(page: Column) -> Column:
    """Posts of a page of X beside the author each names; the last entry of an id counts."""
    read = F.struct(
        F.transform(page["data"], lambda post: F.struct(post.alias("item"), F.get_json_object(post, "$.author_id").alias("author_id"))).alias("posts"),
        F.transform(page["includes"]["users"], lambda user: F.struct(user.alias("user"), F.get_json_object(user, "$.id").alias("id"))).alias("users"))
    return bind(read, lambda p: F.transform(p["posts"], lambda post: F.struct(
        post["item"].alias("item"),
        F.try_element_at(F.filter(p["users"], lambda user: user["id"] == post["author_id"]), F.lit(-1))["user"].alias("author"))))


def outcomes(raw: DataFrame, as_of: dt.datetime, since: dt.datetime | None = None) -> DataFrame:
    """One row per post, refused item and refused page, marked by `tag`, with `reason` where refused.

    A page is refused if it is unreadable, of a source without parser, or of a kind its source does not have; it keeps its
    body. An item is refused by its parser, or as `missing_field` if a required field is null; it keeps its text. Empty pages and children that are
    no comments give no row. Comments are those of every thread; `accepted_posts` keeps those of accepted submissions.
    """
    kind = F.coalesce(F.col("kind"), F.lit("search"))
    own = lambda source: F.col("source") == source
    forms = {
        "x": own("x"), "listing": own("reddit") & (kind == "search"), "thread": own("reddit") & (kind == "comments"), "stream": own("stocktwits")}
    schemas = {"x": X_PAGE, "listing": REDDIT_LISTING, "thread": REDDIT_THREAD, "stream": STOCKTWITS_STREAM}
    pages = raw.select(*LANDED_PAGE.fieldNames(), page_key().alias("page_key"), *[
        F.from_json(F.when(forms[f], F.col("body")), schemas[f], _PERMISSIVE).alias(f"_{f}") for f in forms])
    plain = lambda items: F.transform(items, lambda i: F.struct(i.alias("item"), F.lit(None).cast("string").alias("author")))
    found = {
        "x": _with_authors(F.col("_x")), "listing": plain(F.col("_listing")["data"]["children"]),
        "thread": plain(reddit.first_children(F.col("_thread"))), "stream": plain(F.col("_stream")["messages"])}
    known = F.coalesce(F.col("source").isin(*PARSERS), F.lit(False))
    refused = F.when(~known, "unknown_source").when(own("reddit") & ~kind.isin("search", "comments"), "unknown_kind")
    items = F.lit(None)
    for f, mine in forms.items():
        bad = F.col(f"_{f}").isNull() if f == "thread" else F.col(f"_{f}").isNull() | F.col(f"_{f}")[CORRUPT].isNotNull()
        refused = refused.when(mine & bad, "bad_json")
        items = F.when(mine & ~bad, found[f]).otherwise(items)
    rows = pages.select(*LANDED_PAGE.fieldNames(), "page_key", refused.alias("_refused"), F.posexplode_outer(items).alias("pos", "_found"))
    rows = rows.filter("_refused is not null or pos is not null")

    text = F.col("_found")["item"]
    read = lambda f, schema, of=text: F.from_json(F.when(forms[f], of), schema)
    rows = rows.select("*", read("x", X_POST).alias("_x"), read("x", X_USER, F.col("_found")["author"]).alias("_author"),
                       read("listing", REDDIT_POST).alias("_listing"), read("thread", REDDIT_COMMENT).alias("_thread"), read("stream", STOCKTWITS_MESSAGE).alias("_stream"))
    rows = rows.filter(~forms["thread"] | F.col("_refused").isNotNull() | (F.col("_thread")["kind"] == "t1"))
    made = {
        "x": x.item(F.col("_x"), F.col("_author"), as_of, since), "listing": reddit.post_item(F.col("_listing")["data"], as_of, since),
        "thread": reddit.comment_item(F.col("_thread")["data"], as_of, since), "stream": stocktwits.item(F.col("_stream"), as_of, since)}
    empty = F.struct(F.col("_refused").alias("reason"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in _FIELDS])
    out = F.when(F.col("_refused").isNotNull(), empty)
    for f, (reason, fields) in made.items():
        out = out.when(forms[f], F.struct(reason.alias("reason"), *[fields.get(c.name, F.lit(None)).cast(c.dataType).alias(c.name) for c in _FIELDS]))
    # Out of a generator, so that the fields are not computed once for each use.
    rows = rows.select(*LANDED_PAGE.fieldNames(), "page_key", "pos", text.alias("item"), "_refused", F.inline(F.array(out)).alias(
        "reason", *[f"_{f.name}" for f in _FIELDS]))
    present = " and ".join(f"_{c} is not null" for c in REQUIRED_POST_FIELDS)
    reason = F.coalesce("reason", F.when(~F.expr(present), "missing_field"))
    tag = F.when(F.col("_refused").isNotNull(), PAGE).when(reason.isNotNull(), ITEM).otherwise(POST)
    return rows.select(
        *[c for c in LANDED_PAGE.fieldNames() if c != "body"], F.when(tag == PAGE, F.col("body")).alias("body"), "page_key", "pos",
        F.when(tag == ITEM, F.col("item")).alias("item"), reason.alias("reason"), *[F.col(f"_{f.name}").alias(f.name) for f in _FIELDS if f.name != "source"],
        tag.alias("tag"))


def write_outcomes(raw: DataFrame, path: str, batch: int, as_of: dt.datetime, since: dt.datetime | None = None) -> None:
    """Write what comes of the pages, one folder per outcome; a repeated batch replaces its own."""
    rows = outcomes(raw, as_of, since)
    rows.write.mode("overwrite").partitionBy("tag").parquet(f"{path}/outcomes/batch={batch}")


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/outcomes")


def accepted_posts(spark: SparkSession, path: str) -> DataFrame:
    """Posts of all batches, each once per source and instrument; comments only where their submission was accepted."""
    posts = read_outcomes(spark, path).filter(F.col("tag") == POST).drop("tag", "batch", "reason", "item", "body", "page_key")
    submissions = posts.filter("source = 'reddit' and reply_to_id is null").select(
        F.regexp_replace("platform_id", "^post_", "").alias("reply_to_id")).distinct()
    comment = "source = 'reddit' and reply_to_id is not null"
    kept = posts.filter(f"not ({comment}) or reply_to_id is null").unionByName(posts.filter(comment).join(submissions, "reply_to_id", "left_semi"))
    return dedupe_keep_first(kept, "source", "symbol", "platform_id")


def dead_letters(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Refused pages that no later batch has replayed, as landed pages with page_key, reason and batch. before: as it was then."""
    refused = read_outcomes(spark, path).filter(F.col("tag") == PAGE).select(*LANDED_PAGE.fieldNames(), "page_key", "reason", "batch")
    replayed = spark.read.schema("page_key string, batch bigint").parquet(f"{path}/replayed")
    if before is not None:
        refused, replayed = refused.filter(F.col("batch") < before), replayed.filter(F.col("batch") < before)
    last = broadcast_if_small(replayed.groupBy("page_key").agg(F.max("batch").alias("_replayed")))
    return refused.join(last, "page_key", "left").filter("_replayed is null or batch >= _replayed").drop("_replayed")


def create(spark: SparkSession, path: str) -> None:
    """An empty list of replayed pages to start from."""
    spark.createDataFrame([], "page_key string").write.mode("ignore").parquet(f"{path}/replayed/batch=-1")


def replay(corrected: DataFrame, path: str, batch: int, as_of: dt.datetime, since: dt.datetime | None = None) -> None:
    """Parse corrected pages that stand for dead letters, as a batch of their own; a page that is still refused stays a dead letter.

    Pages that are no dead letters are left alone. What was replayed is written after what came of it, and a batch looks at those before it
    only: a run that is killed, or repeated, is run again with the same result.
    """
    spark = corrected.sparkSession
    waiting = broadcast_if_small(dead_letters(spark, path, batch).select("page_key").distinct())
    pages = corrected.withColumn("page_key", page_key()).join(waiting, "page_key", "left_semi")
    write_outcomes(pages.drop("page_key"), path, batch, as_of, since)
    pages.select("page_key").distinct().write.mode("overwrite").parquet(f"{path}/replayed/batch={batch}")
