"""The registered queries: every operator over the given tables.

Each takes a session and a folder of tables and returns a flat frame: whole numbers as long, fractions rounded to six
places, times and lists as text, so that results can be compared by value with those of another engine.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.constants import SOURCES
from marketpulse.functions import scoring, text, vectors, windows
from marketpulse.operators import aggregate, mentions, merge, models, resolve, similarity, trends
from marketpulse.plans import views as v
from marketpulse.plans.report import report_from_store, report_json, sentiment_report
from marketpulse.schemas import POST_KEY
from marketpulse.session import configure, materialize, scratch_path
from marketpulse.sources import landed, outcomes, reddit, stocktwits, x
from marketpulse.sources.parsing import literal_time
from marketpulse.sources.timestamps import stocktwits_created_at, x_created_at
from marketpulse.store import answers, cache, colocated, cube, log, search
from marketpulse.store import vectors as stored_vectors
from marketpulse.store.tables import COUNTS
from marketpulse.streaming import first, ingest, rolling

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

DIM = 64


# Already rounded, to nine places; rounding again would turn many values into ties.
ROUNDED = ("score",)


def flat(df: DataFrame) -> DataFrame:
    """Plain columns for comparison by value."""
    out = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.FloatType, T.DoubleType)) and field.name not in ROUNDED:
            column = F.round(column.cast("double"), 6)
        elif isinstance(kind, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), ",")
        out.append(column.alias(field.name))
    return df.select(*out)


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(function(configure(spark), sf_dir))

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    REGISTRY[function.__name__] = run
    return run


# ---- inputs shared by several queries ------------------------------------------------------------------------------

def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return aggregate.clean(v.collected(spark, sf))


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf).filter(F.col("outcome") == "processed")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Stored posts with scores; some scores are missing, and all of one source for one symbol."""
    df = aggregate.scored(_stored(spark, sf))
    lost = (F.col("doc_id") % 23 == 0) | ((F.col("symbol") == "MSFT") & (F.col("source") == "reddit"))
    return df.withColumn("polarity", F.when(~lost, F.col("polarity")))


def _landed_posts(spark: SparkSession, sf: str) -> DataFrame:
    return landed.collect_posts(v.landed_pages(spark, sf), v.AS_OF)


def _of(pages: DataFrame, source: str) -> DataFrame:
    return pages.filter(F.col("source") == source)


_POST = ("platform_id", "author_id", "author_handle", "created_at", "lang", "like_count", "permalink")


# ---- sources -------------------------------------------------------------------------------------------------------

@query
def x_parse(spark, sf):
    posts = x.posts(_of(v.landed_pages(spark, sf), "x"), v.AS_OF)
    return posts.select("symbol", *_POST, "text", "reply_count", "repost_count", "follower_count")


@query
def x_author_join(spark, sf):
    """Author lookup across pages, against a table of accounts."""
    posts = v.posts(spark, sf).filter(F.col("source") == "x").select("platform_id", "author_id")
    users = v.posts(spark, sf).filter(~F.col("author_id").endswith("3")).groupBy(F.col("author_id").alias("id")).agg(
        F.max("follower_count").alias("followers_count")).withColumn("username", F.concat(F.lit("h_"), "id"))
    return x.with_authors(posts, users)


@query
def reddit_post_parse(spark, sf):
    posts = reddit.posts(_of(v.landed_pages(spark, sf), "reddit"), v.AS_OF)
    return posts.select("symbol", *_POST, "text", "reply_count")


@query
def reddit_comment_parse(spark, sf):
    comments = reddit.comments(v.threads(spark, sf), v.AS_OF, v.WEEK_AGO)
    return comments.select(*_POST, "text", "reply_to_id")


@query
def reddit_thread_comments(spark, sf):
    submissions = reddit.posts(v.thread_submissions(spark, sf), v.AS_OF, v.WEEK_AGO)
    found = reddit.thread_comments(v.threads(spark, sf), submissions, v.AS_OF, v.WEEK_AGO)
    return found.select("platform_id", "reply_to_id", "author_id", "created_at")


@query
def stocktwits_parse(spark, sf):
    posts = stocktwits.posts(_of(v.landed_pages(spark, sf), "stocktwits"), v.AS_OF)
    return posts.select("symbol", *_POST, "text", "follower_count")


@query
def parse_created_at(spark, sf):
    """Six ways of writing an event's time, read by the rules of both platforms."""
    ts = F.col("ts").cast("timestamp")
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'",
             "yyyy-MM-dd'T'HH:mm:ss'+05:30'", "yyyy/MM/dd")
    written = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        written = F.when(F.col("event_id") % 6 == i, F.date_format(ts, form)).otherwise(written)
    events = v.table(spark, sf, "events").select("event_id", written.alias("written"))
    now = literal_time(v.AS_OF)
    return events.select(
        "event_id",
        F.unix_micros(x_created_at(F.col("written"), now)).alias("x_micros"),
        F.unix_micros(stocktwits_created_at(F.col("written"), now)).alias("stocktwits_micros"))


@query
def page_cap(spark, sf):
    return landed.page_cap(v.landed_pages(spark, sf)).select("source", "symbol", "page_no")


@query
def page_take_while(spark, sf):
    pages = _of(v.landed_pages(spark, sf), "stocktwits")
    return landed.page_take_while(pages, stocktwits.page_yields(v.AS_OF, v.WEEK_AGO)).select("symbol", "page_no")


@query
def search_terms(spark, sf):
    """Search terms of every instrument asked for."""
    resolved = resolve.resolve_symbols(v.queries(spark, sf)).select("o_orderkey", "instrument.*")
    return mentions.search_terms(resolved.select("symbol", "company_name").distinct())


@query
def search_match(spark, sf):
    return mentions.search_match(v.posts(spark, sf), v.instruments(spark, sf), v.AS_OF)


def _text_index(spark: SparkSession, sf: str) -> search.TextIndex:
    """Postings of all posts, in two runs as two batches would leave them."""
    path, posts = scratch_path(spark, "postings"), v.posts(spark, sf)
    for run in (0, 1):
        index = search.add(posts.filter(F.col("doc_id") % 2 == run), path, f"run={run}_{run}")
    return index


@query
def search_match_indexed(spark, sf):
    """The same searches by the stored index of text pieces."""
    posts = v.posts(spark, sf)
    return mentions.search_match(posts, v.instruments(spark, sf), v.AS_OF, find=search.finder(_text_index(spark, sf)))


@query
def mention_join_indexed(spark, sf):
    return mentions.mention_join(v.posts(spark, sf), v.instruments(spark, sf), find=search.finder(_text_index(spark, sf)))


@query
def dedupe_keep_first(spark, sf):
    """Posts delivered by several terms: the first term counts."""
    copies = v.posts(spark, sf).withColumn("term_no", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 3).cast("int"))))
    copies = copies.withColumn("term_no", F.lit(3) - F.col("term_no")).withColumn(
        "text", F.concat(F.col("term_no").cast("string"), F.lit(":"), "text"))
    return landed.dedupe_keep_first(copies, "source", "platform_id").select("source", "platform_id", "term_no", "text")


@query
def union_sources(spark, sf):
    return _landed_posts(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("reply_count").alias("n_replies"), F.count("repost_count").alias("n_reposts"),
        F.count("follower_count").alias("n_followers"), F.sum(F.length("text")).alias("chars"))


@query
def validate_posts(spark, sf):
    d = F.col("doc_id")
    posts = v.posts(spark, sf).withColumn("source", F.when(d % 10 == 0, "myspace").otherwise(F.col("source")))
    posts = posts.withColumn("text", F.when(d % 21 != 0, F.col("text")))
    return landed.validate_posts(posts).select("doc_id", "is_valid")


@query
def quarantine(spark, sf):
    """Over searches and threads; some threads are cut off, some of a source that nothing can parse."""
    thread = F.col("post_id").cast("bigint")
    threads = v.threads(spark, sf).withColumn("source", F.when(thread % 19 == 4, "forum").otherwise("reddit")).withColumn(
        "body", F.when(thread % 17 == 3, F.expr("left(body, length(body) - 3)")).otherwise(F.col("body")))
    pages = v.landed_pages(spark, sf).unionByName(threads)
    return landed.quarantine(pages, v.AS_OF, v.WEEK_AGO).groupBy("source", "symbol", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def dead_letters_replay(spark, sf):
    """What comes of all pages in one parse; then the cut-off ones are replayed whole."""
    path = scratch_path(spark, "outcomes")
    outcomes.create(spark, path)
    outcomes.write_outcomes(v.landed_pages(spark, sf), path, 0, v.AS_OF, v.WEEK_AGO)
    outcomes.replay(v.landed_pages(spark, sf, whole=True), path, 1, v.AS_OF, v.WEEK_AGO)
    posts = outcomes.accepted_posts(spark, path).select("source", "symbol", F.lit(outcomes.POST).alias("tag"), F.lit("").alias("reason"))
    items = outcomes.read_outcomes(spark, path).filter(F.col("tag") == outcomes.ITEM).select("source", "symbol", "tag", "reason")
    pages = outcomes.dead_letters(spark, path).select("source", "symbol", F.lit(outcomes.PAGE).alias("tag"), "reason")
    return posts.unionByName(items).unionByName(pages).groupBy("source", "symbol", "tag", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def scan_landed(spark, sf):
    """Land the responses as JSON lines, scan them again, and count their posts."""
    path = scratch_path(spark, "landed")
    landed.write_landed(v.landed_pages(spark, sf), path)
    posts = landed.collect_posts(landed.scan_landed(spark, path), v.AS_OF)
    return posts.groupBy("source", "symbol").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query
def since_filter(spark, sf):
    since = v.WEEK_AGO + dt.timedelta(milliseconds=500)
    return landed.since_filter(v.posts(spark, sf), since).select("source", "platform_id", "created_at")


@query
def permalinks(spark, sf):
    return _landed_posts(spark, sf).select("source", "platform_id", "permalink")


# ---- cleaning and filters ------------------------------------------------------------------------------------------

@query
def normalize_text(spark, sf):
    pages = v.table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.concat("url", F.lit("\t"), "html").alias("text"))
    posts = v.posts(spark, sf).select(F.concat(F.lit("d"), "platform_id").alias("id"), "text")
    return posts.unionByName(pages).select("id", text.normalize_text(F.col("text")).alias("text"))


@query
def cashtags(spark, sf):
    return v.posts(spark, sf).select("doc_id", F.array_sort(text.cashtags(F.col("text"))).alias("tags"))


@query
def symbol_mention(spark, sf):
    return v.collected(spark, sf).select("doc_id", text.symbol_mention(F.upper("text"), F.col("symbol")).alias("hit"))


@query
def company_mention(spark, sf):
    return v.collected(spark, sf).select("doc_id", text.company_mention(F.upper("text"), F.col("company_name")).alias("hit"))


@query
def extract_symbols(spark, sf):
    return _cleaned(spark, sf).select("doc_id", "symbols")


@query
def has_symbols(spark, sf):
    return _cleaned(spark, sf).filter(text.has_symbols(F.col("symbols"))).select("doc_id")


@query
def bot_short(spark, sf):
    return _cleaned(spark, sf).filter(text.is_short(F.col("text"), F.col("symbols"))).select("doc_id", "text")


@query
def bot_dollar(spark, sf):
    return _cleaned(spark, sf).filter(text.has_many_dollars(F.col("text"))).select(
        "doc_id", text.dollar_signs(F.col("text")).alias("dollars"))


@query
def drop_bots(spark, sf):
    return _cleaned(spark, sf).filter(~text.is_probable_bot(F.col("text"), F.col("symbols"))).select("doc_id")


@query
def parse_window(spark, sf):
    return resolve.with_window(v.requests(spark, sf)).select("o_orderkey", "window", "hours")


@query
def validate_requests(spark, sf):
    return resolve.validate_requests(v.requests(spark, sf)).select("o_orderkey", "symbol", "window", "reason", "query")


@query
def posts_for_symbol(spark, sf):
    return aggregate.posts_for_symbol(_stored(spark, sf), "NVDA", v.WEEK_AGO).select("source", "platform_id", "created_at")


# ---- scores --------------------------------------------------------------------------------------------------------

_SCORES = ("polarity", "subjectivity", "sarcasm_prob", "confidence", "model")


@query
def score_empty(spark, sf):
    """Documents where some texts are missing or blank."""
    d = F.col("doc_id")
    blanked = F.when(d % 5 == 0, F.lit(None)).when(d % 5 == 1, F.lit(" \t\n ")).otherwise(F.col("text"))
    df = v.documents(spark, sf).select("doc_id", blanked.alias("text"))
    return scoring.score_posts(df).select("doc_id", *[f"score.{c}" for c in _SCORES])


@query
def lexicon_hits(spark, sf):
    return scoring.with_features(v.posts(spark, sf)).select(
        "doc_id", F.col("_positive").alias("positive"), F.col("_negative").alias("negative"))


@query
def score_heuristic(spark, sf):
    hits = scoring.with_features(v.posts(spark, sf))
    score = scoring.heuristic_score(F.col("_positive"), F.col("_negative"), F.col("_sarcasm"))
    scored = hits.select("doc_id", score.alias("s"))
    return scored.select("doc_id", "s.polarity", "s.subjectivity", "s.confidence", "s.model")


@query
def sarcasm(spark, sf):
    return scoring.with_features(v.posts(spark, sf)).select("doc_id", F.col("_sarcasm").alias("sarcasm_prob"))


@query
def logits_to_score(spark, sf):
    """The first two places of each vector as logits."""
    df = v.vectors(spark, sf).select(
        "vec_id", (F.col("vector")[0].cast("double") * 4).alias("neg"), (F.col("vector")[1].cast("double") * 4).alias("pos"))
    scored = df.select("vec_id", scoring.score_from_logits(F.col("neg"), F.col("pos"), F.lit(0.05)).alias("s"))
    return scored.select("vec_id", *[f"s.{c}" for c in _SCORES])


def letter_model():
    """A stand-in model: logits from letter counts. Fails on texts that hold "$A $B"."""
    def model(texts: list[str]) -> np.ndarray:
        if any("$A $B" in t for t in texts):
            raise ValueError("cannot read this text")
        return np.array([[t.count("a") / 10.0, t.count("e") / 10.0] for t in texts])

    return model


@query
def score_model(spark, sf):
    posts = v.posts(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).otherwise(F.lit(" ")).alias("text"))
    scored = models.score_with_model(posts, letter_model, name="letters")
    return scored.select("doc_id", "score.*")


@query
def score_text(spark, sf):
    return aggregate.scored(_cleaned(spark, sf)).select("doc_id", *_SCORES)


# ---- vectors -------------------------------------------------------------------------------------------------------

def letter_vectors():
    """A stand-in embedder: counts of eight letters. Fails on texts that hold "$A $B"."""
    def model(texts: list[str]) -> np.ndarray:
        if any("$A $B" in t for t in texts):
            raise ValueError("cannot read this text")
        return np.array([[float(t.count(c)) for c in "aeinorst"] for t in texts])

    return model


def _spread(df: DataFrame, key: str, vector: str) -> DataFrame:
    """What identifies a vector: its length, a sum weighted by place, its first and last number."""
    values = F.col(vector).cast("array<double>")
    places = F.sequence(F.lit(1), F.size(values))
    checksum = F.aggregate(F.zip_with(places, values, lambda i, x: i * x), F.lit(0.0), lambda a, b: a + b)
    return df.select(key, F.size(values).alias("dim"), checksum.alias("checksum"), values[0].alias("first"),
                     F.element_at(values, -1).alias("last"))


@query
def embed_model(spark, sf):
    return _spread(models.embed_with_model(v.posts(spark, sf).select("doc_id", "text"), letter_vectors, dim=8), "doc_id", "emb")


@query
def embed_hash(spark, sf):
    embedded = v.posts(spark, sf).select("doc_id", vectors.hash_embedding(F.col("text")).alias("emb"))
    return _spread(embedded, "doc_id", "emb")


@query
def l2_normalize(spark, sf):
    df = v.vectors(spark, sf).select("vec_id", vectors.l2_normalize(F.col("vector")).alias("unit"))
    return df.select("vec_id", F.posexplode("unit").alias("place", "x"))


@query
def cosine_topk(spark, sf):
    return similarity.cosine_topk(v.source_queries(spark, sf), v.vectors(spark, sf), 10)


def _ivf(spark: SparkSession, sf: str, centroids: DataFrame, probes: int) -> DataFrame:
    index = materialize(similarity.assign_lists(v.vectors(spark, sf), centroids), "lists", partition_by="list_id")
    return similarity.ivf_topk(materialize(v.source_queries(spark, sf), "queries"), index, centroids, k=10, probes=probes)


@query
def ivf_topk(spark, sf):
    """Lists around the label means, three probed."""
    return _ivf(spark, sf, v.label_centroids(spark, sf), 3)


@query
def ivf_topk_kmeans(spark, sf):
    """Lists from k-means, four of sixteen probed."""
    return _ivf(spark, sf, similarity.train_lists(v.vectors(spark, sf), 16), 4)


@query
def ivf_exact(spark, sf):
    """Sixteen lists from k-means, looked into until the radii exclude the rest."""
    centroids = materialize(similarity.train_lists(v.vectors(spark, sf), 16), "centroids")
    index = materialize(similarity.assign_lists(v.vectors(spark, sf), centroids), "lists", partition_by="list_id")
    lists = materialize(similarity.list_radii(index, centroids), "radii")
    return similarity.ivf_exact(materialize(v.source_queries(spark, sf), "queries"), index, lists, k=10).found


# ---- resolution ----------------------------------------------------------------------------------------------------

@query
def resolve_normalize(spark, sf):
    return v.queries(spark, sf).select("o_orderkey", resolve.normalize_query(F.col("query")).alias("normalized"))


@query
def resolve_symbols(spark, sf):
    return resolve.resolve_symbols(v.queries(spark, sf)).select("o_orderkey", "query", "instrument.symbol", "instrument.company_name")


@query
def resolve_cached(spark, sf):
    resolved = resolve.resolve_symbols(v.queries(spark, sf), v.resolver_cache(spark, sf), v.AS_OF)
    return resolved.select("o_orderkey", "query", "cache_hit", "instrument.symbol", "instrument.company_name")


@query
def resolver_cache_stored(spark, sf):
    """The stored cache after the requests were resolved with it twice: the second time, what was missed is found."""
    path = scratch_path(spark, "resolver-cache")
    cache.write_cache(v.resolver_cache(spark, sf), path)
    for _ in range(2):
        resolved = cache.resolve_and_remember(v.queries(spark, sf), path, v.AS_OF)
    stored = cache.read_cache(spark, path)
    hits = resolved.groupBy(F.upper("query").alias("query")).agg(F.bool_and("cache_hit").alias("hit"))
    return stored.join(hits, "query", "left").select("query", "symbol", "company_name", "cached_at", "hit")


@query
def resolver_cache_update(spark, sf):
    return resolve.updated_cache(v.resolver_cache(spark, sf), v.queries(spark, sf), v.AS_OF).select(
        "query", "symbol", "company_name", "cached_at")


# ---- joins ---------------------------------------------------------------------------------------------------------

def _sentiment(spark: SparkSession, sf: str) -> DataFrame:
    """Stored scores: of all documents, stored or not, but for one in nine that was never scored."""
    scored = aggregate.scored(_cleaned(spark, sf).filter(F.col("doc_id") % 9 != 0))
    return scored.select("doc_id", *merge.POST_KEY, *_SCORES)


@query
def posts_sentiment_join(spark, sf):
    scores = _sentiment(spark, sf).drop("doc_id")
    return aggregate.with_scores(_stored(spark, sf), scores).select("doc_id", *_SCORES)


@query
def posts_sentiment_bucketed(spark, sf):
    """The same join between tables bucketed by the post's key: no row of either is moved."""
    root = scratch_path(spark, "bucketed")
    name = "marketpulse_" + root.rsplit("-", 1)[1]
    parts = {"posts": _stored(spark, sf), "scores": _sentiment(spark, sf).drop("doc_id")}
    for part, rows in parts.items():
        colocated.save_bucketed(rows, f"{name}_{part}", f"{root}/{part}", 8)
    return colocated.joined(spark.table(f"{name}_posts"), spark.table(f"{name}_scores")).select("doc_id", *_SCORES)


@query
def mention_join(spark, sf):
    return mentions.mention_join(v.posts(spark, sf), v.instruments(spark, sf))


@query
def enrich_trends(spark, sf):
    reports = aggregate.weighted_sentiment(aggregate.sentiment_by_source(_scored(spark, sf)))
    rich = trends.enrich_trends(reports, _trends(spark, sf))
    return rich.select("symbol", "count", F.size("search_interest.interest_over_time").alias("days"),
                       F.col("search_interest.related_queries").alias("related"))


@query
def cascade_cleanup(spark, sf):
    return merge.only_with_post(_sentiment(spark, sf), _stored(spark, sf)).select("source", "platform_id", "model")


# ---- aggregates ----------------------------------------------------------------------------------------------------

def _recent(spark: SparkSession, sf: str) -> DataFrame:
    return landed.since_filter(_scored(spark, sf), v.WEEK_AGO)


@query
def sentiment_by_source(spark, sf):
    return aggregate.sentiment_by_source(_recent(spark, sf))


@query
def weighted_sentiment(spark, sf):
    return aggregate.weighted_sentiment(aggregate.sentiment_by_source(_recent(spark, sf)))


@query
def stored_sources_map(spark, sf):
    by_source = aggregate.sentiment_by_source(_recent(spark, sf))
    return aggregate.sources_map(by_source).select("symbol", F.explode("sources").alias("source", "n"))


@query
def source_counts(spark, sf):
    posts = _landed_posts(spark, sf).filter((F.col("symbol") != "META") | (F.col("source") != "x"))
    return aggregate.source_counts(posts)


@query
def filter_stats(spark, sf):
    return aggregate.filter_stats(_cleaned(spark, sf), "symbol")


@query
def avg_scores(spark, sf):
    return aggregate.avg_scores(_recent(spark, sf))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return trends.recent_points(v.trend_points(spark, sf), v.AS_OF)


def _trends(spark: SparkSession, sf: str) -> DataFrame:
    return trends.trends_record(_points(spark, sf), v.trend_related(spark, sf), v.trend_regions(spark, sf), v.AS_OF)


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every accepted request, resolved once with the stored cache: a report looks at the requests twice."""
    asked = resolve.validate_requests(v.requests(spark, sf)).filter(F.col("reason").isNull())
    asked = resolve.with_window(asked.select("o_orderkey", "query", "window"))
    path = scratch_path(spark, "resolver-cache")
    cache.write_cache(v.resolver_cache(spark, sf), path)
    return cache.resolve_and_remember(asked, path, v.AS_OF)


def _report(spark: SparkSession, sf: str, dry_run: bool = False) -> DataFrame:
    """All accepted requests against the landed pages."""
    # The posts are looked at twice, as collected and as stored, so they are written once, as an ingesting job would.
    cleaned = materialize(aggregate.clean(_landed_posts(spark, sf)), "cleaned")
    # A post that was landed for several instruments is stored once, as first written.
    stored = landed.dedupe_keep_first(cleaned.filter(F.col("outcome") == "processed"), *POST_KEY)
    stored = aggregate.scored(stored)
    return sentiment_report(_asked(spark, sf), cleaned, stored, _trends(spark, sf), v.AS_OF, dry_run)


def _report_rows(report: DataFrame) -> DataFrame:
    return report.select(
        "o_orderkey", "query", "window", "symbol", "window_since", "count", "weighted_sentiment", "instrument.company_name",
        "posts_found", "posts_processed", "sources.*", F.size("search_interest.interest_over_time").alias("trend_days"),
        "filter_stats.no_symbols", "filter_stats.probable_bots", "error")


@query
def sentiment_report_rows(spark, sf):
    return _report_rows(_report(spark, sf))


REGISTRY["sentiment_report"] = REGISTRY.pop("sentiment_report_rows")


@query
def report_from_store_rows(spark, sf):
    """Ingest the landed pages as a stream, twice (the second time nothing is new), and answer from the stored cube."""
    root = scratch_path(spark, "store")
    pages = materialize(v.landed_pages(spark, sf), "landed")
    for i in range(2):
        pages.write.mode("append").json(f"{root}/landed/delivery={i}")
        ingest.start_ingest(spark, f"{root}/landed/*", f"{root}/store", f"{root}/checkpoint", v.AS_OF, buckets=8).awaitTermination()
    return _report_rows(report_from_store(_asked(spark, sf), f"{root}/store", _trends(spark, sf), v.AS_OF))


REGISTRY["report_from_store"] = REGISTRY.pop("report_from_store_rows")


@query
def report_status(spark, sf):
    return _report(spark, sf).groupBy("error").agg(
        F.count(F.lit(1)).alias("n"), F.count("filter_stats").alias("with_stats"), F.count("search_interest").alias("with_trends"))


@query
def report_dry_run(spark, sf):
    return _report(spark, sf, dry_run=True).select(
        "o_orderkey", "query", "window", "symbol", "avg_polarity", "avg_subjectivity", "avg_confidence", "total_posts", "posts_found", "dry_run")


@query
def report_json_rows(spark, sf):
    # The body is parsed once for all fields that are shown, and once more for the names of all.
    shown = ("symbol string, posts_found long, weighted_sentiment double, sources struct<reddit:long>, "
             "resolved_instrument struct<company_name:string>, error string")
    read = report_json(_report(spark, sf)).select(
        "o_orderkey", "query", "window", F.from_json("body", shown).alias("b"), F.json_object_keys("body").alias("fields"))
    return read.select(
        "o_orderkey", "query", "window", "b.symbol", "b.posts_found", "b.sources.reddit", "b.weighted_sentiment", "b.error",
        "b.resolved_instrument.company_name", F.array_join(F.array_sort("fields"), ",").alias("fields"))


REGISTRY["report_json"] = REGISTRY.pop("report_json_rows")


_BODY = ("symbol string, window_since string, count long, weighted_sentiment double, posts_found long, posts_processed long, "
         "sources struct<x:long,reddit:long,stocktwits:long>, search_interest struct<interest_over_time:map<string,double>>, "
         "resolved_instrument struct<symbol:string,cik:string,isin:string,figi:string,company_name:string>, "
         "filter_stats struct<total_input:long,no_symbols:long,probable_bots:long,processed:long>, error string")


@query
def answers_sink(spark, sf):
    """Answers written as JSON lines, two runs of which the second is repeated, and read back whole."""
    path = scratch_path(spark, "answers")
    bodies = materialize(report_json(_report(spark, sf)), "bodies")
    half = F.col("o_orderkey") % 2
    for run, part in (("even", bodies.filter(half == 0)), ("odd", bodies.limit(5)), ("odd", bodies.filter(half == 1))):
        answers.write_answers(part, path, run)
    read = answers.read_answers(spark, path, "o_orderkey long, query string, window string, body string")
    body = read.select("o_orderkey", "run", "window", F.from_json("body", _BODY).alias("b"))
    return body.select(
        "o_orderkey", "run", "window", "b.symbol", "b.window_since", "b.count", "b.weighted_sentiment", "b.posts_found", "b.posts_processed",
        "b.sources.*", F.size("b.search_interest.interest_over_time").alias("trend_days"), "b.resolved_instrument.company_name",
        F.col("b.resolved_instrument.symbol").alias("instrument"), "b.filter_stats.total_input", "b.filter_stats.no_symbols", "b.filter_stats.probable_bots",
        F.col("b.filter_stats.processed").alias("passed"), "b.error")


# ---- search trends -------------------------------------------------------------------------------------------------

@query
def interest_over_time(spark, sf):
    return trends.interest_over_time(_points(spark, sf)).select("symbol", F.explode("interest_over_time").alias("date", "value"))


@query
def trend_series_pick(spark, sf):
    return trends.pick_series(_points(spark, sf))


@query
def related_queries(spark, sf):
    return trends.related_queries(v.trend_related(spark, sf))


@query
def top_regions(spark, sf):
    return trends.ranked_regions(v.trend_regions(spark, sf))


@query
def trends_record(spark, sf):
    return _trends(spark, sf).select(
        "symbol", F.size("interest_over_time").alias("days"), "related_queries",
        F.size("interest_by_region").alias("regions"), "fetched_at")


# ---- sinks and merges ----------------------------------------------------------------------------------------------

def _deliveries(spark: SparkSession, sf: str, batch: int) -> DataFrame:
    """All posts first; then every fifth again, changed and later, among them every tenth twice and some new ones."""
    d = F.col("doc_id")
    posts = v.posts(spark, sf).select("doc_id", "source", "platform_id", "text", "like_count").withColumn("seq", F.lit(0))
    first = literal_time(v.AS_OF)
    if batch == 1:
        return posts.filter(d % 50 != 0).withColumn("ingested_at", first)
    again = posts.filter(d % 5 == 0).withColumn(
        "seq", F.explode(F.when(d % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return again.withColumn("text", F.concat(F.lit("changed "), F.col("seq").cast("string"))).withColumn(
        "like_count", F.col("like_count") + 100 * F.col("seq")).withColumn(
        "ingested_at", first + F.make_dt_interval(hours=F.col("seq")))


@query
def upsert_posts(spark, sf):
    stored = merge.merge_posts(None, _deliveries(spark, sf, 1), F.col("seq"), drop=("seq",))
    return merge.merge_posts(stored, _deliveries(spark, sf, 2), F.col("seq"), drop=("seq",)).select(
        "source", "platform_id", "text", "like_count", "ingested_at")


@query
def upsert_sentiment(spark, sf):
    scores = [
        aggregate.scored(_deliveries(spark, sf, batch)).select("source", "platform_id", "seq", *_SCORES) for batch in (1, 2)]
    stored = merge.merge_latest(None, scores[0], merge.POST_KEY, F.col("seq"), drop=("seq",))
    return merge.merge_latest(stored, scores[1], merge.POST_KEY, F.col("seq"), drop=("seq",))


@query
def upsert_embeddings(spark, sf):
    """The stored vectors; then those of labels 0 to 4 again, reversed."""
    stored = v.vectors(spark, sf).select(F.lit("x").alias("source"), F.col("vec_id").cast("string").alias("platform_id"),
                                         F.col("vector").alias("emb"), "label")
    again = stored.filter(F.col("label") < 5).withColumn("emb", F.reverse("emb")).withColumn("seq", F.lit(1))
    merged = merge.merge_latest(stored, again, merge.POST_KEY, F.col("seq"), drop=("seq",))
    return _spread(merged, "platform_id", "emb")


@query
def account_rollup(spark, sf):
    posts = v.posts(spark, sf).withColumn("author_handle", F.concat("author_id", F.lit("@"), "platform_id"))
    return merge.account_rollup(posts.withColumn("follower_count", F.col("doc_id").cast("int")))


@query
def processed_count(spark, sf):
    """Posts with score and vector; the vectors are those of the vector table, by number."""
    vectors_ = v.vectors(spark, sf).select(
        v.pick(SOURCES, F.col("vec_id")).alias("source"), F.col("vec_id").cast("string").alias("platform_id"))
    complete = merge.complete_posts(_stored(spark, sf), _sentiment(spark, sf), vectors_)
    return complete.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query
def stored_similarity(spark, sf):
    """Search among the vectors that ingestion keeps: the index is built after the first delivery and brought up to the second.

    Every fiftieth post of the first delivery is looked for, by the vector of its latest text.
    """
    root = scratch_path(spark, "vectors")
    pages = materialize(v.landed_pages(spark, sf), "landed")
    changed = pages.filter("page_no % 2 = 0").withColumn("body", F.replace("body", F.lit("bullish moon"), F.lit("crash dump sell"))).withColumn(
        "fetched_at", F.col("fetched_at") + F.make_dt_interval(hours=F.lit(1)))
    for i, delivery in enumerate((pages, changed)):
        delivery.write.json(f"{root}/landed/delivery={i}")
        ingest.start_ingest(spark, f"{root}/landed/*", f"{root}/store", f"{root}/checkpoint", v.AS_OF, buckets=8).awaitTermination()
        index = stored_vectors.update(spark, f"{root}/store") if i else stored_vectors.build(spark, f"{root}/store", 8)
    wanted = F.regexp_extract("vec_id", r"(\d+)$", 1).cast("bigint") % 50 == 1
    queries_ = materialize(index.rows.filter(wanted).select(F.col("vec_id").alias("query_id"), "vector"), "queries")
    return index.search(queries_, k=5).found


# ---- streaming -----------------------------------------------------------------------------------------------------

@query
def stream_ingest(spark, sf):
    """Land all pages, ingest; land them again an hour later with other counters and texts, ingest; read the tables.

    Posts keep their first content; score and vector are those of the changed texts.
    """
    return _stored_rows(spark, _twice_ingested(spark, sf))


def _stored_rows(spark: SparkSession, store: str) -> DataFrame:
    embedded = ingest.latest_of(spark, store, "embeddings").select(
        "source", "platform_id", F.size("emb").alias("dims"))
    return ingest.scored_store(spark, store).join(embedded, list(POST_KEY), "left").select(
        "source", "platform_id", "like_count", "ingested_at", "symbols", "polarity", "model", "dims")


def _twice_ingested(spark: SparkSession, sf: str, **options) -> str:
    """The store after two deliveries of all pages, the second one changed."""
    root = scratch_path(spark, "stream")
    pages = materialize(v.landed_pages(spark, sf), "landed")
    hour = F.make_dt_interval(hours=F.lit(1))
    body = F.regexp_replace("body", r'"(like_count|ups|total)":\d+', r'"$1":9999')
    again = pages.withColumn("fetched_at", F.col("fetched_at") + hour).withColumn(
        "body", F.replace(body, F.lit("bullish moon"), F.lit("crash dump sell")))
    for i, delivery in enumerate((pages, again)):
        delivery.write.mode("append").json(f"{root}/landed/delivery={i}")
        ingest.start_ingest(
            spark, f"{root}/landed/*", f"{root}/store", f"{root}/checkpoint", v.AS_OF, buckets=8, **options).awaitTermination()
    return f"{root}/store"


@query
def stream_compacted(spark, sf):
    """The same store when every two runs are put together, so that all rows have been rewritten."""
    return _stored_rows(spark, _twice_ingested(spark, sf, fan_in=2))


@query
def sentiment_cube(spark, sf):
    """The cube after both deliveries: the second one has taken back the scores of the first."""
    cells = cube.cells(log.snapshot(spark, _twice_ingested(spark, sf, embed=False)))
    return cells.select("symbol", "source", "hour", *COUNTS, F.col("sum_polarity").cast("double").alias("sum_polarity"))


@query
def progress_ledger(spark, sf):
    """A scorer that leaves out every fifth post, then one that does not: how far the posts are after either delivery."""
    root = scratch_path(spark, "ledger")
    pages = materialize(v.landed_pages(spark, sf), "landed")
    fifth = F.crc32("platform_id") % 5 == 0
    parts = []
    for i, scorer in enumerate((lambda posts: aggregate.scored(posts.filter(~fifth)), aggregate.scored)):
        pages.filter(F.col("page_no") % 2 == i).write.json(f"{root}/landed/delivery={i}")
        ingest.start_ingest(spark, f"{root}/landed/*", f"{root}/store", f"{root}/checkpoint", v.AS_OF, embed=False,
                            scorer=scorer, buckets=8).awaitTermination()
        counted = ingest.ledger(spark, f"{root}/store").groupBy("source").agg(
            F.count(F.lit(1)).alias("stored"), F.count_if("scored").alias("scored"), F.count("reason").alias("failed"))
        parts.append(materialize(counted.withColumn("delivery", F.lit(i)), "progress"))
    return parts[0].unionByName(parts[1])


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = v.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


@query
def stream_dedupe(spark, sf):
    """Posts delivered twice in one stream."""
    root = scratch_path(spark, "dedupe")
    posts = v.post_columns(_stream(spark, sf, "documents")).select("source", "platform_id", "created_at")
    twice = posts.unionByName(posts)
    rolling.write_available(rolling.dedupe_stream(twice, "60 days"), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(posts.schema).parquet(f"{root}/out")


@query
def stream_keep_first(spark, sf):
    """The copies of `dedupe_keep_first` as a stream, last terms first: what counts is the place, not the arrival."""
    root = scratch_path(spark, "first")
    d = F.col("doc_id")
    copies = v.posts(spark, sf).withColumn("term_no", F.explode(F.sequence(F.lit(0), (d % 3).cast("int"))))
    copies = copies.withColumn("term_no", F.lit(3) - F.col("term_no")).withColumn(
        "text", F.concat(F.col("term_no").cast("string"), F.lit(":"), "text")).withColumn("fetched_at", literal_time(v.AS_OF))
    copies = copies.select("source", "platform_id", "term_no", "text", "fetched_at")
    end = copies.limit(1).select(F.lit("end").alias("source"), F.lit("").alias("platform_id"), F.lit(0).alias("term_no"), F.lit("").alias("text"),
                                 (F.col("fetched_at") + F.make_dt_interval(days=F.lit(9))).alias("fetched_at"))
    parts = [copies.filter(F.col("term_no") == term) for term in (3, 1, 2)] + [end, end]
    # A run to each delivery; the last ones only move the watermark.
    for i, part in enumerate(parts):
        part.write.parquet(f"{root}/in/delivery={i}")
        stream = spark.readStream.schema(copies.schema).parquet(f"{root}/in/*")
        kept = first.keep_first_stream(stream, "source", "platform_id")
        rolling.write_available(kept, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(copies.schema).parquet(f"{root}/out").select("source", "platform_id", "term_no", "text")


@query
def rolling_sentiment(spark, sf):
    return aggregate.rolling_sentiment(_scored(spark, sf))


@query
def rolling_sentiment_stream(spark, sf):
    """The same over a stream; windows that the watermark has not passed are still open."""
    root = scratch_path(spark, "rolling")
    posts = v.post_columns(_stream(spark, sf, "documents")).withColumnRenamed("ticker", "symbol")
    scored = aggregate.scored(aggregate.clean(posts).filter(F.col("outcome") == "processed"))
    stream = rolling.rolling_stream(scored)
    rolling.write_available(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sentiment per ticker over the last seven days, from raw text to result."""
    return REGISTRY["weighted_sentiment"](spark, sf_dir)


