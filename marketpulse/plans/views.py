"""Inputs of the registered queries, derived by Spark from the given tables over all their rows and whole texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketpulse.constants import COMPANY_TICKERS
from marketpulse.sources.parsing import literal_time

AS_OF = dt.datetime(2024, 1, 31)
WEEK_AGO = AS_OF - dt.timedelta(days=7)

TICKERS = ("AAPL", "TSLA", "MSFT", "AMZN", "GOOGL", "META", "NVDA")
COMPANIES = ("APPLE", "TESLA", "MICROSOFT", "AMAZON", "GOOGLE", "META", "NVIDIA")
CUES = (
    "bullish moon", "crash sell!!!", "yeah right, to the moon", "is flat", "undervalued strong rally", "scam?!",
)
COMMUNITIES = ("wallstreetbets", "stocks", "investing", "stockmarket", "cooking")
QUERIES = (
    "Apple", "Tesla", "MICROSOFT", "Amazon", "google", "Meta", "NVIDIA", "AAPL", "$TSLA", "BRK.B", "TOOLONGNAME",
    "msft", "$nvda$", "", "GOOGL",
)
WINDOW_UNITS = ("h", "d", "w", "x", "H", "hh")
PAGE_DOCS = 210


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents. A file with one row group is one task however many cores there are, so a table that has fewer
    partitions than cores is dealt out; one of many files, as on a cluster, is read as it is."""
    df, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return df.repartition(cores, "doc_id") if df.rdd.getNumPartitions() < cores else df


def post_columns(documents: DataFrame) -> DataFrame:
    """Posts made of documents; also used on a stream of documents."""
    d = F.col("doc_id")
    ticker, cue = pick(TICKERS, d), pick(CUES, d)
    text = (
        F.when(d % 17 == 0, F.concat(F.lit("$"), ticker))
        .when(d % 13 == 0, F.concat("text", F.lit(" $A $B $C $D $E $F ")))
        .when(d % 4 == 0, F.col("text"))
        .otherwise(F.concat(
            F.col("text"), F.lit("  $"), ticker, F.lit(" "), cue,
            F.when(d % 11 == 0, F.lit(" https://ex.com/a/s?q=1")).otherwise(F.lit(""))))
    )
    minutes = (d * 7919 % 43200) * 60 * 1_000_000
    start = F.unix_micros(literal_time(dt.datetime(2024, 1, 1)))
    return documents.select(
        "doc_id",
        pick(("x", "reddit", "stocktwits"), d).alias("source"),
        d.cast("string").alias("platform_id"),
        F.concat(F.lit("u"), (d % 97).cast("string")).alias("author_id"),
        F.timestamp_micros(start + minutes).alias("created_at"),
        ticker.alias("ticker"),
        text.alias("text"),
        "lang",
        F.when(d % 59 == 0, F.lit("1")).alias("repost_of_id"),
        pick(COMMUNITIES, d).alias("subreddit"),
        (d % 50).cast("int").alias("like_count"),
        (d % 97 * 10).cast("int").alias("follower_count"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return post_columns(documents(spark, sf_dir))


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the instrument each was collected for."""
    return posts(spark, sf_dir).withColumn("company_name", company_of(F.col("ticker"))).withColumnRenamed("ticker", "symbol")


def company_of(ticker: Column) -> Column:
    pairs = [F.lit(part) for company, symbol in COMPANY_TICKERS.items() for part in (symbol, company)]
    return F.element_at(F.create_map(*pairs), ticker)


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments named after nations, with the first four letters as symbol, and those the posts are about."""
    nations = table(spark, sf_dir, "nation").select(
        F.upper(F.substring("n_name", 1, 4)).alias("symbol"), F.col("n_name").alias("company_name"))
    about = posts(spark, sf_dir).select(F.col("ticker").alias("symbol"), company_of(F.col("ticker")).alias("company_name"))
    return nations.unionByName(about).distinct()


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per order: a name from the list, or the customer's number as a symbol."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    symbol = F.when(o % 5 == 0, F.concat(F.lit("C"), c.cast("string"))).otherwise(pick(QUERIES, o))
    window = F.when(o % 41 == 0, F.lit("invalid")).otherwise(
        F.concat((o % 40).cast("string"), pick(WINDOW_UNITS, c)))
    return table(spark, sf_dir, "orders").select("o_orderkey", symbol.alias("symbol"), window.alias("window"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("o_orderkey", F.col("symbol").alias("query"))


def resolver_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached answers for customers' symbols, aged 6 to 8 days; exactly 7 days is expired."""
    unknown = F.lit(None).cast("string")
    c = F.col("c_custkey")
    age = F.make_dt_interval(days=(c % 3 + 6).cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), c.cast("string")).alias("query"),
        F.concat(F.lit("S"), c.cast("string")).alias("symbol"),
        unknown.alias("cik"), unknown.alias("isin"), unknown.alias("figi"),
        F.col("c_name").alias("company_name"),
        (literal_time(AS_OF) - age).alias("cached_at"),
    )


def _iso(created_at: Column, form: str) -> Column:
    return F.date_format(created_at, form)


def landed_text(d: Column) -> Column:
    return F.when(d % 37 == 0, F.lit("")).otherwise(F.col("text"))


def _cursor_missing() -> Column:
    return (F.col("page_no") * 7 + F.length("ticker")) % 3 == 2


def landed_pages(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """Raw responses of the three platforms. A page holds the posts of one source and ticker among 210 documents.

    Some pages are cut off, unless they are wanted whole.
    """
    d = F.col("doc_id")
    df = posts(spark, sf_dir).withColumn("page_no", F.floor(d / PAGE_DOCS).cast("int"))
    key = ("source", "ticker", "page_no")
    iso_id = F.when(d % 31 == 0, F.lit("")).otherwise(F.col("platform_id"))
    unknown = F.lit(None).cast("string")

    x_time = (
        F.when(d % 29 == 0, F.lit("n/a"))
        .when(d % 2 == 0, _iso(F.col("created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(_iso(F.col("created_at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    )
    tweet = F.struct(
        iso_id.alias("id"), landed_text(d).alias("text"), x_time.alias("created_at"), "author_id",
        F.when(d % 7 != 3, F.col("lang")).alias("lang"),
        F.struct(F.col("like_count"), (d % 7).cast("int").alias("reply_count"),
                 (d % 11).cast("int").alias("retweet_count")).alias("public_metrics"),
    )
    user = F.when(~F.col("author_id").endswith("3"), F.struct(
        F.col("author_id").alias("id"), F.concat(F.lit("h_"), "author_id").alias("username"),
        F.struct(F.col("follower_count").alias("followers_count")).alias("public_metrics")))
    submission = F.struct(
        iso_id.alias("id"), F.concat(F.lit("T"), "platform_id").alias("title"),
        F.when(d % 41 == 0, F.lit("[removed]")).otherwise(landed_text(d)).alias("selftext"),
        F.when(d % 19 == 0, F.lit("[deleted]")).otherwise(F.col("author_id")).alias("author"),
        F.unix_seconds("created_at").cast("double").alias("created_utc"),
        F.when(d % 23 != 0, F.col("like_count")).alias("ups"), (d % 7).cast("int").alias("num_comments"),
        F.when(d % 43 == 0, F.lit("")).otherwise(F.concat(
            F.lit("/r/"), "subreddit", F.lit("/comments/"), "platform_id")).alias("permalink"),
    )
    st_time = (
        F.when(d % 29 == 0, F.lit("n/a"))
        .when(d % 2 == 0, _iso(F.col("created_at"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .otherwise(_iso(F.col("created_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    message = F.struct(
        F.when(d % 31 == 0, F.lit(0)).otherwise(d).cast("bigint").alias("id"), landed_text(d).alias("body"),
        st_time.alias("created_at"),
        F.struct(F.struct(
            F.when(d % 5 == 0, F.lit("Bullish")).when(d % 7 == 1, F.lit("bearish")).alias("basic")
        ).alias("sentiment")).alias("entities"),
        F.when(d % 23 != 0, F.struct(F.col("like_count").alias("total"))).alias("likes"),
        F.struct((d % 97).alias("id"),
                 F.when(d % 43 != 0, F.concat(F.lit("h_"), "author_id")).alias("username"),
                 F.when(d % 47 != 0, F.col("follower_count")).alias("followers")).alias("user"),
    )

    def page(source: str, item: Column, *more: Column) -> DataFrame:
        items = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda e: e["item"])
        # At most ten documents share a source, a ticker and a page.
        return df.filter(F.col("source") == source).groupBy(*key).agg(items.alias("items"), *more)

    x_body = F.to_json(F.struct(
        F.col("items").alias("data"), F.struct(F.col("users")).alias("includes"),
        F.struct(F.when(~_cursor_missing(), F.lit("t")).alias("next_token")).alias("meta")))
    reddit_body = F.to_json(F.struct(F.struct(
        F.when(~_cursor_missing(), F.lit("t3")).alias("after"),
        F.transform("items", lambda i: F.struct(i.alias("data"))).alias("children")).alias("data")))
    stream_body = F.to_json(F.struct(
        F.col("items").alias("messages"),
        F.struct(F.when(_cursor_missing(), F.lit(0)).otherwise(F.lit(5)).alias("max")).alias("cursor")))
    parts = [
        page("x", tweet, F.collect_set(user).alias("users")).select(*key, x_body.alias("body")),
        page("reddit", submission).select(*key, reddit_body.alias("body")),
        page("stocktwits", message).select(*key, stream_body.alias("body")),
    ]
    broken = (F.col("ticker") == "NVDA") & (F.col("page_no") % 3 == 1) & F.lit(not whole)
    pages = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return pages.select(
        "source", F.lit("search").alias("kind"), F.col("ticker").alias("symbol"),
        company_of(F.col("ticker")).alias("company_name"), F.col("ticker").alias("term"), F.lit(0).alias("term_no"),
        "page_no", unknown.alias("post_id"), literal_time(AS_OF).alias("fetched_at"),
        F.when(broken, F.substring(F.col("body"), F.lit(1), F.length("body") - 3)).otherwise(F.col("body")).alias("body"),
    )


def thread_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with the fields a thread needs."""
    c, t = F.col("conv_id"), F.col("turn")
    hours = ((c * 7 + t) % 240) * 3600
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.when(F.col("role") == "system", "more").otherwise("t1").alias("kind"),
        F.concat(c.cast("string"), F.lit("_"), t.cast("string")).alias("id"),
        F.when((c + t) % 13 == 0, F.lit("[removed]")).otherwise(F.col("text")).alias("body"),
        F.when((c + t) % 11 == 0, F.lit("[deleted]")).otherwise(F.concat(F.lit("a"), t.cast("string"))).alias("author"),
        (F.unix_seconds(literal_time(AS_OF)) - hours).cast("double").alias("created_utc"),
        (c % 9).cast("int").alias("ups"),
        F.concat(F.lit("/c/"), c.cast("string")).alias("permalink"),
    )


def _landed_reddit(df: DataFrame, kind: str) -> DataFrame:
    unknown = F.lit(None).cast("string")
    return df.select(
        F.lit("reddit").alias("source"), F.lit(kind).alias("kind"), unknown.alias("symbol"),
        unknown.alias("company_name"), unknown.alias("term"), F.lit(0).alias("term_no"), "page_no",
        F.col("conv_id").cast("string").alias("post_id"), literal_time(AS_OF).alias("fetched_at"), "body",
    )


def thread_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search listings with the first turn of each conversation, one submission per page."""
    first = F.struct(F.struct(
        F.col("conv_id").cast("string").alias("id"), F.lit("").alias("title"), F.col("body").alias("selftext"),
        "author", "created_utc", "ups", "permalink").alias("data"))
    body = F.to_json(F.struct(F.struct(F.array(first).alias("children")).alias("data")))
    turns = thread_turns(spark, sf_dir).filter(F.col("turn") == 0)
    return _landed_reddit(turns.select("conv_id", F.lit(0).alias("page_no"), body.alias("body")), "search")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment responses: the further turns of a conversation, twenty to a response."""
    child = F.struct("kind", F.struct("id", "body", "author", "created_utc", "ups", "permalink").alias("data"))
    children = F.transform(F.array_sort(F.collect_list(F.struct("turn", child.alias("child")))), lambda e: e["child"])
    turns = thread_turns(spark, sf_dir).filter(F.col("turn") > 0)
    grouped = turns.groupBy("conv_id", F.floor((F.col("turn") - 1) / 20).cast("int").alias("page_no")).agg(
        children.alias("children"))
    body = F.concat(F.lit("[{},"), F.to_json(F.struct(F.struct("children").alias("data"))), F.lit("]"))
    return _landed_reddit(grouped.withColumn("body", body), "comments")


def trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points of search interest; four of the seven symbols have a series of their own."""
    ticker = pick(TICKERS, F.col("user_id"))
    own = (F.col("user_id") % 7 < 4) & (F.col("event_type") == "purchase")
    flag = (F.col("user_id") % 7 == 6) & (F.col("event_type") == "click")
    kinds = ("click", "error", "purchase", "signup", "view")
    number = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int")
    return table(spark, sf_dir, "events").select(
        ticker.alias("symbol"),
        F.when(own, ticker).when(flag, F.lit("isPartial")).otherwise(F.col("event_type")).alias("term"),
        number.alias("term_no"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("point_no"),
        "value",
    )


def trend_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as queries, ranked by their purchases (top) and views (rising)."""
    kind = F.when(F.col("event_type") == "purchase", "top").when(F.col("event_type") == "view", "rising")
    counted = (
        table(spark, sf_dir, "events").select(pick(TICKERS, F.col("user_id")).alias("symbol"), kind.alias("kind"),
                                             F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("query"))
        .filter(F.col("kind").isNotNull()).groupBy("symbol", "kind", "query").agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = Window.partitionBy("symbol", "kind").orderBy(F.desc("n"), "query")
    return counted.select("symbol", "kind", F.row_number().over(ranked).alias("position"), "query")


def trend_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances of customers per nation as interest; the customer's number says for which symbol."""
    balances = table(spark, sf_dir, "customer").groupBy(
        pick(TICKERS, F.col("c_custkey")).alias("symbol"), F.col("c_nationkey").alias("n_nationkey")
    ).agg(F.round(F.sum("c_acctbal"), 2).alias("value"))
    named = balances.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return named.select("symbol", F.col("symbol").alias("term"), F.lit(0).alias("term_no"),
                        F.col("n_name").alias("region"), "value")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label")


def _means(df: DataFrame, by: str, name: str) -> DataFrame:
    """Mean vector per group: added up per place, which combines before the shuffle."""
    placed = df.select(by, F.posexplode("vector").alias("place", "x"))
    mean = placed.groupBy(by, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda e: e["x"])
    return mean.groupBy(by).agg(ordered.alias(name))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(vectors(spark, sf_dir), "label", "centroid").select(F.col("label").alias("list_id"), "centroid")


def source_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per document source: the mean of its documents' vectors."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("query_id"))
    return _means(vectors(spark, sf_dir).join(documents, "vec_id"), "query_id", "vector")
