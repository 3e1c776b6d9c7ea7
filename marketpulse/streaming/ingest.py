"""Incremental ingestion of landed responses into the tables of a store (`marketpulse.store`)."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketpulse.functions.vectors import hash_embedding
from marketpulse.operators.aggregate import clean, scored, with_scores
from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.schemas import LANDED_PAGE, POST_KEY
from marketpulse.session import scratch, together
from marketpulse.sources.landed import PARSERS, Parser, collect_posts, union_posts
from marketpulse.sources.parsing import literal_time
from marketpulse.store import compact, cube, log
from marketpulse.store.tables import TABLES, bucket_of, latest

_log = logging.getLogger(__name__)

#: Folders that the keys of a store are dealt to; a batch reads those that its posts fall into.
BUCKETS = 64
_CONTENT = [part.split()[0] for part in TABLES["posts"].split(", ") if part.split()[0] not in (*POST_KEY, "batch_id")]

#: From (source, platform_id, text) to a score or vector beside each key; no row, or a null one, for a post that failed.
Step = Callable[[DataFrame], DataFrame]


def _embedded(posts: DataFrame) -> DataFrame:
    return posts.withColumn("emb", hash_embedding(F.col("text")))


def create_store(spark: SparkSession, store: str, buckets: int = BUCKETS) -> None:
    """Empty tables to start from."""
    log.create_store(spark, store, buckets)


def read_table(spark: SparkSession, store: str, table: str) -> DataFrame:
    """All rows of a table that are committed."""
    return log.snapshot(spark, store).read(table)


def stored_posts(spark: SparkSession, store: str, since: dt.datetime | None = None) -> DataFrame:
    """Stored posts with the time of their latest delivery. `since` leaves out whole folders of earlier days."""
    now = log.snapshot(spark, store)
    posts, state = now.read("posts"), now.read("state")
    if since is not None:
        posts = posts.filter((F.col("created_date") >= F.lit(since.date())) & (F.col("created_at") >= literal_time(since)))
        state = state.filter(F.col("created_at") >= literal_time(since))
    seen = state.groupBy(*POST_KEY).agg(F.max("ingested_at").alias("ingested_at"))
    return posts.drop("batch_id", "created_date", "run").join(seen, list(POST_KEY), "left")


def latest_of(spark: SparkSession, store: str, table: str) -> DataFrame:
    """Scores or vectors, one row per post: that of the last batch that made one."""
    return latest(read_table(spark, store, table), table).drop("batch_id")


def scored_store(spark: SparkSession, store: str, since: dt.datetime | None = None) -> DataFrame:
    """Stored posts beside their current scores."""
    return with_scores(stored_posts(spark, store, since), latest_of(spark, store, "sentiment"))


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """How far each stored post has come: (source, platform_id, stored, scored, embedded, reason of a failure)."""
    state = latest(read_table(spark, store, "state"), "state")
    return state.select(*POST_KEY, F.lit(True).alias("stored"), "scored", "embedded", "reason")


def _made(step: Step, todo: DataFrame, wanted: str, good: str, write: Callable[[DataFrame], None]) -> str | None:
    """Write what a step makes of the posts that want it. The reason if it failed as a whole; the posts then stay as they are."""
    rows = todo.filter(wanted).select(*POST_KEY, "text")
    try:
        write(step(rows).filter(good))
        return None
    except Exception as error:  # noqa: BLE001 - a post without score or vector is tried again, the batch goes on
        _log.warning("%s: %s", wanted, error)
        write(rows.limit(0).select(*POST_KEY))
        return f"{type(error).__name__}"


def _collected(pages: DataFrame, as_of: dt.datetime, since: dt.datetime | None, parsers: dict[str, Parser], keep) -> DataFrame:
    """The cleaned posts of every source whose parser goes through, each written by a job of its own."""
    def attempt(source: str, parser: Parser) -> DataFrame | None:
        try:
            return keep(clean(collect_posts(pages, as_of, since, {source: parser})), f"cleaned-{source}")
        except Exception as error:  # noqa: BLE001 - one source must not stop the rest
            _log.warning("source %s left out: %s", source, error)
            return None

    parts = together(pages.sparkSession, *[partial(attempt, *item) for item in parsers.items()])
    if not any(part is not None for part in parts):
        raise ValueError("no source could be parsed")
    return union_posts(*[part for part in parts if part is not None])


def write_batch(
    pages: DataFrame, batch_id: int, store: str, as_of: dt.datetime, since: dt.datetime | None = None,
    embed: bool = True, scorer: Step = scored, embedder: Step = _embedded, parsers: dict[str, Parser] | None = None,
) -> None:
    """Add one micro-batch: new posts, score and vector of every post seen, and what both change in the cube.

    Sources are parsed apart from one another: one whose parser fails, on building its plan or on the data, adds nothing to this batch.

    A post's score and vector follow its latest text, its stored content the first one ever. Posts that an earlier batch could
    not score or embed are tried again. What is known of the batch's posts is read from the key folders they fall into only. Everything is
    written as a run that is committed at the end: a batch that is repeated after its commit does nothing, before it writes anew.
    """
    spark = pages.sparkSession
    now = log.snapshot(spark, store)
    if now.holds(batch_id):
        return
    key, earlier = list(POST_KEY), now.before(batch_id)
    batch = F.lit(batch_id).cast("bigint").alias("batch_id")

    def write(rows: DataFrame, table: str) -> DataFrame:
        columns = [part.split() for part in TABLES[table].split(", ")]
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns if c != "batch_id"],
                           *[batch for c, _ in columns if c == "batch_id"], *[c for c in ("bucket",) if c in rows.columns])
        log.write_run(rows, store, table, batch_id, batch_id)
        return log.Snapshot(spark, store, [(batch_id, batch_id)], now.buckets).read(table)

    with scratch(spark, "batch") as keep:
        order = F.struct("fetched_at", "symbol", "term_no", "page_no", "pos")
        cleaned = _collected(pages, as_of, since, PARSERS if parsers is None else parsers, keep)
        met = cleaned.groupBy(*key, F.col("symbol")).agg(F.max_by(F.struct("created_at", "outcome"), order).alias("_row")).select(
            *key, "symbol", "_row.*", bucket_of(now.buckets).alias("bucket"), batch)
        # Posts to be scored and embedded: those of the batch, and what earlier batches have left.
        left = latest(earlier.read("pending"), "pending").filter("no_score or no_vector")
        met, left = together(spark, lambda: keep(met, "met"), lambda: keep(left, "left"))

        # What was known of these posts, from the folders they fall into.
        touched = keep(met.select(*key).unionByName(left.select(*key)).distinct(), "touched")
        buckets = [r[0] for r in touched.select(bucket_of(now.buckets)).distinct().collect()]
        touched = broadcast_if_small(touched)
        known = lambda table: latest(earlier.read(table, buckets).join(touched, key, "left_semi"), table)
        yes = F.lit(True)

        def with_state() -> tuple[DataFrame, DataFrame]:
            old_state = keep(known("state"), "old-state")
            posts = cleaned.filter("outcome = 'processed'").groupBy(*key).agg(
                F.min_by(F.struct(*_CONTENT), order).alias("_first"), F.max_by("text", order).alias("latest_text"),
                F.max("fetched_at").alias("ingested_at"))
            # Stored posts are told while the texts lie by key, so that they are not dealt out again to be told later.
            posts = posts.join(old_state.select(*key, yes.alias("is_stored")), key, "left")
            # A text that is first and latest is kept once.
            same = F.col("latest_text").eqNullSafe(F.col("_first.text"))
            return old_state, keep(posts.select(
                *key, "_first.*", F.when(~same, F.col("latest_text")).alias("latest_text"), same.alias("same_text"), "ingested_at", "is_stored"), "posts")

        (old_state, posts), old_met = together(spark, with_state, lambda: keep(known("collected"), "old-collected"))
        rest = keep(left.join(posts.select(*key), key, "left_anti").select(*key, "text", "no_score", "no_vector"), "rest")
        wants = [yes.alias("no_score"), F.lit(embed).alias("no_vector")]
        todo = posts.select(*key, F.when(F.col("same_text"), F.col("text")).otherwise(F.col("latest_text")).alias("text"), *wants).unionByName(rest)
        scores_failed, vectors_failed = together(
            spark, lambda: _made(scorer, todo, "no_score", "model is not null", lambda rows: write(rows, "sentiment")),
            lambda: _made(embedder, todo, "no_vector", "emb is not null", lambda rows: write(rows, "embeddings")))
        own = log.Snapshot(spark, store, [(batch_id, batch_id)], now.buckets)
        new_scores = own.read("sentiment").select(*key, F.col("polarity").alias("_polarity"), yes.alias("_scored"))
        new_vectors = own.read("embeddings").select(*key, yes.alias("_embedded"))

        done = lambda wanted, made: F.coalesce(F.col(made), ~F.col(wanted), F.lit(False))
        first = posts.select(
            *key, *wants, F.col("created_at").alias("_created"), F.col("symbols").alias("_symbols"), F.col("ingested_at").alias("_ingested"))
        state = (
            first.unionByName(rest.drop("text"), allowMissingColumns=True)
            .join(old_state, key, "left").join(new_scores, key, "left").join(new_vectors, key, "left")
            .select(
                *key, F.coalesce("created_at", "_created").alias("created_at"), F.coalesce("symbols", "_symbols").alias("symbols"),
                F.when(F.col("_scored"), F.col("_polarity")).otherwise(F.col("polarity")).alias("polarity"),
                F.greatest("ingested_at", "_ingested").alias("ingested_at"),
                done("no_score", "_scored").alias("scored"), done("no_vector", "_embedded").alias("embedded"), "no_score", "no_vector"))
        reason = F.when(~F.col("scored"), F.lit(f"no score: {scores_failed or 'none given'}")).when(
            ~F.col("embedded"), F.lit(f"no vector: {vectors_failed or 'none given'}"))
        state = keep(state.withColumn("reason", reason).withColumn("bucket", bucket_of(now.buckets)), "state")

        now_state = old_state.join(state.select(*key), key, "left_anti").select(*key, "created_at", "symbols", "polarity", "scored", "embedded")
        now_state = now_state.unionByName(state.select(*now_state.columns))
        now_met = latest(old_met.drop("bucket").unionByName(met.drop("bucket")), "collected")
        # Which texts wait is told without them: they are few unless a model has failed, and the others stay where they are.
        open_ = (
            state.select(*key, (~F.col("scored")).alias("no_score"), (~F.col("embedded")).alias("no_vector"))
            .join(left.select(*key, yes.alias("_left")), key, "left").filter("no_score or no_vector or _left"))
        waiting = todo.select(*key, "text").join(broadcast_if_small(keep(open_, "open")), key)
        waiting = waiting.withColumn("text", F.when(F.expr("no_score or no_vector"), F.col("text")))
        together(
            spark, lambda: write(posts.filter("is_stored is null"), "posts"), lambda: write(state, "state"),
            lambda: write(met, "collected"), lambda: write(waiting, "pending"),
            lambda: write(cube.delta((old_state, old_met), (now_state, now_met)), "cube"))
        log.commit(spark, store, batch_id, batch_id, now.buckets)


def start_ingest(
    spark: SparkSession, landed: str, store: str, checkpoint: str, as_of: dt.datetime,
    since: dt.datetime | None = None, files_per_batch: int | None = None, embed: bool = True,
    scorer: Step = scored, embedder: Step = _embedded, buckets: int = BUCKETS, fan_in: int = compact.FAN_IN,
) -> StreamingQuery:
    """Process everything landed since the last run, in micro-batches, then stop. Runs are put together on the way."""
    create_store(spark, store, buckets)
    reader = spark.readStream.schema(LANDED_PAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def add(pages: DataFrame, batch_id: int) -> None:
        write_batch(pages, batch_id, store, as_of, since, embed, scorer, embedder)
        compact.compact(pages.sparkSession, store, fan_in)

    return (
        reader.json(landed).writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
