"""Tables of a store and what is kept of each when runs are put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.schemas import POST_KEY, SENTIMENT_SCORE, SOCIAL_POST

_KEY = "source string, platform_id string"
_CONTENT = [f"{f.name} {f.dataType.simpleString()}" for f in SOCIAL_POST if f.name not in (*POST_KEY, "urls")]
_SCORE = [f"{f.name} {'string' if f.name == 'model' else 'float'}" for f in SENTIMENT_SCORE]
#: What the cube adds up, per symbol, source and hour. Collected posts count for the instrument they were collected for; stored
#: ones (n, n_scored, polarity) for every symbol they carry. `complete` are collected posts with post, score and vector.
COUNTS = ("total_input", "no_symbols", "probable_bots", "processed", "complete", "n", "n_scored")
#: A polarity as a whole number of these digits, so that what was added can be taken back exactly.
POLARITY = "decimal(18,12)"

TABLES = {
    # First content of each post; never changed.
    "posts": ", ".join([_KEY, *_CONTENT, "batch_id bigint"]),
    # Score and vector of the text delivered last.
    "sentiment": ", ".join([_KEY, *_SCORE, "batch_id bigint"]),
    "embeddings": f"{_KEY}, emb array<float>, batch_id bigint",
    # What is known of a post without its text: what the cube holds of it, and how far it has come.
    "state": f"{_KEY}, created_at timestamp, symbols array<string>, polarity float, ingested_at timestamp, scored boolean, "
             "embedded boolean, reason string, batch_id bigint",
    # For which instrument a post was collected, and the filter it met, by its latest delivery.
    "collected": f"{_KEY}, symbol string, created_at timestamp, outcome string, batch_id bigint",
    # Texts that have no score or no vector yet.
    "pending": f"{_KEY}, text string, no_score boolean, no_vector boolean, batch_id bigint",
    # Signed sums: a batch adds what is new and takes back what it replaces.
    "cube": "symbol string, source string, hour timestamp, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", sum_polarity decimal(28,12)",
}
DATED = ("posts",)
BUCKETED = ("state", "collected")
FOLDERS = {"posts": {"created_date": "date"}} | {t: {"bucket": "int"} for t in BUCKETED}
#: Key of the tables in which a later batch replaces the row of an earlier one.
LATEST = {t: POST_KEY for t in ("sentiment", "embeddings", "state", "pending")} | {"collected": (*POST_KEY, "symbol")}


def bucket_of(buckets: int) -> Column:
    """The folder of a post among `buckets` ones."""
    return F.pmod(F.xxhash64(*POST_KEY), F.lit(buckets)).cast("int")


def latest(rows: DataFrame, table: str) -> DataFrame:
    """One row per key: that of the last batch. Copies are combined before the shuffle."""
    key = list(LATEST[table])
    rest = [c.split()[0] for c in TABLES[table].split(", ") if c.split()[0] not in key]
    kept = [c for c in ("bucket",) if c in rows.columns]
    return rows.groupBy(*key, *kept).agg(F.max_by(F.struct(*rest), "batch_id").alias("_row")).select(*key, *kept, "_row.*")


def summed(cube: DataFrame) -> DataFrame:
    """Cells of the cube without those that add up to nothing."""
    cells = cube.groupBy("symbol", "source", "hour").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.sum("sum_polarity").cast("decimal(28,12)").alias("sum_polarity"))
    return cells.filter(" or ".join(f"{c} != 0" for c in (*COUNTS, "sum_polarity")))


def put_together(rows: DataFrame, table: str, whole: bool) -> DataFrame:
    """What a run keeps of shorter ones. whole: no earlier run is left whose rows must still be replaced."""
    if table == "cube":
        return summed(rows)
    if table not in LATEST:
        return rows
    rows = latest(rows, table)
    return rows.filter("no_score or no_vector") if table == "pending" and whole else rows
