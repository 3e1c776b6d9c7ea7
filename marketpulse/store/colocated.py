"""Posts, scores and vectors as tables bucketed by the post's key, so that joining them moves no row.

A published generation is the store as of one snapshot: three Parquet tables with the same number of buckets, each sorted by key inside
a bucket. Bucketing is a matter of the session's catalog, so a generation is named there; its files lie under the store. What
has come in since is a few runs: they are joined by themselves, and only their keys are sent to the large tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.operators.sizes import broadcast_if_small
from marketpulse.schemas import POST_KEY
from marketpulse.store.log import Snapshot, snapshot
from marketpulse.store.tables import latest

PARTS = ("posts", "sentiment", "embeddings")
_KEY = list(POST_KEY)


def save_bucketed(rows: DataFrame, name: str, path: str, buckets: int) -> None:
    """Write a table bucketed and sorted by the post's key, one file to a bucket, and name it in the catalog."""
    # Dealt as the buckets are, so that each is written by one task.
    dealt = rows.repartition(buckets, *_KEY)
    dealt.write.mode("overwrite").bucketBy(buckets, *_KEY).sortBy(*_KEY).option("path", path).saveAsTable(name)


def joined(posts: DataFrame, *others: DataFrame) -> DataFrame:
    """Posts beside their scores and vectors; a post that lacks one of them drops out. Bucketed sides are not shuffled."""
    for other in others:
        # Large sides meet bucket by bucket; a broadcast would move one of them whole.
        posts = posts.join(other.hint("merge"), _KEY)
    return posts


def _parts(rows: Snapshot) -> dict[str, DataFrame]:
    out = {"posts": rows.read("posts").drop("created_date", "run", "batch_id")}
    for table in PARTS[1:]:
        out[table] = latest(rows.read(table), table).drop("batch_id")
    return out


@dataclass(frozen=True)
class Published:
    """A generation: the names of its tables and the last batch it holds."""

    name: str
    last: int

    def table(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.table(f"{self.name}_{part}")


def publish(spark: SparkSession, store: str, name: str, buckets: int) -> Published:
    """Bucketed tables `name`_posts, `name`_sentiment and `name`_embeddings of what the store holds now."""
    now = snapshot(spark, store)
    for part, rows in _parts(now).items():
        save_bucketed(rows, f"{name}_{part}", f"{store}/bucketed/{name}/{part}", buckets)
    return Published(name, now.runs[-1][1])


def current(spark: SparkSession, store: str, base: Published, vectors: bool = False) -> DataFrame:
    """All stored posts with their current scores (and vectors): the published tables, corrected by the runs since.

    A run that holds batches from before and after the generation was put together since; it is read whole, as its rows are no older.
    """
    now = snapshot(spark, store)
    wanted = PARTS if vectors else PARTS[:2]
    old = {part: base.table(spark, part) for part in wanted}
    since = Snapshot(spark, store, [r for r in now.runs if r[1] > base.last], now.buckets)
    if not since.runs:
        return joined(*old.values())
    new = {part: rows for part, rows in _parts(since).items() if part in wanted}
    # Rows that a later one replaces go from the large tables; posts are never replaced.
    kept = {"posts": old["posts"].join(broadcast_if_small(new["posts"].select(*_KEY)), _KEY, "left_anti")}
    kept |= {part: old[part].join(broadcast_if_small(new[part].select(*_KEY)), _KEY, "left_anti") for part in wanted[1:]}
    plain = joined(*kept.values())
    # Posts whose content, score or vector came since: their other parts are looked up by key in both.
    touched = new["posts"].select(*_KEY)
    for part in wanted[1:]:
        touched = touched.unionByName(new[part].select(*_KEY))
    touched = broadcast_if_small(touched.distinct())
    either = [kept[part].join(touched, _KEY, "left_semi").unionByName(new[part]) for part in wanted]
    return plain.join(touched, _KEY, "left_anti").unionByName(joined(*either).select(plain.columns))
