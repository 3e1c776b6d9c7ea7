"""Streaming dedupe and rolling sentiment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketpulse.operators.aggregate import per_symbol
from marketpulse.schemas import POST_KEY

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: Of streams whose state Spark keeps in RocksDB only. A batch writes its changes to the checkpoint, not the files that compaction makes of old ones; the
#: local files of a run that has ended go soon, not after a minute (the first stream of an executor decides this for all).
ROCKSDB = {
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
}


def dedupe_stream(posts: DataFrame, delay: str = "7 days") -> DataFrame:
    """One row per key among deliveries that lie within the watermark; older state is dropped."""
    return posts.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(list(POST_KEY))


def rolling_stream(scored_posts: DataFrame, delay: str = "1 hour", length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Mean polarity per symbol over sliding windows; a window is final once the watermark has passed it.

    Posts are added up per slide first, and only those sums are copied into the windows they lie in: `length` is a
    multiple of `slide`.
    """
    if pd.Timedelta(length) % pd.Timedelta(slide):
        raise ValueError(f"{length} is no multiple of {slide}")
    rows = per_symbol(scored_posts, "created_at", F.col("polarity").cast("double").alias("polarity"))
    sums = (
        rows.withWatermark("created_at", delay)
        .groupBy("symbol", F.window("created_at", slide).alias("pane"))
        .agg(F.count(F.lit(1)).alias("n"), F.count("polarity").alias("n_scored"), F.sum("polarity").alias("sum_polarity"))
        .select("symbol", F.window_time("pane").alias("pane_time"), "n", "n_scored", "sum_polarity")
    )
    return (
        sums.groupBy("symbol", F.window("pane_time", length, slide))
        .agg(F.sum("n").alias("n"), (F.sum("sum_polarity") / F.nullif(F.sum("n_scored"), F.lit(0))).alias("avg_polarity"))
        .select("symbol", F.col("window.start").alias("window_start"), "n", "avg_polarity")
    )


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all results for the data available now to a table. State that Spark keeps in RocksDB only is kept there, other state as the session has it."""
    writer = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    if "TransformWithState" not in stream._jdf.queryExecution().analyzed().toString():
        return writer.start()
    # A stream takes over the settings of its session when it starts.
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in ROCKSDB}
    for k, value in ROCKSDB.items():
        conf.set(k, value)
    try:
        return writer.start()
    finally:
        for k, value in before.items():
            conf.unset(k) if value is None else conf.set(k, value)
