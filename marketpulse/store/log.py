"""Runs of a store and the log of those that are complete.

A run is what the batches first..last have added to each table: one folder per table, written once. A batch is a run of its
own; compaction writes longer runs that stand for several shorter ones. A run exists from the moment its commit record does, which is
written last: readers take the longest committed runs that follow one another, so they see a batch or a compaction whole or not
at all, and whatever a killed job has left is written over or removed later.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.session import together
from marketpulse.store.tables import DATED, FOLDERS, TABLES

#: Before any batch: the empty run that a new store starts with.
START = -1


def folder(first: int, last: int) -> str:
    return f"run={first}_{last}"


def live(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest of the runs that start at a batch, one after the other."""
    longest: dict[int, int] = {}
    for first, last in runs:
        longest[first] = max(last, longest.get(first, last))
    out: list[tuple[int, int]] = []
    for first in sorted(longest):
        if not out or first > out[-1][1]:
            out.append((first, longest[first]))
    return out


def commits(spark: SparkSession, store: str) -> list[tuple[int, int, int]]:
    """(first, last, buckets) of every committed run. Compaction keeps their number small."""
    rows = spark.read.schema("first bigint, last bigint, buckets int").parquet(f"{store}/commits").select("first", "last", "buckets").collect()
    return [tuple(r) for r in rows]


def commit(spark: SparkSession, store: str, first: int, last: int, buckets: int) -> None:
    record = spark.createDataFrame([(first, last, buckets)], "first bigint, last bigint, buckets int")
    record.coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/{folder(first, last)}")


@dataclass(frozen=True)
class Snapshot:
    """What a store holds, as of the commits seen when it was taken."""

    spark: SparkSession
    store: str
    runs: list[tuple[int, int]]
    buckets: int

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table with the columns of its folders; of the given buckets only, where it has any."""
        schema = TABLES[table] + "".join(f", {c} {kind}" for c, kind in FOLDERS.get(table, {}).items()) + ", run string"
        if not self.runs:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.store}/{table}")
        rows = reader.parquet(*[f"{self.store}/{table}/{folder(*run)}" for run in self.runs])
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def before(self, batch_id: int) -> Snapshot:
        """What was there before a batch."""
        return Snapshot(self.spark, self.store, [r for r in self.runs if r[1] < batch_id], self.buckets)

    def holds(self, batch_id: int) -> bool:
        return any(first <= batch_id <= last for first, last in self.runs)


def snapshot(spark: SparkSession, store: str) -> Snapshot:
    found = commits(spark, store)
    return Snapshot(spark, store, live([(a, b) for a, b, _ in found]), found[0][2])


def write_run(rows: DataFrame, store: str, table: str, first: int, last: int) -> None:
    """Write one table of a run. Rows of a folder go to the same tasks, so few rows make few files; a crowded one is split."""
    path, folders = f"{store}/{table}/{folder(first, last)}", list(FOLDERS.get(table, {}))
    if table in DATED:
        rows = rows.withColumn("created_date", F.to_date("created_at"))
    rows = rows.select(*[c.split()[0] for c in TABLES[table].split(", ")], *folders)
    if folders:
        rows.hint("rebalance", *folders).write.mode("overwrite").partitionBy(*folders).parquet(path)
    else:  # written where the rows are: what comes from a shuffle has been put into few parts there
        rows.write.mode("overwrite").parquet(path)


def create_store(spark: SparkSession, store: str, buckets: int) -> None:
    """Empty tables to start from; an existing store stays as it is, with the number of buckets it was made with."""
    if any(exists(spark, f"{store}/commits/{name}/_SUCCESS") for name in folders(spark, f"{store}/commits")):
        return
    def empty(table: str) -> None:
        own = "".join(f", {c} {kind}" for c, kind in FOLDERS.get(table, {}).items() if table not in DATED)
        write_run(spark.createDataFrame([], TABLES[table] + own), store, table, START, START)

    together(spark, *[partial(empty, table) for table in TABLES])
    commit(spark, store, START, START, buckets)


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    files, found = _path(spark, path)
    return files.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    files, found = _path(spark, path)
    files.delete(found, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    files, found = _path(spark, path)
    return [s.getPath().getName() for s in files.listStatus(found)] if files.exists(found) else []
