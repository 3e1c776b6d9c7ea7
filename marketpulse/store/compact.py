"""Compaction: runs of like length become one, with one row per key."""

from __future__ import annotations

from functools import partial

from pyspark.sql import SparkSession

from marketpulse.session import together
from marketpulse.store.log import commit, commits, folder, folders, live, remove, snapshot, write_run
from marketpulse.store.tables import FOLDERS, TABLES, bucket_of, put_together

#: Runs of like length that are put together; a row is so rewritten once per power of it.
FAN_IN = 8


def _level(run: tuple[int, int], fan_in: int) -> int:
    level, length = 0, run[1] - run[0] + 1
    while length >= fan_in:
        level, length = level + 1, length // fan_in
    return level


def due(runs: list[tuple[int, int]], fan_in: int) -> list[tuple[int, int]]:
    """The latest runs, if `fan_in` or more of them are of like length."""
    tail = [r for r in runs]
    same = []
    while tail and (not same or _level(tail[-1], fan_in) == _level(same[0], fan_in)):
        same.insert(0, tail.pop())
    return same if len(same) >= fan_in else []


def vacuum(spark: SparkSession, store: str) -> None:
    """Remove runs that longer ones stand for, and what killed jobs have left among them.

    Called before a compaction, not after it: who has read the log before the last compaction can go on reading.
    """
    known = [(a, b) for a, b, _ in commits(spark, store)]
    kept = live(known)
    names, last = {folder(*r) for r in kept}, kept[-1][1]
    for table in ("commits", *TABLES):
        for name in folders(spark, f"{store}/{table}"):
            if name.startswith("run=") and name not in names and int(name.rsplit("_", 1)[1]) <= last:
                remove(spark, f"{store}/{table}/{name}")


def merge_runs(spark: SparkSession, store: str, runs: list[tuple[int, int]]) -> None:
    """Write one run for the given ones, which follow one another, and commit it. Killed before that, it has changed nothing."""
    now = snapshot(spark, store)
    first, last = runs[0][0], runs[-1][1]
    part = type(now)(spark, store, runs, now.buckets)

    def write(table: str) -> None:
        rows = put_together(part.read(table), table, whole=first == now.runs[0][0])
        if "bucket" in FOLDERS.get(table, {}):
            rows = rows.withColumn("bucket", bucket_of(now.buckets))
        write_run(rows, store, table, first, last)

    together(spark, *[partial(write, table) for table in TABLES])
    commit(spark, store, first, last, now.buckets)


def compact(spark: SparkSession, store: str, fan_in: int = FAN_IN) -> bool:
    """Put runs together as long as enough of them are of like length. Whether there was anything to do."""
    done = False
    while runs := due(snapshot(spark, store).runs, fan_in):
        vacuum(spark, store)
        merge_runs(spark, store, runs)
        done = True
    return done
