"""Where answers go: JSON lines per run, staged and then committed.

A run that is repeated replaces its own answers and no others; one that is killed before its commit leaves what was there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marketpulse.store.log import exists, folders, remove

_COMMIT = "run string, number int, attempt string"


def _commits(spark: SparkSession, path: str, run: str) -> list[tuple[int, str]]:
    """(number, attempt) of a run's commits, oldest first."""
    found = []
    for name in folders(spark, f"{path}/commits"):
        if name.rsplit("_", 1)[0] == f"commit={run}" and exists(spark, f"{path}/commits/{name}/_SUCCESS"):
            row = spark.read.schema(_COMMIT).json(f"{path}/commits/{name}").first()
            found.append((row["number"], row["attempt"]))
    return sorted(found)


def write_answers(answers: DataFrame, path: str, run: str) -> None:
    """Write the answers of a run as JSON lines. They count once the commit record, written last, is there."""
    if not run or any(c in run for c in "/=_"):
        raise ValueError(f"a run is named without slash, equals sign and underscore: {run!r}")
    spark, attempt = answers.sparkSession, uuid.uuid4().hex
    answers.write.option("ignoreNullFields", "false").json(f"{path}/answers/run={run}/attempt={attempt}")
    earlier = _commits(spark, path, run)
    number = earlier[-1][0] + 1 if earlier else 0
    record = spark.createDataFrame([(run, number, attempt)], _COMMIT)
    record.coalesce(1).write.json(f"{path}/commits/commit={run}_{number}")
    # The answers before stay for those who are reading them; older ones, and what killed attempts have left, go.
    kept = {f"attempt={a}" for _, a in earlier[-1:]} | {f"attempt={attempt}"}
    for name in folders(spark, f"{path}/answers/run={run}"):
        if name not in kept:
            remove(spark, f"{path}/answers/run={run}/{name}")
    for old, _ in earlier[:-1]:
        remove(spark, f"{path}/commits/commit={run}_{old}")


def read_answers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The committed answers of all runs, with `run`."""
    runs = {name.split("=")[1].rsplit("_", 1)[0] for name in folders(spark, f"{path}/commits")}
    last = {run: commits[-1][1] for run in sorted(runs) if (commits := _commits(spark, path, run))}
    if not last:
        return spark.createDataFrame([], f"{schema}, run string")
    found = [f"{path}/answers/run={run}/attempt={attempt}" for run, attempt in last.items()]
    return spark.read.schema(f"{schema}, run string").option("basePath", f"{path}/answers").json(found).drop("attempt")
