"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import marketpulse
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on (the time zone) and what skewed data needs (adaptive plans)."""
    # Helpers that run in Python workers travel with the job, so executors need no copy of the package.
    cloudpickle.register_pickle_by_value(marketpulse)
    for key, value in _SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("marketpulse")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Call sites of column expressions are not recorded: plans here are built of many small expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by spark.checkpoint.dir.

    Only a local session without that setting falls back to a temporary folder: on a cluster a machine-local
    folder is out of reach for the other executors.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="marketpulse-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write the frame to the shared folder and read it back: computed once, and it outlives lost executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write if partition_by is None else df.write.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """`materialize` under a folder that is removed at the end, for frames that nothing reads afterwards."""
    root = scratch_path(spark, name)

    def keep(df: DataFrame, table: str) -> DataFrame:
        path = f"{root}/{table}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    try:
        yield keep
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def together(spark: SparkSession, *actions: Callable[[], object]) -> list:
    """The results of jobs that do not wait for one another: small ones leave most of a cluster idle, one by one."""
    with ThreadPoolExecutor(len(actions)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(a)) for a in actions]]
