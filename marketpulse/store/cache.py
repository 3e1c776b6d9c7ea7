"""The resolver cache as a stored table: requests are resolved with it, and what it missed is written back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from marketpulse.operators.resolve import resolve_symbols, updated_cache
from marketpulse.schemas import RESOLVED_INSTRUMENT
from marketpulse.session import materialize
from marketpulse.store.log import exists, folders, remove

SCHEMA = "query string, " + ", ".join(f"{f.name} string" for f in RESOLVED_INSTRUMENT) + ", cached_at timestamp"


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Those that were written whole, oldest first."""
    return sorted(int(name.split("=")[1]) for name in folders(spark, path)
                  if name.startswith("generation=") and exists(spark, f"{path}/{name}/_SUCCESS"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation; empty before the first one."""
    found = _generations(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/generation={found[-1]}") if found else spark.createDataFrame([], SCHEMA)


def write_cache(cache: DataFrame, path: str) -> None:
    """A new generation. The one before stays for those who are reading it; older ones go."""
    spark = cache.sparkSession
    found = _generations(spark, path)
    number = found[-1] + 1 if found else 0
    cache.select(*[part.split()[0] for part in SCHEMA.split(", ")]).write.mode("overwrite").parquet(f"{path}/generation={number}")
    for old in found[:-1]:
        remove(spark, f"{path}/generation={old}")


def resolve_and_remember(requests: DataFrame, path: str, as_of: dt.datetime) -> DataFrame:
    """The requests with `instrument` and `cache_hit`: fresh rows of the stored cache count, and every miss is stored with `as_of`.

    The answer is written before the cache changes, so that reading it later still shows hits and misses as they were.
    """
    spark = requests.sparkSession
    cache = read_cache(spark, path)
    resolved = materialize(resolve_symbols(requests, cache, as_of), "resolved")
    missed = resolved.filter("not cache_hit").select("query")
    if missed.limit(1).count():
        write_cache(updated_cache(cache, missed, as_of), path)
    return resolved
