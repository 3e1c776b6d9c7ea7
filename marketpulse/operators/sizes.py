"""Broadcasts behind a check of size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 1_000_000
MAX_BYTES = 64 * 1024 * 1024


#: Bytes of a row, and of a value in it, besides what strings hold.
ROW_BYTES, VALUE_BYTES = 16, 8


def _width(df: DataFrame) -> Column:
    """Bytes of a row in memory, about. Only nested values are rendered to learn their size."""
    width = F.lit(ROW_BYTES + VALUE_BYTES * len(df.schema)).cast("bigint")
    held = []
    for field in df.schema:
        value = df[f"`{field.name}`"]
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            held.append(F.octet_length(value))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            held.append(F.octet_length(F.to_json(F.struct(value.alias("v")))))
    return reduce(lambda a, b: a + F.coalesce(b, F.lit(0)), held, width)


def is_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether the measured rows and bytes stay within the bounds. One pass that only adds up, so no row is moved."""
    size = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(_width(df)).alias("bytes")).first()
    return size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Mark the frame for broadcast if it is small, else leave it as it is.

    For the small-looking side of a join with a stored table: a shuffle of the stored table, which the planner would
    otherwise start before it knows the size, costs far more than computing this side twice. Beyond the bounds the
    join is an ordinary shuffled one.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df
