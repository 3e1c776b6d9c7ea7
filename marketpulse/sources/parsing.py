"""Pieces that the platform parsers share.

A parser turns landed pages into candidate posts with a `reason` column: null where the item is a post, otherwise why
it is refused. Accepted posts and the quarantine are two filters over the same candidates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.schemas import CORRUPT, SOCIAL_POST

# Where a post was found: for which instrument, by which term, on which page, at which place.
ORIGIN = ("symbol", "company_name", "term_no", "page_no", "fetched_at", "pos")


def literal_time(value: dt.datetime) -> Column:
    """A UTC instant as a literal, so that it reaches scans as a pushed filter."""
    return F.lit(value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)).cast("timestamp")


def page_items(raw: DataFrame, schema: T.DataType, items: Column, item: T.DataType | None = None, *carry: str) -> DataFrame:
    """One row per item of a page: origin, the item, its place. `items` may use the column `page`.

    Items that are still JSON text are read by the schema `item`, each by itself.
    """
    options = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    parsed = raw.withColumn("page", F.from_json("body", schema, options))
    if isinstance(schema, T.StructType):
        parsed = parsed.filter(F.col("page")[CORRUPT].isNull())
    origin = [c for c in ORIGIN if c != "pos"]
    rows = parsed.select(*origin, *carry, F.posexplode(items).alias("pos", "item"))
    return rows if item is None else rows.withColumn("item", F.from_json("item", item))


def bad_pages(raw: DataFrame, schema: T.DataType) -> DataFrame:
    """Pages that are not valid JSON."""
    options = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}
    parsed = raw.withColumn("page", F.from_json("body", schema, options))
    bad = F.col("page").isNull()
    if isinstance(schema, T.StructType):
        bad = bad | F.col("page")[CORRUPT].isNotNull()
    return parsed.filter(bad).drop("page")


def as_candidates(df: DataFrame, reason: Column, **fields: Column) -> DataFrame:
    """Project to origin, reason and the post fields, with nulls for fields the platform does not have."""
    columns = [fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SOCIAL_POST
               if f.name not in ("symbols", "urls")]
    return df.select(*[c for c in ORIGIN if c in df.columns], reason.alias("reason"), *columns)


def accepted(candidates: DataFrame) -> DataFrame:
    return candidates.filter(F.col("reason").isNull()).drop("reason")


def missing(value: Column) -> Column:
    return value.isNull() | (value == "")
