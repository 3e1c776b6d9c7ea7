"""Creation times as the platforms write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
_FRACTION = r"(\.\d{1,6})?"
# ISO forms beyond the usual one: a date alone, a blank for the T, no seconds, an offset without a colon or minutes.
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
_ISO_OFFSET = r"(?<=[T ].{2,20})(Z|[+-]\d{2}(:?\d{2})?)$"
#: Seconds since 1970 of the years 1 to 9999.
_EPOCH_RANGE = (-62_135_596_800, 253_402_300_799)


def _parse(written: Column, form: str) -> Column:
    """Date, time and fraction of a value of the given form; an offset is dropped, not applied."""
    bare = F.regexp_replace(F.substring(written, 1, 26), r"(Z|[+-]\d{2}:\d{2}|[+-]\d{0,2}:?\d?)$", "")
    stamp = F.concat(F.replace(bare, F.lit("T"), F.lit(" "))).try_cast("timestamp")
    return F.when(F.rlike(written, F.lit(form)), stamp)


def x_created_at(written: Column, as_of: Column) -> Column:
    """UTC with or without a fraction; anything else counts as now."""
    return F.coalesce(_parse(written, _WHOLE + _FRACTION + "Z$"), as_of)


def stocktwits_created_at(written: Column, as_of: Column) -> Column:
    """UTC, or another ISO form; an offset is dropped, anything else counts as now."""
    bare = F.replace(F.regexp_replace(written, _ISO_OFFSET, ""), F.lit("T"), F.lit(" "))
    hour_only = F.rlike(bare, F.lit(r" \d{2}$"))
    bare = F.when(hour_only, F.concat(bare, F.lit(":00"))).otherwise(bare)
    return F.coalesce(F.when(F.rlike(written, F.lit(_ISO)), bare.try_cast("timestamp")), as_of)


def reddit_created_at(epoch_seconds: Column) -> Column:
    """Null for a number that no timestamp can hold."""
    return F.timestamp_micros(F.when(epoch_seconds.between(*_EPOCH_RANGE), F.round(epoch_seconds * 1_000_000).try_cast("bigint")))
