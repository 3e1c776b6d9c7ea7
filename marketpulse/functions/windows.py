"""Look-back windows and request checks."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketpulse.constants import DEFAULT_WINDOW_HOURS
from marketpulse.functions.binding import bind

# Hours per unit.
HOURS_PER_UNIT = {"h": 1, "d": 24, "w": 168}

#: Longest window, 2,000 years: any longer one would begin before the year 1, which no timestamp can say.
MAX_HOURS = 2000 * 8766

_NUMBER = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def parse_window(window: str) -> dt.timedelta:
    """Length of one window such as 24h, 7d or 1w. Unknown units count as 24 hours; too long a window is an error."""
    amount, unit = window[:-1], window[-1:].lower()
    if not re.match(_NUMBER, amount):
        raise ValueError(f"invalid window: {window!r}")
    hours = int(amount) * HOURS_PER_UNIT[unit] if unit in HOURS_PER_UNIT else DEFAULT_WINDOW_HOURS
    if abs(hours) > MAX_HOURS:
        raise ValueError(f"window too long: {window!r}")
    return dt.timedelta(hours=hours)


def window_hours(window: Column) -> Column:
    """Column form of parse_window: hours, or null for a window that is invalid or too long."""
    per_unit = F.create_map(*[F.lit(part) for unit in HOURS_PER_UNIT.items() for part in unit])
    parts = F.struct(F.substring(window, F.lit(1), F.length(window) - 1).alias("amount"), F.lower(F.right(window, F.lit(1))).alias("unit"))

    def read(p: Column) -> Column:
        number = F.replace(F.trim(p["amount"]), F.lit("_"), F.lit("")).try_cast("bigint")
        by = F.try_element_at(per_unit, p["unit"])
        hours = F.when(by.isNull(), DEFAULT_WINDOW_HOURS).otherwise(F.try_multiply(number, by)).cast("bigint")
        return F.when(F.rlike(p["amount"], F.lit(_NUMBER)), hours)

    return bind(bind(parts, read), lambda hours: F.when(hours.between(-MAX_HOURS, MAX_HOURS), hours))


def age_hours(created_at: Column, as_of: Column) -> Column:
    """Smallest whole number of hours h with created_at >= as_of - h.

    Every window is a whole number of hours, so counting by this age answers all windows at once.
    """
    micros = F.unix_micros(as_of) - F.unix_micros(created_at)
    return F.ceil(micros / F.lit(3_600_000_000)).cast("bigint")


def request_reason(symbol: Column, window: Column) -> Column:
    """Why a request is refused, or null where it is accepted."""
    return (
        F.when(symbol.isNull() | (F.length(symbol) < 1), "symbol_missing")
        .when(F.length(symbol) > 10, "symbol_too_long")
        .when(window.isNull() | ~F.rlike(window, F.lit("^[0-9]+[hd]$")) | window_hours(window).isNull(), "window_invalid")
    )
