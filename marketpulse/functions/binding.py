"""Use of one value at several places of an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`: inside a lambda an expression is evaluated at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)
