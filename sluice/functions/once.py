"""A value that is computed once and used in many places of one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also within a lambda and in expressions too large to be compiled, where equal parts are not shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
