"""Ways to work an expression out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once a row.

    An expression inside a lambda is worked out for each element, so a maximum there takes the square of the array.
    The variable of a lambda over one element is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def settled(df: DataFrame) -> DataFrame:
    """``df`` unchanged, but filters above it are not pushed below.

    A pushed filter repeats the expressions it needs, and inside higher-order functions repeats them for each
    element. The row number keeps the optimizer from moving filters past it; it costs nothing and is dropped.
    A stream cannot be numbered; a filter on a random number that lets all rows pass does the same there.
    """
    if df.isStreaming:
        return df.where(F.rand() >= 0)
    return df.withColumn("__once", F.monotonically_increasing_id()).where("__once >= 0").drop("__once")
