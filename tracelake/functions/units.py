"""Time unit functions over integer nanoseconds."""

from pyspark.sql import Column
from pyspark.sql import functions as F

NS_PER_US = 1_000
NS_PER_MS = 1_000_000
NS_PER_S = 1_000_000_000


def whole(value: Column, divisor: int) -> Column:
    """Integer quotient, truncated toward zero, exact for any bigint."""
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))


def micros(ns: Column) -> Column:
    """Whole microseconds."""
    return whole(ns, NS_PER_US)


def millis(ns: Column) -> Column:
    """Milliseconds as double."""
    return ns / F.lit(float(NS_PER_MS))
