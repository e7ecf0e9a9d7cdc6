"""Places of rows in an order over a whole table, without a task that sorts or numbers all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

_AT, _RANGE, _START = "__at", "__range", "__start"


def places(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """``df`` with ``name``, from 0, in the given order; ties get places in any order.

    Rows are sorted within ranges, as many as the session's partitions, and written with their range and place in it; a range
    starts where the sums of the ranges before it end.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the number has the partition above its lower 33 bits, and the place in it below
    table = written(sorted_.withColumn(_AT, F.monotonically_increasing_id()), "placed").withColumn(_RANGE, F.shiftright(_AT, 33))
    counts = table.groupBy(_RANGE).agg(F.count(F.lit(1)).alias("__n"))
    starts = counts.withColumn(_START, F.sum("__n").over(Window.orderBy(_RANGE)) - F.col("__n")).drop("__n")  # a row a range
    within = F.col(_AT) - F.shiftleft(F.col(_RANGE), 33)
    return table.join(F.broadcast(starts), _RANGE).withColumn(name, F.col(_START) + within).drop(_AT, _RANGE, _START)


def numbered(df: DataFrame, by: list[str], *order: Column | str, name: str = "number") -> DataFrame:
    """``df`` with ``name``, from 0 within each value of ``by``; a value that many rows share is numbered over several ranges."""
    x = places(df, *by, *order, name=name)
    first = x.groupBy(*by).agg(F.min(name).alias("__first"))
    # null-safe, as rows without a value are a group as well
    keys = [F.col(c).alias(f"__{c}") for c in by]
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return x.join(first.select(*keys, "__first"), on).withColumn(name, F.col(name) - F.col("__first")).drop("__first", *[f"__{c}" for c in by])
