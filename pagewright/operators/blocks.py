"""Running values along whole numbers in two levels, so that no key is one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_max(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], size: int = 4096) -> DataFrame:
    """rows with each of values as its greatest up to that row, by key; null where there is none so far.

    The first of order is a whole number; rows are taken in blocks of size of them, and what earlier blocks reach is carried on block by block.
    """
    rows = rows.withColumn("__block", F.floor(F.col(order[0]) / size))
    w = Window.partitionBy(*keys, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    came = rows.groupBy(*keys, "__block").agg(*(F.max(v).alias(f"__{v}") for v in values)).withColumns({f"__{v}": F.max(f"__{v}").over(before) for v in values})
    rows = rows.join(came, [*keys, "__block"]).withColumns({v: F.greatest(F.max(v).over(w), f"__{v}") for v in values})
    return rows.drop("__block", *(f"__{v}" for v in values))
