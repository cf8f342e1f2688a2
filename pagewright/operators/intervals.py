"""Closed page intervals: expansion, lookup, completeness, overlap and union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand(intervals: DataFrame) -> DataFrame:
    """One row per page of each interval (start_page, end_page); an interval that ends before it starts has no page."""
    return intervals.withColumn("page", F.explode(F.when(F.col("start_page") <= F.col("end_page"), F.sequence("start_page", "end_page"))))


def containing(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """points with the start and end of the interval of their case that holds them, else null.

    As-of by one window over the union of both sides, so neither side is replicated: the last start at or before a page, then the
    bound check. Intervals of a case must not overlap.
    """
    a = points.select("case_id", "page", F.lit(1).alias("is_point"), F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e"))
    b = intervals.select("case_id", F.col("start_page").alias("page"), F.lit(0).alias("is_point"), F.col("start_page").alias("s"), F.col("end_page").alias("e"))
    w = Window.partitionBy("case_id").orderBy("page", "is_point").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionAll(b).withColumn("s", F.last("s", True).over(w)).withColumn("e", F.last("e", True).over(w)).where("is_point = 1")
    held = F.col("page") <= F.col("e")
    return got.select("case_id", "page", F.when(held, F.col("s")).alias("start_page"), F.when(held, F.col("e")).alias("end_page"))


def completeness(intervals: DataFrame, pages: DataFrame) -> DataFrame:
    """intervals with n_available pages and complete (every page is there)."""
    have = pages.select("case_id", "page").distinct()
    joined = expand(intervals).join(have.withColumn("_have", F.lit(1)), ["case_id", "page"], "left")
    out = joined.groupBy("case_id", "start_page", "end_page").agg(F.count("_have").alias("n_available"))
    return out.withColumn("complete", F.col("n_available") == F.col("end_page") - F.col("start_page") + 1)


def overlaps(intervals: DataFrame) -> DataFrame:
    """Intervals that begin at or before the greatest end of the earlier ones of their case."""
    w = Window.partitionBy("case_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("earlier_end", F.max("end").over(w)).where(F.col("start") <= F.col("earlier_end"))


def union(intervals: DataFrame, gap: int = 1) -> DataFrame:
    """(case_id, start, end, n_parts): overlapping intervals, or ones at most gap apart, as one."""
    w = Window.partitionBy("case_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = intervals.withColumn("before", before)
    rows = rows.withColumn("island", F.sum((F.col("before").isNull() | (F.col("start") > F.col("before") + gap)).cast("int")).over(w))
    return rows.groupBy("case_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_parts")).drop("island")
