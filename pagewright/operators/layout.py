"""The two-sided layout of a record: validation, side of a page, signature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.reconcile import ordered_hash


def layout_issues(layouts: DataFrame) -> DataFrame:
    """(case_id, rule) for layouts (case_id, mode, rt_end, ct_start, n_pages): known mode, bounds, and adjacent sides of a split."""
    split = F.col("mode") == "split"
    rules = F.array(
        F.when(~F.col("mode").isin("rt_only", "ct_only", "split") | F.col("mode").isNull(), F.lit("mode")),
        F.when(split & ~F.coalesce((F.col("rt_end") >= 1) & (F.col("ct_start") <= F.col("n_pages")), F.lit(False)), F.lit("bounds")),
        F.when(split & ~F.coalesce(F.col("ct_start") == F.col("rt_end") + 1, F.lit(False)), F.lit("adjacent")),
        F.when(~split & (F.col("rt_end").isNotNull() | F.col("ct_start").isNotNull()), F.lit("split_pages_unused")),
    )
    return layouts.select("case_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def sides(pages: DataFrame, layouts: DataFrame) -> DataFrame:
    """pages with side RT or CT by page number; null without a layout."""
    side = F.when(F.col("mode") == "rt_only", "RT").when(F.col("mode") == "ct_only", "CT").when(F.col("mode") == "split", F.when(F.col("page") <= F.col("rt_end"), "RT").otherwise("CT"))
    return pages.join(layouts.select("case_id", "mode", "rt_end"), "case_id", "left").withColumn("side", side).drop("mode", "rt_end")


def layout_signature(pages: DataFrame) -> DataFrame:
    """(case_id, layout_signature) over page names and lengths in page order: an edit that keeps a page's length isn't seen."""
    rows = pages.select("case_id", "page", F.concat_ws(":", "file_name", F.coalesce("n_bytes", F.lit(0))).alias("row"))
    return ordered_hash(rows, ["case_id"], "page", "row").withColumnRenamed("content_sha256", "layout_signature")
