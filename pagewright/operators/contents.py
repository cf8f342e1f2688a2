"""Tables of contents: sections by a finite automaton over lines, first entry of each date, report starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.dates import recognized

#: The section that is corrected, and the others that end it.
CORRECTED = "MINUTE ORDERS"
OTHERS = ("FORMS", "REPORTS", "MOTIONS", "HEARINGS")
BLOCK = 256  # places of lines


def sections(lines: DataFrame, key: str, line: str, text: str) -> DataFrame:
    """lines with heading (the section they stand in, null before the first) and nth (how often the corrected section began so far).

    What a block of lines does to the state is its last heading, if any, and a count; these compose in any grouping. So blocks are
    read by themselves, their effects are carried on block by block, and no key is one task.
    """
    bare = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""))
    rows = lines.withColumn("__own", F.when(bare.isin(CORRECTED, *OTHERS), bare)).withColumn("__block", F.floor(F.col(line) / BLOCK))
    starts = (F.col("__own") == CORRECTED).cast("long")
    effect = rows.where("__own is not null").groupBy(key, "__block").agg(F.max_by("__own", line).alias("__last"), F.sum(starts).alias("__n"))
    effect = rows.select(key, "__block").distinct().join(effect, [key, "__block"], "left")
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    effect = effect.select(key, "__block", F.last("__last", True).over(before).alias("__came"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__count"))
    inside = Window.partitionBy(key, "__block").orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__state", F.last("__own", True).over(inside)).withColumn("__nth", F.coalesce(F.sum(starts).over(inside), F.lit(0)))
    rows = rows.join(effect, [key, "__block"])
    rows = rows.withColumn("heading", F.coalesce("__state", "__came")).withColumn("nth", F.col("__nth") + F.col("__count")).withColumn("is_heading", F.col("__own").isNotNull())
    return rows.drop("__own", "__block", "__state", "__nth", "__came", "__count")


def entry_date(text: Column) -> Column:
    """The recognised date of a tab-indented entry: what stands before its last word, or all of it if it is one word; else null."""
    entry = F.regexp_replace(text, r"^\s+", "")
    said = F.when(entry.contains(" "), F.trim(F.regexp_replace(entry, r"(?s) [^ ]*$", ""))).otherwise(entry)
    return F.when(text.startswith("\t") & (F.trim(entry) != ""), recognized(said))


def corrected(lines: DataFrame, key: str, line: str, text: str) -> DataFrame:
    """lines with removed: true for an entry of a corrected section whose date an earlier entry of it has. Entries without a date stay.

    line: whole numbers, one a line of a key. Null texts are blank lines.
    """
    rows = sections(lines, key, line, text)
    day = F.when((F.col("heading") == CORRECTED) & ~F.col("is_heading"), entry_date(F.col(text)))
    rows = rows.withColumn("__day", day)
    first = rows.where("__day is not null").groupBy(key, "nth", "__day").agg(F.min(line).alias(line)).select(key, line, F.lit(True).alias("__first"))
    rows = rows.join(first, [key, line], "left")
    return rows.withColumn("removed", F.col("__day").isNotNull() & F.col("__first").isNull()).drop("__day", "__first", "is_heading")


def report_entries(pages: DataFrame, split: int = 0, modern: bool = True, first: str = "report_first", body: str = "report") -> DataFrame:
    """(case_id, page, listed, unresolved) of the report pages after split that start an entry or should.

    A run starts where the page before isn't a report page next to it. Modern pages are listed at their first pages only, and a run that
    begins otherwise is unresolved; historical ones have an entry for every named page. A start without a name is unresolved too.
    """
    w = Window.partitionBy("case_id").orderBy("page")
    report = F.col("page_type").isin(first, body) & (F.col("page") > split)
    run = report & ~F.coalesce(F.lag(F.when(report, F.col("page"))).over(w) == F.col("page") - 1, F.lit(False))
    rows = pages.withColumn("report", report).withColumn("run", run).where("report")
    start = (F.col("page_type") == first) if modern else F.col("run")
    fragment = F.col("run") & ~start if modern else F.lit(False)
    rows = rows.withColumn("listed", F.col("named") & (start if modern else F.lit(True))).withColumn("unresolved", fragment | (start & ~F.col("named")))
    return rows.where("listed or unresolved").select("case_id", "page", "listed", "unresolved")
