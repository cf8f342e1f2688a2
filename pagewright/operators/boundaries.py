"""Saved boundaries: structure first, then dates and names; what is left out, and work items with the records they meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.dates import recognized


def source_page(x: Column) -> Column:
    """The number of a page written as digits with or without .txt, from 1 up; else null."""
    n = F.regexp_extract(F.coalesce(x.cast("string"), F.lit("")), r"^([0-9]{1,9})(?:\.txt)?$", 1).try_cast("int")
    return F.when(n >= 1, n)


def said_page(entries: DataFrame, key: str, second: str) -> Column:
    """The page under key, or under the second name where key is missing, null, empty or the number nought."""
    empty = {c: F.col(c).cast("string").isin("", *([] if entries.schema[c].dataType.simpleString() == "string" else ["0"])) for c in (key, second) if c in entries.columns}
    return F.coalesce(*(F.when(~e, F.col(c).cast("string")) for c, e in empty.items()))


def structure_issues(entries: DataFrame) -> DataFrame:
    """(case_id, entry_id, rule) of saved boundaries: malformed, reversed, or overlapping the one before.

    entries: case_id, entry_id, and start_page and end_page or, by their second names, start and end.
    """
    rows = entries.select("case_id", "entry_id", source_page(said_page(entries, "start_page", "start")).alias("s"), source_page(said_page(entries, "end_page", "end")).alias("e"))
    w = Window.partitionBy("case_id").orderBy("s", "e", "entry_id").rowsBetween(Window.unboundedPreceding, -1)
    fine = F.col("s") <= F.col("e")
    earlier = F.max(F.when(fine, F.col("e"))).over(w)
    rules = F.when(F.col("s").isNull() | F.col("e").isNull(), "malformed").when(~fine, "reversed").when(F.col("s") <= earlier, "overlap")
    return rows.select("case_id", "entry_id", rules.alias("rule")).where("rule is not null")


def dated_boundaries(entries: DataFrame) -> DataFrame:
    """entries with status kept or omitted by their date, or refused: a case with any structural issue is judged no further."""
    bad = structure_issues(entries).select("case_id").distinct().withColumn("_bad", F.lit(True))
    rows = entries.join(bad, "case_id", "left")
    status = F.when(F.col("_bad"), "refused").when(recognized(F.col("date")).isNotNull(), "kept").otherwise("omitted")
    return rows.withColumn("status", status).drop("_bad")


def omission_lines(omitted: DataFrame, size: int = 20) -> DataFrame:
    """(case_id, batch, ranges): the omitted (case_id, start_page, end_page) of each case as text, size of them a line."""
    w = Window.partitionBy("case_id").orderBy("start_page", "end_page")
    shown = F.when(F.col("start_page") == F.col("end_page"), F.format_string("%04d", "start_page")).otherwise(F.format_string("%04d-%04d", "start_page", "end_page"))
    rows = omitted.select("case_id", F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("batch"), F.struct("start_page", "end_page", shown.alias("t")).alias("x"))
    return rows.groupBy("case_id", "batch").agg(F.array_join(F.sort_array(F.collect_list("x"))["t"], ", ").alias("ranges"))


#: Why minute orders are left out, and what is said about it.
NO_DATE = "minute_date_unresolved"
COUNTED = " minute candidates omitted: {}. Source pages remain available; missing dates do not prove misclassification."
LISTED = "Omitted minute source-page ranges: "


def omission_messages(omitted: DataFrame, size: int = 20) -> DataFrame:
    """(case_id, nth, message): message 0 counts the omitted ranges of a case, the others list them, size a message."""
    counts = omitted.groupBy("case_id").agg(F.lit(0).alias("nth"), F.concat(F.count("*").cast("string"), F.lit(COUNTED.format(NO_DATE))).alias("message"))
    lines = omission_lines(omitted, size)
    return counts.unionByName(lines.select("case_id", (F.col("batch") + 1).alias("nth"), F.concat(F.lit(LISTED), "ranges", F.lit(".")).alias("message")))


def retained(entries: DataFrame) -> DataFrame:
    """entries (kind, name, date, naming_status) with keep and reason: hearings need a date, reports and motions a name that is not unresolved,
    minute orders a date that is recognised."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    kind = F.col("kind")
    reason = (
        F.when((kind == "hearing") & blank("date"), "undated").when(kind.isin("report", "motion") & blank("name"), "unnamed")
        .when(kind.isin("report", "motion") & F.coalesce(F.col("naming_status") == "unresolved", F.lit(False)), "unresolved")
        .when((kind == "minute_order") & recognized(F.col("date")).isNull(), "unrecognized_date")
    )
    return entries.withColumn("reason", reason).withColumn("keep", reason.isNull())


def work_items(boundaries: DataFrame, participants: DataFrame) -> DataFrame:
    """(case_id, ordinal, start_page, end_page, n_people, issue) of the boundaries of each case in page order.

    A record of participants (case_id, start_page, end_page, n_people) belongs to the item of just those pages; of repeated records the least count is taken. issue: unmatched (no such
    record), repeated (several), overlap (the item before reaches into it), orphan (a record without an item; it has no ordinal).
    """
    key = ["case_id", "start_page", "end_page"]
    w = Window.partitionBy("case_id").orderBy("start_page", "end_page")
    items = boundaries.select(*key).withColumn("ordinal", F.row_number().over(w))
    items = items.withColumn("_before", F.max("end_page").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    people = participants.groupBy(*key).agg(F.count("*").alias("_n"), F.min("n_people").alias("n_people"))
    issue = (
        F.when(F.col("ordinal").isNull(), "orphan").when(F.col("start_page") <= F.col("_before"), "overlap").when(F.col("_n").isNull(), "unmatched").when(F.col("_n") > 1, "repeated")
    )
    return items.join(people, key, "full").select("case_id", "ordinal", "start_page", "end_page", "n_people", issue.alias("issue"))
