"""Document ranges from page sequences: gaps and islands in one window pass per case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_page():
    return Window.partitionBy("case_id").orderBy("page")


def report_ranges(pages: DataFrame, first: str = "report_first", body: str = "report", split: int = 0, modern: bool = True) -> DataFrame:
    """(case_id, start_page, end_page, n_pages, start_detected): a range opens at a type break, a page gap or a first page.

    A fragment without its first page stays, with start_detected false. Pages up to split are ignored. Historical pages (not modern) were
    never checked for first pages: there these open no range, and every range counts as detected.
    """
    rows = pages.where(F.col("page_type").isin(first, body) & (F.col("page") > split))
    opens = F.lag("page").over(by_page()).isNull() | (F.col("page") != F.lag("page").over(by_page()) + 1)
    opens = opens | (F.col("page_type") == first) if modern else opens
    rows = rows.withColumn("r", F.sum(opens.cast("int")).over(by_page()))
    spans = rows.groupBy("case_id", "r").agg(
        F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("n_pages"), (F.min_by("page_type", "page") == first if modern else F.lit(True)).alias("start_detected")
    )
    return spans.drop("r")


def started_ranges(pages: DataFrame, start: str = "minute_start", body: str = "minute_body", first_page: int = 1, last_page: int | None = None) -> DataFrame:
    """(case_id, start_page, end_page, n_pages): an explicit start and the body pages strictly adjacent to it; orphans are ignored."""
    rows = pages.where(F.col("page_type").isin(start, body) & (F.col("page") >= first_page))
    rows = rows.where(F.col("page") <= last_page) if last_page is not None else rows
    rows = rows.withColumn("r", F.sum((F.col("page_type") == start).cast("int")).over(by_page())).where("r > 0")
    inside = Window.partitionBy("case_id", "r").orderBy("page")
    rows = rows.withColumn("ahead", F.col("page") - F.first("page").over(inside) - F.row_number().over(inside) + 1).where("ahead = 0")
    return rows.groupBy("case_id", "r").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("n_pages")).drop("r")


def motion_pages(pages: DataFrame, first: str = "motion_first", body: str = "motion") -> DataFrame:
    """Pages of motion runs with lead (the first named first page of the run) and component (0 before the lead)."""
    rows = pages.where(F.col("page_type").isin(first, body)).withColumn("run", F.col("page") - F.row_number().over(by_page()))
    run = Window.partitionBy("case_id", "run")
    is_first = F.col("page_type") == first
    rows = rows.withColumn("lead", F.min(F.when(is_first & F.col("named"), F.col("page"))).over(run))
    inside = F.coalesce(F.col("page") >= F.col("lead"), F.lit(False))
    return rows.withColumn("inside", inside).withColumn("component", F.sum((inside & is_first).cast("int")).over(run.orderBy("page")))


def motion_packets(pages: DataFrame) -> DataFrame:
    """(case_id, paper_id, packet_page, role, start_page, end_page): lead and continuation papers of each packet."""
    rows = motion_pages(pages).where("inside")
    papers = rows.groupBy("case_id", "lead", "component").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    return papers.select(
        "case_id", F.format_string("motion:%04d", "start_page").alias("paper_id"), F.col("lead").alias("packet_page"),
        F.when(F.col("component") == 1, "lead").otherwise("continuation").alias("role"), "start_page", "end_page",
    )


def omitted_fragments(pages: DataFrame) -> DataFrame:
    """(case_id, start_page, end_page, n_pages) of motion pages before a run's lead, or of runs without one."""
    rows = motion_pages(pages).where("not inside")
    return rows.groupBy("case_id", "run").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count("*").alias("n_pages")).drop("run")


def selected_documents(pages: DataFrame) -> DataFrame:
    """(case_id, kind, start_page, end_page) of reports with a detected start and motion packets."""
    reports = report_ranges(pages).where("start_detected").select("case_id", F.lit("report").alias("kind"), "start_page", "end_page")
    packets = motion_packets(pages).groupBy("case_id", "packet_page").agg(F.max("end_page").alias("end_page"))
    return reports.unionByName(packets.select("case_id", F.lit("motion").alias("kind"), F.col("packet_page").alias("start_page"), "end_page"))


def motion_boundaries(pages: DataFrame) -> DataFrame:
    """(case_id, start_page, end_page, n_pages) of named motions alone: ranges cut at every first page, kept if their first page is named."""
    found = report_ranges(pages, "motion_first", "motion").where("start_detected").drop("start_detected")
    named = pages.where("named").select("case_id", F.col("page").alias("start_page"))
    return found.join(named, ["case_id", "start_page"], "left_semi")


def all_documents(pages: DataFrame) -> DataFrame:
    """(case_id, kind, start_page, end_page) of pages (case_id, page, page_type, named), one row a page: named reports and motions, all minute
    orders and hearings, named forms. An unnamed first page still ends the range before it.

    What report_ranges and started_ranges give for each kind, in one pass over the pages of a case: a page belongs to one kind.
    """
    first = {"report": "report_first", "motion": "motion_first", "minute_order": "minute_start", "hearing": "hearing_start", "form": "form_first"}
    body = {"report": "report", "motion": "motion", "minute_order": "minute_body", "hearing": "hearing_body"}
    kinds = [F.when(F.col("page_type").isin(t, *([body[k]] if k in body else [])), k) for k, t in first.items()]
    rows = pages.select("case_id", "page", F.coalesce(*kinds).alias("kind"), F.col("page_type").isin(*first.values()).alias("first"), F.coalesce("named", F.lit(False)).alias("named"))
    rows = rows.where("kind is not null and page is not null and (kind = 'form' or page > 0)")
    w = Window.partitionBy("case_id", "kind").orderBy("page")
    gap = F.coalesce(F.col("page") != F.lag("page").over(w) + 1, F.lit(True))
    rows = rows.withColumn("opens", F.col("first") | gap)
    rows = rows.withColumn("r", F.sum(F.col("opens").cast("int")).over(w))
    found = rows.groupBy("case_id", "kind", "r").agg(
        F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.bool_or("first").alias("detected"), F.bool_or(F.col("first") & F.col("named")).alias("named")
    )
    found = found.where("detected and (named or kind in ('minute_order', 'hearing'))")
    return found.select("case_id", "kind", "start_page", "end_page")


def same_date_starts(starts: DataFrame) -> DataFrame:
    """starts (case_id, kind, start_page, date) of hearings and minute orders with same_date_as_previous: the start before it in page order
    is of its kind and has its date; an empty date equals none."""
    w = Window.partitionBy("case_id").orderBy("start_page", "kind")
    dated = F.coalesce(F.col("date") != "", F.lit(False))
    same = (F.lag("kind").over(w) == F.col("kind")) & (F.lag("date").over(w) == F.col("date")) & dated
    return starts.withColumn("same_date_as_previous", F.coalesce(same, F.lit(False)))
