"""Categories of pages from page types, series, saved ranges and contents, for display only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.blocks import running_max
from pagewright.operators.stages import written_once

#: The types of pages by category, the headings by category, their order, what is shown for one, and the identity of a category.
TYPES = {"hearing": "rt_body", "report": "ct_report", "motion": "ct_motion", "minute_order": "ct_minute_order", "form": "ct_form"}
HEADINGS = {"hearings": "hearing", "reports": "report", "motions": "motion", "minute orders": "minute_order", "forms": "form", "procedural filings": "form"}
ORDER = ("form", "hearing", "report", "motion", "minute_order")
SHOWN = {"form": "PROC. FILINGS"}
UNKNOWN = "unknown"
BLOCK = 4096  # pages


def looked_up(x: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(v) for pair in names.items() for v in pair)), x)


def plain(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", ""))


def heading_category(title: Column) -> Column:
    return F.coalesce(looked_up(plain(title), HEADINGS), F.lit(UNKNOWN))


def display_heading(title: Column) -> Column:
    """Headings of procedural filings by their short name, all others as they are."""
    return F.coalesce(looked_up(heading_category(title), SHOWN), title)


def heading_rank(title: Column) -> Column:
    """The place of a heading's category in the order of display; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, ORDER)), heading_category(title))
    return F.when(at == 0, len(ORDER)).otherwise(at - 1).cast("int")


def type_category(page_type: Column) -> Column:
    """The category of a page type, with or without _first_page; null for blank ones, unknown for others."""
    token = plain(page_type)
    known = F.coalesce(looked_up(F.regexp_replace(token, "_first_page$", ""), {t: c for c, t in TYPES.items()}), F.lit(UNKNOWN))
    return F.when(token != "", known)


def identities(page_type: Column, *record_types: Column) -> Column:
    """The identities (RT, CT) that a page's type prefix and record types name."""
    raw = F.array(*(F.upper(plain(r)) for r in record_types), F.upper(F.split(plain(page_type), "_", 2)[0]))
    return F.array_distinct(F.filter(raw, lambda i: i.isin("RT", "CT")))


def with_series(pages: DataFrame, series: DataFrame) -> DataFrame:
    """pages (case_id, page, page_type, record_type, citation_series_id, series_id, sequence_id) with category and ids of each row.

    The first id that isn't empty names the series (case_id, ordinal, series_id, sequence_id, record_type) of the page; of several rows of
    one series the last by ordinal counts, and a page without an id meets the series without one. Series are few next to pages and
    combine before the join, which is left to the optimizer.
    """
    first = lambda *ids: F.coalesce(*(F.nullif(F.col(i), F.lit("")) for i in ids), F.lit(""))
    last = series.groupBy("case_id", first("series_id", "sequence_id").alias("__series")).agg(F.max_by(F.struct(F.col("record_type").alias("r")), F.struct("ordinal", "record_type")).alias("__of"))
    rows = pages.withColumn("__series", first("citation_series_id", "series_id", "sequence_id")).join(last, ["case_id", "__series"], "left")
    told = rows.withColumn("category", type_category(F.col("page_type"))).withColumn("ids", identities(F.col("page_type"), F.col("record_type"), F.col("__of.r")))
    return told.drop("__series", "__of")


def page_categories(pages: DataFrame, typed: DataFrame, ranges: DataFrame, listed: DataFrame, agreement: bool = False) -> DataFrame:
    """(case_id, page, category, provenance, status, record_type) of each of pages (case_id, page).

    typed: case_id, page, tier (0 transcript, 1 source_map), category, ids, as of with_series. ranges: case_id, start_page, end_page,
    category. listed: case_id, page, title of contents. The best of transcript, source_map and boundary that says anything decides; with
    agreement all three are asked. Where none says anything and the identities agree, the contents' headings do. Several categories or identities,
    or a category that isn't of the page's identity (RT for hearings, CT for others), are a conflict; unknown alone is unknown.

    A page lies in a range if the greatest end of the starts up to it reaches it. That is found within blocks of BLOCK pages, and what
    earlier blocks reach is carried on block by block, so no case is one task. Repeated pages give one row.
    Ranges are written once: they are used four times, and Spark fails where a union of rows dealt by case meets others of the case
    without a new shuffle and its sides are then coalesced.
    """
    known = pages.select("case_id", "page").where("page > 0").distinct()
    of = written_once(ranges.where("start_page <= end_page").select("case_id", "category", F.col("start_page").alias("page"), F.lit(0).alias("is_page"), F.col("end_page").alias("reach")))
    kinds = of.select("case_id", "category").distinct()
    asked = known.join(kinds, "case_id").select("case_id", "category", "page", F.lit(1).alias("is_page"), F.lit(None).cast(of.schema["reach"].dataType).alias("reach"))
    rows = running_max(of.unionByName(asked), ["case_id", "category"], ["page", "is_page"], ["reach"], BLOCK)
    inside = rows.where("is_page = 1 and page <= reach")

    row = lambda df, tier, ids: df.select("case_id", "page", tier.cast("int").alias("tier"), "category", ids.alias("ids"))
    none = F.array().cast("array<string>")
    heads = listed.select("case_id", "page", heading_category(F.col("title")).alias("category")).where(F.col("category") != UNKNOWN)
    said = row(typed, F.col("tier"), F.col("ids")).unionByName(row(inside, F.lit(2), none)).unionByName(row(heads, F.lit(3), none))
    # Of each set only the least and the greatest are kept: they tell whether it is empty, has one or several, and which.
    ends = [f(F.when(F.col("tier") == t, F.col("category"))).alias(f"{n}{t}") for t in range(4) for n, f in (("lo", F.min), ("hi", F.max))]
    ends += [F.min(F.array_min("ids")).alias("lo_id"), F.max(F.array_max("ids")).alias("hi_id")]
    rows = known.join(said.groupBy("case_id", "page").agg(*ends), ["case_id", "page"], "left")

    names = F.when(F.col("lo0").isNotNull(), "transcript").when(F.col("lo1").isNotNull(), "source_map").when(F.col("lo2").isNotNull(), "boundary")
    several = F.coalesce(F.col("lo_id") != F.col("hi_id"), F.lit(False))
    names = F.coalesce(names, F.when(F.col("lo3").isNotNull() & ~several, "toc"), F.lit("none"))
    rows = rows.withColumn("provenance", names)
    of = lambda n: F.when(names == "transcript", F.col(f"{n}0")).when(names == "source_map", F.col(f"{n}1")).when(names == "boundary", F.col(f"{n}2")).when(names == "toc", F.col(f"{n}3"))
    every = lambda n, f: F.when(names == "toc", F.col(f"{n}3")).otherwise(f(*(f"{n}{t}" for t in range(3))))
    rows = rows.withColumns({"lo": every("lo", F.least) if agreement else of("lo"), "hi": every("hi", F.greatest) if agreement else of("hi")})
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    expected = F.when(one == "hearing", "RT").when(one != UNKNOWN, "CT")
    clash = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)) | several | F.coalesce(F.col("lo_id") != expected, F.lit(False))
    status = F.when(clash, "conflict").when(F.coalesce(one, F.lit(UNKNOWN)) != UNKNOWN, "classified").otherwise(UNKNOWN)
    category = F.when(status == "classified", one).otherwise(UNKNOWN)
    identity = F.when(F.col("lo_id") == F.col("hi_id"), F.col("lo_id")).otherwise("")
    return rows.select("case_id", "page", category.alias("category"), "provenance", status.alias("status"), identity.alias("record_type"))
