"""Proposed corrections of pages: whether one can be applied, and whether it changes any selected document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pagewright.functions.dates import long_date, recognized
from pagewright.operators.blocks import running_max
from pagewright.operators.stages import written_once

#: Fields that may change, types of pages of each side, families of documents by type, fields and bases of motions.
FIELDS = ("page_type", "report_first_page", "motion_first_page", "name", "date", "date_basis", "naming_rule_id")
SIDES = {
    "RT": ("RT_cover", "RT_index", "RT_body", "RT_certificate", "RT_other"),
    "CT": ("CT_cover", "CT_index", "CT_minute_order", "CT_report", "CT_form", "CT_certificate", "CT_motion", "CT_notice", "CT_proof_of_service", "CT_other"),
}
FAMILIES = {"CT_report": "report", "CT_motion": "motion", "CT_minute_order": "minute_order", "RT_body": "hearing", "CT_form": "form"}
FIRST = "_first_page"
MOTION_FIELDS = ("name", "naming_rule_id", "date", "date_basis")
BASES = ("filed", "document", "unknown")
MOST, MOST_MOTION_NAME = 200, 1024

EMPTY = "map<string,string>"


def without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def having(m: Column, key: str, value: Column) -> Column:
    return F.map_concat(without(m, key), F.create_map(F.lit(key), value))


def said(m: Column, key: str) -> Column:
    return F.coalesce(F.element_at(m, key), F.lit(""))


def applied(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (case_id, page, before, after) with fields, the page's own after the change, or reason, why it can't be applied.

    pages: case_id, page, fields MAP<STRING,STRING>, one row a page; before and after have the same keys, and null stands for a missing
    field. Reasons, the first that holds: no_page, before_values, too_long, page_type (unknown, or of the other side), motion_check,
    motion_basis, date, name (on a page that can't have one), report_check (first pages of reports marked otherwise than by their type, or
    marks in a case without any), no_change. Naming rules themselves aren't judged here.
    """
    kind_of = F.element_at("fields", "page_type")
    is_report = F.coalesce(kind_of.isin("CT_report", "CT_report" + FIRST), F.lit(False))
    marked = is_report & (F.map_contains_key("fields", F.lit("report_first_page")) | (kind_of == "CT_report" + FIRST))
    modes = pages.groupBy("case_id").agg((F.coalesce(F.max(marked), F.lit(False)) | ~F.coalesce(F.max(is_report), F.lit(False))).alias("__modern"))
    none = F.create_map().cast(EMPTY)
    rows = changes.join(pages.select("case_id", "page", F.col("fields").alias("__was")), ["case_id", "page"], "left").join(modes, "case_id", "left")
    was, before, after = F.coalesce("__was", none), F.coalesce("before", none), F.coalesce("after", none)
    has = lambda k: F.map_contains_key(after, F.lit(k))
    keys = lambda m: F.array_sort(F.map_keys(m))
    fits = (F.size(after) > 0) & (keys(before) == keys(after)) & F.forall(F.map_keys(after), lambda k: k.isin(*FIELDS))
    agrees = F.forall(F.map_entries(before), lambda e: e["value"].eqNullSafe(F.element_at(was, e["key"])))
    rows = rows.withColumn("__row", F.map_concat(F.map_filter(was, lambda k, v: ~F.array_contains(F.map_keys(after), k)), F.map_filter(after, lambda k, v: v.isNotNull())))

    side, old, kind = F.substring(said(was, "page_type"), 1, 2), said(was, "page_type"), said(F.col("__row"), "page_type")
    motion_first = "CT_motion" + FIRST
    proposed = F.when(has("page_type"), said(after, "page_type")).otherwise(old)
    most = lambda k: F.when((k == "name") & (proposed == motion_first), MOST_MOTION_NAME).otherwise(MOST)
    short = F.forall(F.map_entries(F.map_filter(after, lambda k, v: v.isNotNull())), lambda e: F.length(e["value"]) <= most(e["key"]))
    allowed = F.coalesce(*(F.when(side == s, kind.isin(*types, *(t + FIRST for t in FAMILIES if t.startswith(s)))) for s, types in SIDES.items()), F.lit(False))
    rows = rows.withColumn("__kind", kind).withColumn("__allowed", allowed).withColumn("__short", short)

    left = (old == motion_first) & (F.col("__kind") != motion_first)
    gone = F.filter(F.array(*map(F.lit, MOTION_FIELDS)), lambda k: ~F.array_contains(F.map_keys(after), k))
    row = F.when(left, F.map_filter("__row", lambda k, v: ~F.array_contains(gone, k))).otherwise(F.col("__row"))
    rows = rows.withColumn("__row", row)
    row, kind = F.col("__row"), F.col("__kind")
    motion, first = kind.isin("CT_motion", motion_first), kind == motion_first
    expected = F.when(first, "yes").otherwise("no")
    check = motion & has("motion_first_page") & (said(row, "motion_first_page") != expected)
    basis = F.coalesce(F.element_at(row, "date_basis"), F.lit("unknown"))
    rows = rows.withColumn("__check", check).withColumn("__basis", first & ~basis.isin(*BASES))
    row = F.when(motion & (has("page_type") | has("motion_first_page")), having(row, "motion_first_page", expected)).when(~motion, without(row, "motion_first_page")).otherwise(row)
    row = F.when(first, having(row, "date_basis", F.when(said(row, "date") != "", basis).otherwise("unknown"))).otherwise(without(row, "date_basis"))
    rows = rows.withColumn("__row", row)

    row = F.col("__row")
    date, name = said(row, "date"), said(row, "name")
    dated = kind.endswith(FIRST) & (kind != "CT_form" + FIRST) & recognized(date).isNotNull() & (long_date(date) == date)
    bad_date = (date != "") & (has("date") | has("page_type")) & ~F.coalesce(dated, F.lit(False))
    nameable = kind.isin("CT_report" + FIRST, "CT_form" + FIRST, motion_first)
    bad_name = (name != "") & (has("name") | has("page_type") | has("naming_rule_id")) & ~nameable
    report, mark = kind.isin("CT_report", "CT_report" + FIRST), F.element_at(row, "report_first_page")
    wrong = F.when(report & F.col("__modern"), ~F.coalesce(mark == F.when(kind.endswith(FIRST), "yes").otherwise("no"), F.lit(False)))
    wrong = wrong.when(report, mark.isNotNull() | kind.endswith(FIRST)).otherwise(mark.isNotNull())
    final = F.when((name == "") | ~nameable, without(row, "naming_rule_id")).otherwise(row)
    rows = rows.withColumns({"__date": bad_date, "__name": bad_name, "__report": wrong, "__row": final})
    entries = lambda m: F.array_sort(F.map_entries(m))
    reason = (
        F.when(F.col("__was").isNull(), "no_page").when(~F.coalesce(fits & agrees, F.lit(False)), "before_values").when(~F.col("__short"), "too_long").when(~F.col("__allowed"), "page_type").when(F.col("__check"), "motion_check")
        .when(F.col("__basis"), "motion_basis").when(F.col("__date"), "date").when(F.col("__name"), "name").when(F.col("__report"), "report_check").when(entries(F.col("__row")) == entries(was), "no_change")
    )
    rows = rows.withColumn("reason", reason).withColumn("fields", F.when(F.col("reason").isNull(), F.col("__row")))
    return rows.select(*changes.columns, "fields", "reason")


def documents_of(runs: list[tuple]) -> list[tuple]:
    """(family, start, end, name, date) of runs of pages (start, end, type, name, date) in order; first pages are runs of their own."""
    found: list[list] = []
    now = None  # the document that the next page may continue
    for start, end, kind, name, date in runs:
        family = FAMILIES.get(kind.removesuffix(FIRST))
        if family and kind.endswith(FIRST):
            named = name if family in ("report", "motion", "form") else ""
            now = [family, start, start if family == "form" else end, named, "" if family == "form" else date]
            if named or family in ("minute_order", "hearing"):
                found.append(now)
            if family == "form":
                now = None
        elif now and family == now[0] and now[2] + 1 == start:
            now[2] = end
        else:
            now = None
    return [tuple(f) for f in found]


def kept_in(rows: list[tuple]) -> list[bool]:
    """For each row (start, end, nth, old (type, name, date), new), whether its change is kept; rows without one (nth None) give False.

    Changes are tried in their order against what is left of the others; one goes if the documents stay the same without it. Only what
    lies between the first pages around it is read again.
    """
    now = [new for *_, new in rows]
    kept = [False] * len(rows)

    def starts(i: int) -> bool:
        return now[i][0].endswith(FIRST)

    for i in sorted((i for i, r in enumerate(rows) if r[2] is not None), key=lambda i: (rows[i][2], rows[i][0])):
        low, high = i - 1, i + 1
        while low > 0 and not starts(low):
            low -= 1
        while high < len(rows) and not starts(high):
            high += 1
        low = max(low, 0)
        have = documents_of([(*rows[j][:2], *now[j]) for j in range(low, high)])
        less = documents_of([(*rows[j][:2], *(rows[j][3] if j == i else now[j])) for j in range(low, high)])
        kept[i] = have != less
        if not kept[i]:
            now[i] = rows[i][3]
    return kept


def effective(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """(case_id, page, nth, kept) of changes: whether the selected documents of the case differ without it, the others being applied.

    pages: case_id, page, page_type, name, date; changes: case_id, page, nth (their order) and the same three as they are afterwards; one row a page each.
    Changes are tried by nth, as if one by one over the whole case: one that changes nothing is taken back before the next is tried. So
    two pages that mend one gap together stay together. Changes of unknown pages aren't kept. Nulls are empty texts.

    No document reaches over a page that begins one before and after, nor from one page to another of a family that the first can't have.
    Pages are written before and after the running values, as each is used twice.

    A case is cut there, and pieces are judged by themselves. In a piece unchanged pages of one type are one row, so what a task holds
    grows with the changes of a piece, not with the length of a case or document.
    """
    three = ("page_type", "name", "date")
    blank = lambda c, as_: F.coalesce(F.col(c), F.lit("")).alias(as_)
    new = changes.select("case_id", "page", "nth", *(blank(c, f"new_{c}") for c in three))
    rows = pages.select("case_id", "page", *(blank(c, c) for c in three)).join(new, ["case_id", "page"], "left")
    rows = rows.withColumn("changed", F.col("nth").isNotNull()).withColumns({f"new_{c}": F.coalesce(f"new_{c}", c) for c in three})
    family = lambda c: F.regexp_replace(F.col(c), FIRST + "$", "")
    families = F.filter(F.array(family("page_type"), family("new_page_type")), lambda f: f.isin(*FAMILIES))
    rows = rows.withColumn("families", families)
    came = rows.select("case_id", (F.col("page") + 1).alias("page"), F.col("families").alias("__f"), F.col("page_type").alias("__t"), F.col("changed").alias("__c"))
    rows = rows.join(came, ["case_id", "page"], "left")
    begins = ~F.col("changed") & F.col("page_type").endswith(FIRST)
    cut = begins | ~F.coalesce(F.arrays_overlap("families", "__f"), F.lit(False))
    run = cut | begins | F.col("changed") | F.coalesce(F.col("__c") | (F.col("__t") != F.col("page_type")), F.lit(True))
    rows = rows.withColumn("piece", F.when(cut, F.col("page"))).withColumn("run", F.when(run, F.col("page"))).drop("__f", "__t", "__c", "families")
    rows = written_once(running_max(written_once(rows), ["case_id"], ["page"], ["piece", "run"]))
    rows = rows.join(rows.where("changed").select("case_id", "piece").distinct(), ["case_id", "piece"], "left_semi")
    firsts = [F.min_by(c, "page").alias(c) for c in (*three, *(f"new_{c}" for c in three), "nth")]
    runs = rows.groupBy("case_id", "piece", "run").agg(F.max("page").alias("end"), *firsts)

    page = pages.schema["page"].dataType.simpleString()
    held = F.sort_array(F.collect_list(F.struct("run", "end", F.struct(*three).alias("old"), F.struct(*(f"new_{c}" for c in three)).alias("new"), "nth")))

    @pandas_udf(f"array<struct<page:{page},kept:boolean>>")
    def judge(pieces: pd.Series) -> pd.Series:
        out = []
        for piece in pieces:
            kept = kept_in([(r["run"], r["end"], r["nth"], tuple(r["old"].values()), tuple(r["new"].values())) for r in piece])
            out.append([{"page": r["run"], "kept": k} for r, k in zip(piece, kept) if r["nth"] is not None])
        return pd.Series(out)

    judged = runs.groupBy("case_id", "piece").agg(held.alias("held")).select("case_id", F.inline(judge("held")))
    found = changes.select("case_id", "page", "nth").join(judged, ["case_id", "page"], "left")
    return found.withColumn("kept", F.coalesce("kept", F.lit(False)))
