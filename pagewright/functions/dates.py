"""Date text: recognition in a fixed order of formats and reformatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.text import collapse


def without_weekday(x: Column) -> Column:
    return F.regexp_replace(collapse(x), r"(?i)^(?:mon|tues|wednes|thurs|fri|satur|sun)day,? +", "")


def recognized(x: Column) -> Column:
    """The date of "March 5, 2026", "Mar 5, 2026", 3/5/2026, 3/5/26 or 2026-03-05; else null. Two-digit years from 69 are 19xx."""
    v = without_weekday(x)
    parse = lambda fmt: F.try_to_timestamp(v, F.lit(fmt)).cast("date")
    long = F.when(v.rlike(r"^[A-Za-z]+ \d{1,2}, \d{4}$"), F.coalesce(parse("MMMM d, yyyy"), parse("MMM d, yyyy")))
    slash4 = F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), parse("M/d/yyyy"))
    slash2 = F.when(v.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), parse("M/d/yy"))
    late = F.substring(v, -2, 2).try_cast("int") >= 69
    slash2 = F.when(late, F.add_months(slash2, -1200)).otherwise(slash2)
    iso = F.when(v.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), parse("yyyy-M-d"))
    return F.coalesce(long, slash4, slash2, iso)


def long_date(x: Column) -> Column:
    """"March 5, 2026" where a date is recognised, else the text without its weekday."""
    return F.coalesce(F.date_format(recognized(x), "MMMM d, yyyy"), without_weekday(x))
