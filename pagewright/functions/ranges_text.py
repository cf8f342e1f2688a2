"""Range lists as text, and predicates on quotations and case numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_list(x: Column) -> Column:
    """ARRAY<STRUCT<start,end>> of "5-3, 7": ends swapped if needed, single pages as ranges, other parts dropped."""
    parts = F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d{1,9}( *[-–] *\d{1,9})?$"))

    def pair(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"^(\d+)", 1).cast("int"), F.regexp_extract(p, r"(\d+)$", 1).cast("int")
        return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))

    return F.transform(parts, pair)


def range_text(ranges: Column) -> Column:
    return F.array_join(F.transform(ranges, lambda r: F.when(r["start"] == r["end"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"], r["end"]))), ", ")


def whole_words_of(selection: Column, quote: Column) -> Column:
    """Whether the selection stands in the quote, whole words only; regular-expression characters count as themselves."""
    itself = F.regexp_replace(selection, r"([^\p{L}\p{N}\p{M}\s])", r"\\$1")
    pattern = F.concat(F.lit(r"(?s)(?<![\p{L}\p{N}\p{M}])"), itself, F.lit(r"(?![\p{L}\p{N}\p{M}])"))
    return F.coalesce((F.trim(selection) != "") & F.regexp_like(quote, pattern), F.lit(False))


def only_capitals_differ(a: Column, b: Column) -> Column:
    return (F.lower(a) == F.lower(b)) & (F.length(a) == F.length(b))


def identity_conflict(a: Column, b: Column) -> Column:
    """Both lists of case numbers are there and share none."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
