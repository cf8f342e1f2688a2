"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse(x: Column) -> Column:
    """White space runs (Unicode) as one space, trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), r"(?U)\s+", " "))


def without_controls(x: Column) -> Column:
    """Without control characters but newline and tab."""
    return F.regexp_replace(x, r"[\p{Cc}&&[^\n\t]]", "")


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def page_number(name: Column) -> Column:
    """The first digit run of the stem, else null."""
    return F.regexp_extract(file_stem(name), r"(\d+)", 1).try_cast("int")


def natural_key(x: Column) -> Column:
    """A string that sorts digit runs by value, at any length: each run is led by its number of digits; letters are lower case."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    led = lambda p: F.concat(F.lit("\x00"), F.lpad(F.length(digits(p)).cast("string"), 9, "0"), digits(p))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), led(p)).otherwise(p)), "")


def without_images(x: Column) -> Column:
    """Markdown without the lines that are nothing but an image."""
    return F.regexp_replace(x, r"(?m)^[ \t]*!\[[^\]]*\]\([^)\s]+\)[ \t]*\n?", "")


def positive_page(x: Column) -> Column:
    """A whole number from 1 up written in ASCII digits; anything else is null."""
    v = F.trim(x.cast("string"))
    n = F.when(v.rlike(r"^[0-9]{1,9}$"), v.cast("int"))
    return F.when(n > 0, n)


def bounded_text(x: Column, most: int = 1024, otherwise: str = "") -> Column:
    """The trimmed text if it is printable, not blank and, untrimmed, no longer than most characters; else the fallback."""
    v = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.when((v != "") & (F.length(x) <= most) & ~x.rlike(r"[\p{C}\p{Z}&&[^ ]]"), v).otherwise(otherwise)


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin("true", "yes", "y", "1", "relevant", "keep"), F.lit(False))


def normal_key(k: Column) -> Column:
    return F.regexp_replace(F.lower(k), "[^a-z0-9]", "")


def field(row: Column, *names: str) -> Column:
    """A map's value by the first of the names that is there exactly (even blank), else by normalised key; null is empty, trimmed."""
    exact = F.coalesce(*(F.try_element_at(row, F.lit(n)) for n in names))
    plain = F.map_entries(row)

    def loose(name: str) -> Column:
        return F.get(F.filter(plain, lambda e: normal_key(e["key"]) == normal_key(F.lit(name))), F.lit(0))["value"]

    return F.trim(F.coalesce(exact, *map(loose, names), F.lit("")))


def citation_label(x: Column) -> Column:
    """White space collapsed, a page mark after the prefix dropped: "CT  p. 12" is "CT 12"."""
    return F.regexp_replace(collapse(x), r"\b([A-Za-z0-9]+) pp?\. ?", "$1 ")


def citation_key(prefix: Column, number: Column) -> Column:
    return F.when((F.trim(prefix) != "") & (number > 0), F.concat(F.upper(F.trim(prefix)), F.lit(":"), number.cast("string"))).otherwise(F.lit(""))


def report_id(start: Column) -> Column:
    return F.format_string("report:%04d", start)


def report_label(name: Column, date: Column) -> Column:
    """"date - name", or whichever is there, else "Report"."""
    n, d = F.trim(F.coalesce(name, F.lit(""))), F.trim(F.coalesce(date, F.lit("")))
    return F.when((n != "") & (d != ""), F.concat(d, F.lit(" - "), n)).when(n != "", n).when(d != "", d).otherwise("Report")


def toc_line(label: Column, page: Column) -> Column:
    return F.concat(F.lit("\t"), F.coalesce(label, F.lit("")), F.lit(" "), F.coalesce(page.cast("string"), F.lit("")))


def token_range(x: Column) -> tuple[Column, Column]:
    """Least and greatest token estimate: a quarter and a third of the bytes, rounded down."""
    n = F.octet_length(F.coalesce(x, F.lit("")))
    return F.floor(n / 4), F.floor(n / 3)


#: Characters that draw table borders; the first three also stand between columns.
BORDERS = "│┃║╎╏┆┇┊┋─━═┄┅┈┉┌┐└┘├┤┬┴┼╭╮╰╯+"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"
#: What goes from a line, in this order, and what comes in its place.
MARGINS = (
    (r"^[│┃║]\s*\d+\s*[│┃║]\s*", ""),
    (r"^\d+\s*[│┃║]\s*", ""),
    (r"^\s*\d{1,3}\s{2,}", ""),
    (r"""^\s*\d{1,2}\s+(?=[A-Za-z("'])""", ""),
    (r"^\s*[│┃║]\s*", ""),
    (r"\s*[│┃║]\s*$", ""),
    (r"\s*[│┃║]\s*", "    "),
    (r" {5,}", "    "),
)


def strip_margins(x: Column) -> Column:
    """Line by line: rules drawn with border characters go, numbers in the left margin go, column bars and wide gaps become four spaces.

    Mark-up of tables is for html_text.strip_tables, which comes before. Blank lines stay as empty ones; a last line end goes.
    """
    stripped = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    lines = F.transform(F.split(F.regexp_replace(x, f"(?:{LINE_ENDS})\\z", ""), LINE_ENDS), stripped)
    lines = F.filter(lines, lambda s: ~s.rlike(f"(?U)^[{BORDERS}\\s]*[{BORDERS}][{BORDERS}\\s]*$"))

    def clean(s: Column) -> Column:
        for pattern, by in MARGINS:
            s = F.regexp_replace(s, f"(?U){pattern}", by)
        return stripped(s)

    return F.array_join(F.transform(lines, clean), "\n")


def quote_flags(x: Column, normal: Column) -> Column:
    """Flags of a quotation that isn't 6 to 12 words, has an ellipsis or ends in a full stop, "!" or "?", with or without a closing mark.

    normal: the quotation as locate.normalised has it, whose words are counted.
    """
    n = F.size(F.filter(F.split(normal, " "), lambda w: w != ""))
    flags = F.array(
        F.when((n < 6) | (n > 12), F.lit("length")), F.when(x.rlike(r"(?U)\.\s*\.\s*\.|…"), F.lit("ellipsis")), F.when(x.rlike(r"(?U)[.!?][”\"]?\s*\z"), F.lit("terminal"))
    )
    return F.filter(flags, lambda f: f.isNotNull())
