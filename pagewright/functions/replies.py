"""Model answers as data: finding the payload, reading fields, normalising them; nothing here calls a model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.dates import recognized, without_weekday
from pagewright.functions.text import collapse

#: What counts as yes and no in an answer.
YES, NO = ("yes", "y", "true", "1"), ("no", "n", "false", "0")
#: English month names.
MONTHS = "January February March April May June July August September October November December".split()


def json_payload(reply: Column) -> Column:
    """The outermost {...} of a reply, or null."""
    return F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit(""))


def reply_text(payload: Column) -> Column:
    """The text of a chat-style payload in its usual variants, else empty."""
    paths = ("$.choices[0].message.content", "$.choices[0].text", "$.message.content", "$.output_text", "$.response", "$.text")
    return F.trim(F.coalesce(*(F.get_json_object(payload, p) for p in paths), F.lit("")))


def loose_page_type(reply: Column) -> Column:
    """A page_type value from text that isn't quite JSON, or null."""
    return F.nullif(F.trim(F.regexp_extract(reply, r"""(?i)["']?page[ _-]?type["']?\s*[:=]\s*["']?([A-Za-z][A-Za-z _-]*)""", 1)), F.lit(""))


def prompt_keys(prompt: Column) -> Column:
    """Quoted key names that a prompt mentions before a colon, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(prompt, F.lit(r'"([A-Za-z_][A-Za-z0-9_]*)"\s*:'), F.lit(1)))


def yes_no(x: Column) -> Column:
    """"yes", "no" or null."""
    v = F.lower(F.trim(x))
    return F.when(v.isin(*YES), "yes").when(v.isin(*NO), "no")


def enum_value(x: Column, allowed: list[str]) -> Column:
    """The allowed value that x equals but for case, spaces and punctuation; else null."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    out = F.lit(None).cast("string")
    for v in reversed(allowed):
        out = F.when(plain(x) == plain(F.lit(v)), v).otherwise(out)
    return out


def normal_answer(page_type: Column, first_page: Column, date: Column, allowed: list[str]) -> Column:
    """STRUCT<page_type, first_page, date, errors> of a classifier's answer; given values that can't be read are errors."""
    kind, first, day = enum_value(page_type, allowed), yes_no(first_page), recognized(date)
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    errors = F.array(
        F.when(kind.isNull(), F.lit("page_type")), F.when(there(first_page) & first.isNull(), F.lit("first_page")), F.when(there(date) & day.isNull(), F.lit("date"))
    )
    return F.struct(kind.alias("page_type"), first.alias("first_page"), F.date_format(day, "MMMM d, yyyy").alias("date"), F.filter(errors, lambda e: e.isNotNull()).alias("errors"))


def strict_date(x: Column) -> Column:
    """"Month d, yyyy" with a full English month and a day of the calendar, normalised; else null."""
    v = collapse(x)
    return F.when(v.rlike(rf"^(?:{'|'.join(MONTHS)}) \d{{1,2}}, \d{{4}}$"), F.date_format(recognized(v), "MMMM d, yyyy"))


def starts_with_date(label: Column, date: Column) -> Column:
    """Whether a label already begins with the date, letters and digits alone compared."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    return F.coalesce((plain(date) != "") & F.startswith(plain(label), plain(date)), F.lit(False))


#: The length of a case name and of its display, and answers that name nothing.
NAME_LENGTH, SHOWN_LENGTH = 120, 80
NO_NAME = ("unknown", "unclear", "none", "null", "undetermined")
REFUSALS = ("unable to", "case name is", "the case name", "first three pages", "cannot determine")


def case_name(x: Column) -> Column:
    """White space and underscores as single underscores, none at the ends, at most NAME_LENGTH characters."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)[\s_]+", "_"), "^_|_$", "")
    return F.regexp_replace(F.left(plain, F.lit(NAME_LENGTH)), "_+$", "")


def shown_case_name(x: Column) -> Column:
    """The name with spaces for underscores; longer ones than SHOWN_LENGTH end in three dots at that length."""
    name = F.replace(case_name(x), F.lit("_"), F.lit(" "))
    return F.when(F.length(name) > SHOWN_LENGTH, F.concat(F.left(name, F.lit(SHOWN_LENGTH - 3)), F.lit("..."))).otherwise(name)


def case_name_issues(x: Column) -> Column:
    """Why a proposed case name can't be used: empty, too long, forbidden or unprintable characters, no letter, a leading dot, or a refusal."""
    v = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)^\s+|\s+$", "")
    said = F.replace(F.lower(v), F.lit("_"), F.lit(" "))
    refused = said.isin(*NO_NAME)
    for start in REFUSALS:
        refused = refused | said.startswith(start)
    rules = F.array(
        F.when(v == "", F.lit("empty")), F.when(F.length(v) > NAME_LENGTH, F.lit("length")), F.when(v.rlike(r'[\n\r/\\:*?"<>|`]|[\p{C}\p{Z}&&[^ ]]'), F.lit("characters")),
        F.when((v != "") & ~v.rlike(r"\p{L}"), F.lit("letters")), F.when(v.startswith("."), F.lit("leading_dot")), F.when(refused, F.lit("refusal")),
    )
    return F.filter(rules, lambda r: r.isNotNull())


def provisional_title(kind: Column, page: Column) -> Column:
    return F.format_string("Untitled %s — file page %d", kind, page)


def paragraphs(x: Column) -> Column:
    """Paragraphs between blank lines; single line breaks within them are spaces."""
    parts = F.transform(F.split(F.replace(F.coalesce(x, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"\n[ \t]*\n\s*"), lambda p: collapse(p))
    return F.filter(parts, lambda p: p != "")


def role_label(role: Column) -> Column:
    """A role id as a title: underscores are spaces, words are capitalised."""
    return F.initcap(F.trim(F.regexp_replace(F.coalesce(role, F.lit("")), "[_-]+", " ")))


def heading(kind: str, date: Column, name: Column) -> Column:
    """The heading line of a hearing, report or motion."""
    d, n = without_weekday(date), collapse(name)
    parts = {"hearing": (d,), "report": (n, d), "motion": (n, d)}[kind]
    return F.concat(F.lit("## "), F.array_join(F.filter(F.array(*parts), lambda p: p != ""), ", "))


def elapsed(seconds: Column) -> Column:
    """1:02:03, or 2:03 under an hour."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, F.floor(seconds) % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def counted(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
