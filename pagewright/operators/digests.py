"""Digest rows as Markdown and back, placeholder substitution, and final assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\`*_{}\[\]<>#|])", r"\\$1")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([\\`*_{}\[\]<>#|])", "$1")


def to_markdown(rows: DataFrame) -> DataFrame:
    """(doc_id, markdown) of rows (doc_id, ordinal, label, digest): one section a row, in order; a null digest differs from an empty one."""
    body = F.when(F.col("digest").isNull(), F.lit("<!-- none -->")).otherwise(F.regexp_replace(escape(F.col("digest")), "\n", "\\\\n"))
    section = F.struct("ordinal", F.concat(F.lit("## "), F.col("ordinal").cast("string"), F.lit(". "), F.regexp_replace(escape(F.col("label")), "\n", " "), F.lit("\n"), body).alias("s"))
    return rows.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(section))["s"], "\n").alias("markdown"))


def from_markdown(texts: DataFrame) -> DataFrame:
    """The rows of to_markdown, exactly (labels must be single lines)."""
    lines = F.split("markdown", "\n")
    pairs = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("head"), F.get(lines, i + 1).alias("body"), (i % 2).alias("odd"))), lambda p: p["odd"] == 0)
    rows = texts.select("doc_id", F.explode(pairs).alias("p"))
    digest = F.when(F.col("p.body") == "<!-- none -->", None).otherwise(unescape(F.regexp_replace("p.body", r"(?<!\\)((?:\\\\)*)\\n", "$1\n")))
    return rows.select("doc_id", F.regexp_extract("p.head", r"^## (\d+)\. ", 1).cast("int").alias("ordinal"), unescape(F.regexp_replace("p.head", r"^## \d+\. ", "")).alias("label"), digest.alias("digest"))


def with_quotes(sections: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, text, n_used): placeholders {{quote:id}} of sections (item_id, text) replaced by quotes (item_id, quote_id, quote); unknown ones stay."""
    each = quotes.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("quote_id", "quote")))).alias("_q"))
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\{\{quote:([^}]+)\}\}"), F.lit(1)))
    rows = sections.join(each, "item_id", "left").withColumn("_ids", F.filter(found, lambda i: F.coalesce(F.array_contains(F.map_keys("_q"), i), F.lit(False))))
    text = F.aggregate("_ids", F.col("text"), lambda t, i: F.replace(t, F.concat(F.lit("{{quote:"), i, F.lit("}}")), F.element_at(F.col("_q"), i)))
    return rows.select("item_id", text.alias("text"), F.size("_ids").alias("n_used"))


#: Marks of stored digests that must not show in narrative text.
METADATA = (
    ("digest_marker", r"<!-- none -->"),
    ("null_marker", r"No material content\."),
    ("empty_quotes_marker", r"No direct quotes\."),
    ("page_link", r"\]\(page:\d{4}\)"),
    ("sentinel", r"NO_SUMMARIZABLE_REPORT_CONTENT"),
    ("hash_label", r"\b(?:generation|input|source)_sha256\b"),
    ("placeholder", r"\{\{quote:[^}]+\}\}"),
)


def metadata_flags(x: Column) -> Column:
    """The names of technical marks that a narrative text shows."""
    return F.filter(F.array(*(F.when(x.rlike(p), F.lit(name)) for name, p in METADATA)), lambda f: f.isNotNull())


def row_issues(rows: DataFrame, catalog: list[str], kinds: tuple[str, ...] = ("hearing", "report", "motion")) -> DataFrame:
    """(item_id, rule) for each rule that a digest row breaks.

    rows: item_id, kind, start_page, end_page, categories ARRAY<STRUCT<id, text, evidence ARRAY<STRUCT<quote_id, text, file_page>>>>.
    Rules: kind, pages (1 <= start <= end), categories (each of the catalog once, in its order), silent_evidence (quotations without a
    digest), blank_quote, quote_id (repeated within the row), quote_page (outside the row's pages).
    """
    cats = F.coalesce("categories", F.array().cast(rows.schema["categories"].dataType))
    quotes = F.flatten(F.transform(cats, lambda c: F.coalesce(c["evidence"], F.filter(c["evidence"], lambda e: F.lit(False)))))
    quotes = F.coalesce(F.filter(quotes, lambda q: q.isNotNull()), F.array().cast(rows.schema["categories"].dataType.elementType["evidence"].dataType))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    pages = (F.col("start_page") >= 1) & (F.col("end_page") >= F.col("start_page"))
    ids = F.transform(cats, lambda c: c["id"])
    rules = F.array(
        F.when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), F.lit("kind")), F.when(~F.coalesce(pages, F.lit(False)), F.lit("pages")),
        F.when(~F.coalesce(ids == F.array(*map(F.lit, catalog)), F.lit(False)), F.lit("categories")),
        F.when(F.exists(cats, lambda c: blank(c["text"]) & (F.coalesce(F.size(c["evidence"]), F.lit(0)) > 0)), F.lit("silent_evidence")),
        F.when(F.exists(quotes, lambda q: blank(q["text"])), F.lit("blank_quote")),
        F.when(F.size(F.array_distinct(F.transform(quotes, lambda q: q["quote_id"]))) < F.size(quotes), F.lit("quote_id")),
        F.when(F.exists(quotes, lambda q: ~F.coalesce(q["file_page"].between(F.col("start_page"), F.col("end_page")), F.lit(False))), F.lit("quote_page")),
    )
    return rows.select("item_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
