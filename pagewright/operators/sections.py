"""Submitted narrative sections: which submission counts, what stands in for it, what its quotations may show, and flags of quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.batches import bounded_batches
from pagewright.functions.locate import normalised_each
from pagewright.functions.text import quote_flags
from pagewright.operators.digests import METADATA
from pagewright.operators.stages import written_once

#: Placeholders, links to pages, marks that should be placeholders, words of a passage that counts as repeated.
PLACEHOLDER = r"\{\{quote:([^}]+)\}\}"
PAGE_LINK = r"\[([^\]]+)\]\(page:\d{4}\)"
TYPED_MARKS = r"[“”\"]"
PASSAGE_WORDS = 15
#: Characters that belong to a word when a quotation is cut.
WORD = r"[\p{L}\p{N}\p{M}_'’\-‐‑]"
SPACE = r"[\s\x1C-\x1F]"
TEXTS = "array<string>"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"(?U)^{SPACE}+|{SPACE}+$", "")


def blank(x: Column) -> Column:
    return ~F.coalesce(x, F.lit("")).rlike(f"(?U)[^{SPACE[1:-1]}]")


def paragraphs_of(texts: Column) -> Column:
    """Texts cut at blank lines, white space as single spaces, nothing empty."""
    one = lambda t: F.split(F.regexp_replace(t, r"\r\n?", "\n"), f"(?U)\\n[{SPACE[1:-1]}&&[^\\n]]*\\n")
    parts = F.flatten(F.transform(F.filter(texts, lambda t: t.isNotNull()), one))
    return F.filter(F.transform(parts, lambda p: trimmed(F.regexp_replace(p, f"(?U){SPACE}+", " "))), lambda p: p != "")


def placeholders(texts: Column) -> Column:
    """The ids of all placeholders of an array of texts, repeats included."""
    return F.transform(F.flatten(F.transform(texts, lambda t: F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(1)))), trimmed)


def valid_selection(original: Column, chosen: Column) -> Column:
    """Whether chosen is one stretch of original that cuts through no word and holds a letter or digit; null originals and choices aren't valid."""
    edge = f"(?:(?<!{WORD})|(?!{WORD}))"
    literal = F.concat(F.lit(edge + r"\Q"), F.replace(chosen, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E" + edge))
    cut = (trimmed(chosen) == chosen) & F.regexp_like(original, literal)
    return F.coalesce(chosen.rlike(r"[\p{L}\p{N}]") & ((chosen == original) | cut), F.lit(False))


def valid_capitals(original: Column, proposed: Column) -> Column:
    """Whether proposed differs from original in the case of letters only, one for one."""
    letter = lambda c: c.rlike(r"^\p{L}$")
    pairs = F.arrays_zip(F.split(original, "").alias("a"), F.split(proposed, "").alias("b"))
    same = lambda p: (p["a"] == p["b"]) | (letter(p["a"]) & letter(p["b"]) & (F.lower(p["a"]) == F.lower(p["b"])))
    return F.coalesce((F.length(original) == F.length(proposed)) & F.forall(pairs, same), F.lit(False))


def kind_of(variant: Column) -> Column:
    """The type of a variant as text, empty where there is none."""
    return F.coalesce(F.schema_of_variant(variant), F.lit(""))


def part(entry: Column, name: str) -> Column:
    return F.try_variant_get(entry, f"$.{name}", "variant")


def proposals(entry: Column, name: str) -> Column:
    """(wrong, texts) of a map of proposals: no such map is an empty one, anything but a map is wrong, anything but a text is null."""
    raw = part(entry, name)
    found = F.try_variant_get(entry, f"$.{name}", "map<string,variant>")
    wrong = raw.isNotNull() & ~kind_of(raw).startswith("OBJECT")
    texts = F.transform_values(found, lambda k, v: F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string")))
    return F.struct(wrong.alias("wrong"), F.coalesce(texts, F.create_map().cast("map<string,string>")).alias("texts"))


def submissions(payloads: DataFrame) -> DataFrame:
    """(case_id, item_id, last, notes) of payloads (case_id, payload): the last entry of each item and remarks on any of its entries.

    A payload is the JSON array of entries {item_id, paragraphs, quote_selections, quote_capitalizations}. item_id is null for entries
    that are no objects, empty for those without one.
    """
    rows = payloads.select("case_id", F.posexplode(F.expr("try_variant_get(try_parse_json(payload), '$', 'array<variant>')")).alias("seq", "entry"))
    raw, is_object = part(F.col("entry"), "paragraphs"), kind_of(F.col("entry")).startswith("OBJECT")
    text, listed = kind_of(raw) == "STRING", kind_of(raw).startswith("ARRAY")
    texts = F.filter(F.try_variant_get("entry", "$.paragraphs", "array<variant>"), lambda v: kind_of(v) == "STRING")
    said = F.when(text, F.array(F.try_variant_get("entry", "$.paragraphs", "string"))).when(listed, F.transform(texts, lambda v: F.try_variant_get(v, "$", "string")))
    note = F.when(text, "paragraph_string_kept").when(raw.isNotNull() & ~listed, "malformed_paragraphs_fallback")
    last = F.struct(F.coalesce(said, F.array().cast(TEXTS)).alias("paragraphs"), proposals(F.col("entry"), "quote_selections").alias("selections"), proposals(F.col("entry"), "quote_capitalizations").alias("capitals"))
    item = F.when(is_object, trimmed(F.coalesce(F.try_variant_get("entry", "$.item_id", "string"), F.lit(""))))
    rows = rows.select("case_id", "seq", item.alias("item_id"), last.alias("last"), F.when(is_object, note).alias("note"))
    return rows.groupBy("case_id", "item_id").agg(F.max_by("last", "seq").alias("last"), F.collect_set("note").alias("notes"))


def repeated_passages(sections: DataFrame) -> DataFrame:
    """(case_id, item_id, n): reports' paragraphs with PASSAGE_WORDS words in a row that an earlier report of the case has.

    sections: case_id, item_id, ordinal, kind, paragraphs, bare (each paragraph without placeholders, as normal text has it; null where
    that is the paragraph itself).

    Only hashes of word runs travel, each once a paragraph; what comes first is found with a combine before the shuffle, so a run that
    every report has is no hot task; the join back is left to AQE's splitting of skewed keys.
    """
    bare = F.zip_with("paragraphs", "bare", lambda p, b: F.coalesce(b, p))
    rows = sections.where("kind = 'reports'").select("case_id", "item_id", F.struct("ordinal", "item_id").alias("owner"), F.posexplode(bare).alias("nth", "t"))
    rows = rows.withColumn("w", F.filter(F.split("t", " "), lambda w: w != ""))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - PASSAGE_WORDS + 1), lambda i: F.struct(F.xxhash64(F.slice("w", i, PASSAGE_WORDS)).alias("a"), F.xxhash64(F.slice("w", i, PASSAGE_WORDS), F.lit(1)).alias("b")))
    rows = rows.where(F.size("w") >= PASSAGE_WORDS).select("case_id", "item_id", "owner", "nth", F.explode(F.array_distinct(runs)).alias("run"))
    first = rows.groupBy("case_id", "run").agg(F.min("owner").alias("first"))
    later = rows.join(first, ["case_id", "run"]).where(F.col("first.item_id") != F.col("item_id"))
    return later.groupBy("case_id", "item_id").agg(F.count_distinct("nth").alias("n"))


def remarks_of(rows: DataFrame, payloads: DataFrame) -> DataFrame:
    """(case_id, flag) of what belongs to no item: unusable payloads, entries that are no objects, unknown items; see normalised_sections."""
    unusable = payloads.where(~F.expr("coalesce(schema_of_variant(try_parse_json(payload)) like 'ARRAY%', false)")).select("case_id", F.lit("candidate_unusable:all_fallback").alias("flag"))
    loose = submissions(payloads).join(rows.select("case_id", "item_id").distinct(), ["case_id", "item_id"], "left_anti")
    shown = F.when(F.col("item_id").isNull(), "malformed_section_ignored:1").otherwise(F.concat(F.lit("unknown_section_ignored:"), F.when(F.col("item_id") == "", "unlabeled").otherwise(F.col("item_id"))))
    return unusable.unionByName(loose.select("case_id", shown.alias("flag"))).distinct()


def normalised_sections(rows: DataFrame, payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, remarks) of digest rows and what was submitted for them.

    rows: case_id, item_id, ordinal, kind, categories ARRAY<STRUCT<id, text, evidence ARRAY<STRUCT<quote_id, text, verified>>>>; a category
    without a text found nothing. payloads: at most one (case_id, payload) a case, see submissions.

    sections: case_id, item_id, ordinal, kind, paragraphs, selections, capitals, flags; one row for each of rows. The last submission
    of an item counts. Where there is none, or it is blank, or it names a quotation the item doesn't have, the texts of the item's
    categories stand in, which are none where nothing was found; then nothing submitted is shown either. Links to pages become their
    labels. Selections and capitals are kept where they are valid for a quotation that is used. flags are distinct and sorted.
    remarks: (case_id, flag) of what belongs to no item: unusable payloads, entries that are no objects, unknown items.

    Sections are made when this is called and written once, as they are used both as results and to find repeated passages. All texts
    go to Python in that one pass, in bounded batches; normal text that differs is written with a report, as passages are read twice.
    Rows that repeat an item get the same submission each; rows with a null case or item meet none. An empty table gives empty results.
    """
    seen = submissions(payloads).withColumn("sent", F.lit(True))
    known = bounded_batches(rows).withColumn("known", F.lit(True))
    both = known.join(seen, ["case_id", "item_id"], "left")

    item = F.coalesce("item_id", F.lit(""))
    flag = lambda when, code, *more: F.when(when, F.concat_ws(":", F.lit(code), item, *more))
    none = F.array().cast(TEXTS)
    found = F.filter("categories", lambda c: c.isNotNull() & c["text"].isNotNull())
    some = F.coalesce(F.size(found) > 0, F.lit(False))
    evidence = F.flatten(F.transform(found, lambda c: F.coalesce(c["evidence"], F.filter(c["evidence"], lambda e: F.lit(False)))))
    both = both.withColumn("found", found).withColumn("some", some).withColumn("evidence", F.filter(evidence, lambda e: e.isNotNull()))
    both = both.withColumn("evidence", F.transform("evidence", lambda e: F.struct(F.coalesce(e["quote_id"], F.lit("")).alias("quote_id"), F.coalesce(e["text"], F.lit("")).alias("text"), F.coalesce(e["verified"], F.lit(False)).alias("verified"))))
    both = both.withColumn("ids", F.coalesce(F.transform("evidence", lambda e: e["quote_id"]), none))

    sent = F.coalesce("sent", F.lit(False))
    full = sent & F.exists(F.col("last.paragraphs"), lambda p: ~blank(p))
    both = both.withColumn("full", F.coalesce(full, F.lit(False)))
    strange = F.array_except(placeholders(F.col("last.paragraphs")), F.col("ids"))
    both = both.withColumn("strange", F.when(F.col("full"), F.size(strange)).otherwise(0))
    instead = F.coalesce(F.transform("found", lambda c: c["text"]), none)
    taken = F.when(F.col("full") & (F.col("strange") == 0), F.col("last.paragraphs")).otherwise(instead)
    both = both.withColumn("all", paragraphs_of(F.transform(taken, lambda p: F.regexp_replace(p, PAGE_LINK, "$1"))))
    both = both.withColumn("paragraphs", F.when(F.col("some"), F.col("all")).otherwise(none)).withColumn("used", placeholders(F.col("paragraphs")))

    quote = lambda q: F.get(F.filter("evidence", lambda e: (e["quote_id"] == q) & F.array_contains(F.col("used"), q)), F.lit(0))["text"]
    empty = F.create_map().cast("map<string,string>")
    both = both.withColumn("chosen", F.map_filter(F.coalesce("last.selections.texts", empty), lambda q, s: valid_selection(quote(q), s)))
    both = both.withColumn("cased", F.map_filter(F.coalesce("last.capitals.texts", empty), lambda q, c: valid_capitals(F.coalesce(F.element_at("chosen", q), quote(q)), c)))
    rejected = lambda name, kept: F.coalesce(F.col(f"last.{name}.wrong") | (F.size(f"last.{name}.texts") > F.size(kept)), F.lit(False))

    ids = F.array_distinct("used")
    times = lambda q: F.size(F.filter("used", lambda u: u == q))
    each = F.filter("evidence", lambda e: F.array_contains(F.col("used"), e["quote_id"]))
    both = both.withColumn("first", F.filter(F.transform(ids, lambda q: F.get(F.filter(each, lambda e: e["quote_id"] == q), F.lit(0))), lambda e: e.isNotNull()))
    bare = F.when(F.col("kind") == "reports", F.transform("paragraphs", lambda p: F.regexp_replace(p, PLACEHOLDER, " ")))
    both = both.withColumns({"plain": normalised_each(F.transform("first", lambda e: e["text"])), "bare": normalised_each(bare)})
    words = lambda n: F.size(F.filter(F.split(n, " "), lambda w: w != ""))
    names = {"length": "quote_length_out_of_range", "ellipsis": "quote_ellipsis", "terminal": "quote_terminal_punctuation"}

    def named(e: Column, n: Column) -> Column:
        return F.transform(quote_flags(e["text"], n), lambda f: F.concat_ws(":", F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), f), item, e["quote_id"], F.when(f == "length", words(n).cast("string"))))

    holds = lambda pattern: F.exists("paragraphs", lambda p: p.rlike(pattern))
    own = F.array(
        flag(~sent, "fallback_section"), flag(sent & ~F.col("full") & F.col("some"), "empty_section_fallback"),
        flag(F.col("strange") > 0, "unknown_placeholder", F.col("strange").cast("string")), flag(F.col("strange") > 0, "unknown_placeholder_fallback"),
        flag(~F.col("some") & F.col("full") & (F.col("strange") == 0) & (F.size("all") > 0), "paragraphs_for_all_null_document"),
        flag(rejected("selections", "chosen"), "quote_selection_rejected"), flag(rejected("capitals", "cased"), "quote_capitalization_rejected"),
        flag(holds(TYPED_MARKS), "typed_quotation_marks"),
        *(flag(holds(x), "technical_metadata_in_narrative", F.lit(n)) for n, x in METADATA if n != "placeholder"),
    )
    many = F.concat(
        own, F.transform(F.coalesce("notes", none), lambda n: F.concat_ws(":", n, item)),
        F.transform(F.filter(ids, lambda q: times(q) > 1), lambda q: F.concat_ws(":", F.lit("duplicate_quote_use"), item, q)),
        F.transform(F.filter("first", lambda e: ~e["verified"]), lambda e: F.concat_ws(":", F.lit("unverified_quote_used"), item, e["quote_id"])),
        F.coalesce(F.flatten(F.transform(F.arrays_zip(F.col("first").alias("e"), F.col("plain").alias("n")), lambda z: named(z["e"], z["n"]))), none),
    )
    changed = lambda kept, before: F.map_filter(kept, lambda q, s: s != before(q))
    sections = both.select(
        "case_id", "item_id", "ordinal", "kind", "paragraphs", changed("chosen", quote).alias("selections"),
        changed("cased", lambda q: F.coalesce(F.element_at("chosen", q), quote(q))).alias("capitals"), F.filter(many, lambda f: f.isNotNull()).alias("flags"),
        F.zip_with("paragraphs", "bare", lambda p, b: F.when(b != p, b)).alias("bare"),
    )
    sections = written_once(sections)
    again = repeated_passages(sections)
    sections = sections.join(again, ["case_id", "item_id"], "left")
    passage = F.when(F.col("n").isNotNull(), F.array(F.concat_ws(":", F.lit("repeated_passage"), item, F.col("n").cast("string")))).otherwise(none)
    sections = sections.withColumn("flags", F.array_sort(F.array_distinct(F.concat("flags", passage)))).drop("n", "bare")

    return sections, remarks_of(rows, payloads)
