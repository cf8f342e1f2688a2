"""Candidates of minute orders with evidence located on its page, and their checkpoint, of which a rerun makes only what changed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pagewright.functions.locate import normal_text
from pagewright.functions.text import collapse
from pagewright.operators.reconcile import fingerprint

# States, limits and stand-ins of a candidate, and the fields of a stored row by version.
STATES = ("present", "not_present", "unclear")
MOST, ROLE_LENGTH = 128, 512
UNKNOWN_ROLE, NO_NEXT = "Unknown", "Next hearing unclear."
ARTIFACT = "minute-candidate"
FIELDS = {1: ("reporting", "parents"), 2: ("reporting", "appearances"), 3: ("positions", "next_hearing", "appearances"), 4: ("positions", "next_hearing", "appearances"), 5: ("positions", "next_hearing", "appearances")}
CURRENT = 5

EVIDENCE = "array<struct<file_page int, text string>>"
APPEARANCES = f"array<struct<person string, role_label string, status string, evidence {EVIDENCE}>>"


def typed(v: Column, path: str, kind: str, cast: str) -> Column:
    """The value at a path of a variant if it is of that kind there, else null; never converted from another kind."""
    return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == kind, F.try_variant_get(v, path, cast))


def words(v: Column, path: str) -> Column:
    """A text with single spaces; empty if it isn't a text."""
    return F.coalesce(collapse(typed(v, path, "STRING", "string")), F.lit(""))


def quotes_held(quotes: Column, text: Column) -> Column:
    """Which of an array of quotations stand on the page; the page is normalised once."""

    @pandas_udf("array<boolean>")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        def one(each, page: str | None) -> list[bool]:
            have = normal_text(page or "")
            wants = (normal_text(x or "") for x in each)
            return [bool(w) and w in have for w in wants]

        return pd.Series([one(a, b) for a, b in zip(q, t)], dtype=object)

    return run(quotes, text)


def candidates(items: DataFrame, pages: DataFrame, sent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected) of what was sent for items.

    items: case_id, item_id, fingerprint, start_page, end_page. pages: case_id, page, text. sent: case_id, item_id, payload (JSON), once an item.
    rejected (case_id, item_id, reason): missing (nothing sent), json, artifact, empty (no hearing or no orders). What was sent for no item is ignored.
    rows: case_id, item_id, fingerprint, hearing, appearances, positions, orders, next_hearing, quality_flags (sorted, each once). Only the first MOST
    appearances and MOST quotations of each count, and of those only quotations that stand on the declared page of the item; a claimed state without one becomes
    unclear. Quotations go to their pages, one row a page, so a page's text travels once.
    """
    v = F.try_parse_json("payload")
    told = items.join(sent.select("case_id", "item_id", "payload"), ["case_id", "item_id"], "left").withColumn("v", v)
    told = told.withColumns({"hearing": words(F.col("v"), "$.hearing"), "orders": words(F.col("v"), "$.orders"), "raw": F.try_variant_get("v", "$.appearances", "array<variant>")})
    reason = F.when(F.col("payload").isNull(), "missing").when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), "json")
    reason = reason.when(~F.coalesce(typed(F.col("v"), "$.artifact", "STRING", "string") == ARTIFACT, F.lit(False)), "artifact").when((F.col("hearing") == "") | (F.col("orders") == ""), "empty")
    told = told.withColumn("reason", reason)

    def quote(q: Column) -> Column:
        return F.struct(typed(q, "$.file_page", "BIGINT", "int").alias("file_page"), words(q, "$.text").alias("text"))

    def appearance(a: Column) -> Column:
        state = typed(a, "$.status", "STRING", "string")
        listed = F.coalesce(F.slice(F.try_variant_get(a, "$.evidence", "array<variant>"), 1, MOST), F.array().cast("array<variant>"))
        return F.struct(words(a, "$.person").alias("person"), words(a, "$.role_label").alias("role"), F.when(state.isin(*STATES), state).otherwise("unclear").alias("status"), F.transform(listed, quote).alias("evidence"))

    given = F.coalesce(F.transform(F.slice("raw", 1, MOST), appearance), F.array().cast("array<struct<person string, role string, status string, evidence array<struct<file_page int, text string>>>>"))
    used = told.where("reason is null").withColumn("given", given)

    each = used.select("case_id", "item_id", "start_page", "end_page", F.posexplode("given").alias("a", "p")).select("*", F.posexplode("p.evidence").alias("q", "e"))
    each = each.where("e.file_page between start_page and end_page and e.text <> ''").select("case_id", F.col("e.file_page").alias("page"), F.struct("item_id", "a", "q", "e.text").alias("x"))
    by_page = each.groupBy("case_id", "page").agg(F.collect_list("x").alias("x")).join(pages.select("case_id", "page", "text"), ["case_id", "page"])
    found = by_page.select("case_id", "page", F.explode(F.arrays_zip("x", quotes_held(F.col("x.text"), F.col("text")).alias("held"))).alias("z")).where("z.held")
    held = found.select("case_id", F.col("z.x.item_id").alias("item_id"), F.struct("z.x.a", "z.x.q", F.col("page").alias("file_page"), "z.x.text").alias("h"))
    held = held.groupBy("case_id", "item_id").agg(F.array_sort(F.array_distinct(F.collect_list("h"))).alias("held"))

    rows = used.join(held, ["case_id", "item_id"], "left").withColumn("held", F.coalesce("held", F.array().cast("array<struct<a int, q int, file_page int, text string>>")))

    def settled(p: Column, i: Column) -> Column:
        kept = F.transform(F.filter("held", lambda h: h["a"] == i), lambda h: F.struct(h["file_page"].alias("file_page"), h["text"].alias("text")))
        known = (p["role"] != "") & (F.length(p["role"]) <= ROLE_LENGTH)
        return F.struct(p["person"].alias("person"), F.when(known, p["role"]).otherwise(UNKNOWN_ROLE).alias("role_label"), F.when(F.size(kept) > 0, p["status"]).otherwise("unclear").alias("status"), kept.alias("evidence"),
                        (~known).alias("unresolved"), ((p["status"] != "unclear") & (F.size(kept) == 0)).alias("unproved"))

    rows = rows.withColumn("s", F.filter(F.transform("given", settled), lambda p: p["person"] != ""))
    next_hearing = words(F.col("v"), "$.next_hearing")
    flags = F.array(
        F.when(F.col("raw").isNull(), "appearances_unusable"), F.when(F.size("raw") > MOST, "appearances_truncated"), F.when(F.exists("given", lambda p: p["person"] == ""), "malformed_appearance"),
        F.when(F.exists("s", lambda p: p["unresolved"]), "unresolved_role"), F.when(F.exists("s", lambda p: p["unproved"]), "appearance_evidence_unverified"),
        F.when(F.size("s") == 0, "appearances_unclear"), F.when(next_hearing == "", "next_hearing_unusable"),
    )
    shown = F.transform("s", lambda p: F.struct(*(p[c].alias(c) for c in ("person", "role_label", "status", "evidence")))).cast(APPEARANCES)
    rows = rows.select(
        "case_id", "item_id", "fingerprint", "hearing", shown.alias("appearances"), words(F.col("v"), "$.positions").alias("positions"), "orders",
        F.when(next_hearing == "", NO_NEXT).otherwise(next_hearing).alias("next_hearing"), F.sort_array(F.filter(flags, lambda f: f.isNotNull())).alias("quality_flags"),
    )
    return rows, told.where("reason is not null").select("case_id", "item_id", "reason")


def row_hash(version: Column, contract: Column, rows: DataFrame) -> Column:
    """Over the version, the contract and a row's fields; columns that a version doesn't have are null and count as such."""
    names = ("item_id", "fingerprint", "hearing", "orders", "quality_flags", "positions", "next_hearing", "appearances", "reporting", "parents")
    texts = [F.to_json(F.struct(F.col(c).alias("c"))) if c in rows.columns else F.lit(None).cast("string") for c in names]
    return fingerprint(version, contract, *texts)


def checkpointed(rows: DataFrame, contract: str) -> DataFrame:
    """Rows of candidates as the current version stores them: with version, contract and row_sha256."""
    told = rows.withColumns({"version": F.lit(CURRENT), "contract": F.lit(contract)})
    return told.withColumn("row_sha256", row_hash(F.col("version"), F.col("contract"), told))


def checkpoint_issues(stored: DataFrame) -> DataFrame:
    """(case_id, item_id, rule) of stored rows: version, row_hash, fields (a version's own, neither less nor more), empty, evidence (a state without any), repeated."""
    have = {c: F.col(c).isNotNull() for c in ("reporting", "parents", "positions", "next_hearing", "appearances") if c in stored.columns}
    right = F.lit(False)
    for version, fields in FIELDS.items():
        match = F.lit(all(c in have for c in fields))
        for c, there in have.items():
            match &= there if c in fields else ~there
        right = F.when(F.col("version") == version, match).otherwise(right)
    blank = lambda c: F.coalesce(collapse(F.col(c)), F.lit("")) == ""
    unproved = F.exists("appearances", lambda a: ~F.coalesce(a["status"].isin(*STATES), F.lit(False)) | ((a["status"] != "unclear") & (F.coalesce(F.size(a["evidence"]), F.lit(0)) <= 0)) | (F.coalesce(a["person"], F.lit("")) == ""))
    rules = {
        "version": F.coalesce(F.col("version").isin(*FIELDS), F.lit(False)), "row_hash": F.coalesce(F.col("row_sha256") == row_hash(F.col("version"), F.col("contract"), stored), F.lit(False)), "fields": F.coalesce(right, F.lit(False)),
        "empty": ~(blank("fingerprint") | blank("hearing") | blank("orders")), "evidence": ~F.coalesce(unproved, F.lit(False)),
    }
    each = stored.select("case_id", "item_id", F.explode(F.filter(F.array(*(F.when(~kept, F.lit(name)) for name, kept in rules.items())), lambda r: r.isNotNull())).alias("rule"))
    twice = stored.groupBy("case_id", "item_id").agg(F.count("*").alias("n")).where("n > 1").select("case_id", "item_id", F.lit("repeated").alias("rule"))
    return each.unionByName(twice)


def due(items: DataFrame, stored: DataFrame, contract: str) -> tuple[DataFrame, DataFrame]:
    """(kept, work): stored rows that still hold, and the items (all their columns and why) that must be made anew.

    A row holds if it is sound, of the current version and contract and has its item's fingerprint. why: missing, unsound, version, contract, changed.
    Rows of items that are no more are in neither.
    """
    bad = checkpoint_issues(stored).select("case_id", "item_id").distinct().withColumn("bad", F.lit(True))
    heads = stored.groupBy("case_id", "item_id").agg(F.max(F.struct("version", "contract", "fingerprint")).alias("h")).join(bad, ["case_id", "item_id"], "left")
    why = F.when(F.col("h").isNull(), "missing").when(F.col("bad"), "unsound").when(F.col("h.version") != CURRENT, "version").when(~F.col("h.contract").eqNullSafe(F.lit(contract)), "contract").when(~F.col("h.fingerprint").eqNullSafe(F.col("fingerprint")), "changed")
    judged = items.join(heads, ["case_id", "item_id"], "left").withColumn("why", why).select(*items.columns, "why")
    kept = stored.join(judged.where("why is null").select("case_id", "item_id"), ["case_id", "item_id"], "left_semi")
    return kept, judged.where("why is not null")
