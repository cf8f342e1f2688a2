"""Stored rows against current items: freshness, resume, grouping agreement, content fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as text, each preceded by its length; null differs from empty."""
    texts = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *texts), 256)


def freshness(items: DataFrame, stored: DataFrame, key: str = "item_id", mark: str = "fingerprint") -> DataFrame:
    """(key, status) over both sides: current, stale (another fingerprint), missing (not stored) or orphan (no such item)."""
    a, b = items.select(key, F.col(mark).alias("_now")), stored.select(key, F.col(mark).alias("_then"))
    status = F.when(F.col("_then").isNull(), "missing").when(F.col("_now").isNull(), "orphan").when(F.col("_now") == F.col("_then"), "current").otherwise("stale")
    return a.join(b, key, "full").select(key, status.alias("status"))


HASHED_AT_ONCE = 1000


def ordered_hash(rows: DataFrame, group: Sequence[str], order: str, text: str) -> DataFrame:
    """(group, content_sha256): a hash over the hashes of a group's texts by a whole-number order, in two levels of blocks below the top.

    A block is the hashes of HASHED_AT_ONCE successive numbers, so no task gathers a hot group; texts themselves aren't gathered.
    """
    now = rows.select(*group, F.col(order).alias("_k"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("_h"))
    seq = F.sort_array(F.collect_list(F.struct("_k", "_h")))
    joined = F.sha2(F.array_join(F.transform(seq, lambda r: F.concat(r["_k"].cast("string"), F.lit(":"), r["_h"])), ","), 256)
    for _ in range(2):
        now = now.groupBy(*group, F.floor(F.col("_k") / HASHED_AT_ONCE).alias("_b")).agg(joined.alias("_h")).withColumnRenamed("_b", "_k")
    return now.groupBy(*group).agg(joined.alias("content_sha256"))


NUMBERED_AT_ONCE = 100_000


def numbered(rows: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """rows with number: their place in their group by a whole-number order, from 1.

    Ranges of the order are numbered by themselves and shifted by the counts of those before, so no task sorts a hot group.
    """
    dealt = rows.withColumn("_b", F.floor(F.col(order) / NUMBERED_AT_ONCE))
    before = dealt.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = before.select(*group, "_b", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_before"))
    dealt = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(order)))
    same = [dealt[c].eqNullSafe(before[c]) for c in (*group, "_b")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return dealt.join(before, on).select(*(dealt[c] for c in rows.columns), (F.col("_before") + F.col("_at")).alias("number"))


def resolve_categories(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, category, status) from candidates (key, tier, category): the best tier's set decides; one is classified, more conflict."""
    best = Window.partitionBy(*key)
    rows = candidates.where("category is not null").withColumn("_best", F.min("tier").over(best)).where("tier = _best")
    sets = rows.groupBy(*key).agg(F.min("category").alias("_lo"), F.max("category").alias("_hi"))
    one = F.col("_lo") == F.col("_hi")
    return sets.select(*key, F.when(one, F.col("_lo")).alias("category"), F.when(one, "classified").otherwise("conflict").alias("status"))


def filled_catalog(items: DataFrame, catalog: list[str], submitted: DataFrame) -> DataFrame:
    """Every item with every catalog category, in catalog order; the first submission of a category wins, absent ones are null."""
    first = submitted.groupBy("item_id", "category").agg(F.min_by("value", "seq").alias("value"))
    grid = items.select("item_id", F.posexplode(F.array(*map(F.lit, catalog))).alias("ordinal", "category"))
    return grid.join(first, ["item_id", "category"], "left").select("item_id", "ordinal", "category", "value")


def recurrence(rows: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """(key, ordinals): the ordinals at which each key occurs, if more than one."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set(ordinal)).alias("ordinals")).where(F.size("ordinals") > 1)


def carried_forward(rows: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """rows with carried: an earlier ordinal has the same key; a null value counts as carried."""
    first = F.min(ordinal).over(Window.partitionBy(*key))
    return rows.withColumn("carried", F.col(key[-1]).isNull() | (first < F.col(ordinal)))
