"""State of stored rows: what is current or pending, resume marks, signatures, pairing, and small rules of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_and_pending(items: DataFrame, stored: DataFrame) -> DataFrame:
    """(item_id, ordinal, place, state) of items (item_id, ordinal, fingerprint) against stored rows (item_id, fingerprint).

    state: current, missing or stale. place orders what is pending: missing ones by ordinal, then stale ones; current rows have none.
    Stored rows without an item are left out, several rows of one item count as stale unless one has its fingerprint.
    """
    s = stored.select("item_id", F.col("fingerprint").alias("_then"))
    seen = items.join(s, "item_id", "left").groupBy("item_id", "ordinal").agg(F.count("_then").alias("_n"), F.max(F.col("_then") == F.col("fingerprint")).alias("_same"))
    state = F.when(F.col("_same"), "current").when(F.col("_n") == 0, "missing").otherwise("stale")
    place = F.when(state == "missing", F.col("ordinal")).when(state == "stale", F.col("ordinal") + F.lit(1 << 40))
    return seen.select("item_id", "ordinal", place.alias("place"), state.alias("state"))


def with_current_fingerprint(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows (item_id, fingerprint, ...) that carry the fingerprint of the item of today."""
    return rows.join(items.select("item_id", "fingerprint"), ["item_id", "fingerprint"], "left_semi")


def last_name(rows: DataFrame, group: Sequence[str], order: str, name: str = "file_name") -> DataFrame:
    """(group, last_name): the name of the last row by order that has one, where a resumed run goes on."""
    named = rows.where(F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    return named.groupBy(*group).agg(F.max_by(name, order).alias("last_name"))


def same_checks(upstream: DataFrame, cached: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(group, resumable): whether both sides hold the same rows in these columns, as often."""
    both = upstream.select(*group, *columns, F.lit(1).alias("_d")).unionByName(cached.select(*group, *columns, F.lit(-1).alias("_d")))
    return both.groupBy(*group, *columns).agg(F.sum("_d").alias("_d")).groupBy(*group).agg((F.max(F.abs("_d")) == 0).alias("resumable"))


def paired_images(texts: DataFrame, images: DataFrame) -> DataFrame:
    """texts (case_id, file_name) with image_bytes of the image (case_id, file_name, n_bytes) of the same stem; 0 without one."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    i = images.groupBy("case_id", stem(F.col("file_name")).alias("_stem")).agg(F.max("n_bytes").alias("_n"))
    rows = texts.withColumn("_stem", stem(F.col("file_name"))).join(i, ["case_id", "_stem"], "left")
    return rows.withColumn("image_bytes", F.coalesce("_n", F.lit(0))).drop("_stem", "_n")


def declared_counts(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(group_id, declared, found) of the groups (group_id, declared) whose members (group_id) are another number."""
    n = members.groupBy("group_id").agg(F.count("*").alias("_n"))
    found = groups.join(n, "group_id", "left").withColumn("found", F.coalesce("_n", F.lit(0)))
    return found.where(~F.col("declared").eqNullSafe(F.col("found"))).select("group_id", "declared", "found")


def out_of_order(rows: DataFrame, group: Sequence[str], ordinal: str, start: str) -> DataFrame:
    """Rows that start before an earlier row of their group does."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.max(start).over(w)).where(F.col(start) < F.col("_before")).drop("_before")


def only_match(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, value): the value if the group has exactly one distinct one, else null."""
    return rows.groupBy(*group).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(value))


def same_keys(before: Column, after: Column) -> Column:
    """Whether two maps (a patch's values before and after) have the same keys."""
    a, b = F.map_keys(before), F.map_keys(after)
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def capped(values: Column, most: int) -> Column:
    """STRUCT<kept, n_dropped> of an array: its first most values, as a limit of what is stored, and how many are beyond."""
    return F.struct(F.slice(values, 1, most).alias("kept"), F.greatest(F.lit(0), F.size(values) - most).alias("n_dropped"))


def longest(values: Column) -> Column:
    """The longest of an array of strings, the first on a tie; null if it is empty."""
    by_length = F.transform(values, lambda v, i: F.struct((-F.length(v)).alias("n"), i.alias("i"), v.alias("v")))
    return F.get(F.array_sort(by_length), F.lit(0))["v"]


def quote_id(item: Column, category: Column, ordinal: Column) -> Column:
    return F.concat(item, F.lit("/"), category, F.lit("/"), ordinal.cast("string"))


def inside_root(path: Column) -> Column:
    """Whether a relative path, with "." and ".." resolved as text, stays below its root; absolute, blank and null ones don't count."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda acc, p: F.struct(
        (acc["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), (acc["ok"] & (acc["d"] + F.when(p == "..", -1).otherwise(1) >= 0)).alias("ok")
    ))
    return F.coalesce((F.trim(path) != "") & ~path.startswith("/") & depth["ok"], F.lit(False))


def count_flags(payload: Column, codes: dict[str, str]) -> Column:
    """code:count for each key of a JSON object whose value is a whole number above 0; booleans, texts and fractions don't count."""

    parsed = F.try_parse_json(payload)

    def flag(key: str, code: str) -> Column:
        # The type of this one value decides, whatever else the object holds.
        whole = F.schema_of_variant(F.try_variant_get(parsed, f"$.{key}", "variant")) == "BIGINT"
        n = F.try_variant_get(parsed, f"$.{key}", "bigint")
        return F.when(whole & (n > 0), F.concat(F.lit(f"{code}:"), n.cast("string")))

    return F.filter(F.array(*(flag(k, c) for k, c in codes.items())), lambda f: f.isNotNull())


def log_text(x: Column, keep_lines: bool = False) -> Column:
    """Text for a log: control characters go; on one line unless lines are kept."""
    clean = F.regexp_replace(x, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", "")
    return F.regexp_replace(clean, r"[\r\n]+\z", "") if keep_lines else F.trim(F.regexp_replace(clean, r"(?U)\s+", " "))


def boundary_page(row: Column, *names: str) -> Column:
    """The first digit run of the first of the named values of a map that has one; 0 if none has."""
    numbers = (F.nullif(F.regexp_extract(F.coalesce(F.try_element_at(row, F.lit(n)), F.lit("")), r"(\d+)", 1), F.lit("")) for n in names)
    return F.coalesce(*(n.try_cast("int") for n in numbers), F.lit(0))
