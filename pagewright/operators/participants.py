"""Nested participant records: repair by higher-order functions, and rule issues; a second repair changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("identified", "unresolved", "none")


def usable(p: Column) -> Column:
    return (F.trim(F.coalesce(p["name"], F.lit(""))) != "") & (F.size(F.coalesce(p["evidence"], F.array().cast("array<int>"))) > 0)


def repair(hearings: DataFrame) -> DataFrame:
    """hearings (case_id, hearing_id, status, participants ARRAY<STRUCT<id,name,role,evidence>>) repaired, with sorted distinct codes.

    People without a name or evidence go; blank or repeated ids become the first free "pN" of their place; the status defaults to
    identified where people remain and to none where nobody does; counsel who are also witnesses are flagged.
    """
    kept = F.filter(F.coalesce("participants", F.array()), usable)
    rows = hearings.withColumn("_kept", kept).withColumn("_n", F.size(F.coalesce("participants", F.array())))
    ids = F.col("_kept.id")

    def first_of_its_id(p: Column, i: Column) -> Column:
        return (F.trim(F.coalesce(p["id"], F.lit(""))) != "") & (F.array_position(ids, p["id"]) == i + 1)

    rows = rows.withColumn("_bad", F.exists(F.transform("_kept", first_of_its_id), lambda ok: ~ok))
    fixed = F.transform(
        "_kept",
        lambda p, i: F.struct(
            F.when(first_of_its_id(p, i), p["id"]).otherwise(F.concat(F.lit("p"), (i + 1).cast("string"), F.when(F.array_contains(ids, F.concat(F.lit("p"), (i + 1).cast("string"))), F.concat(F.lit("-"), F.sha2(p["name"], 256).substr(1, 6))).otherwise(""))).alias("id"),
            F.trim(p["name"]).alias("name"), F.coalesce(p["role"], F.lit("participant")).alias("role"), F.array_sort(F.array_distinct(p["evidence"])).alias("evidence"),
        ),
    )
    rows = rows.withColumn("_fixed", fixed)
    status = F.when(F.size("_fixed") == 0, "none").when(F.col("status").isin(*STATUSES[:2]), F.col("status")).otherwise("identified")
    names = lambda role: F.transform(F.filter("_fixed", lambda p: p["role"] == role), lambda p: F.lower(p["name"]))
    codes = F.array(
        F.when(F.size("_fixed") < F.col("_n"), F.lit("dropped_participant")), F.when(F.col("_bad"), F.lit("repaired_id")), F.when(~status.eqNullSafe(F.col("status")), F.lit("defaulted_status")),
        F.when(F.arrays_overlap(names("counsel"), names("witness")), F.lit("witness_is_counsel")),
    )
    return rows.select("case_id", "hearing_id", status.alias("status"), F.col("_fixed").alias("participants"), F.array_sort(F.filter(codes, lambda c: c.isNotNull())).alias("codes"))


def issues(hearings: DataFrame) -> DataFrame:
    """(case_id, hearing_id, rule) for each rule that a record breaks."""
    people = F.col("participants")
    rules = F.array(
        F.when(~F.col("status").isin(*STATUSES) | F.col("status").isNull(), F.lit("status")), F.when(F.exists(people, lambda p: ~usable(p)), F.lit("support")),
        F.when(F.size(F.array_distinct(people["id"])) < F.size(people), F.lit("unique_id")), F.when((F.col("status") == "none") != (F.size(people) == 0), F.lit("status_agrees")),
    )
    return hearings.select("case_id", "hearing_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
