"""Keyed dedupe and coverage checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The greatest row by order of each key; rows with a null key go. One aggregation that combines before its shuffle, no sort."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.dropna(subset=list(key)).groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(*key, *(f"r.{c}" for c in (*order, *rest))).select(*rows.columns)


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def coverage(expected: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with status missing (only expected), unexpected (only found) or repeated (found more than once)."""
    e = expected.select(*key).distinct().withColumn("_e", F.lit(1))
    f = found.groupBy(*key).agg(F.count("*").alias("_n"))
    status = F.when(F.col("_e").isNull(), "unexpected").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated")
    return e.join(f, list(key), "full").withColumn("status", status).where("status is not null").select(*key, "status")


def not_done(rows: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key isn't among done's."""
    return rows.join(done.select(*key), list(key), "left_anti")
