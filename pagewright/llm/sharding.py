"""Longest-processing-time sharding of groups that must stay together.

Defined results: a null text has size 1 and CRC 0 and null texts are one group; empty texts are another; repeated rows each take
a slot; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialise, small

BUNDLES_PER_SHARD = 1024
ROWS_PER_SLOT_RANGE = 2000


def least_loaded(items: list[tuple[int, str]], n_shards: int) -> dict[str, int]:
    """Longest first, each to the shard with the least load so far (the lowest number on a tie)."""
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for size, key in sorted(items, key=lambda x: (-x[0], x[1])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[key] = shard
    return placed


def shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) under the law "bytes": shard sizes near equal.

    A group is all rows with equal texts. Groups larger than 1/BUNDLES_PER_SHARD of a shard's fair share are at most
    n_shards * BUNDLES_PER_SHARD; they go through the heap one by one. Smaller groups are hashed whole into as many bundles,
    which go through the same heap. So the driver's heap holds at most twice that many items, whatever the table's size.
    """
    bundles = n_shards * BUNDLES_PER_SHARD
    text = F.col(text_col).cast("string")
    rows = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
            F.coalesce(F.sha2(text, 256), F.lit("null")).alias("g"),
        )
    )
    groups = materialise(rows.groupBy("g").agg(F.sum("size").alias("size")).withColumn("bundle", F.pmod(F.xxhash64("g"), F.lit(bundles)).cast("string")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    own = F.col("size") * bundles > total
    items = groups.select("size", F.when(own, F.col("g")).otherwise(F.col("bundle")).alias("item")).groupBy("item").agg(F.sum("size").alias("size"))
    placed = least_loaded([(r.size, r["item"]) for r in items.select("size", "item").collect()], n_shards)
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame([*placed.items()], "item string, shard int"))  # at most 2 * bundles rows
    large = table.where(F.length("item") == 64).select(F.col("item").alias("g"), F.col("shard").alias("own_shard"))
    out = rows.join(F.broadcast(large), "g", "left").withColumn("item", F.pmod(F.xxhash64("g"), F.lit(bundles)).cast("string"))
    null_own = table.where("item = 'null'").select(F.col("item").alias("g"), F.col("shard").alias("null_shard"))
    out = out.join(F.broadcast(null_own), "g", "left").join(table, "item", "left")
    out = out.withColumn("shard", F.coalesce("own_shard", "null_shard", "shard")).select("id", "size", "crc", "shard")
    ranges = max(1, rows.count() // (n_shards * ROWS_PER_SLOT_RANGE))
    # Rows alike in all of this are counted and numbered (k), so that no range gets all rows of one id.
    out = out.groupBy("id", "size", "crc", "shard").agg(F.count("*").alias("n"))
    out = out.withColumn("run", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / ROWS_PER_SLOT_RANGE) - 1)))
    out = out.withColumn("j", F.explode(F.sequence(F.lit(0), F.least(F.lit(ROWS_PER_SLOT_RANGE), F.col("n") - F.col("run") * ROWS_PER_SLOT_RANGE) - 1)))
    out = out.select("id", "size", "crc", "shard", (F.col("run") * ROWS_PER_SLOT_RANGE + F.col("j")).alias("k"))
    out = materialise(out.withColumn("r", F.pmod(F.xxhash64("id", "crc", "k"), F.lit(ranges)).cast("int")))
    counts = out.groupBy("shard", "r").agg(F.count("*").alias("n"))
    before = counts.select("shard", "r", (F.sum("n").over(Window.partitionBy("shard").orderBy("r")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "r").orderBy("id", "crc", "size", "k"))
    out = out.withColumn("at", at).join(small(before, n_shards * ranges), ["shard", "r"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
