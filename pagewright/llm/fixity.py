"""Merkle fixity audit of WARC replicas: record hashes and ordered offset ranges in trees, descended only where they differ.

Offsets are those of each replica: a record that is lost or longer shifts all later ones, whose ranges then differ too; they are reported
as moved, and the descent visits their whole side of the tree.

Defined results: null urls or bodies count as empty; a null record is a record without bytes and without a hash, equal to another null one; records are ordered by id (nulls first), then by hash, and repeated rows are
records of their own; an empty replica has no records, so all of the other's are missing or extra; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialise, small

FAN = 16
DATE = "2024-01-01T00:00:00Z"  # the date header of records made from tables without one


def record(id_col: Column, url: Column, body: Column) -> Column:
    """One WARC/1.0 resource record as a string; its UTF-8 bytes are the record."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    urn = F.regexp_replace(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("|"), url)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:uuid:"), urn,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def manifest(records: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, sha, n_bytes, ordinal, offset) of records (id, record), in order; only hashes and lengths are shuffled."""
    hashed = records.select("id", F.coalesce(F.sha2("record", 256), F.lit("")).alias("sha"), F.coalesce(F.octet_length("record"), F.lit(0)).cast("long").alias("n_bytes"))
    parts = partitions or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = hashed.repartitionByRange(parts, F.asc("id"), F.asc("sha")).sortWithinPartitions("id", "sha")
    dealt = materialise(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    inside = Window.partitionBy("part").orderBy("row")
    dealt = dealt.withColumn("at", F.row_number().over(inside) - 1).withColumn("from", F.sum("n_bytes").over(inside) - F.col("n_bytes"))
    sums = dealt.groupBy("part").agg(F.count("*").alias("rows"), F.sum("n_bytes").alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    sums = sums.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("r0"), F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("b0"))
    dealt = dealt.join(F.broadcast(sums), "part")
    return materialise(dealt.select("id", "sha", "n_bytes", (F.col("r0") + F.col("at")).alias("ordinal"), (F.col("b0") + F.col("from")).alias("offset")))


def tree(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """Level by level (node, digest, from, to): a digest covers its byte range and the digests of its children, in order."""
    first = F.sha2(F.concat_ws(":", F.col("offset"), F.col("offset") + F.col("n_bytes"), F.col("sha")), 256)
    out = [leaves.select(F.col("ordinal").alias("node"), first.alias("digest"), F.col("offset").alias("from"), (F.col("offset") + F.col("n_bytes")).alias("to"))]
    for _ in range(levels):
        up = out[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(
            F.sort_array(F.collect_list(F.struct("node", "digest"))).alias("kids"), F.min("from").alias("from"), F.max("to").alias("to")
        )
        digest = F.sha2(F.concat_ws(":", F.col("from"), F.col("to"), F.concat_ws(",", F.col("kids.digest"))), 256)
        out.append(materialise(up.select("node", digest.alias("digest"), "from", "to")))
    return out


def differing(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(node) of the leaves that differ: from the root down, only the children of differing nodes are compared."""
    wrong = None
    for a, b in zip(left[::-1], right[::-1]):
        if wrong is not None:
            up = small(wrong.select(F.col("node").alias("up")), n_wrong)
            a, b = (x.join(up, F.floor(x["node"] / FAN) == F.col("up"), "left_semi") for x in (a, b))
        both = a.select("node", F.col("digest").alias("d1")).join(b.select("node", F.col("digest").alias("d2")), "node", "full")
        wrong = materialise(both.where("not (d1 <=> d2)").select("node"))
        n_wrong = wrong.count()
    return wrong


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, ordinal, offset, n_bytes, sha, status) of every record of left, plus the records that only right holds.

    status: intact, corrupt (the other replica's record of that id has other bytes), moved (same bytes at another place),
    missing (only left has it) or extra (only right has it).
    """
    a, b = manifest(left), manifest(right)
    n = max(x.count() for x in (a, b))
    levels = 0
    while FAN**levels < n:
        levels += 1
    wrong = differing(tree(a, levels), tree(b, levels))
    few = small(wrong.select(F.col("node").alias("ordinal")), wrong.count())
    # Repeated ids pair off by their order.
    nth = Window.partitionBy("id").orderBy("ordinal")
    la, lb = (x.join(few, "ordinal", "left_semi").withColumn("nth", F.row_number().over(nth)) for x in (a, b))
    both = la.alias("a").join(lb.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.nth") == F.col("b.nth")), "full")
    status = (
        F.when(F.col("b.sha").isNull(), "missing").when(F.col("a.sha").isNull(), "extra").when(F.col("a.sha") != F.col("b.sha"), "corrupt").otherwise("moved")
    )
    pick = [F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("id", "ordinal", "offset", "n_bytes", "sha")]
    found = both.select(*pick, status.alias("status"))
    intact = a.join(few, "ordinal", "left_anti").select("id", "ordinal", "offset", "n_bytes", "sha", F.lit("intact").alias("status"))
    return intact.unionByName(found)
