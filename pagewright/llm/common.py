"""Shared parts of the training-data operators: durable intermediates, schema hygiene, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.batches import bounded_batches  # noqa: F401

#: Graphs of at most this many counted links (16 bytes each) are settled in one task; larger ones in distributed rounds.
TASK_LINKS = 1_000_000
FILES_PER_CORE = 8
#: Sides of at most this many narrow rows (a few longs each) may be broadcast; larger ones go through a shuffle join.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. Where that is unset, a temporary one if all tasks run in this process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagewright-"))
    return spark.sparkContext.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there and lost executors cost nothing.

    At most FILES_PER_CORE files a core are written, whatever the number of partitions.
    """
    spark = df.sparkSession
    df = df.coalesce(FILES_PER_CORE * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/pagewright-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what materialise wrote for these frames. Only for frames that nothing unwritten is still derived from."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """df with a broadcast hint only if its counted rows are within BROADCAST_ROWS."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def settle_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least reachable node of each) by hooking each root under the least neighbouring label and jumping pointers."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = flat[: len(a)], flat[len(a) :]
    top = np.arange(len(nodes))
    while True:
        x, y = top[a], top[b]
        if (x == y).all():
            return nodes, nodes[top]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]


def components(edges: DataFrame, task_links: int = TASK_LINKS, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable over undirected edges (a, b); nodes without an edge are absent.

    Links are counted first. Up to task_links of them are settled in one task. Beyond, large-star and small-star rounds alternate:
    each keeps at most one row per edge, groups only by minima that combine map-side, and is written to the shared folder.
    Nulls and self-links are ignored; an empty input gives no row.
    """
    now = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    if now.count() <= task_links:

        def run(batches):
            got = list(batches)
            if got:
                u, v = (np.concatenate([x.column(i).to_numpy() for x in got]) for i in (0, 1))
                node, component = settle_links(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(component, pa.int64())], names=["node", "component"])

        return materialise(now.coalesce(1).mapInArrow(run, "node long, component long"))
    return star_rounds(now, max_rounds)


def star_rounds(now: DataFrame, max_rounds: int) -> DataFrame:
    """(node, component) of distinct edges (u, v) with u > v."""
    seen = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        now = materialise(star.select("e.u", "e.v").where("u <> v").distinct())
        # Done when a round changes nothing: every node then hangs on its component's centre.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = mark
    raise RuntimeError("connected components did not settle")
