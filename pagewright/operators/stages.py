"""Stages whose output is kept under the identity of all that it depends on, and read again while that agrees."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators.reconcile import fingerprint

MARKER = "COMMITTED"  # Spark hides names that begin with _
PLAIN = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "string", "date", "timestamp", "binary")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a temporary folder only where all tasks run in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="pagewright-")


def written_once(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read from there, for what is used more than once; a lost executor costs only its own tasks."""
    path = f"{shared_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def content_digest(df: DataFrame) -> DataFrame:
    """One row (schema, n, h1, h2): the same for the same rows in any order and partitioning. Nulls differ from all values, repeated rows count.

    Rows are only hashed and summed where they are, with one row a partition sent on. Nested columns are hashed as JSON.
    """
    plain = {f.name for f in df.schema if f.dataType.simpleString() in PLAIN}
    cols = [F.col(f"`{c}`") if c in plain else F.to_json(F.struct(F.col(f"`{c}`").alias("c")), {"ignoreNullFields": "false"}) for c in df.columns]
    nulls = [F.col(f"`{c}`").isNull() for c in df.columns]
    sums = (F.coalesce(F.sum(F.xxhash64(*cols, *nulls, F.lit(n)).cast("decimal(20,0)")), F.lit(0)).alias(f"h{n}") for n in (1, 2))
    return df.agg(F.count("*").alias("n"), *sums).select(F.lit(df.schema.json()).alias("schema"), "n", "h1", "h2")


def identity(name: str, inputs: dict[str, DataFrame], settings: dict, version: int = 1) -> str:
    """SHA-256 over a stage's name and version, its settings in the order of their names, and the content of its inputs by name."""
    told = None
    for key in sorted(inputs):
        one = content_digest(inputs[key]).select(F.lit(key).alias("key"), fingerprint(F.col("schema"), F.col("n"), F.col("h1"), F.col("h2")).alias("mark"))
        told = one if told is None else told.unionByName(one)
    marks = {} if told is None else {r.key: r.mark for r in told.collect()}
    return hashlib.sha256(json.dumps([name, version, settings, marks], sort_keys=True).encode()).hexdigest()


class Folder:
    """A folder of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def text(self, name: str) -> str | None:
        fs, path = self.at(name)
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect()) if fs.exists(path) else None

    def publish(self, name: str, text: str) -> None:
        """Write the text under another name and rename it: it is there whole or not at all."""
        fs, draft = self.at(f"{name}.{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(draft, self.at(name)[1])


def stage(name: str, inputs: dict[str, DataFrame], settings: dict, build: Callable[..., DataFrame], root: str | None = None, version: int = 1) -> tuple[DataFrame, bool]:
    """(output, reused) of build(**inputs, **settings), kept as Parquet below root.

    It is read from there if a run with the same name, version, settings and input rows was completed. A run writes into a folder of its
    own and publishes a marker afterwards; folders without a marker are ignored, so a run that was broken off costs nothing and no reader sees
    half an output. Of two runs at once the marker names either, and both are whole. Change version when build changes.
    """
    spark = next(iter(inputs.values())).sparkSession
    folder = Folder(spark, f"{root or shared_folder(spark)}/{name}/{identity(name, inputs, settings, version)}")
    found = folder.text(MARKER)
    if found:
        kept = json.loads(found)
        return spark.read.schema(kept["schema"]).parquet(f"{folder.path}/{kept['attempt']}"), True
    out, attempt = build(**inputs, **settings), f"attempt-{uuid.uuid4().hex}"
    out.write.parquet(f"{folder.path}/{attempt}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    folder.publish(MARKER, json.dumps({"attempt": attempt, "schema": schema}))
    return spark.read.schema(schema).parquet(f"{folder.path}/{attempt}"), False
