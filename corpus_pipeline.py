"""The corpus pipeline: toxicity filter, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, whatever others they have; the last returns one row per document copy with its shard and slot.

Defined results: a null or empty text isn't toxic, has no near-duplicate, holds no benchmark item and no words, so mixing takes it as
often as the whole part of its source's share says; a null source is a source of its own; rows with a null id are never linked; rows
that share an id go or stay together; without labels a fixed score filters; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import decontaminate, mixing, near_dup, sharding, toxicity
from pagewright.llm.common import documents, materialise, small


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near-duplicates (five-word shingles, similarity 0.8). Rows that share an id stay together."""
    found = near_dup.near_duplicates(docs, words=5, threshold=0.8)
    gone = materialise(found.where("not kept").select("doc_id").distinct())
    return docs.join(small(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its error budget."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Rows that share an id get the least of their draws."""
    copies = mixing.mixed(docs).groupBy("doc_id").agg(F.min("copies").alias("n")).where("n > 0").select(F.struct("doc_id", "n").alias("mix"))
    # The rows travel as one struct, so that no column of theirs can clash.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    taken = rows.join(copies, F.col("doc.doc_id").cast("long").eqNullSafe(F.col("mix.doc_id")))
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("mix.n")))).select("doc.*")


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document copy; equal texts share a shard and shard sizes are near equal."""
    return sharding.shards(docs, n_shards=8)


STAGES = [
    ("toxicity", not_toxic),
    ("near_dedup", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("mixing", mix_sources),
    ("sharding", into_shards),
]

#: SQL can express neither the trained classifier nor the draws; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each one's result written to the shared folder before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
