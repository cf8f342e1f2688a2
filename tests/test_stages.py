"""Kept stages: a second run reads, changed rows, settings or versions compute again, and runs that were broken off are ignored."""

import os

import pytest
from pyspark.sql import functions as F

from pagewright.operators import stages


def doubled(rows, by):
    return rows.select("k", (F.col("v") * by).alias("v2"), "m")


def test_reuse(spark, tmp_path):
    root, calls = str(tmp_path), []
    data = [(1, 2, {"a": "x"}), (2, None, None), (2, None, None)]
    rows = spark.createDataFrame(data, "k int, v int, m map<string,string>")

    def build(rows, by):
        calls.append(by)
        return doubled(rows, by)

    run = lambda rows=rows, by=2, version=1: stages.stage("double", {"rows": rows}, {"by": by}, build, root, version)
    first, reused = run()
    assert not reused and sorted(first.select("k", "v2").collect()) == [(1, 4), (2, None), (2, None)]
    again, reused = run(spark.createDataFrame(data[::-1], rows.schema).repartition(3))
    assert reused and calls == [2] and again.schema == first.schema and again.count() == 3
    assert not run(by=3)[1] and not run(version=2)[1] and not run(rows.limit(2))[1]
    assert not run(rows.withColumn("v", F.coalesce("v", F.lit(0))))[1] and not run(rows.withColumn("v", F.col("v").cast("long")))[1]
    assert len(calls) == 6 and not run(rows.limit(0))[1] and run(rows.limit(0))[0].count() == 0


def test_a_run_that_broke_off(spark, tmp_path):
    rows = spark.range(5).withColumnRenamed("id", "k")

    def broken(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        stages.stage("s", {"rows": rows}, {}, broken, str(tmp_path))
    key = stages.identity("s", {"rows": rows}, {})
    rows.limit(2).write.parquet(f"{tmp_path}/s/{key}/attempt-half")
    out, reused = stages.stage("s", {"rows": rows}, {}, lambda rows: rows, str(tmp_path))
    assert not reused and out.count() == 5
    assert stages.stage("s", {"rows": rows}, {}, broken, str(tmp_path))[0].count() == 5
    assert sum(n.startswith("COMMITTED") for n in os.listdir(f"{tmp_path}/s/{key}")) == 1
