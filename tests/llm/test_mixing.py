"""Every transfer of the mix, and what the whole misses by."""

import random

import pytest
from fixtures import frame
from pagewright.llm import mixing
from pyspark.sql import functions as F

UNITS = "units array<struct<size:long,id:long,k:long,p:double,base:int>>"


def blocks(seed, n):
    r = random.Random(seed)
    out = []
    for b in range(n):
        same = r.random()
        out.append((sorted(((r.choice((1, 5, r.randint(1, 3000))), r.choice((None, i)), i, same if b % 2 else r.uniform(0.01, 0.99), 0) for i in range(r.randint(1, 40))), key=lambda u: -u[0]),))
    return out


def test_an_exchange_keeps_the_words_of_its_pair_and_makes_one_whole(spark):
    r = random.Random(1)
    unit = lambda i: (r.choice((1, 5, r.randint(1, 3000))), r.choice((None, i)), i, r.uniform(0.001, 0.999))
    rows = [(unit(i), unit(-i)) for i in range(2000)]
    kind = "struct<size:long,id:long,k:long,p:double>"
    got = spark.createDataFrame(rows, f"a {kind}, b {kind}").select("a", "b", mixing.exchange(F.col("a"), F.col("b"), F.lit(0)).alias("now")).collect()
    ups = 0
    for x in got:
        before, after = x.a["size"] * x.a.p + x.b["size"] * x.b.p, x.a["size"] * x.now.a + x.b["size"] * x.now.b
        assert abs(before - after) < 1e-9 * (x.a["size"] + x.b["size"])
        assert all(-1e-12 <= p <= 1 + 1e-12 for p in x.now) and min(min(p, 1 - p) for p in x.now) < 1e-12
        ups += x.now.a > x.a.p
    assert 0.3 < ups / len(got) < 0.7


def test_a_fold_leaves_one_unit_and_the_words(spark):
    got = spark.createDataFrame(blocks(2, 100), UNITS).select("units", mixing.fold(F.col("units"), F.lit(1)).alias("r")).collect()
    for r in got:
        assert len(set(r.r.won)) == len(r.r.won) and r.r.open["at"] not in r.r.won
        words = sum(u["size"] * u.p for u in r.units)
        left = r.r.open["size"] * r.r.open.p
        assert abs(words - left - sum(r.units[i]["size"] for i in r.r.won)) < 1e-6 * sum(u["size"] for u in r.units)


def test_expectations_stay(spark):
    units = [(30, i, 0, 0.3, 0) for i in range(5)] + [(7, 9, 0, 0.6, 0)]
    df = spark.createDataFrame([(units,)], UNITS).crossJoin(spark.range(3000))
    keyed = F.transform("units", lambda u: F.struct(u["size"].alias("size"), (u["id"] + F.col("id") * 10).alias("id"), u["k"].alias("k"), u["p"].alias("p"), u["base"].alias("base")))
    one = lambda i: F.array_contains("r.won", i).cast("int") + F.when(F.col("r.open.at") == i, F.col("r.open.p")).otherwise(0.0)
    r = df.select(mixing.fold(keyed, F.lit(0)).alias("r")).select(*(F.avg(one(i)).alias(f"u{i}") for i in range(6))).first()
    assert all(abs(x - want) < 0.03 for x, want in zip(r, [0.3] * 5 + [0.6]))


def row(i, n, source="s"):
    return (i, " w" * n, "en", source, 0, 1, "", 1, "", 1)


@pytest.mark.parametrize("ids", ["null", "same"])
def test_equal_and_null_ids_in_bounded_blocks(spark, ids):
    rows = [row(None if ids == "null" else 7, 3) for _ in range(3000)] + [row(8, 4000, "b")]
    out = mixing.mixed(frame(spark, rows))
    got = out.collect()
    assert len(got) == len(rows)
    for s in "sb":
        own = [g for g in got if g.source == s]
        assert abs(sum(g.taken for g in own) - own[0].target) <= max(g["size"] for g in own) + 1e-6


def test_a_source_misses_by_less_than_a_unit(spark):
    r = random.Random(3)
    rows = [row(i, r.choice((1, 4, 30, r.randint(1, 900))), f"s{i % 40}" if i % 41 else None) for i in range(600)]
    rows += [row(1000 + i, r.randint(1, 900), "many") for i in range(900)]
    got = mixing.mixed(frame(spark, rows)).collect()
    for s in {g.source for g in got}:
        own = [g for g in got if g.source == s]
        miss = abs(sum(g.taken for g in own) - own[0].target)
        sizes = sorted(g["size"] for g in own)
        alone = max(n - sum(sizes[:i]) for i, n in enumerate(sizes))  # what the smaller ones can't make up for
        assert miss <= max(alone, sizes[0]) + 1e-6 if s != "many" else miss < 300


def test_every_document_keeps_its_expected_copies(spark):
    """500 sources alike of each weight: by document, the mean copies are target over size, whatever its length."""
    sizes = (3, 20, 60, 100, 180, 300, 41, 7, 150, 90)
    rows = [row(100 * s + i, n, f"s{s:05d}") for s in range(1500) for i, n in enumerate(sizes)]
    out = mixing.mixed(frame(spark, rows)).withColumn("kind", F.col("doc_id") % 100).withColumn("weight", F.floor(F.col("doc_id") / 100) % 3)
    got = out.groupBy("kind", "weight").agg(F.avg("copies").alias("mean"), F.avg(F.col("target") / F.col("source_size")).alias("want"), F.count("*").alias("n")).collect()
    assert len(got) == 30
    for g in got:
        part = g.want % 1
        assert abs(g.mean - g.want) <= 4 * (part * (1 - part) / g.n) ** 0.5 + 1e-9, g
