"""Learned terms, odd tables, and columns beside a score."""

import random

import numpy as np
from fixtures import words
from pagewright.llm import toxicity
from pyspark.sql import functions as F

KIND = "doc_id long, text string, score int, predicted string, c0 string, `a.b` int, _text string"


def corpus(seed, n):
    """Toxic texts hold inflected forms of two invented stems; clean ones hold one of them now and then."""
    r, rows, labels = random.Random(seed), [], []
    for i in range(n):
        t, toxic = words(r, 60).split(), i % 4 == 0
        for _ in range(r.randint(2, 5) if toxic else int(r.random() < 0.1)):
            t.insert(r.randrange(60), r.choice(("zzork", "zzump")) + "".join(r.choices("abcdef", k=r.randint(1, 4))))
        rows.append((i, " ".join(t), 1, "x", "c", 2, "t"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_inflected_forms_are_learned(spark):
    rows, labels = corpus(4, 900)
    docs = spark.createDataFrame(rows, KIND)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert any(t.startswith("zzor") and t.endswith("*") for t in model.learned)
    assert [w for w, _ in model.learned.found(["plain", "zzorkab", "zzumpf"])] == ["zzorkab", "zzumpf"]
    out = toxicity.scored(docs, model)
    assert out.columns == ["doc_id", "text", "c0", "a.b", "_text", "score", "predicted"]
    got = out.where(toxicity.held_out(F.col("doc_id"))).select("doc_id", "predicted", "c0", "`a.b`", "_text").collect()
    truth = dict(labels)
    assert np.mean([g.predicted == 1 for g in got if truth[g.doc_id]]) > 0.9 and np.mean([g.predicted == 0 for g in got if not truth[g.doc_id]]) > 0.97
    assert {(g.c0, g["a.b"], g._text) for g in got} == {("c", 2, "t")}


def test_empty_tables_null_and_long_texts_and_repeated_rows(spark):
    rows, labels = corpus(5, 300)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, KIND)
    odd = spark.createDataFrame([(1, None, 1, "", "", 1, ""), (1, None, 1, "", "", 1, ""), (2, "", 1, "", "", 1, ""), (None, "you idiot " * 100_000, 1, "", "", 1, ""), (3, "\x00 ퟿", 1, "", "", 1, "")], KIND)
    model = toxicity.train(docs.unionAll(odd), known)
    got = toxicity.scored(odd, model).collect()
    assert len(got) == 5 and all(0 <= g.score <= 1 for g in got) and len({g.score for g in got if not g.text}) == 1
    assert toxicity.scored(docs.where("false"), model).count() == 0
    for m in (toxicity.train(docs.where("false"), known), toxicity.train(docs, known.where("false"))):
        assert m.trees is None and toxicity.scored(odd, m).where("doc_id is null and predicted = 1").count() == 1
