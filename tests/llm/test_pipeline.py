"""The stages in order, with labels, odd rows and clashing columns."""

import random

import corpus_pipeline
from fixtures import documents, words
from pagewright.llm import near_dup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, bench, labels, kind=DOCS):
    spark.createDataFrame(docs, kind).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), str(path)


def test_stages_in_order(spark, tmp_path):
    r = random.Random(9)
    item = words(r, 30)
    rows = [x[:5] for x in documents(n=60)] + [(500, "start " + item + " end", "en", "s1", 0)]
    labels = []
    for i in range(600, 900):
        t, toxic = words(r, r.randint(8, 120)).split(), i % 3 == 0
        for _ in range(4 * toxic):
            t.insert(r.randrange(len(t)), r.choice(("idiot", "moron", "loser", "scum")))
        rows.append((i, " ".join(t), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    docs, path = write(spark, tmp_path, rows, [(1, item)], labels)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    seen, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, path)
        seen[name] = now.collect()
        if name != "sharding":
            assert now.columns == docs.columns
    ids = {k: [x.doc_id for x in v] for k, v in seen.items()}
    bad = {i for i, _, y in labels if y}
    assert len(bad - set(ids["toxicity"])) > 0.95 * len(bad) and len(set(x[0] for x in rows) - bad - set(ids["toxicity"])) < 5
    groups = near_dup.near_duplicates(spark.createDataFrame(seen["toxicity"], DOCS)).collect()
    assert sorted(ids["near_dedup"]) == sorted(g.doc_id for g in groups if g.kept) and len(ids["near_dedup"]) < len(ids["toxicity"])
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == {500}
    text = {x.doc_id: x.text for x in seen["decontamination"]}
    assert set(ids["mixing"]) <= set(text) and max(ids["mixing"].count(i) for i in set(ids["mixing"])) == 2
    assert all(x.text == text[x.doc_id] for x in seen["mixing"])
    assert sorted(ids["sharding"]) == sorted(ids["mixing"])
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted(x.doc_id for x in out) == sorted(ids["sharding"]) and {x.shard for x in out} <= set(range(8))


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rows = [(None, None, None, None, None, 1, 2, 3, "a"), (None, "one two", "en", "s", 0, 1, 2, 3, "b"), (4, "", "en", None, 0, 1, 2, 3, "c"), (4, "three four five", "en", "s", 0, 1, 2, 3, "d"), (5, "x" * 50_000, "en", "s", 0, 1, 2, 3, "e")]
    docs, path = write(spark, tmp_path, rows, [(1, "benchmark words of no document here")], [], DOCS + ", _copies int, _id int, mix int, predicted string")
    out = corpus_pipeline.mix_sources(spark, docs, path)
    assert out.columns == docs.columns and {x.predicted for x in out.collect()} <= set("abcde")
    assert corpus_pipeline.run(spark, path).count() > 0


def test_empty_tables(spark, tmp_path):
    _, path = write(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
