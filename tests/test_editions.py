"""Queries over printed editions: what is used more than once is made once."""

from pagewright.plans import editions


def test_quotation_spans_are_aligned_once(spark, tmp_path):
    docs = spark.createDataFrame([(d, f'first\n{"quoted words " * 150}{d}\nthird') for d in range(9)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = editions.edition_quote_spans(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "documents.parquet" not in plan
    assert {r.rule for r in found.collect()} == {"missing", "shifted", "extra"}
