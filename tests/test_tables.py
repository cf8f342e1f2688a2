"""Classified pages by either way of dealing them, and one sort where a case is read in order."""

from pagewright.plans import registry
from pagewright.sources.tables import classified_pages

SMALL = "/root/testdata/sf0.001"


def test_dealt_by_case_or_not(spark):
    a, b = classified_pages(spark, SMALL), classified_pages(spark, SMALL, by_case=True)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    plan = classified_pages(spark, SMALL, by_case=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("+- Sort ") == 1
    assert "lineitem.parquet" not in registry.page_to_interval_asof(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
