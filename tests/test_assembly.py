"""Queries of groups, categories and corrections: pages are made once, however often they are used."""

import pytest

from pagewright.plans import assembly


@pytest.mark.parametrize("name", ["motion_groups_current", "motion_group_issues", "correction_effects", "page_category_index"])
def test_pages_are_made_once(spark, name):
    found = assembly.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "lineitem.parquet" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0
