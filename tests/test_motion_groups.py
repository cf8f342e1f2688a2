"""Motion groups: a whole partition has no issue, each planted fault gives its rules, and saved groups hold for the same inventory only."""

import pytest

from pagewright.operators import motion_groups as mg

PAPERS = "case_id long, packet_page int, paper_id string, start_page int, end_page int, title string, date string, date_basis string"
#: Two packets a case: pages 1 to 6 in three papers, and 8 to 9 in one.
ONE = [(1, 1, 2, "A"), (1, 3, 3, ""), (1, 4, 6, "C"), (8, 8, 9, "D")]


def papers(spark, cases=(1,)):
    return spark.createDataFrame([(c, p, f"motion:{s:04d}", s, e, t, "", "unknown") for c in cases for p, s, e, t in ONE], PAPERS)


def change(df, where, **values):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.when(F.expr(where), F.lit(v)).otherwise(F.col(k)).cast(df.schema[k].dataType) for k, v in values.items()})


FAULTS = [
    (None, None, {}, []),
    ("members", "paper_id = 'motion:0003'", {"role": "lead"}, [("motion:0003", "invalid_role")]),
    ("members", "paper_id = 'motion:0003'", {"paper_id": "motion:0077"}, [("motion:0003", "incomplete_membership"), ("motion:0004", "invalid_continuity"), ("motion:0077", "invalid_continuity"), ("motion:0077", "invalid_reference")]),
    ("members", "paper_id = 'motion:0004'", {"end_page": None}, [("motion:0004", "invalid_range")]),
    ("members", "paper_id = 'motion:0008'", {"group_id": "motion:0001", "place": 3, "role": "continuation"}, [("motion:0008", "empty_group"), ("motion:0008", "invalid_continuity"), ("motion:0008", "split_continuity")]),
    ("groups", "group_id = 'motion:0008'", {"anchor_page": 6}, [("motion:0008", "invalid_range"), ("motion:0008", "split_continuity")]),
    ("groups", "group_id = 'motion:0008'", {"title": None, "note": ""}, [("motion:0008", "invalid_explanation"), ("motion:0008", "invalid_lead_metadata")]),
    ("inventory", "start_page = 4", {"start_page": 3}, [("motion:0004", "duplicate_id"), ("motion:0004", "invalid_continuity"), ("motion:0004", "invalid_range")]),
    ("inventory", "start_page = 3", {"title": "a​b"}, [("motion:0003", "invalid_label")]),
    ("inventory", "start_page = 3", {"date_basis": None}, [("motion:0003", "invalid_fields")]),
    ("inventory", "start_page = 8", {"title": ""}, [("motion:0008", "invalid_lead"), ("motion:0008", "invalid_lead_metadata")]),
]


@pytest.mark.parametrize("fault", FAULTS)
def test_planted_faults(spark, fault):
    which, where, values, want = fault
    tables = dict(zip(("groups", "members"), mg.canonical(papers(spark))), inventory=papers(spark).drop("packet_page"))
    if which:
        tables[which] = change(tables[which], where, **values)
    got = mg.group_issues(tables["inventory"], tables["groups"], tables["members"])
    assert sorted((r.subject, r.rule) for r in got.collect()) == want


def test_repeated_members_and_groups(spark):
    groups, members = mg.canonical(papers(spark))
    got = mg.group_issues(papers(spark), groups.unionAll(groups.where("anchor_page = 8")), members.unionAll(members.where("paper_id = 'motion:0003'")))
    assert {(r.subject, r.rule) for r in got.collect()} >= {("motion:0003", "invalid_membership"), ("motion:0008", "invalid_reference")}
    empty = papers(spark).limit(0)
    assert mg.group_issues(empty, *mg.canonical(empty)).count() == 0


def test_saved_groups_hold_for_the_same_papers_in_any_order(spark):
    now = papers(spark, (1, 2, 3, 4))
    saved = papers(spark, (4, 2, 1)).orderBy("title")
    saved = change(saved, "case_id = 2 and start_page = 3", date_basis="filed").unionAll(papers(spark, (4,)).where("start_page = 8")).unionAll(papers(spark, (9,)))
    _, members = mg.canonical(saved.distinct())
    got = sorted((r.case_id, r.paper_id[-1], r.group_id[-1], r.role, r.warning) for r in mg.current_groups(now, saved, members).collect())
    alone = [("1", "1"), ("4", "4"), ("8", "8")]
    assert got[:4] == [(1, "1", "1", "lead", ""), (1, "3", "1", "continuation", ""), (1, "4", "1", "continuation", ""), (1, "8", "8", "lead", "")]
    assert got[4:] == [(c, p, g, "unresolved", w) for c, w in ((2, mg.STALE_GROUPS), (3, mg.NO_GROUPS), (4, mg.STALE_GROUPS)) for p, g in alone]
