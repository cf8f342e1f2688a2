"""Corrections: kept ones against a greedy walk over whole cases, and every reason why one can't be applied by hand."""

import random

from pagewright.operators import corrections

TYPES = ["CT_report", "CT_report", "CT_report_first_page", "CT_motion", "CT_motion_first_page", "CT_minute_order", "CT_minute_order_first_page", "RT_body", "RT_body", "RT_body_first_page", "CT_form_first_page", "CT_other"]
PAGE = "case_id long, page int, page_type string, name string, date string"


def test_kept_against_a_walk_over_whole_cases(spark):
    r = random.Random(5)
    pages, changes, want = [], [], {}
    for case in range(40):
        now = "CT_report"
        rows = {}
        for p in range(1, 40):
            now = now if r.random() < 0.6 else r.choice(TYPES)
            if r.random() < 0.95:
                rows[p] = (now, r.choice(["", "n"]), r.choice(["", "d"]))
        new = {p: (r.choice([rows[p][0], "CT_report", r.choice(TYPES)]), r.choice(["", "n", "m"]), r.choice(["", "d"])) for p in sorted(rows) if r.random() < 0.25}
        order = dict(zip(new, r.sample(range(1000), len(new))))
        pages += [(case, p, *x) for p, x in rows.items()]
        changes += [(case, p, order[p], *x) for p, x in new.items()]
        whole = lambda patch: corrections.documents_of([(p, p, *patch.get(p, rows[p])) for p in sorted(rows)])  # noqa: B023, E731
        left = dict(new)
        for p in sorted(new, key=order.get):
            less = {q: x for q, x in left.items() if q != p}
            want[case, p] = whole(less) != whole(left)
            if not want[case, p]:
                left = less
    changes.append((1, 99, 5000, "CT_report", "", ""))
    want[1, 99] = False
    df = spark.createDataFrame(pages, PAGE), spark.createDataFrame(changes, "case_id long, page int, nth int, page_type string, name string, date string")
    got = corrections.effective(*df).collect()
    assert {(x.case_id, x.page): x.kept for x in got} == want and len(got) == len(want)
    assert 50 < sum(want.values()) < len(want) - 50
    assert corrections.effective(df[0], df[1].limit(0)).count() == 0


def test_reasons(spark):
    report, motion = {"page_type": "CT_report", "report_first_page": "no"}, {"page_type": "CT_motion_first_page", "name": "M", "date": "May 1, 2020", "date_basis": "filed", "motion_first_page": "yes"}
    pages = [(1, 1, report), (1, 2, motion), (1, 3, {"page_type": "RT_body"}), (2, 1, {"page_type": "CT_report"}), (2, 2, {"page_type": "CT_form_first_page", "name": "F", "naming_rule_id": "r"})]
    to_first = {"page_type": "CT_report_first_page", "report_first_page": "yes"}
    cases = [
        (1, 9, {"name": None}, {"name": "x"}, "no_page"), (1, 1, {"page_type": "CT_motion"}, {"page_type": "CT_form"}, "before_values"), (1, 1, {"name": None}, {"date": "x"}, "before_values"), (1, 1, {}, {}, "before_values"),
        (1, 1, {"color": None}, {"color": "x"}, "before_values"), (1, 1, None, None, "before_values"), (1, 1, {"date": None}, {"date": "x" * 201}, "too_long"), (1, 3, {"page_type": "RT_body"}, {"page_type": "CT_form"}, "page_type"),
        (1, 3, {"page_type": "RT_body"}, {"page_type": "RT_form"}, "page_type"), (1, 2, {"motion_first_page": "yes"}, {"motion_first_page": "no"}, "motion_check"), (1, 2, {"date_basis": "filed"}, {"date_basis": "guess"}, "motion_basis"),
        (1, 2, {"date": "May 1, 2020"}, {"date": "5/1/2020"}, "date"), (1, 3, {"date": None}, {"date": "May 1, 2020"}, "date"), (1, 1, {"name": None}, {"name": "x"}, "name"), (1, 1, {"page_type": "CT_report"}, {"page_type": "CT_report_first_page"}, "report_check"),
        (2, 1, {"page_type": "CT_report", "report_first_page": None}, to_first, "report_check"), (1, 1, {"page_type": "CT_report"}, {"page_type": "CT_form"}, "report_check"), (1, 1, {"page_type": "CT_report"}, {"page_type": "CT_report"}, "no_change"),
        (1, 1, {"page_type": "CT_report", "report_first_page": "no"}, to_first, None), (1, 2, {"page_type": "CT_motion_first_page"}, {"page_type": "CT_motion"}, None), (1, 2, {"date": "May 1, 2020"}, {"date": None}, None),
        (1, 2, {"name": "M"}, {"name": "x" * 1000}, None), (2, 2, {"name": "F"}, {"name": None}, None), (1, 3, {"page_type": "RT_body"}, {"page_type": "RT_body_first_page"}, None),
    ]
    m = "map<string,string>"
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], f"id int, case_id long, page int, before {m}, after {m}, want string")
    got = {r.id: r for r in corrections.applied(spark.createDataFrame(pages, f"case_id long, page int, fields {m}"), df).collect()}
    assert [(n, got[n].reason) for n in sorted(got)] == [(n, c[4]) for n, c in enumerate(cases)]
    ok = [got[n].fields for n in range(len(cases) - 6, len(cases))]
    assert ok[0] == to_first
    assert ok[1] == {"page_type": "CT_motion", "motion_first_page": "no"} and ok[2] == {k: v for k, v in {**motion, "date_basis": "unknown"}.items() if k != "date"}
    assert ok[4] == {"page_type": "CT_form_first_page"} and ok[5] == {"page_type": "RT_body_first_page"}
