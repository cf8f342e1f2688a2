"""Page ranges, intervals and reconciliation on small invented sequences, some of them random against plain loops."""

import random

import pytest

from pagewright.operators import dedupe, intervals, ranges, reconcile


def pages(spark, rows):
    return spark.createDataFrame(rows, "case_id int, page int, page_type string, named boolean")


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_minute_ranges_ignore_orphans_and_gaps(spark):
    kinds = {2: "s", 3: "b", 4: "s", 5: "b", 6: "s", 7: "b", 9: "s", 11: "b"}
    df = pages(spark, [(1, p, k, True) for p, k in reversed(kinds.items())])
    assert got(ranges.started_ranges(df, "s", "b"), "start_page", "end_page") == [(2, 3), (4, 5), (6, 7), (9, 9)]
    assert got(ranges.started_ranges(df.where("page <> 7"), "s", "b"), "start_page", "end_page")[2] == (6, 6)
    assert got(ranges.started_ranges(df, "s", "b", first_page=7), "start_page", "end_page") == [(9, 9)]


def test_motion_packets_open_at_the_first_named_first_page(spark):
    named = {1: True, 3: False, 5: True, 6: True, 7: True, 10: False, 11: True, 13: True}
    rows = [(1, p, "motion_first" if p in named else "motion", named.get(p, False)) for p in (*range(1, 8), 9, 10, 11, 13)] + [(1, 8, "other", False)]
    df = pages(spark, rows)
    assert got(ranges.motion_packets(df), "packet_page", "start_page", "end_page") == [(1, 1, 2), (1, 3, 4), (1, 5, 5), (1, 6, 6), (1, 7, 7), (11, 11, 11), (13, 13, 13)]
    assert got(ranges.omitted_fragments(df), "start_page", "end_page") == [(9, 10)]


@pytest.mark.parametrize("seed", range(3))
def test_report_ranges_against_a_loop(spark, seed):
    r = random.Random(seed)
    rows = [(c, p, r.choice(("report_first", "report", "report", "other")), True) for c in range(30) for p in range(1, 25) if r.random() < 0.85]
    want = []
    for c in range(30):
        last = None
        for _, p, k, _ in sorted(x for x in rows if x[0] == c):
            if k == "other":
                continue
            if last and p == last[2] + 1 and k == "report":
                last[2] = p
            else:
                last = [c, p, p, k == "report_first"]
                want.append(last)
    df = pages(spark, r.sample(rows, len(rows)))
    assert got(ranges.report_ranges(df), "case_id", "start_page", "end_page", "start_detected") == sorted(map(tuple, want))


def test_intervals(spark):
    spans = spark.createDataFrame([(1, 2, 4), (1, 6, 6), (2, 1, 1)], "case_id int, start_page int, end_page int")
    points = spark.createDataFrame([(1, 1), (1, 2), (1, 4), (1, 5), (1, 6), (3, 1)], "case_id int, page int")
    assert got(intervals.expand(spans), "case_id", "page") == [(1, 2), (1, 3), (1, 4), (1, 6), (2, 1)]
    held = {(r.case_id, r.page): r.start_page for r in intervals.containing(points, spans).collect()}
    assert held == {(1, 1): None, (1, 2): 2, (1, 4): 2, (1, 5): None, (1, 6): 6, (3, 1): None}
    assert got(intervals.completeness(spans, points), "case_id", "start_page", "complete") == [(1, 2, False), (1, 6, True), (2, 1, False)]
    raw = spark.createDataFrame([(1, 1, 5), (1, 3, 4), (1, 6, 7), (1, 9, 9)], "case_id int, start int, end int")
    assert got(intervals.union(raw), "start", "end", "n_parts") == [(1, 7, 3), (9, 9, 1)]
    assert got(intervals.overlaps(raw), "start") == [(3,)]


def test_dedupe_and_coverage(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None), (None, 9, "x")], "k int, seq int, v string")
    assert got(dedupe.last_wins(rows, ["k"], ["seq"]), "k", "v") == [(1, "b"), (2, None)]
    found = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert got(dedupe.coverage(rows.where("k is not null"), found, ["k"]), "k", "status") == [(1, "repeated"), (2, "missing"), (3, "unexpected")]


def test_categories_and_freshness(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (1, 1, None), (2, 1, "a"), (2, 1, "b"), (2, 2, "c"), (3, 1, "z")], "k int, tier int, category string")
    assert got(reconcile.resolve_categories(rows, ["k"]).fillna("-"), "k", "category", "status") == [(1, "a", "classified"), (2, "-", "conflict"), (3, "z", "classified")]
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "item_id int, fingerprint string")
    b = spark.createDataFrame([(1, "x"), (2, "q"), (4, "z")], "item_id int, fingerprint string")
    assert got(reconcile.freshness(a, b), "item_id", "status") == [(1, "current"), (2, "stale"), (3, "missing"), (4, "orphan")]


def test_all_documents_take_one_pass_and_equal_the_ranges_of_each_kind(spark):
    import random

    from pagewright.operators import ranges

    r = random.Random(5)
    types = ["report_first", "report", "motion_first", "motion", "minute_start", "minute_body", "hearing_start", "hearing_body", "form_first", "other"]
    made = [(c, p, r.choice(types[(c % 5) * 2 :][:3] or types), r.choice([True, False, None])) for c in range(60) for p in range(0, 40) if r.random() < 0.9]
    pages = spark.createDataFrame(made, "case_id int, page int, page_type string, named boolean")
    named = pages.where("named").selectExpr("case_id", "page as start_page")
    parts = {
        "report": ranges.report_ranges(pages).where("start_detected").join(named, ["case_id", "start_page"], "left_semi"), "motion": ranges.motion_boundaries(pages),
        "minute_order": ranges.started_ranges(pages), "hearing": ranges.started_ranges(pages, "hearing_start", "hearing_body"),
        "form": named.join(pages.where("page_type = 'form_first'"), ["case_id"]).where("page = start_page").selectExpr("case_id", "start_page", "page as end_page"),
    }
    want = sorted((x.case_id, k, x.start_page, x.end_page) for k, d in parts.items() for x in d.collect())
    found = ranges.all_documents(pages)
    assert sorted(tuple(x) for x in found.collect()) == want and len({k for _, k, _, _ in want}) == 5
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan
