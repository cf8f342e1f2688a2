"""Boundaries, work items, digest rows, expected pages, numbering and keyed streams."""

import random

from pyspark.sql import functions as F

from pagewright.operators import boundaries, digests, intervals, ranges, reconcile
from pagewright.sources import tables
from pagewright.streaming import live


def test_expected_pages_and_expansion(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 0), (3, None)], "case_id int, n_pages int")
    assert sorted((r.case_id, r.page, r.file_name) for r in tables.expected_pages(df).collect()) == [(1, 1, "0001.txt"), (1, 2, "0002.txt"), (1, 3, "0003.txt")]
    spans = spark.createDataFrame([(1, 3, 1), (1, 4, 5), (1, 7, 7)], "case_id int, start_page int, end_page int")
    assert sorted(r.page for r in intervals.expand(spans).collect()) == [4, 5, 7]


def pages(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "case_id int, page int, page_type string, named boolean")


def test_historical_ranges_and_named_motions(spark):
    rows = [(1, "report", False), (2, "report_first", True), (3, "report", False), (5, "report_first", False), (6, "other", False), (7, "report_first", True)]
    got = sorted((r.start_page, r.end_page, r.start_detected) for r in ranges.report_ranges(pages(spark, rows), modern=False).collect())
    assert got == [(1, 3, True), (5, 5, True), (7, 7, True)]
    kinds = [(1, 1), (2, 0), (3, 1, False), (4, 0), (5, 1), (6, 1), (7, 1), (9, 0), (10, 1, False), (11, 1), (13, 1)]
    motion = [(k[0], "motion_first" if k[1] else "motion", len(k) < 3) for k in kinds] + [(8, "other", False)]
    assert sorted(r.start_page for r in ranges.motion_boundaries(pages(spark, motion)).collect()) == [1, 5, 6, 7, 11, 13]


def test_documents_of_all_kinds(spark):
    rows = [(1, "form_first", True), (2, "form_first", False), (3, "hearing_start", False), (4, "hearing_body", False), (5, "minute_start", False), (6, "hearing_body", False), (7, "report_first", True), (8, "report_first", False), (9, "report", True)]
    got = sorted((r.start_page, r.kind, r.end_page) for r in ranges.all_documents(pages(spark, rows)).collect())
    assert got == [(1, "form", 1), (3, "hearing", 4), (5, "minute_order", 5), (7, "report", 7)]
    starts = spark.createDataFrame([(1, "hearing", 1, "May 1"), (1, "hearing", 5, "May 1"), (1, "minute_order", 7, "May 1"), (1, "minute_order", 8, ""), (1, "minute_order", 9, ""), (2, "hearing", 9, "May 1")], "case_id int, kind string, start_page int, date string")
    assert sorted((r.case_id, r.start_page) for r in ranges.same_date_starts(starts).where("same_date_as_previous").collect()) == [(1, 5)]


def test_structure_comes_before_dates(spark):
    rows = [(1, 1, "0001.txt", "3", "May 1, 2020"), (1, 2, "4", "0004.txt", "soon"), (2, 1, "5", "4", "May 1, 2020"), (2, 2, "9", "9", "May 1, 2020"), (3, 1, "1", "5", None), (3, 2, "5", "6", "5/1/20"), (4, 1, "0", "2", ""), (4, 2, "x.txt", "2", "")]
    df = spark.createDataFrame(rows, "case_id int, entry_id int, start string, end string, date string")
    assert sorted(tuple(r) for r in boundaries.structure_issues(df).collect()) == [(2, 1, "reversed"), (3, 2, "overlap"), (4, 1, "malformed"), (4, 2, "malformed")]
    got = {(r.case_id, r.entry_id): r.status for r in boundaries.dated_boundaries(df).collect()}
    assert got == {(1, 1): "kept", (1, 2): "omitted", **{(c, e): "refused" for c in (2, 3, 4) for e in (1, 2)}}
    lines = boundaries.omission_lines(spark.createDataFrame([(1, i, i + i % 2) for i in range(1, 46, 2)], "case_id int, start_page int, end_page int"))
    assert sorted((r.batch, r.ranges.count(",") + 1) for r in lines.collect()) == [(0, 20), (1, 3)]


def test_retention_and_work_items(spark):
    rows = [("hearing", None, " ", None), ("hearing", None, "someday", None), ("report", " ", "", None), ("report", "n", "", "unresolved"), ("motion", "n", "", "fixed"), ("minute_order", "", "soon", None), ("minute_order", "", "5/1/20", None)]
    got = boundaries.retained(spark.createDataFrame(rows, "kind string, name string, date string, naming_status string").coalesce(1)).collect()
    assert [r.reason for r in got] == ["undated", None, "unnamed", "unresolved", None, "unrecognized_date", None] and all(r.keep == (r.reason is None) for r in got)
    items = spark.createDataFrame([(1, 9, 12), (1, 1, 4), (1, 4, 6), (1, 7, 8)], "case_id int, start_page int, end_page int")
    people = spark.createDataFrame([(1, 1, 4, 3), (1, 7, 8, 1), (1, 7, 8, 1), (1, 20, 21, 5)], "case_id int, start_page int, end_page int, n_people int")
    got = sorted((r.start_page, r.ordinal, r.issue) for r in boundaries.work_items(items, people).collect())
    assert got == [(1, 1, None), (4, 2, "overlap"), (7, 3, "repeated"), (9, 4, "unmatched"), (20, None, "orphan")]


def test_digest_rows(spark):
    kind = "item_id string, kind string, start_page int, end_page int, categories array<struct<id:string,text:string,evidence:array<struct<quote_id:string,text:string,file_page:int>>>>"
    fine = [("a", "x", [("q1", "t", 2), ("q2", "t", 3)]), ("b", None, None)]
    rows = [("fine", "hearing", 2, 3, fine), ("null", None, None, 3, None), ("order", "report", 1, 3, fine[::-1]), ("quotes", "motion", 1, 3, [("a", " ", [("q1", " ", 2), ("q1", "t", 9)]), ("b", "y", [])])]
    got = sorted(tuple(r) for r in digests.row_issues(spark.createDataFrame(rows, kind), ["a", "b"]).collect())
    assert got == sorted([("null", "kind"), ("null", "pages"), ("null", "categories"), ("order", "categories"), ("quotes", "silent_evidence"), ("quotes", "blank_quote"), ("quotes", "quote_id"), ("quotes", "quote_page")])
    texts = spark.createDataFrame([("see [p](page:0012) and {{quote:a}}",), ("input_sha256 No direct quotes.",), ("plain (page:0012)",)], "t string").coalesce(1)
    assert [r.f for r in texts.select(digests.metadata_flags(F.col("t")).alias("f")).collect()] == [["page_link", "placeholder"], ["empty_quotes_marker", "hash_label"], []]


def test_numbers_in_ranges_are_those_of_the_whole(spark, monkeypatch):
    monkeypatch.setattr(reconcile, "NUMBERED_AT_ONCE", 7)
    r = random.Random(2)
    rows = [(r.choice(("a", "b", None)), k) for k in r.sample(range(-50, 200), 120)]
    got = {(x.g, x.k): x.number for x in reconcile.numbered(spark.createDataFrame(rows, "g string, k long"), ["g"], "k").collect()}
    assert got == {(g, k): 1 + sum(h == g and j < k for h, j in rows) for g, k in rows}


def test_several_files_in_natural_order(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"file_name": "0010.txt"}\n{"x": 1}\n')
    (tmp_path / "b.jsonl").write_text('{"File Name": "9.txt"}\n{"file_name": "0010.txt"}\n')
    rows = tables.read_jsonl_sorted(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")])
    assert [r.row.get("file_name") or r.row.get("File Name") for r in rows.collect()] == ["9.txt", "0010.txt", "0010.txt", None]
    assert sorted(r.file_name for r in tables.names_in(rows).collect()) == ["0010.txt", "9.txt"]


def test_keyed_batches_add_each_key_once(spark, tmp_path):
    schema = "k int, v string"
    source, out = tmp_path / "in", str(tmp_path / "out")
    for i, rows in enumerate(([(1, "a"), (1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        live.upsert_batches(stream, out, ["k"]).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        got = sorted((r.k, r.v) for r in spark.read.parquet(out).collect())
        assert got == [(1, "a"), (2, "b"), (3, "d")][: 2 + i]


def test_second_names_and_omission_messages(spark):
    rows = [(1, 1, None, "3", "0004.txt", ""), (1, 2, "", "x", "7", "9"), (1, 3, "9", "1", None, "8"), (1, 4, "10", "5", "12", None), (1, 5, None, None, "3", "4")]
    df = spark.createDataFrame(rows, "case_id long, entry_id long, start_page string, start string, end_page string, `end` string")
    assert sorted((r.entry_id, r.rule) for r in boundaries.structure_issues(df).collect()) == [(2, "malformed"), (3, "reversed"), (5, "malformed")]
    numbers = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 0, 0)], "case_id long, entry_id long, start_page int, start int").withColumn("end", F.lit(6))
    assert [(r.entry_id, r.rule) for r in boundaries.structure_issues(numbers).collect()] == [(2, "malformed")]
    omitted = spark.createDataFrame([(1, 4, 4), (1, 2, 3), (1, 9, 12)], "case_id long, start_page int, end_page int")
    got = sorted((r.nth, r.message) for r in boundaries.omission_messages(omitted, 2).collect())
    assert [n for n, _ in got] == [0, 1, 2] and got[0][1].startswith("3 minute candidates omitted: minute_date_unresolved. ") and got[1][1] == "Omitted minute source-page ranges: 0002-0003, 0004."


def test_hearing_ranges_are_made_once_for_their_work_items(spark):
    from pagewright.plans import boundaries as plans

    found = plans.hearing_work_items(spark, "/root/testdata/sf0.001")
    assert found.count() > 0 and "l_shipdate" not in found._jdf.queryExecution().optimizedPlan().toString()
