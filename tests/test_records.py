"""Quotation places, gutters, HTML text, participants, layout, digests, streams."""

from pyspark.sql import functions as F

from pagewright.functions import html_text, locate, ranges_text
from pagewright.operators import digests, layout, participants
from pagewright.streaming import live


def test_places_of_quotations():
    assert locate.place("two words", "one two\n  words two words") == (4, 15, True)
    assert locate.place("interrupted", "it was inter-\n rupted there") == (7, 21, False)
    assert locate.place("interrupted", "it was inter-  rupted there") == (7, 21, False)
    assert locate.place("ﬁne  print", "a fine\u200b\nprint b") == (2, 13, False)
    # Quotation marks and dashes are compared as they are.
    assert locate.place("“quoted”", 'a "quoted" b') == locate.place("a-b", "a–b") == (None, None, False)
    assert locate.place("absent", "text") == locate.place("", "text") == locate.place(None, None) == (None, None, False)


def test_tables_become_grids():
    page = "<p>before</p><table><tr><th>a<th>long head</tr><tr><td>1<td>2</tr></table><script>x</script><p>after &amp;"
    assert html_text.to_text(page) == "before\n\na | long head\n1 | 2\n\nafter &"
    assert html_text.to_text(None) == ""


def test_participant_repair_settles(spark):
    person = "struct<id:string,name:string,role:string,evidence:array<int>>"
    rows = [
        (1, 1, None, [("a", " Ann ", "witness", [3, 1, 3]), ("a", "Ann", "counsel", [2]), ("", "Bo", None, [1]), ("z", "", "witness", [1]), ("y", "No Evidence", "witness", [])]),
        (1, 2, "odd", []),
        (1, 3, "none", None),
        (1, 4, "unresolved", [("q", "Q", "witness", [1])]),
    ]
    df = spark.createDataFrame(rows, f"case_id int, hearing_id int, status string, participants array<{person}>")
    once = participants.repair(df)
    got = {r.hearing_id: r for r in once.collect()}
    assert [p.id for p in got[1].participants] == ["a", "p2", "p3"] and got[1].participants[0].evidence == [1, 3] and got[1].status == "identified"
    assert got[1].codes == ["defaulted_status", "dropped_participant", "repaired_id", "witness_is_counsel"]
    assert (got[2].status, got[3].status, got[4].status) == ("none", "none", "unresolved") and got[4].codes == []
    assert participants.issues(once).count() == 0 and participants.issues(df.where("hearing_id < 3")).count() > 0
    twice = {r.hearing_id: (r.status, r.participants) for r in participants.repair(once.drop("codes")).collect()}
    assert twice == {k: (r.status, r.participants) for k, r in got.items()}


def test_layouts(spark):
    rows = [(1, "split", 3, 4, 9), (2, "split", 3, 5, 9), (3, "split", 0, 1, 9), (4, "rt_only", None, None, 9), (5, "ct_only", 1, None, 9), (6, None, None, None, 9)]
    df = spark.createDataFrame(rows, "case_id int, mode string, rt_end int, ct_start int, n_pages int")
    assert sorted((r.case_id, r.rule) for r in layout.layout_issues(df).collect()) == [(2, "adjacent"), (3, "bounds"), (5, "split_pages_unused"), (6, "mode")]
    pages = spark.createDataFrame([(1, 3), (1, 4), (4, 9), (8, 1)], "case_id int, page int")
    assert sorted((r.case_id, r.page, r.side or "-") for r in layout.sides(pages, df).collect()) == [(1, 3, "RT"), (1, 4, "CT"), (4, 9, "RT"), (8, 1, "-")]


def test_digests_round_trip(spark):
    rows = [(1, 0, "a_b #", "x\ny \\n *z*"), (1, 1, "c", None), (1, 2, "d", ""), (2, 10, "e", "## 3. no"), (2, 2, "f", "\\")]
    df = spark.createDataFrame(rows, "doc_id int, ordinal int, label string, digest string")
    got = digests.from_markdown(digests.to_markdown(df)).collect()
    assert sorted((r.doc_id, r.ordinal, r.label, r.digest) for r in got) == sorted(rows, key=lambda r: r[:2])


def test_range_text(spark):
    r = spark.sql("select '5-3, 7,x, 9 – 9' as t").select(ranges_text.range_text(ranges_text.range_list(F.col("t"))).alias("v")).first()
    assert r.v == "3-5, 7, 9"


def test_stream_keeps_each_page_once(spark, tmp_path):
    schema = "case_id int, page int, page_type string, ts timestamp"
    rows = spark.sql("select 1 as case_id, id % 3 as page, 'a' as page_type, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as ts from range(9)")
    rows.select(F.col("case_id").cast("int"), F.col("page").cast("int"), "page_type", "ts").write.parquet(str(tmp_path / "in"))
    stream = live.last_page_rows(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.page for r in spark.table("seen").collect()) == [0, 1, 2]
    counts = live.activity(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = counts.writeStream.format("memory").outputMode("complete").queryName("counts").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n_pages for r in spark.table("counts").collect()] == [9]
