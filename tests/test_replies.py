"""Reading and normalising answers."""

from pyspark.sql import functions as F

from pagewright.functions import replies


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_payloads(spark):
    assert values(spark, replies.json_payload, 'well {"a": {"b": 1}} so', "none", None) == ['{"a": {"b": 1}}', None, None]
    assert values(spark, replies.reply_text, '{"choices":[{"message":{"content":" hi "}}]}', '{"response":"x"}', "bad") == ["hi", "x", ""]
    assert values(spark, replies.loose_page_type, "{page_type: 'Report First', x", "no") == ["Report First", None]
    assert values(spark, replies.prompt_keys, 'use "a": 1, "b" : 2 and "a": 3') == [["a", "b"]]


def test_values(spark):
    assert values(spark, replies.yes_no, " Yes", "0", "maybe", None) == ["yes", "no", None, None]
    assert values(spark, lambda c: replies.enum_value(c, ["minute order", "report"]), "Minute_Order", "x") == ["minute order", None]
    assert values(spark, replies.strict_date, "March  5, 2026", "march 5, 2026", "March 35, 2026", "3/5/2026") == ["March 5, 2026", None, None, None]
    assert values(spark, lambda c: replies.starts_with_date(c, F.lit("March 5, 2026")), "march 5 2026 - x", "x") == [True, False]
    assert values(spark, replies.case_name, "  A v. B / C ", None, "__a _ b\tc_", "x" * 119 + "_yz") == ["A_v._B_/_C", "", "a_b_c", "x" * 119]
    assert values(spark, replies.shown_case_name, "A_v_B", "x" * 81, "x" * 80) == ["A v B", "x" * 77 + "...", "x" * 80]
    assert values(spark, replies.case_name_issues, "Fine", "", "a/b", "In re Unknown Heirs", "Unknown", "cannot_determine it", ".a", "12 34", "a`b", "a\u200bb", "x" * 121) == [
        [], ["empty"], ["characters"], [], ["refusal"], ["refusal"], ["leading_dot"], ["letters"], ["characters"], ["characters"], ["length"]
    ]
    assert values(spark, replies.paragraphs, "a\nb\n\n  \nc", None) == [["a b", "c"], []]
    assert values(spark, lambda c: replies.elapsed(c.cast("int")), "3723", "63") == ["1:02:03", "1:03"]
    assert values(spark, lambda c: replies.counted(c.cast("int"), "page"), "1", "2") == ["1 page", "2 pages"]
    assert values(spark, lambda c: replies.heading("report", F.lit("Monday, May 1, 2026"), c), " Big  Report") == ["## Big Report, May 1, 2026"]
