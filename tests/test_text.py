"""Text, date and search functions."""

import datetime

from pyspark.sql import functions as F

from pagewright.functions import dates, html_text, locate, ranges_text, text
from pagewright.operators import search
from pagewright.sources import tables


def values(spark, f, *inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_dates(spark):
    d = datetime.date
    given = ("March 5, 2026", "Thursday, March  5, 2026", "Mar 5, 2026", "3/5/2026", "3/5/26", "3/5/70", "2026-03-05", "2/30/2026", "soon", None, "")
    assert values(spark, dates.recognized, *given) == [d(2026, 3, 5)] * 5 + [d(1970, 3, 5), d(2026, 3, 5)] + [None] * 4
    assert values(spark, dates.long_date, "3/5/26", "Monday, some day") == ["March 5, 2026", "some day"]


def test_scalars(spark):
    assert values(spark, text.page_number, "0012.txt", "x7y.a3.json", "none.txt") == [12, 7, None]
    assert values(spark, text.citation_label, "CT  p. 12", "RT pp. 3", "file page 4") == ["CT 12", "RT 3", "file page 4"]
    assert values(spark, text.truthy, " Yes", "0", None) == [True, False, False]
    assert values(spark, text.without_controls, "a\x00b\tc\nd\x85") == ["ab\tc\nd"]
    assert values(spark, text.collapse, " a \n b ", None) == ["a b", ""]
    keys = values(spark, text.natural_key, "Page 10", "page 9", "page 009b")
    assert sorted(keys) == [keys[1], keys[2], keys[0]]
    long = values(spark, text.natural_key, "p1234567890123", "p123456789012", "p1234567890124", "p", "p!")
    assert sorted(long) == [long[3], long[1], long[0], long[2], long[4]]
    assert values(spark, text.positive_page, " 12 ", "0", "-1", "x", "٣", None, "007") == [12, None, None, None, None, None, 7]
    assert values(spark, text.without_images, "a\n ![x](p.png) \nb ![y](z)\n![q](a b)") == ["a\nb ![y](z)\n![q](a b)"]
    assert values(spark, lambda x: text.bounded_text(x, 5, "-"), " ab ", "a\nb", "", None, "abcdef", "é") == ["ab", "-", "-", "-", "-", "é"]


def test_margins(spark):
    page = "┌──┬──┐\n│ 21 │ Q. Did you? │\n22 │ A. Yes\n 3   He said\n7 (yes)\n120  x\na + b | c - d\n=====\na │ b\n\n7 9\nwide        gap\n+++\n"
    want = "Q. Did you?\nA. Yes\nHe said\n(yes)\nx\na + b | c - d\n=====\na    b\n\n7 9\nwide    gap"
    assert values(spark, text.strip_margins, page, "", None) == [want, "", None]
    assert values(spark, html_text.strip_tables, "a  b\n", "<TABLE><tr><td>x<td>y</table>", None) == ["a  b\n", "x | y", None]


def test_quote_flags(spark):
    given = ("one two three four five six", "one, two; three four five six,", "a b c d e f. . . g", "one two three four five six.”", "inter-\nrupted one two three four five", "too short!", "one two three four five six…")
    got = values(spark, lambda x: text.quote_flags(x, locate.normalised(x)), *given)
    assert got == [[], [], ["ellipsis"], ["terminal"], [], ["length", "terminal"], ["ellipsis"]]


def test_relaxed_search_folds_case_and_marks(spark):
    quotes = spark.createDataFrame([(1, "the STRASSE’s “end”"), (2, " "), (3, "x•y")], "quote_id int, text string")
    pages = spark.createDataFrame([(1, "on the\n\nstraße's \"End\" now"), (2, "x y")], "page_id int, text string")
    assert [(r.quote_id, r.page_id) for r in search.quote_hits(quotes, pages, "relaxed").collect()] == [(1, 1)]


def test_selections_hold_any_characters(spark):
    rows = [(r"a\E)b", r"x a\E)b y"), ("a.b", "axb"), ("a+b", "is a+b."), ("[x", "q [x z"), ("ab", "cab ab"), ("😀 x", "y 😀 x")]
    got = [r.v for r in spark.createDataFrame(rows, "s string, q string").coalesce(1).select(ranges_text.whole_words_of(F.col("s"), F.col("q")).alias("v")).collect()]
    assert got == [True, False, True, True, True, True]


def test_field_prefers_the_exact_key(spark):
    row = spark.sql("select map('Page Type', 'a', 'page_type', '') as m, map('PAGE-TYPE', ' b ') as n")
    r = row.select(text.field(F.col("m"), "page_type").alias("x"), text.field(F.col("n"), "page_type").alias("y"), text.field(F.col("n"), "other").alias("z")).first()
    assert tuple(r) == ("", "b", "")


def test_phrase_search(spark):
    quotes = spark.createDataFrame([(1, "the quick fox")], "quote_id int, text string")
    texts = {1: "the quick fox", 2: "The\n\nquick  fox", 3: "the\n\n\nquick fox", 4: "the 12345678 quick fox", 5: "the 123456789 quick fox", 6: "the 1 2 quick fox", 7: "bathe quick fox"}
    pages = spark.createDataFrame([*texts.items()], "page_id int, text string")
    assert sorted(r.page_id for r in search.quote_hits(quotes, pages, "phrase").collect()) == [1, 2, 4]
    assert sorted(r.page_id for r in search.quote_hits(quotes, pages).collect()) == [1, 7]


def test_jsonl_is_read_tolerantly(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n[1]\nnot json\n{"k": "x", "z": null}\n{"bad"\n')
    assert sorted(r.row["k"] for r in tables.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == ["1", "x"]
    (tmp_path / "0003.txt").write_text("three")
    (tmp_path / "x.txt").write_text("no")
    assert [(r.page, r.text) for r in tables.read_page_texts(spark, str(tmp_path)).collect()] == [(3, "three")]
