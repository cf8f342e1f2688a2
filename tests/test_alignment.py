"""Alignment of sources and pages against a character-by-character walk, and span differences."""

import random
import unicodedata

from pyspark.sql import functions as F

from pagewright.functions import printable
from pagewright.operators import alignment


def coverage(text):
    """(character, offset) one by one, by the rule as stated."""
    out = []
    for i, c in enumerate(text):
        out += [(x, i) for x in unicodedata.normalize("NFKC", c) if not x.isspace() and unicodedata.category(x) not in ("Cc", "Cf")]
    return out


def plainly(source, pages):
    """(first line, last line, restored) of each page, walking both sides together."""
    stream = [(c, n) for n, shown, _ in printable.shown_lines(source) for c, _ in coverage(shown)]
    at, out, last = 0, [], 0
    for text in pages:
        have = coverage(text)
        lines = [n for _, n in stream[at : at + len(have)]]
        restored, done = [], 0
        for k in range(1, len(have)):
            if lines[k] != lines[k - 1] and have[k - 1][1] + 1 <= have[k][1]:
                restored += [text[done : have[k - 1][1] + 1], "\n" if lines[k] == lines[k - 1] + 1 else "\n\n"]
                done = have[k][1]
        first, last = (lines[0], lines[-1]) if lines else (last, last)
        out.append((first, last, "".join(restored) + text[done:]))
        at += len(have)
    return out


def cases():
    r, out = random.Random(8), []
    alphabet = 'abc ﬁ½ é­​"“”\t东 '
    for d in range(25):
        source = "\n".join("".join(r.choices(alphabet, k=r.choice((0, 3, 40, 900 if d % 5 == 0 else 20)))) for _ in range(r.randint(0, 30)))
        body = " ".join(shown for _, shown, _ in printable.shown_lines(source)).replace("ﬁ", "fi" if d % 2 else "ﬁ")
        pages, at = [], 0
        while at < len(body) or r.random() < 0.3:
            n = r.choice((0, 1, 7, 60, 700))
            pages.append(body[at : at + n])
            at += n
        out.append((d, source, pages))
    return out


def test_against_a_plain_walk(spark):
    given = cases()
    sources = spark.createDataFrame([(d, s, "x") for d, s, _ in given], "doc_id long, text string, line string").repartition(3)
    pages = spark.createDataFrame([(d, k + 1, p) for d, _, ps in given for k, p in enumerate(ps)], "doc_id long, page_no long, text string").repartition(3)
    got = {}
    rows = alignment.align(sources, pages).withColumn("moved", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda o: alignment.rebased(o, F.col("breaks")))).collect()
    for x in sorted(rows, key=lambda x: (x.doc_id, x.page_no)):
        assert x.equal and x.differs_at is None
        got.setdefault(x.doc_id, []).append((x.first_line, x.last_line, x.restored))
        text = given[x.doc_id][2][x.page_no - 1]
        for o in range(min(4, len(text))):  # an offset outside of breaks shows the same character
            if not any(b.start <= o < b.end for b in x.breaks):
                assert x.restored[x.moved[o]] == text[o]
        for s in x.spans:
            assert text[s.start : s.end] == s.label and "".join(c for c, _ in coverage(s.label)) in printable.content(s.phrase)
    assert got == {d: plainly(s, ps) for d, s, ps in given if ps}
    assert alignment.issues(sources, pages, alignment.align(sources, pages)).count() == sum(not ps and bool(coverage(s)) for d, s, ps in given)


def test_faults_are_reported(spark):
    sources = spark.createDataFrame([(1, "one two\nthree"), (2, "same"), (3, None), (5, "")], "doc_id long, text string")
    pages = spark.createDataFrame([(1, 1, "one tw"), (1, 2, "o threX"), (2, 1, "same and more"), (4, 1, "x"), (3, 1, None)], "doc_id long, page_no long, text string")
    found = {tuple(x) for x in alignment.issues(sources, pages, alignment.align(sources, pages)).collect()}
    assert found == {(1, 2, "content", 10), (2, None, "count", 7), (2, 1, "content", 4), (4, None, "no_source", 1), (4, 1, "content", 0)}
    assert alignment.align(sources.limit(0), pages.limit(0)).count() == 0


def test_lines_links_and_quotations():
    parts = printable.line_parts
    assert parts('see [RT 1](page:12) and "two words" here')[0] == "see RT 1 and two words here"
    assert parts('"a" "b c"') == ("a b c", [], [(0, 1, "a"), (2, 5, "b c")])
    assert parts('“a "b" c”')[0] == 'a "b" c' and parts('" "')[0] == '" "' and parts('""x"')[0] == '"x'
    assert parts('"half [in" link](page:3)')[2] == [] and parts('["all"](page:3)')[2] == [(0, 3, "all")]
    assert parts('“open')[0] == "“open"


def test_spans(spark):
    cols = "doc_id long, page_no long, start int, end int, label string, phrase string"
    a = [(1, 1, 0, 3, "a", "p"), (1, 1, 5, 8, "a", "p"), (1, 1, 9, 10, "b", "q"), (1, 2, 0, 1, "c", "r"), (1, 2, 0, 1, "c", "r")]
    b = [(1, 1, 0, 3, "a", "p"), (1, 1, 6, 9, "a", "p"), (1, 2, 0, 1, "c", "r"), (2, 1, 0, 1, "z", "z")]
    got = {tuple(x) for x in alignment.span_issues(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols)).collect()}
    assert got == {(1, 1, "shifted", "p", 5, 8, 6, 9), (1, 1, "missing", "q", 9, 10, None, None), (1, 2, "missing", "r", 0, 1, None, None), (2, 1, "extra", "z", None, None, 0, 1)}


def test_a_long_text_in_pieces(spark):
    text = "\n".join(f"line {i} of a long text" for i in range(100_000))
    body = text.replace("\n", " ")
    pages = spark.createDataFrame([(1, k + 1, body[at : at + 3000]) for k, at in enumerate(range(0, len(body), 3000))], "doc_id long, page_no long, text string")
    got = alignment.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), pages).agg(F.min("equal"), F.sum("first_line"), F.max("last_line"), F.count("*")).first()
    lines, at = [], 0
    for k in range(0, len(body), 3000):
        first = body[: k].count("line ") if body[k - 1 : k] == " " or not k else None
        lines.append(first)
    assert got[0] and got[2] == 100_000 and got[3] == len(lines)


def test_each_source_is_read_once(spark):
    sources = spark.createDataFrame([(1, 'a "b" c')], "doc_id long, text string")
    pages = spark.createDataFrame([(1, 1, "a b c")], "doc_id long, page_no long, text string")
    plan = alignment.align(sources, pages)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_content_and_its_sizes_by_character():
    r = random.Random(3)
    for alphabet in ("ab \t", "é東 x　", "ﬁ½­\u0000 a", "ﷺ\U0001d400\x1f b", ""):
        text = "".join(r.choices(alphabet, k=200)) if alphabet else ""
        assert printable.content(text) == "".join(c for c, _ in coverage(text))
        assert printable.content_sizes(text).tolist() == [len(coverage(c)) for c in text]


def test_a_quotation_over_many_cells_is_told_once_a_page(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CELL", 4)
    sources = spark.createDataFrame([(1, '"abcdefghijklmnopqrstuvwxyz"')], "doc_id long, text string")
    pages = spark.createDataFrame([(1, 1, "abcdefghijk"), (1, 2, "lmnopqrstuvwxyz")], "doc_id long, page_no long, text string")
    got = sorted((x.page_no, [(s.start, s.end) for s in x.spans]) for x in alignment.align(sources, pages).collect())
    assert got == [(1, [(0, 11)]), (2, [(0, 15)])]
