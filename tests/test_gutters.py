"""Gutters of four forms, pages that are left alone, places, and the longest chain against trying all."""

import itertools
import random

from pyspark.sql import functions as F

from pagewright.functions import gutters

TEXT = "so the witness said that it was late and then went home again".split()


def row(r):
    return " ".join(r.choice(TEXT) for _ in range(11))[:60].strip()


def forms(seed=1, n=28):
    r = random.Random(seed)
    rows = [row(r) for _ in range(n)]
    return rows, {
        "barred": "\n".join(f"{i:2} | {x}" for i, x in enumerate(rows, 1)),
        "bare": "\n".join(f"{i:2}   {x}" for i, x in enumerate(rows, 1)),
        "detached": "\n".join(f"{i:2}\n  {x}" for i, x in enumerate(rows, 1)),
        "flattened": "front " + " ".join(f"{i} {x}" for i, x in enumerate(rows, 1)),
    }


def test_each_form_and_its_places():
    for seed in range(8):
        rows, pages = forms(seed)
        for form, page in pages.items():
            found, spans = gutters.gutter(page)
            text = gutters.without(page, spans)
            assert found == form and text == ("front " + " ".join(rows) if form == "flattened" else "\n".join(rows))
            assert "".join(page[gutters.source_place(spans, i)] for i in range(len(text))) == text


def test_rules_bars_and_mixed_pages():
    rows, pages = forms(3)
    page = "   |  " + "\n" + pages["barred"] + "\n" + "─" * 20 + "\n"
    text = gutters.without(page, gutters.gutter(page)[1])
    assert text.strip() == "\n".join(rows)
    with_number = pages["flattened"].replace("again", "again 12 months", 1)  # a number out of order is text
    assert "12 months" in gutters.without(with_number, gutters.gutter(with_number)[1]) or "12 months" not in with_number


def test_what_is_left_alone():
    rows, pages = forms(5)
    table = "\n".join(f"{i:2} | name      {i * 7}      total" for i in range(1, 29))
    prose = " ".join(rows) * 3
    listed = "\n".join(f"{i}. {x}" for i, x in enumerate(rows, 1))
    sentences = "\n".join(f"{i}\n{x}." for i, x in enumerate(rows, 1))
    short = "\n".join(f"{i}\n{x}" for i, x in enumerate(rows[:12], 1))
    exhibits = "\n".join(f"EXHIBIT {i} {x}" for i, x in enumerate(rows, 1))
    falling = "\n".join(f"{29 - i:2} | {x}" for i, x in enumerate(rows, 1))
    for page in (table, prose, listed, sentences, short, exhibits, falling, "", None, "1 | a\n2 | b", pages["barred"] + "x" * gutters.PAGE_CAP):
        assert gutters.gutter(page) == (None, []), page


def test_longest_chain_against_all_chains():
    r = random.Random(9)
    for _ in range(60):
        at, tokens = 0, []
        for _ in range(r.randint(0, 9)):
            at += r.randint(5, 120)
            tokens.append(gutters.Token(r.randint(1, 6), at, at + 1))
        fits = lambda a, b: 1 <= b.number - a.number <= 3 and 18 * (b.number - a.number) <= b.start - a.start <= 95 * (b.number - a.number)
        best = max((len(c) for n in range(len(tokens) + 1) for c in itertools.combinations(tokens, n) if all(fits(a, b) for a, b in zip(c, c[1:]))), default=0)
        found = gutters.longest_chain(tokens)
        assert len(found) <= best and all(fits(a, b) for a, b in zip(found, found[1:]))
        assert len(found) >= best - 1  # one chain a number is kept, so a shorter one that could go on further may be lost


def test_columns(spark):
    _, pages = forms(2)
    rows = [(k, p) for k, p in pages.items()] + [("none", "plain"), ("null", None)]
    df = spark.createDataFrame(rows, "kind string, page string").withColumn("g", gutters.projection(F.col("page")))
    at = F.explode(F.sequence(F.lit(0), F.length("g.text") - 1))
    places = df.where("g.form is not null").select("kind", "page", "g", at.alias("at")).select((F.substring("page", gutters.source_offset(F.col("at"), F.col("g.removed")) + 1, F.lit(1)) == F.substring("g.text", F.col("at") + 1, F.lit(1))).alias("ok"))
    assert places.groupBy("ok").count().collect()[0].ok is True and places.where("not ok").count() == 0
    got = {x.kind: (x.g.form, x.g.text) for x in df.collect()}
    assert got["none"] == (None, "plain") and got["null"] == (None, None) and all(got[k][0] == k for k in pages)
