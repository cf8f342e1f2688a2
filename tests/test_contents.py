"""Sections and repeated dates against a plain walk, at any size of a block."""

import random

import pytest

from pagewright.operators import contents

SOME = ["MINUTE ORDERS", " MINUTE ORDERS\t", "HEARINGS", "FORMS", "", None, "\tMay 1, 2020 0003", "\tMay 1, 2020 0009", "\t2020-05-01 7", "\tsoon 4", "\t", "May 1, 2020 3", "\tMay 2, 2020 0001", "note", "\t5/2/2020"]
DAYS = {"\tMay 1, 2020 0003": 1, "\tMay 1, 2020 0009": 1, "\t2020-05-01 7": 1, "\tMay 2, 2020 0001": 2, "\t5/2/2020": 2}


@pytest.mark.parametrize("block", [1, 3, 256])
def test_against_a_plain_walk(spark, monkeypatch, block):
    monkeypatch.setattr(contents, "BLOCK", block)
    r = random.Random(block)
    rows = [(k, n, r.choice(SOME)) for k in range(6) for n in range(60)]
    want = []
    for k in range(6):
        state, nth, seen = None, 0, set()
        for _, n, t in (x for x in rows if x[0] == k):
            bare = (t or "").strip()
            gone = False
            if bare in ("MINUTE ORDERS", "FORMS", "HEARINGS"):
                state, seen, nth = bare, set(), nth + (bare == "MINUTE ORDERS")
            elif state == "MINUTE ORDERS" and t in DAYS:
                gone = DAYS[t] in seen
                seen.add(DAYS[t])
            want.append((k, n, state, nth, gone))
    df = spark.createDataFrame(rows, "toc long, line long, text string").repartition(4)
    got = contents.corrected(df, "toc", "line", "text").select("toc", "line", "heading", "nth", "removed").collect()
    assert sorted(map(tuple, got), key=lambda x: x[:2]) == want
    assert contents.corrected(df.limit(0), "toc", "line", "text").count() == 0
