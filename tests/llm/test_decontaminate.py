"""Where a match begins, odd tables and long texts."""

import random

from fixtures import words
from hypothesis import given, settings
from hypothesis import strategies as st
from pagewright.llm import decontaminate


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(prev[j] + 1, now[-1] + 1, prev[j - 1] + (x != y)))
        prev = now
    return prev[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=12, max_size=60), st.text("abcd ", max_size=40), st.text("abcd ", max_size=40), st.integers(0, 3), st.randoms(use_true_random=False))
def test_a_match_spans_what_it_says(item, before, after, edits, r):
    item = decontaminate.normalise(item)
    if len(item) < 12:
        return
    t = list(item)
    for _ in range(edits):
        k = r.randrange(len(t))
        t[k : k + 1] = r.choice(([], ["z"], [t[k], "y"]))
    text = decontaminate.normalise(before + " " + "".join(t) + " " + after)
    for _, found, start, end in decontaminate.Matcher([(1, item)], 0.25).match(text):
        assert 0 <= start <= end <= len(text) and distance(item, text[start:end]) == found


def test_a_left_out_word():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda"
    text = "xx yy " + item.replace(" eta", "") + " zz"
    (found,) = decontaminate.Matcher([(1, item)], 0.1).match(text)
    assert text[found[2] : found[3]] == item.replace(" eta", "") and found[1] == 4


def test_empty_tables_repeated_rows_null_ids_and_long_texts(spark):
    r = random.Random(3)
    item = words(r, 25)
    long = words(r, 60_000) + " " + item + " " + words(r, 10)
    kind = "doc_id long, text string, item_id int, start string"
    docs = spark.createDataFrame([(1, item, 1, "x"), (1, item, 1, "x"), (None, item.upper(), 1, "x"), (2, long, 1, "x"), (3, words(r, 30), 1, "x")], kind)
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string")
    got = decontaminate.hits(docs, bench).collect()
    assert sorted((g.doc_id or -1, g.item_id, g.edits, g.end - g.start) for g in got) == [(-1, 7, 0, len(item)), (1, 7, 0, len(item)), (1, 7, 0, len(item)), (2, 7, 0, len(item))]
    kept = decontaminate.clean(docs, bench)
    assert [x.doc_id for x in kept.collect()] == [3] and kept.columns == docs.columns
    assert decontaminate.hits(docs.where("false"), bench).count() == 0 and decontaminate.clean(docs, bench.where("false")).count() == 5
