"""Quotation search against plain comparison."""

import itertools
import random
import re
import unicodedata

import pytest
from pagewright.functions import locate, phrases
from pagewright.functions.contained import Contained
from pagewright.operators import search
from pagewright.plans import records


def hits(spark, quotes, pages, *mode):
    q = spark.createDataFrame(quotes, "quote_id int, text string")
    p = spark.createDataFrame(pages, "page_id long, text string")
    return sorted(tuple(r) for r in search.quote_hits(q, p, *mode).collect())


def test_contained_against_plain_test():
    r = random.Random(2)
    for _ in range(300):
        strings = ["".join(r.choices("ab", k=r.randint(0, 14))).encode() for _ in range(30)]
        data = "".join(r.choices("ab", k=r.randint(0, 60))).encode()
        assert Contained(strings).find(data) == [i for i, s in enumerate(strings) if s in data]
    long = b"x" * ((1 << 20) - 3) + b"over the edge" + b"y" * 50
    assert Contained([b"over the edge", b"over the hedge"]).find(long) == [0]


@pytest.mark.parametrize("mode", ["exact", "relaxed"])
def test_any_number_of_quotations_gives_the_same_rows(spark, monkeypatch, mode):
    quotes = [(1, "art"), (2, "§ — §"), (3, "a"), (4, "the party of the art"), (5, "y of t"), (6, "art"), (6, "art"), (7, None), (8, "  "), (9, "absent quotation")]
    pages = [(10, "the party of the arts"), (11, "§ — § a"), (12, None), (13, ""), (10, "the party of the arts")]
    want = sorted((i, k) for i, q in quotes if (q or "").strip() for k, t in pages if t and (q in t if mode == "exact" else q.replace("—", "-") in t.replace("—", "-")))
    whole = hits(spark, quotes, pages, mode)
    for name in ("BLOCK", "MAX_QUOTES"):
        monkeypatch.setattr(search, name, 2, raising=False)
    assert whole == want and hits(spark, quotes, pages, mode) == want
    assert hits(spark, [], pages, mode) == []


def plainly_held(phrase, page):
    """The reference's rules, written out once more: words letter by letter, and all ways of joining them."""
    plain = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "\u00a0": " ", "·": " ", "•": " ", "|": " "}
    norm = lambda x: "".join(plain.get(c, c) for c in unicodedata.normalize("NFKC", x))
    page = norm(page.replace("\r\n", "\n").replace("\r", "\n"))
    words = norm(phrase.strip()).split()

    def run(at, chars):
        while at < len(page) and page[at] in chars:
            at += 1
        return at

    def word(w, i, at):
        """Ends of w[i:] that begins at at."""
        if i == len(w):
            return {at}
        c = page[at : at + 1]
        if not c or not (c.lower() == w[i].lower() or (c in "'\"" and w[i] in "'\"")):
            return set()
        ends = {at + 1}
        if w[i] == "-":
            k = run(at + 1, " ")
            ends |= {j for k in range(at + 1, k + 1) if page[k : k + 1] == "\n" for j in range(k + 1, run(k + 1, " ") + 1)}
        if w[i].isalnum() and w[i + 1 : i + 2].isalnum():
            ends |= set(range(at + 1, run(at + 1, " ") + 1))
        return set().union(*(word(w, i + 1, e) for e in ends))

    def join(at):
        for q in range(at, run(at, "'\"") + 1):
            for k in range(q + 1, len(page) + 1):
                gap = page[q:k]
                if set(gap) - set(" \t\n") or gap.count("\n") > 2:
                    break
                yield from range(k, run(k, "'\"") + 1)
                for d in range(k + 1, k + 9):
                    if not page[k:d].isdigit() or d > len(page):
                        break
                    for e in range(d, run(d, " \t") + 1):
                        yield from range(e, run(e, "'\"") + 1)

    ends = set(range(len(page) + 1))
    for i, w in enumerate(words):
        ends = set().union(*(word(w, 0, s) for s in ({s for e in ends for s in join(e)} if i else ends)))
    return bool(words) and bool(ends)


GIVEN = [
    ("plain words", "of plain words here"), ("a rule-bound man", "a rule-\n bound man"), ("ten – twelve", "ten - twelve"), ("office staff", "oﬃce\u00a0staff"), ("two lines", "two |\r\n| lines"), ("it’s \"so\"", "it\"s 'so'"),
    ("he said no", "he \"said\" no"), ("broken", "bro ken"), ("art of war", "party of art of warfare"), ("one two", "one\n\n 12 'two"), ("one two", "one\n\n\ntwo"), ("one two", "one 123456789 two"), ("one two", "onetwo"), ("Kiſs", "kiss"), ("...", "a . . ."), ("12 x", "1 2 x"), ("«é» ç", "«É» Ç"),
]


def test_phrases_by_the_rules(spark):
    r = random.Random(4)
    made = [("".join(r.choices("ab- '1", k=r.randint(1, 6))), "".join(r.choices("abAB--  ''1\n\t", k=r.randint(1, 16)))) for _ in range(4000)]
    held = 0
    for q, t in GIVEN + made:
        find = search.finder([q], "phrase", False)
        want = plainly_held(q, t)
        held += want
        assert find(t) == ([0] if want else []), (q, t)
    assert held > 300
    got = hits(spark, [(i, q) for i, (q, _) in enumerate(GIVEN)], [(i, t) for i, (_, t) in enumerate(GIVEN)], "phrase", False)
    assert got == sorted((i, k) for (i, (q, _)), (k, (_, t)) in itertools.product(enumerate(GIVEN), repeat=2) if plainly_held(q, t))
    assert {(i, i) for i in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9)} <= set(got) and not {(i, i) for i in (10, 11, 12)} & set(got)
    assert re.fullmatch(phrases.pattern("a", False), "A")


def test_quotations_are_placed_where_normal_text_holds_them(spark, tmp_path):
    quotes = [(0, "wrapped over lines"), (1, "interrupted speech"), (2, "\"fine\" words"), (3, "nowhere at all"), (4, "\x00"), (5, " twice "), (6, None)]
    pages = [(0, "x wrapped\n  over lines"), (1, "it was inter-\nrupted\nspeech"), (2, 'a "ﬁne" wo\u00adrds'), (3, "wrapped over\nlines"), (4, "twice or twice"), (5, "twice"), (6, None)]
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(pages, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(i, k, *locate.place(q, t)) for i, q in quotes for k, t in pages if locate.place(q, t)[0] is not None]
    assert sorted(tuple(r) for r in records.quote_locate_span(spark, str(tmp_path)).collect()) == sorted(want)
    assert [x[:2] for x in want] == [(0, 0), (0, 3), (1, 1), (2, 2), (5, 4), (5, 5)]
    best = sorted(tuple(r) for r in records.quote_best_page(spark, str(tmp_path)).collect())
    assert best == [(0, 0, True), (1, 1, True), (2, 2, True), (3, None, False), (4, None, False), (5, 5, True), (6, None, False)]


def test_phrases_that_stand_as_they_are_need_no_pattern(monkeypatch):
    class Never:
        def search(self, t):
            raise AssertionError("a pattern was tried")

    monkeypatch.setattr(phrases, "pattern", lambda *_: Never())
    find = search.finder(["one  two", "so forth"], "phrase", False)
    assert find("zero one \n two, and so\n\nforth") == [0, 1] and find("nothing") == []


def test_equal_quotations_give_a_row_each(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 2)
    quotes, pages = [(i, "so forth" if i % 2 else "and so") for i in range(9)], [(k, "and so forth") for k in range(4)]
    for mode in ("exact", "phrase"):
        assert hits(spark, quotes, pages, mode, False) == sorted((i, k) for i in range(9) for k in range(4))
    placed = [r[:2] for r in hits(spark, quotes, pages, "placed")]
    assert placed == sorted((i, k) for i in range(9) for k in range(4))


def test_shingles_are_shuffled_once_and_own_repeats_do_not_count(spark):
    texts = [(1, 5, "a b c d e"), (1, 5, "a b c d e"), (2, 6, "x b c d b c d"), (2, 6, "b c d"), (3, 7, None), (4, None, "a b c"), (5, 8, "c d e, C D E. b c d"), (6, 9, "a b")]
    rows = spark.createDataFrame(texts, "item int, at int, text string")
    found = search.repeated_shingles(rows, "item", "at", "text", 3)
    assert sorted(tuple(r) for r in found.collect()) == [(2, 1), (5, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2  # shingles, and counts by item
