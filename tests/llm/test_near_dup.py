import random
import re

import numpy as np
import pytest
from fixtures import documents, frame, words
from pagewright.llm import near_dup
from pagewright.llm.common import components, star_rounds
from pagewright.llm.hashing import BLOCK, shingle_sets, words_of
from pyspark.sql import functions as F


def plain_sets(rows, n):
    out = {}
    for row in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), row[1] or ""))
        out[row[0]] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    return out


def roots(nodes, links):
    top = {x: x for x in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("n", [2, 5])
def test_against_brute_force(spark, n):
    rows = documents()
    sets = plain_sets(rows, n)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = roots(sets, [x for x in links if sets[x[1]]])
    got = near_dup.near_duplicates(frame(spark, rows), words=n).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {k: len(v) for k, v in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_group_of_near_copies_larger_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 8)
    r = random.Random(3)
    base = words(r, 80).split()
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(r.randint(0, 7)):
            t[r.randrange(80)] = f"w{r.randrange(9)}"
        rows.append((i, " ".join(t), "en", "s", 0, 1, "", 1, "", 1))
    sets = plain_sets(rows, 2)
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), words=2).collect()} == want


def test_null_ids_empty_table_and_repeated_rows(spark):
    row = (5, "a b c d e f", "en", "s", 0, 1, "", 1, "", 1)
    got = near_dup.near_duplicates(frame(spark, [row, row, (None, *row[1:])])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got if r.doc_id) == [(5, 5, True)] * 2
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert near_dup.near_duplicates(frame(spark, []), words=2).count() == 0


def test_components_in_one_task_and_in_rounds(spark):
    r = random.Random(5)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)]
    df = spark.createDataFrame([*edges, (None, 3), (4, 4)], "a long, b long")
    want = roots({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert {x.node: x.component for x in components(df).collect()} == want
    assert {x.node: x.component for x in components(df, task_links=0).collect()} == want
    assert components(df.where("a > 999"), task_links=0).count() == 0
    assert star_rounds(df.where("a > 999").select(F.col("a").alias("u"), F.col("b").alias("v")), 9).count() == 0


def test_hashes_do_not_depend_on_the_place(spark):
    text = words(random.Random(2), BLOCK // 4).encode()
    assert len(text) > BLOCK
    assert (words_of(text) == np.concatenate([words_of(w) for w in text.split()])).all()
    a = shingle_sets([b"x", text, b"", b" a  B\tc "], 2)
    assert (a[1] == shingle_sets([text], 2)[0]).all() and not len(a[2]) and (a[3] == shingle_sets([b"A b C"], 2)[0]).all()


def test_sketches_estimate_high_similarities():
    r = np.random.default_rng(0)
    for j in (0.8, 0.9):
        both = r.integers(0, 1 << 63, 800, dtype=np.uint64)
        k = round(800 * (1 - j) / (1 + j))
        a, b = np.sort(both), np.sort(np.concatenate((both[: 800 - k], r.integers(0, 1 << 63, k, dtype=np.uint64))))
        s = near_dup.odd_sketches(near_dup.minhashes([a, b])).view(np.uint64)
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= near_dup.most_flips(0.8)


def test_long_words_that_polynomials_confuse(spark):
    """A Thue-Morse string and its complement: equal under every polynomial hash modulo 2 ** 64."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a, "en", "s", 0, 1, "", 1, "", 1), (2, b, "en", "s", 0, 1, "", 1, "", 1), (3, f"{a} x", "en", "s", 0, 1, "", 1, "", 1), (4, f"{b} x", "en", "s", 0, 1, "", 1, "", 1)]
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows), words=2).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_no_pair_at_the_threshold_is_missed(spark):
    """Pairs of 40 to 400 words at a similarity from 0.8 up, one by one: all are linked, and none below."""
    r, rows, want = random.Random(12), [], 0
    for i in range(250):
        a = [f"w{r.randrange(10**6)}" for _ in range(r.randint(40, 400))]
        b = list(a)
        for _ in range(max(1, round(len(a) * r.uniform(0.01, 0.1)))):
            b[r.randrange(len(b))] = f"v{r.randrange(10**6)}"
        rows += [(2 * i, " ".join(a), "en", "s", 0, 1, "", 1, "", 1), (2 * i + 1, " ".join(b), "en", "s", 0, 1, "", 1, "", 1)]
    sets = plain_sets(rows, 2)
    close = {i for i in range(250) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])}
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(frame(spark, rows), words=2).collect()}
    assert 60 < len(close) < 240 and {i for i in range(250) if got[2 * i + 1] == 2 * i} == close


def test_one_id_with_several_texts(spark):
    """Each text of an id keeps its links, and the id joins them; a row without words keeps to its id."""
    a, b = (" ".join(f"{w}{i}" for i in range(30)) for w in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (4, "something else here at all"), (1, ""), (5, a), (5, a), (None, a)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=5, threshold=0.8)
    got = {(x.doc_id, x.n_shingles > 0): x.component_id for x in found.collect()}
    assert got == {(1, True): 1, (2, True): 1, (3, True): 1, (4, True): 4, (1, False): 1, (5, True): 1, (None, True): None}
    assert found.count() == len(rows)
