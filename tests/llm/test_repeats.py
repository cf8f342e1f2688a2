import hashlib
import random

import numpy as np
from fixtures import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pagewright.llm import repeats


def plain(rows, length=50):
    seen, out = {}, {}
    for doc, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        gone = np.zeros(len(text), bool)
        for i in range(len(text) - length + 1):
            w = text[i : i + length]
            if seen.get(w, doc) < doc:
                gone[i : i + length] = True
            seen.setdefault(w, doc)
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out[doc] = (len(text), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    rows, r = documents(), random.Random(4)
    passage = "".join(r.choices("abc é", k=70))
    rows += [(200 + i, "".join(r.choices("ab", k=r.randint(0, 40))) + passage[i % 3 : 50 + i] + "".join(r.choices("ab", k=30)), "", "", 0, 1, "", 1, "", 1) for i in range(15)]
    rows += [(300 + i, "a" * (45 + i), "", "", 0, 1, "", 1, "", 1) for i in range(12)] + [(400 + i, "ab" * 60 + "c" * i, "", "", 0, 1, "", 1, "", 1) for i in range(3)]
    rows += [(500, "z" * 60 + "y" * 50, "", "", 0, 1, "", 1, "", 1), (501, "z" * 60 + "y" * 50, "", "", 0, 1, "", 1, "", 1)]
    got = repeats.remove_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == plain(rows)


def test_null_ids_and_empty_table(spark):
    rows = [(None, "q" * 80, "", "", 0, 1, "", 1, "", 1), (1, "q" * 80, "", "", 0, 1, "", 1, "", 1), (1, "q" * 80, "", "", 0, 1, "", 1, "", 1)]
    assert sorted((r.doc_id or -1, r.n_removed) for r in repeats.remove_repeats(frame(spark, rows)).collect()) == [(-1, 0), (1, 0), (1, 0)]
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text("ab", max_size=40).map(str.encode), st.integers(1, 4))
def test_maximal_repeats(data, least):
    want = []
    for n in range(least, len(data)):
        for w in {data[i : i + n] for i in range(len(data) - n + 1)}:
            at = [i for i in range(len(data) - n + 1) if data[i : i + n] == w]
            left, right = {data[i - 1] if i else -1 for i in at}, {data[i + n] if i + n < len(data) else -1 for i in at}
            if len(at) > 1 and (len(left) > 1 or -1 in left) and (len(right) > 1 or -1 in right):
                want.append((n, at))
    assert repeats.maximal_repeats(data, least) == sorted(want, key=lambda x: (x[1], x[0]))


def test_groups_have_all_occurrences(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 3000)
    r = random.Random(8)
    passages = ["".join(r.choices("abcd é", k=r.randint(45, 160))) for _ in range(5)]
    rows = []
    for i in range(40):
        p = r.choice(passages)
        a, b = sorted((r.randrange(len(p)), r.randrange(len(p))))
        rows.append((i, "".join(r.choices("xyz", k=r.randint(0, 30))) + p[a:b] + r.choice(("", "q", p)) + "".join(r.choices("xyz", k=9)), "", "", 0, 1, "", 1, "", 1))
    rows += [(90, None, "", "", 0, 1, "", 1, "", 1), (91, "a" * 70, "", "", 0, 1, "", 1, "", 1), (92, rows[0][1], "", "", 0, 1, "", 1, "", 1), (None, rows[0][1], "", "", 0, 1, "", 1, "", 1)]
    raw = {x[0]: (x[1] or "").encode() for x in rows if x[0] is not None}
    groups = {}
    for g in repeats.repeat_groups(frame(spark, rows)).collect():
        groups.setdefault((g.group_id, g.n_bytes), set()).add((g.doc_id, g.start))
    everywhere = {}
    for doc, t in raw.items():
        for i in range(len(t) - 49):
            everywhere.setdefault(t[i : i + 50], set()).add((doc, i))
    covered = {doc: np.zeros(len(t), bool) for doc, t in raw.items()}
    assert any(k[0].startswith("node") for k in groups)
    for (_, n), at in groups.items():
        doc, i = next(iter(at))
        s = raw[doc][i : i + n]
        assert n >= 50 and len(at) > 1 and at == {(d, i) for d, i in everywhere[s[:50]] if raw[d][i : i + n] == s}
        for d, i in at:
            covered[d][i : i + n] = True
    for doc, t in raw.items():
        want = np.zeros(len(t), bool)
        for i in range(len(t) - 49):
            if len({d for d, _ in everywhere[t[i : i + 50]]}) > 1:
                want[i : i + 50] = True
        assert (covered[doc] >= want).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=3, max_size=12).map(str.encode), st.integers(0, 5)), min_size=1, max_size=8))
def test_reach_against_brute_force(entries):
    """Every byte of a 3-byte string that a smaller document has too, and no other, is reached."""
    text = np.frombuffer(b"".join(t for t, _ in entries), np.uint8)
    size = np.array([len(t) for t, _ in entries])
    begin = np.cumsum(size) - size
    entry = np.repeat(np.arange(len(size)), size - 2)
    offset = np.concatenate([np.arange(k - 2) for k in size])
    starts, doc = begin[entry] + offset, np.array([d for _, d in entries])
    left = np.where(offset > 0, text[starts - 1].astype(np.int16), np.int16(-1))
    order, lcp = repeats.enhanced(text, starts, begin + size, entry, left, 3)
    depth, owner = repeats.reach(lcp, left[order], doc[entry[order]], 3)
    gone = np.zeros(len(text), bool)
    for s, d, o, e in zip(starts[order], depth, owner, entry[order]):
        gone[s : s + d] = gone[s : s + d] | (d > 0)
        assert d == 0 or o < doc[e]
    want = np.zeros(len(text), bool)
    for t, d, at in ((t, d, b) for (t, d), b in zip(entries, begin)):
        for i in range(len(t) - 2):
            if any(t[i : i + 3] in u and f < d for u, f in entries):
                want[at + i : at + i + 3] = True
    assert (gone == want).all()
