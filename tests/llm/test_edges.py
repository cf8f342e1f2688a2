"""Null ids, repeated rows, empty tables, long texts and clashing columns; brute force of sharding; patterns of secrets written anew."""

import hashlib
import heapq
import random
import zlib

from fixtures import words
from pagewright.llm import fixity, html_extract, secrets, sharding

DOCS = "doc_id long, text string, source string, shard int, id int, spans string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, "x") for r in rows], DOCS).repartition(3)


# ---- sharding


def test_shards_are_those_of_the_plain_rule(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUNDLES_PER_SHARD", 1 << 18)  # so that every group is scheduled by itself
    r = random.Random(4)
    rows = [(i, words(r, r.choice((1, 3, 40, 200)))) for i in range(120)] + [(200 + i, "again and again") for i in range(30)] + [(300, None), (301, None), (302, ""), (None, "no id"), (None, "no id"), (5, "y"), (5, "y")]
    groups = {}
    for _, t in rows:
        key = "null" if t is None else hashlib.sha256(t.encode()).hexdigest()
        groups[key] = groups.get(key, 0) + len((t or "").encode()) + 1
    heap, want = [(0, s) for s in range(4)], {}
    for key, size in sorted(groups.items(), key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        want[key] = s
        heapq.heappush(heap, (load + size, s))
    total = sum(groups.values())
    single = {k for k, v in groups.items() if v * 4 * sharding.BUNDLES_PER_SHARD > total}
    assert single == set(groups)
    got = sharding.shards(docs(spark, rows), n_shards=4).collect()
    by_crc = {zlib.crc32((t or "").encode()): want["null" if t is None else hashlib.sha256(t.encode()).hexdigest()] for _, t in rows if t}
    assert len(got) == len(rows) and all(g.shard == by_crc[g.text_crc32] for g in got if g.text_crc32)
    assert {g.shard for g in got if g["size"] == 1 and g.doc_id == 302} == {want[hashlib.sha256(b"").hexdigest()]} and {g.shard for g in got if g.doc_id in (300, 301)} == {want["null"]}
    for s in range(4):
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))


# ---- secrets


def runs(text, allowed):
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        if end > at:
            out.append((at, end))
        at = max(end, at + 1)
    return out


def plain_bases(text):
    """The fixed patterns by hand, one character after the other."""
    out, low, upper = [], "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = "".join(low[upper.index(c)] if c in upper else c for c in text)
    i = 0
    while i < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if lower.startswith(word, i):
                for quote in (1, 0):
                    p = i + len(word)
                    if quote and not (p < len(text) and text[p] in "\"'"):
                        continue
                    p += quote
                    while p < len(text) and text[p] == " ":
                        p += 1
                    if p < len(text) and text[p] in ":=":
                        p += 1
                        while p < len(text) and text[p] == " ":
                            p += 1
                        p += p < len(text) and text[p] in "\"'"
                        end = p
                        while end < len(text) and (text[end] in low + upper + "0123456789+/_.=-"):
                            end += 1
                        if end > p:
                            if end - p >= 8:
                                out.append((i, 0, f"assign:{i}:{end}"))
                            i = end - 1
                            break
                break
        i += 1
    i = text.find("AKIA")
    while i >= 0:
        end = i + 4
        while end < len(text) and text[end] in upper + "0123456789":
            end += 1
        if end > i + 4:
            if end - i >= 16:
                out.append((i, 1, f"access:{i}:{end}"))
        i = text.find("AKIA", max(end, i + 1) if end > i + 4 else i + 1)
    out += [(a, 2, f"hex:{a}:{b}") for a, b in runs(text, "0123456789abcdef") if b - a >= 32]
    return sorted(out)


def test_base_spans_by_hand(spark):
    r = random.Random(9)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "ApiKey", '"', "'", " ", "  ", ":", "=", "abcDEF12", "x/y+z_1.-=", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef", "é", "K", "\n", "short"]
    rows = [(i, "".join(r.choices(parts, k=r.randint(1, 14)))) for i in range(1500)] + [(None, "token=abcdefgh"), (3, "token=abcdefgh"), (3, "token=abcdefgh"), (9000, None), (9001, ""), (9002, "word " * 200_000 + "secret: 'Zk8vQ2xR7mN4pL9sT1wY6bH3'")]
    found = secrets.scan(docs(spark, rows)).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(plain_bases(t or ""))
    assert len(found) == len(rows)
    for g in found:
        assert any(g.base_sha256 == hashlib.sha256(",".join(s for _, _, s in w).encode()).hexdigest() and (g.n_assign, g.n_access, g.n_hex) == tuple(sum(x[1] == k for x in w) for k in range(3)) for w in want[g.doc_id]), g
    assert [g.n_random_base for g in found if g.doc_id == 9002] == [1] and sum(g.n_assign for g in found) > 100
    assert secrets.scan(docs(spark, rows).where("false")).count() == 0


# ---- HTML


def test_pages_long_repeated_empty_and_with_clashing_columns(spark):
    page = "<article>" + "".join(f"<p>Sentence number {i} of a long article goes on and on.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", page, 5, "t"), (1, "u", page, 5, "t"), (None, None, None, None, None), (2, "u", "<div>" * 3000 + "deep", 1, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html_extract.extract(df, ["page_id", "url", "n_chars", "text"])
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    seen = got.collect()
    assert sum(g.text.count("Sentence number") == 3000 for g in seen) == 2 and [g.text for g in seen if g.page_id is None] == [""]
    assert all(g.n_chars == len(g.text) for g in seen)
    assert html_extract.extract(df.where("false"), ["page_id"]).count() == 0


# ---- fixity


def test_records_null_repeated_and_with_clashing_columns(spark):
    kind = "id long, record string, sha int, ordinal string"
    left = spark.createDataFrame([(None, "a", 1, ""), (None, None, 1, ""), (1, "x", 1, ""), (1, "x", 1, ""), (2, None, 1, ""), (3, "same", 1, "")], kind)
    right = spark.createDataFrame([(None, "a", 1, ""), (None, None, 1, ""), (1, "x", 1, ""), (1, "z", 1, ""), (2, "y", 1, ""), (3, "same", 1, "")], kind)
    assert {r.status for r in fixity.audit(left, left).collect()} == {"intact"} and fixity.audit(left, left).count() == 6
    got = sorted((r.id or 0, r.status) for r in fixity.audit(left, right).collect())
    assert got == [(0, "intact"), (0, "intact"), (1, "corrupt"), (1, "intact"), (2, "corrupt"), (3, "moved")]
