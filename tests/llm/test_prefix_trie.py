"""The trie against a plain one with a row a node, in one range and in many."""

import hashlib
import random
import re
import zlib

import pytest

from pagewright.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string, key string, pid int, depth string, low int"


def plain(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(own.get(first, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], ([], []))[0].append(c)
        nodes[seq][1].append(c)
    words = {k: len(re.findall(r"[^ \t-\r]+", k[-1][1])) if k else 0 for k in nodes}
    kids = {k: sum(x[:-1] == k and len(x) == len(k) + 1 for x in nodes) for k in nodes}
    out = []
    for k, (members, ended) in nodes.items():
        under = [x for x in nodes if x[: len(k)] == k]
        sha = hashlib.sha256(",".join(map(str, sorted(ended))).encode()).hexdigest()
        up = min(nodes[k[:-1]][0]) if k else None
        out.append((min(members), len(k), up, len(members), kids[k], sum(not kids[x] for x in under), sum((len(nodes[x][0]) - 1) * words[x] for x in under), sha))
    return sorted(out, key=repr)


def invented(seed):
    r, rows = random.Random(seed), []
    some = ["", None, "a b", "a  b c", "x", "word " * 300, "é 東 🙂"]
    for c in [*range(-25, 90), *range(400, 420)]:
        if r.random() < 0.15:
            continue
        copy = r.random() < 0.4
        for turn in range(3 if copy else r.choice((1, 2, 3, 5, 9))):
            rows.append((c, r.choice((None, turn)) if r.random() < 0.1 else turn, "u" if copy else r.choice(("u", "a", None)), "x" if copy else r.choice(some)))
    rows += [(7, 0, "u", "x")] * 3 + [(None, 0, "u", "x")] + [(50, t, "u", "x") for t in range(400)] + [(51, t, "u", "x") for t in range(300)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*x, "k", 1, "d", 2) for x in rows], COLUMNS).repartition(3)


@pytest.mark.parametrize("turns", [prefix_trie.RANGE_TURNS, 60])
def test_against_a_plain_trie(spark, monkeypatch, turns):
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    rows = invented(turns)
    assert sorted((tuple(x) for x in prefix_trie.trie(frame(spark, rows)).collect()), key=repr) == plain(rows)


def test_few_and_no_conversations(spark):
    """No row gives no node; only turnless conversations give a root, which is a leaf."""
    assert prefix_trie.trie(frame(spark, [(1, 0, "u", "x")]).limit(0)).count() == 0
    turnless = next(c for c in range(21, 400) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    for rows in ([(turnless, 0, "u", "x")], [(40, 0, "u", "x y")], [(40, None, None, None), (40, None, None, None)]):
        assert [tuple(x) for x in sorted(prefix_trie.trie(frame(spark, rows)).collect(), key=repr)] == plain(rows)
