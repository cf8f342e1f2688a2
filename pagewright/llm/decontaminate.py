"""Benchmark decontamination by pigeonhole edit matching and Myers' bit-parallel distance.

An item of m normalised characters may differ by k = floor(rate * m) edits from some stretch of a document. Cut into k + 1 pieces,
one piece at least then occurs unchanged (and so do, within budgets of their own, the stretches above it in a binary tree of pieces); an Aho-Corasick automaton finds all pieces of all items in one pass over each whole
text, and Myers' algorithm gives the exact least distance around every hit.

Defined results: null, empty and all-punctuation texts and items match nothing; repeated rows are judged one by one; a document
that holds an item several times has one row, its best place (the first on a tie); an empty table gives no row.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches

RATE = 0.1
BLOCK_ITEMS = 20_000  # items in one automaton; more items are matched block by block
GRAM = 3
CHAIN_MOST = 64  # characters of the longest stretch that a hit must match before the whole item is tried
_lower = bytes(32 if c < 48 or 57 < c < 97 or 122 < c < 128 else c for c in range(256))  # ASCII but letters and digits is space


def normalise(text: str | None) -> str:
    """Lower case; ASCII punctuation and white space become single spaces."""
    return b" ".join((text or "").lower().encode().translate(_lower).split()).decode()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 consecutive pieces of near equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any stretch of text, the first end at which it is reached)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = full, 0, m, m, 0
    get = masks.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, i + 1
        ph <<= 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return best, at


def first_end(masks: dict[str, int], m: int, text: str, edits: int) -> int:
    """The least length of a beginning of text within so many edits of the whole pattern."""
    # Myers' recurrence with a fixed beginning: the horizontal difference of the top row is 1 instead of 0.
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score <= edits:
            return i + 1
        ph = (ph << 1) | 1
        pv = ((mh << 1) | ~(xv | ph)) & full
        mv = ph & xv & full
    return len(text)


class Matcher:
    """The automaton and the verifier for one block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        found = defaultdict(list)
        for item_id, text in items:
            text = normalise(text)
            if not text:
                continue
            k = int(rate * len(text))
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(text):
                masks[c] |= 1 << i
            grams = Counter(text[i : i + GRAM] for i in range(len(text) - GRAM + 1))
            # An edit spoils at most GRAM of the item's grams.
            need = sum(grams.values()) - GRAM * k
            self.tree(text, pieces(text, k), len(self.items), (), found)
            back: dict[str, int] = defaultdict(int)
            for i, c in enumerate(reversed(text)):
                back[c] |= 1 << i
            self.items.append((item_id, text, k, dict(masks), frozenset(grams), len(grams) - (sum(grams.values()) - need), dict(back)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def match(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, from, to) of each item found; places count characters of the normalised text."""
        if not self.any or not text:
            return []
        text = normalise(text)
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for item, at, above in where:
                start = end + 1 - size - at
                if self.plausible(text, start, above):
                    starts.setdefault(item, []).append(start)
        out = []
        for item, diagonals in starts.items():
            item_id, pattern, k, masks, grams, need, back = self.items[item]
            m, best = len(pattern), None
            for lo, hi in self.windows(diagonals, m, k):
                lo, hi = max(0, lo), min(len(text), hi)
                part = text[lo:hi]
                if hi - lo < m - k or len(grams.intersection([part[i : i + GRAM] for i in range(len(part) - GRAM + 1)])) < need:
                    continue
                edits, end = myers(masks, m, part)
                if edits <= k and (best is None or edits < best[0]):
                    # The match ends there; read backwards from its end, it begins where the reversed item reaches that distance.
                    stretch = text[max(0, lo + end - m - k) : lo + end]
                    best = (edits, lo + end - first_end(back, m, stretch[::-1], edits), lo + end)
            if best:
                out.append((item_id, *best))
        return out

    def tree(self, item: str, leaves: list[tuple[int, str]], number: int, above: tuple, found: dict) -> None:
        """Hand each piece the chain of stretches above it, smallest first.

        A stretch of n pieces that holds at most n - 1 edits has a half of h pieces with at most h - 1, down to an unchanged
        piece. So a hit counts only if every stretch above it matches within its own budget.
        """
        if len(leaves) == 1:
            found[leaves[0][1]].append((number, leaves[0][0], above))
            return
        lo, hi = leaves[0][0], leaves[-1][0] + len(leaves[-1][1])
        if hi - lo <= CHAIN_MOST:
            masks: dict[str, int] = defaultdict(int)
            for i, c in enumerate(item[lo:hi]):
                masks[c] |= 1 << i
            above = ((lo, hi - lo, len(leaves) - 1, dict(masks)), *above)
        half = (len(leaves) + 1) // 2
        self.tree(item, leaves[:half], number, above, found)
        self.tree(item, leaves[half:], number, above, found)

    @staticmethod
    def plausible(text: str, start: int, above: tuple) -> bool:
        """start: where the item would begin in text if the hit's piece lay at its own offset."""
        for lo, m, k, masks in above:
            if myers(masks, m, text[max(0, start + lo - k) : max(0, start + lo + m + k)])[0] > k:
                return False
        return True

    @staticmethod
    def windows(diagonals: list[int], m: int, k: int):
        """Stretches that hold every match through the hits, merged only where starts lie within k of each other."""
        diagonals.sort()
        first = last = diagonals[0]
        for d in diagonals[1:]:
            if d - last > k:
                yield first - k, last + m + k
                first = d
            last = d
        yield first - k, last + m + k


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_ITEMS, each collected by itself."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    n = -(-rows.count() // BLOCK_ITEMS)
    for b in range(n):
        yield sorted(tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect())


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """(id, item_id, edits, start, end) of each document and item within the item's error budget."""
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for block in blocks(benchmark, item_col, item_text):
        shared = spark.sparkContext.broadcast((block, rate))

        def run(batches, shared=shared):
            m = Matcher(*shared.value)
            for batch in batches:
                ids, found = [], []
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    for x in m.match(text.as_py()):
                        ids.append(doc_id.as_py())
                        found.append(x)
                cols = list(zip(*found)) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cols[0], pa.int64()), *(pa.array(c, pa.int32()) for c in cols[1:])], names=["id", "item_id", "edits", "start", "end"])

        part = bounded_batches(rows).mapInArrow(run, "id long, item_id long, edits int, start int, end int")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "id long, item_id long, edits int, start int, end int")
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """The rows of docs without any item, all columns unchanged; one streaming pass a block of items, nothing is shuffled."""
    at = docs.columns.index(text_col)
    for block in blocks(benchmark, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast((block, rate))

        def run(batches, shared=shared):
            m = Matcher(*shared.value)
            for batch in batches:
                yield batch.filter(pa.array([not m.match(t.as_py()) for t in batch.column(at)], pa.bool_()))

        docs = bounded_batches(docs).mapInArrow(run, docs.schema)
    return docs
