"""Printed line-number gutters of transcript pages: where they are, the text without them, and a map back to the page.

Four forms are known: numbers before a bar, bare right-aligned numbers, numbers on rows of their own (detached), and numbers that
extraction has run into the prose (flattened). The last is found by a dynamic programme over the page's numbers. Pages that still look
like a table or a list without their numbers are left alone, as is whatever is ambiguous.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bytes of a page, highest line number, and shapes of rows.
PAGE_CAP = 256 * 1024
HIGHEST = 35
UNMARKED_CHARS = 600
BARS = "|│┃║"
BARRED = re.compile(rf"[ \t]*(\d{{1,2}})[ \t]*[{BARS}]\s*")
BARE = re.compile(r"[ \t]*(\d{1,2})(?:[ \t]{2,}|[ \t]*$)")
BAR_ONLY = re.compile(rf"[ \t]*[{BARS}][ \t]*")
RULED = re.compile(rf"[ \t{BARS}─━═_+┼┤├┬┴┌┐└┘-]{{8,}}")
LISTED = re.compile(r"(?:EXHIBIT|ITEM|SECTION)\s+(?:NO\.?\s*)?\d+\b", re.I)
TABLE = re.compile(r"\S[ \t]{3,}\S.*[ \t]{3,}\S|\S\s*[|│║]\s*\S.*[|│║]")
NUMBER_ROW = re.compile(r"[ \t]*([1-9]|[12]\d|3[0-5])[ \t]*")
LONE_NUMBER = re.compile(r"(?<!\S)\d{1,2}(?!\S)")
SPEAKER = re.compile(
    r"(?:BY[ \t]+)?(?:(?:MR|MS|MRS|DR)(?:\.[ \t]*|[ \t]+)|(?:ATTORNEY|DEPUTY)[ \t]+)[^\W\d_](?:[^\W\d_]|[ .’'\-]){0,64}:"
    r"|THE[ \t]+(?:COURT|WITNESS|CLERK|BAILIFF|REPORTER|INTERPRETER|JURY|DEFENDANT|PETITIONER|RESPONDENT|MOTHER|FATHER|MINOR|CHILD):|[QA][.:](?=[ \t]|$)",
    re.I,
)


class Line(NamedTuple):
    start: int
    end: int
    text: str


def lines_of(page: str) -> list[Line]:
    out, at = [], 0
    for whole in page.splitlines(keepends=True):
        text = whole.rstrip("\r\n")
        out.append(Line(at, at + len(text), text))
        at += len(whole)
    return out


def share(flags) -> float:
    """Part of the flags that is set; 1 of none."""
    flags = list(flags)
    return sum(flags) / len(flags) if flags else 1.0


def steps(numbers: list[int]) -> list[int]:
    return [b - a for a, b in zip(numbers, numbers[1:])]


def prefixes(lines: list[Line], form: re.Pattern) -> list[tuple[Line, re.Match]]:
    found = [(x, m) for x in lines if (m := form.match(x.text)) and 1 <= int(m[1]) <= HIGHEST]
    return found


def barred(lines: list[Line]) -> list[tuple[int, int]]:
    """Three rising numbers or more before bars whose right edges differ by one column at most; bars without a number go too."""
    rows = prefixes(lines, BARRED)
    edges = [m.end(1) for _, m in rows]
    by = steps([int(m[1]) for _, m in rows])
    if len(rows) < 3 or max(edges) - min(edges) > 1 or min(by) < 1 or share(b == 1 for b in by) < 0.65:
        return []
    alone = [(x, m) for x in lines if (m := BAR_ONLY.match(x.text)) and abs(m.end() - rows[0][1].end()) <= 4]
    return [(x.start, x.start + m.end()) for x, m in rows + alone]


def bare(lines: list[Line]) -> list[tuple[int, int]]:
    """Ten rising numbers or more that end in one column, of one and of two digits, on most lines, before rows of a line's usual length."""
    known = {x.start for x, _ in prefixes(lines, BARRED)}
    rows = [(x, m) for x, m in prefixes(lines, BARE) if x.start not in known]
    by = steps([int(m[1]) for _, m in rows])
    if len(rows) < 10 or len({m.end(1) for _, m in rows}) > 1 or {len(m[1]) for _, m in rows} != {1, 2} or min(by) < 1 or share(b == 1 for b in by) < 0.65:
        return []
    filled = sum(bool(x.text.strip()) for x in lines)
    if len(rows) < 0.7 * filled or share(41 <= len(x.text) - m.end() <= 120 for x, m in rows) < 0.6:
        return []
    return [(x.start, x.start + m.end()) for x, m in rows]


def detached(page: str, lines: list[Line]) -> list[tuple[int, int]]:
    """Number rows and text rows in turn: twenty pairs or more, from 4 or less to 24 or more, over text that is wrapped, not listed."""
    filled = [x for x in lines if x.text.strip()]
    is_number = [NUMBER_ROW.fullmatch(x.text) for x in filled]
    pairs = [(int(m[1]), filled[i], filled[i + 1]) for i, m in enumerate(is_number[:-1]) if m and not is_number[i + 1]]
    if len(page) < UNMARKED_CHARS or len(pairs) < 20 or pairs[0][0] > 4 or pairs[-1][0] < 24:
        return []
    by = steps([n for n, _, _ in pairs])
    texts = [t.text.strip() for _, _, t in pairs]
    if (
        not all(1 <= b <= 3 for b in by) or share(b == 1 for b in by) < 0.8 or share(30 <= len(t) <= 100 for t in texts) < 0.7
        or share(t.endswith((".", "?", "!", ":", ";")) for t in texts) > 0.45 or 2 * len(pairs) < 0.85 * len(filled)
    ):
        return []
    return [(n.start, t.start + len(t.text) - len(t.text.lstrip())) for _, n, t in pairs]


class Token(NamedTuple):
    number: int
    start: int
    end: int


def inner_numbers(lines: list[Line]) -> list[Token]:
    """Numbers of 1 to HIGHEST that stand alone inside a line, neither first nor last on it."""
    out = []
    for x in lines:
        first, last = len(x.text) - len(x.text.lstrip()), len(x.text.rstrip())
        for m in LONE_NUMBER.finditer(x.text):
            if first < m.start() and m.end() < last and 1 <= int(m[0]) <= HIGHEST:
                out.append(Token(int(m[0]), x.start + m.start(), x.start + m.end()))
    return out


def longest_chain(tokens: list[Token]) -> list[Token]:
    """The longest rising chain of numbers whose places rise by 18 to 95 characters a line, up to three lines at once.

    For each number the best chain that ends in it so far is kept as its length, its token and the token before: HIGHEST states.
    """
    best: list[tuple[int, int] | None] = [None] * (HIGHEST + 1)  # (length, index of the last token)
    before: list[int] = []
    for i, t in enumerate(tokens):
        length, link = 0, -1
        for n in range(max(1, t.number - 3), t.number):
            if best[n] and best[n][0] > length and 18 * (t.number - n) <= t.start - tokens[best[n][1]].start <= 95 * (t.number - n):
                length, link = best[n]
        before.append(link)
        if not best[t.number] or length + 1 > best[t.number][0]:
            best[t.number] = (length + 1, i)
    ends = [b for b in best if b]
    at, out = max(ends, key=lambda b: b[0], default=(0, -1))[1], []
    while at >= 0:
        out.append(tokens[at])
        at = before[at]
    return out[::-1]


def is_whole_column(page: str, tokens: list[Token]) -> bool:
    """Whether all numbers are one nearly complete column over dialogue, whose short and empty rows a chain would break at."""
    gaps = [(b.number - a.number, b.start - a.start, page[a.end : b.start].strip()) for a, b in zip(tokens, tokens[1:])]
    if len(tokens) < 24 or tokens[0].number > 4 or tokens[-1].number < 24 or tokens[-1].start - tokens[0].start < 0.65 * len(page):
        return False
    single = [width for by, width, _ in gaps if by == 1]
    if any(by not in (1, 2) or width > 95 * by for by, width, _ in gaps) or len(single) < 0.9 * len(gaps):
        return False
    if sum(35 <= w <= 85 for w in single) < max(8, 0.35 * len(gaps)):
        return False
    turns = sum(bool(t.startswith("(") or SPEAKER.match(t)) for _, _, t in gaps)
    return turns >= 2 or (turns == 1 and sum(not t for _, _, t in gaps) >= 2)


def flattened(page: str, lines: list[Line]) -> list[tuple[int, int]]:
    """A dense chain of numbers inside the prose: at least 16, from 4 or less to 24 or more, over most of the page, at a line's usual distance."""
    if len(page) < UNMARKED_CHARS:
        return []
    tokens = inner_numbers(lines)
    chain = tokens
    if not is_whole_column(page, tokens):
        chain = longest_chain(tokens)
        if len(chain) < 16 or chain[0].number > 4 or chain[-1].number < 24 or chain[-1].start - chain[0].start < 0.65 * len(page):
            return []
        single = [b.start - a.start for a, b in zip(chain, chain[1:]) if b.number == a.number + 1]
        if len(single) < 0.75 * (len(chain) - 1) or share(35 <= w <= 85 for w in single) < 0.85:
            return []
    blank = re.compile(r"[ \t]*")
    return [(t.start, blank.match(page, t.end).end()) for t in chain]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(page: str, spans: list[tuple[int, int]]) -> str:
    edges = [0, *(x for span in spans for x in span), len(page)]
    return "".join(page[a:b] for a, b in zip(edges[::2], edges[1::2]))


def gutter(page: str | None) -> tuple[str | None, list[tuple[int, int]]]:
    """(form, spans to take out): barred, bare, detached or flattened; none for a page without a sure gutter."""
    if not page or len(page.encode()) > PAGE_CAP:
        return None, []
    lines = lines_of(page)
    found = [("barred", barred(lines)), ("bare", bare(lines))]
    form, spans = next(((f, s) for f, s in found if s), (None, []))
    if form:
        spans = [x for _, s in found for x in s]  # a page may have both
    elif sum(bool(LISTED.match(x.text.strip())) for x in lines) >= 2:
        return None, []
    else:
        for form, make in (("detached", detached), ("flattened", flattened)):
            if spans := make(page, lines):
                break
    if not spans:
        return None, []
    spans = merged(spans + [(x.start, x.end) for x in lines if RULED.fullmatch(x.text)])
    left = [x.strip() for x in without(page, spans).splitlines()]
    if sum(bool(TABLE.search(x)) for x in left) >= 2 or sum(bool(LISTED.match(x)) for x in left) >= 2:
        return None, []
    return form, spans


def text_of(page: str) -> str:
    """The page without its gutter."""
    return without(page, gutter(page)[1])


def source_place(spans: list[tuple[int, int]], at: int) -> int:
    """The page's offset of an offset in the text without spans; where a span was taken out, behind it."""
    kept, gone = [], 0
    for s, e in spans:
        kept.append(s - gone)
        gone += e - s
    k = bisect_right(kept, at)
    return at + sum(e - s for s, e in spans[:k])


def projection(text: Column) -> Column:
    """form, text without its gutter, and removed (start, end) of each page; a page without one stays as it is, null stays null."""

    @pandas_udf("form string, text string, removed array<struct<start:int,end:int>>")
    def run(t: pd.Series) -> pd.DataFrame:
        out = []
        for page in t:
            form, spans = gutter(page)
            out.append((form, without(page, spans) if spans else page, spans))
        return pd.DataFrame(out, columns=["form", "text", "removed"])

    return run(text)


def source_offset(at: Column, removed: Column) -> Column:
    """source_place of an offset column: removed spans are passed in order while they begin at or before it."""
    passed = lambda acc, s: F.when(s["start"] <= at + acc, acc + s["end"] - s["start"]).otherwise(acc)
    return at + F.aggregate(removed, F.lit(0), passed)
