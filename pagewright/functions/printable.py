"""What a line of a marked-up source prints as: links as their labels, quotations without their marks, content without white space."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: The form of a record link and the two styles of quotation marks.
LINK = re.compile(r"\[([^\]\[\n]+)\]\(page:(\d+)\)")
MARKS = {'"': '"', "“": "”"}
OPENER = re.compile("[" + "".join(MARKS) + "]")


class _Content(dict):
    """What each character adds to the content, as str.translate wants it: its compatibility form without white space and control characters."""

    def __missing__(self, code: int) -> str:
        kept = (x for x in unicodedata.normalize("NFKC", chr(code)) if not x.isspace() and unicodedata.category(x) not in ("Cc", "Cf"))
        self[code] = "".join(kept)
        return self[code]


CONTENT = _Content()


class _Same(dict):
    """Whether a character is its own content or white space."""

    def __missing__(self, c: str) -> bool:
        self[c] = CONTENT[ord(c)] == c or (c.isspace() and not CONTENT[ord(c)])
        return self[c]


SAME = _Same()
NOT_ASKED = 255  # no character's content is as long
SIZES = np.full(0x110000, NOT_ASKED, np.uint8)  # of the content of each character, filled as characters are met


def content(text: str) -> str:
    """The content of all characters; texts of which nothing but white space goes are only split, which is faster."""
    return "".join(text.split()) if all(map(SAME.__getitem__, set(text))) else text.translate(CONTENT)


def content_sizes(text: str) -> np.ndarray:
    """How many characters each character of text adds to the content."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = SIZES[codes]
    if (sizes == NOT_ASKED).any():
        for code in np.unique(codes[sizes == NOT_ASKED]).tolist():
            SIZES[code] = len(CONTENT[code])
        sizes = SIZES[codes]
    return sizes


def quotations(text: str):
    """(start, end) of what stands between matched marks of one style, left to right; an unmatched or empty pair is literal."""
    at = 0
    while opener := OPENER.search(text, at):
        start = opener.end()
        end = text.find(MARKS[opener[0]], start)
        if end > start:
            yield start, end
        at = end + 1 if end > start else start


def line_parts(line: str) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """(printable, links, quotes): links as (start, end, page) before quotation marks go, quotes as (start, end, phrase) in printable.

    A quotation counts if its content shows anything and no link lies half in it, marks included.
    """
    texts, links, at = [], [], 0
    pieces = LINK.split(line)
    for k in range(0, len(pieces), 3):
        texts.append(pieces[k])
        at += len(pieces[k])
        if k + 1 < len(pieces):
            links.append((at, at + len(pieces[k + 1]), int(pieces[k + 2])))
            texts.append(pieces[k + 1])
            at += len(pieces[k + 1])
    text = "".join(texts)
    found = [(s, e) for s, e in quotations(text) if content(text[s:e]) and not any(held(link, s, e) for link in links)]
    shown, quotes, at, size = [], [], 0, 0
    for s, e in found:
        shown += [text[at : s - 1], text[s:e]]
        size += s - 1 - at
        quotes.append((size, size + e - s, text[s:e]))
        size += e - s
        at = e + 1
    return "".join([*shown, text[at:]]), links, quotes


def held(link: tuple[int, int, int], start: int, end: int) -> bool:
    """Whether a link forbids the quotation: it overlaps it and neither lies in the content nor holds the marks too."""
    s, e, _ = link
    return s < end + 1 and start - 1 < e and not (start - 1 <= s and e <= end) and not (s <= start - 1 and end + 1 <= e)


def shown_lines(text: str):
    """(line number from 1, printable, quotes) of each line that prints anything but white space."""
    for n, line in enumerate(text.splitlines(), 1):
        shown, _, quotes = line_parts(line)
        if shown.strip():
            yield n, shown, quotes


def line_analysis(line: Column) -> Column:
    """printable, links (start, end, page) and quotes (start, end, phrase) of each line; null for null."""

    @pandas_udf("printable string, links array<struct<start:int,end:int,page:long>>, quotes array<struct<start:int,end:int,phrase:string>>")
    def run(t: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None else line_parts(x) for x in t]
        return pd.DataFrame(rows, columns=["printable", "links", "quotes"])

    return run(line)


def content_of(text: Column) -> Column:
    @pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else content(x) for x in t], dtype=object)

    return run(text)
