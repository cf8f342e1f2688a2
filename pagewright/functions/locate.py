"""Where a quotation stands on a page: Arrow batches, one page at a time."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

def normal(text: str) -> tuple[str, list[int], list[int]]:
    """Text for matching and, for each of its characters, where what it comes from begins and ends.

    NFKC by character, white space runs as one space, a hyphen before white space joined to what follows, control and format characters
    dropped, no space at either end.
    """
    out: list[tuple[str, int, int]] = []
    gap = True  # white space now adds nothing
    for i, c in enumerate(text):
        if c.isspace():
            if not gap:
                if out[-1][0] == "-":
                    out.pop()
                else:
                    out.append((" ", i, i))
            gap = True
        elif unicodedata.category(c) not in ("Cc", "Cf"):
            out += [(x, i, i + 1) for x in unicodedata.normalize("NFKC", c)]
            gap = False
    first, last = 0, len(out)
    while first < last and out[first][0] == " ":
        first += 1
    while last > first and out[last - 1][0] == " ":
        last -= 1
    chars, begins, ends = zip(*out[first:last]) if last > first else ((), (), ())
    return "".join(chars), list(begins), list(ends)


class _Mapped(dict):
    """What each character becomes in normal, as str.translate wants it, white space as a line end; filled as characters are met."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        if c.isspace():
            self[code] = "\n"
        elif unicodedata.category(c) in ("Cc", "Cf"):
            self[code] = None
        else:
            self[code] = unicodedata.normalize("NFKC", c)
        return self[code]


MAPPED = _Mapped()
GAP = re.compile(r"-?\n+")


def normal_text(text: str) -> str:
    """The text of normal without its offsets, many times faster."""
    return GAP.sub(lambda m: "" if m[0][0] == "-" else " ", text.translate(MAPPED)).strip(" ")


def normalised(text: Column) -> Column:
    """Whole texts as normal has them; null stays null."""

    @pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else normal_text(x) for x in t], dtype=object)

    return run(text)


def place(quote: str | None, text: str | None) -> tuple[int | None, int | None, bool]:
    """(start, end, ambiguous) of the quote in the text; nulls where it isn't there."""
    want = normal_text(quote or "")
    have, begins, ends = normal(text or "")
    first = have.find(want) if want else -1
    if first < 0:
        return None, None, False
    return begins[first], ends[first + len(want) - 1], have.find(want, first + 1) >= 0


def quote_place(quote: Column, text: Column) -> Column:
    @pandas_udf("start int, `end` int, ambiguous boolean")
    def run(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([place(a, b) for a, b in zip(q, t)], columns=["start", "end", "ambiguous"])
        return rows.astype({"start": "Int32", "end": "Int32"})

    return run(quote, text)


def normalised_each(texts: Column) -> Column:
    """Each text of an array as normal has it; null arrays and null texts stay null."""

    @pandas_udf("array<string>")
    def run(t: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [None if y is None else normal_text(y) for y in x] for x in t], dtype=object)

    return run(texts)
