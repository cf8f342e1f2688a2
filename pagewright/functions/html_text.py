"""Page mark-up as plain text: blocks apart by blank lines, tables as grids of padded cells."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

BLOCKS = frozenset("p div section article header footer nav ul ol li h1 h2 h3 h4 h5 h6 blockquote pre table tr form main aside body".split())


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.now: list[str] = []
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.skip = 0

    def flush(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.blocks.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "table":
            self.flush()
            self.rows = []
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif self.rows is not None and tag in ("td", "th"):
            self.end_cell()
            self.rows or self.rows.append([])
            self.cell = []
        elif tag == "br":
            self.now.append(" ")
        elif tag in BLOCKS and self.rows is None:
            self.flush()

    def end_cell(self):
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th", "tr") and self.rows is not None:
            self.end_cell()
        elif tag == "table" and self.rows is not None:
            self.end_cell()
            self.end_table()
        elif tag in BLOCKS and self.rows is None:
            self.flush()

    def end_table(self):
        rows, self.rows = [r for r in self.rows if any(r)], None
        width = [max(len(r[i]) if i < len(r) else 0 for r in rows) for i in range(max(map(len, rows), default=0))]
        if rows:
            self.blocks.append("\n".join(" | ".join(x.ljust(w) for x, w in zip(r, width)).rstrip() for r in rows))

    def handle_data(self, data):
        if not self.skip:
            (self.now if self.cell is None else self.cell).append(data)


def to_text(page: str | None) -> str:
    r = Reader()
    r.feed(page or "")
    r.close()
    if r.rows is not None:
        r.end_cell()
        r.end_table()
    r.flush()
    return "\n\n".join(r.blocks)


def html_to_text(page: Column) -> Column:
    @pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(to_text, na_action=None)

    return run(page)


def strip_tables(page: Column) -> Column:
    """Texts with table mark-up as to_text has them, others as they are."""

    @pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: to_text(t) if "<table" in t.lower() else t, na_action="ignore")

    return run(page)
