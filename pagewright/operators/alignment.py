"""Monotone alignment of sources with the pages that they were printed on.

Both sides are reduced to content: characters that show, in compatibility form. A place of the content is the same on both sides, so lines
and pages are intervals of one scale, and alignment is an interval join in cells of that scale: no document is one task, and a page meets
only the pieces of lines that it shows. What differs is reported, not guessed: places are never searched for.

Defined results: a null source or page has no content; lines without anything but white space are left out; a page without content
takes the line of the content before it, or 0; page numbers of a document should be unique: `issues` has a row for each that isn't; documents without pages and pages without a document are reported by `issues`.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import printable
from pagewright.operators.stages import written_once

CELL = 2048  # places of content; a piece of a line never crosses a cell
BLOCK = 256  # pages whose places are summed at once
ROWS, BYTES = 4096, 1 << 20  # of a batch that a Python worker gives back


def running(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """rows with out: the sum of value over the rows before it within key, by order (whole numbers), in blocks so that no key is one task."""
    block = F.floor(F.col(order) / BLOCK)
    inside = F.sum(value).over(Window.partitionBy(key, "__block").orderBy(order)) - F.col(value)
    rows = rows.withColumn("__block", block)
    sums = rows.groupBy(key, "__block").agg(F.sum(value).alias("__sum"))
    before = sums.select(key, "__block", (F.sum("__sum").over(Window.partitionBy(key).orderBy("__block")) - F.col("__sum")).alias("__before"))
    return rows.withColumn(out, inside).join(before, [key, "__block"]).withColumn(out, (F.col(out) + F.col("__before")).cast("long")).drop("__block", "__before")


def batches_of(rows, kinds: dict):
    """Arrow batches of at most ROWS tuples and about BYTES of their texts."""
    held, size = [], 0
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds.values())], names=[*kinds])
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= ROWS or size >= BYTES:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def parts(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, cell, start, end, line, piece, quote, phrase): what the documents' content holds, each line read once.

    Rows with a piece are the content of each printable line, cut at the cells; rows with a quote are the places of each recognised
    quotation, one row for each cell that it meets. start and end are places in the document's content.
    """
    kinds = {key: pa.int64(), "cell": pa.int64(), "start": pa.int64(), "end": pa.int64(), "line": pa.int32(), "piece": pa.string(), "quote": pa.int32(), "phrase": pa.string()}

    def rows(batch):
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            at = quote = 0
            for n, shown, quotes in printable.shown_lines(t.as_py() or ""):
                read, place = 0, at
                for s, e, phrase in quotes:
                    first = place + len(printable.content(shown[read:s]))
                    read, place = e, first + len(printable.content(shown[s:e]))
                    for cell in range(first // CELL, (place - 1) // CELL + 1):
                        yield k, cell, first, place, n, None, quote, phrase
                    quote += 1
                held, lo = printable.content(shown), 0
                while lo < len(held):
                    hi = min(len(held), lo + CELL - at % CELL)
                    yield k, at // CELL, at, at + hi - lo, n, held[lo:hi], None, None
                    at += hi - lo
                    lo = hi

    def run(batches):
        for batch in batches:
            yield from batches_of(rows(batch), kinds)

    return sources.select(F.col(key).cast("long").alias(key), F.col(text).alias("t")).mapInArrow(run, f"{key} long, cell long, start long, end long, line int, piece string, quote int, phrase string")


def placed_pages(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, page, first, after): each page's place in the content of its document. Texts stay behind: only their sizes are shuffled.

    Sizes are taken when this is called and written once, as they are summed by block and within it, and the places are used twice.
    """
    n = F.length(printable.content_of(F.coalesce(F.col(text), F.lit("")))).cast("long")
    rows = written_once(pages.select(F.col(key).cast("long").alias(key), F.col(page).cast("long").alias(page), n.alias("n")))
    return running(rows, key, page, "n", "first").withColumn("after", F.col("first") + F.col("n")).drop("n")


def cells(first: Column, after: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / CELL), F.floor((F.greatest(after, first + 1) - 1) / CELL)))


def parts_of_pages(found: DataFrame, at: DataFrame, key: str, page: str) -> DataFrame:
    """(key, page, shown, quotes): for each page the (start, end, line, piece) of what it shows of each line, in order, and its quotations."""
    # A page without content looks at the place before it.
    look = F.when(F.col("after") > F.col("first"), F.col("first")).otherwise(F.greatest(F.col("first") - 1, F.lit(0)))
    narrow = at.where("after > 0").select(key, page, "first", "after", look.alias("look"))  # without content, after is first
    narrow = narrow.withColumn("cell", cells(F.col("look"), F.col("after")))
    counted = F.col("piece").isNotNull() | ((F.col("after") > F.col("first")) & (F.col("cell") == F.floor(F.greatest("start", "first") / CELL)))
    rows = found.join(narrow, [key, "cell"]).where(F.expr("start < after and look < `end`") & counted)
    s, e = F.greatest("start", "look"), F.least("end", "after")
    shown = F.struct(s.alias("start"), e.alias("end"), "line", F.substr("piece", (s - F.col("start") + 1).cast("int"), (e - s).cast("int")).alias("piece"))
    quote = F.struct("quote", "start", "end", "phrase")
    return rows.groupBy(key, page).agg(
        F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), shown))).alias("shown"), F.sort_array(F.collect_list(F.when(F.col("piece").isNull(), quote))).alias("quotes")
    )


def page_view(text: Column, first: Column, source: Column, shown: Column, quotes: Column) -> Column:
    """equal, alike, breaks (start, end, mark), restored and spans (start, end, label, phrase) of each page.

    equal: the content of the page's text is source, else alike characters of both are the same at the beginning; breaks: what of the page's text
    stands between two lines of the source and the line ends that replace it in restored.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("equal boolean, alike long, breaks array<struct<start:int,end:int,mark:string>>, restored string, spans array<struct<start:int,end:int,label:string,phrase:string>>")
    def run(texts: pd.Series, firsts: pd.Series, sources: pd.Series, starts: pd.Series, lines: pd.Series, froms: pd.Series, tos: pd.Series, phrases: pd.Series) -> pd.DataFrame:
        out = []
        for t, c, source, begin, line, lo_of, hi_of, said in zip(texts, firsts, sources, starts, lines, froms, tos, phrases):
            held = printable.content(t)
            equal = held == source
            raw = np.repeat(np.arange(len(t)), printable.content_sizes(t))  # where each character of the content comes from
            breaks, parts, done = [], [], 0
            if begin is not None and len(begin) > 1:
                for k, a, b in zip((begin[1:] - c).tolist(), line[:-1].tolist(), line[1:].tolist()):
                    if b != a and 0 < k < len(raw) and raw[k - 1] + 1 <= raw[k]:
                        start, end, mark = int(raw[k - 1]) + 1, int(raw[k]), "\n" if b == a + 1 else "\n\n"
                        breaks.append((start, end, mark))
                        parts += [t[done:start], mark]
                        done = end
            spans = []
            for q, (a, b) in enumerate(zip(lo_of, hi_of) if lo_of is not None else ()):
                lo, hi = max(a - c, 0), min(b - c, len(raw))
                if lo < hi:
                    start, end = int(raw[lo]), int(raw[hi - 1]) + 1
                    spans.append((start, end, t[start:end], said[q]))
            out.append((equal, None if equal else len(commonprefix([held, source])), breaks, "".join([*parts, t[done:]]), spans))
        return pd.DataFrame(out, columns=["equal", "alike", "breaks", "restored", "spans"]).astype({"alike": "Int64"})

    field = lambda c, f: F.transform(c, lambda x: x[f])
    return run(text, first, source, field(shown, "start"), field(shown, "line"), field(quotes, "start"), field(quotes, "end"), field(quotes, "phrase"))


def rebased(offset: Column, breaks: Column) -> Column:
    """An offset into a page's text as one into its restored text; inside a replaced stretch, where that began."""
    before = F.filter(breaks, lambda b: b["start"] < offset)
    by = lambda b: F.when(b["end"] <= offset, F.length(b["mark"]) - (b["end"] - b["start"])).otherwise(b["start"] - offset)
    return offset + F.aggregate(before, F.lit(0), lambda s, b: s + by(b))


def align(sources: DataFrame, pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text", page_text: str = "text") -> DataFrame:
    """One row a page: key, page, first_line, last_line, equal, differs_at, restored, breaks, spans.

    equal: the page shows what its place in the source holds; differs_at: the first place of the document's content at which it doesn't.
    """
    at = placed_pages(pages, key, page, page_text)
    found = parts_of_pages(parts(sources, key, text), at, key, page)
    texts = pages.select(F.col(key).cast("long").alias(key), F.col(page).cast("long").alias(page), F.coalesce(F.col(page_text), F.lit("")).alias("text"))
    rows = at.join(found, [key, page], "left").join(texts, [key, page])
    source = F.when(F.col("after") > F.col("first"), F.coalesce(F.array_join("shown.piece", ""), F.lit(""))).otherwise("")
    rows = rows.select(
        key, page, "first", F.coalesce(F.get("shown", F.lit(0))["line"], F.lit(0)).alias("first_line"), F.coalesce(F.try_element_at("shown", F.lit(-1))["line"], F.lit(0)).alias("last_line"),
        page_view(F.col("text"), F.col("first"), source, F.col("shown"), F.col("quotes")).alias("view"),
    )
    return rows.select(key, page, "first_line", "last_line", "view.equal", (F.col("first") + F.col("view.alike")).alias("differs_at"), "view.restored", "view.breaks", "view.spans")


def issues(sources: DataFrame, pages: DataFrame, aligned: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text", page_text: str = "text") -> DataFrame:
    """(key, page, rule, place): what forbids the use of an alignment; nothing if there is no row.

    count: source and pages have different amounts of content (place: the difference); content: a page shows something else (its first place);
    no_source: pages of a document that isn't there; repeated: a page number that several pages have (place: how many).
    """
    have = parts(sources, key, text).groupBy(key).agg(F.sum(F.length("piece")).alias("held"))
    have = sources.select(F.col(key).cast("long").alias(key)).distinct().join(have, key, "left").withColumn("known", F.lit(True))
    show = pages.groupBy(F.col(key).cast("long").alias(key)).agg(F.sum(F.length(printable.content_of(F.coalesce(F.col(page_text), F.lit(""))))).alias("printed"))
    both = have.join(show, key, "full")
    gap = F.coalesce("printed", F.lit(0)) - F.coalesce("held", F.lit(0))
    rule = F.when(F.col("known").isNull(), "no_source").when(gap != 0, "count")
    docs = both.select(key, F.lit(None).cast("long").alias(page), rule.alias("rule"), gap.cast("long").alias("place")).where("rule is not null")
    again = pages.groupBy(F.col(key).cast("long").alias(key), F.col(page).cast("long").alias(page)).agg(F.count("*").alias("n")).where("n > 1")
    docs = docs.unionAll(again.select(key, page, F.lit("repeated"), "n"))
    return docs.unionAll(aligned.where("not equal").select(key, page, F.lit("content"), "differs_at"))


def span_issues(expected: DataFrame, declared: DataFrame, key: str = "doc_id", page: str = "page_no") -> DataFrame:
    """(key, page, rule, phrase, start, end, declared_start, declared_end): spans that are missing, extra or shifted; equal ones give no row.

    Both sides: (key, page, start, end, label, phrase). What is left of a phrase's spans on a page on both sides is paired in order: shifted.
    """
    cols = [key, page, "start", "end", "label", "phrase"]
    both = expected.select(*cols, F.lit(1).alias("n")).unionAll(declared.select(*cols, F.lit(-1)))
    left = both.groupBy(*cols).agg(F.sum("n").alias("n")).where("n <> 0")
    left = left.withColumn("copy", F.explode(F.sequence(F.lit(1), F.abs("n")))).withColumn("is_declared", F.col("n") < 0)
    nth = F.row_number().over(Window.partitionBy(key, page, "phrase", "is_declared").orderBy("start", "end", "label", "copy"))
    left = left.withColumn("nth", nth)
    pick = lambda c, d: F.max(F.when(F.col("is_declared") == d, F.col(c)))
    rows = left.groupBy(key, page, "phrase", "nth").agg(
        pick("start", False).alias("start"), pick("end", False).alias("end"), pick("start", True).alias("declared_start"), pick("end", True).alias("declared_end")
    )
    rule = F.when(F.col("declared_start").isNull(), "missing").when(F.col("start").isNull(), "extra").otherwise("shifted")
    return rows.select(key, page, rule.alias("rule"), "phrase", "start", "end", "declared_start", "declared_end")
