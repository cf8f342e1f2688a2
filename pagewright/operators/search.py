"""Quotation search over page texts: each page is read once for a block of quotations, in exact, relaxed or phrase matching."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewright.functions import gutters, locate, phrases
from pagewright.functions.contained import Contained

BLOCK = 20_000  # quotations that are sent to the pages at once; more go in further blocks
ROWS = 100_000  # rows of hits that are held at once, but for those of one page


def blocks(quotes: DataFrame):
    """The rows (quote_id, q) in blocks of about BLOCK, each collected by itself."""
    n = -(-quotes.count() // BLOCK)
    for b in range(n):
        yield [tuple(r) for r in quotes.where(F.pmod(F.xxhash64("quote_id", "q"), F.lit(n)) == b).collect()]


def finder(quotes: list[str], mode: str, whole_words: bool):
    """A function from a page's text to the indexes of the quotes that it holds."""
    if mode == "placed":
        wanted = [locate.normal_text(q) for q in quotes]
        known = [i for i, q in enumerate(wanted) if q]
        search = Contained([wanted[i].encode() for i in known])
        return lambda t: [known[k] for k in search.find(locate.normal_text(t).encode())]
    if mode == "relaxed":
        wanted = [phrases.relaxed(q).strip() for q in quotes]
        known = [i for i, q in enumerate(wanted) if q]
        search = Contained([wanted[i].encode() for i in known])
        return lambda t: [known[k] for k in search.find(phrases.relaxed(t).encode())]
    if mode != "phrase":
        search = Contained([q.encode() for q in quotes])
        return lambda t: search.find(t.encode())
    wanted = [phrases.search_phrase(q) for q in quotes]
    known = [i for i, q in enumerate(wanted) if q.strip()]
    search = Contained([phrases.skeleton(wanted[i]) for i in known])
    patterns = [phrases.pattern(wanted[i], whole_words) for i in known]
    # A phrase that stands in the text as it is needs no pattern, unless the letters around it must be judged.
    plain = [None if whole_words else re.sub(r"\s+", " ", wanted[i].strip()) for i in known]

    def find(t: str) -> list[int]:
        t = phrases.search_text(t)
        maybe = search.find(phrases.skeleton(t))
        flat = phrases.spaced(t) if maybe else ""
        return [known[k] for k in maybe if (plain[k] and plain[k] in flat) or patterns[k].search(t)]

    return find


def quote_hits(quotes: DataFrame, pages: DataFrame, mode: str = "exact", whole_words: bool = True, transcripts: bool = False) -> DataFrame:
    """(quote_id, page_id) where a page holds a quote: exact (as written), relaxed (phrases.relaxed), phrase (word pattern)
    or placed (wherever locate.place has a place for it; then with its columns start, end, ambiguous).

    The quotes are a stated query set. They go to the pages in blocks, by one path at any number of them, and equal texts of a block are looked for once; each row of quotes that
    meets a row of pages is one row, so repeated rows stay. whole_words: a phrase may not begin or end inside a longer word.
    transcripts: the pages are hearing transcripts; printed line numbers are taken out before the search, and places count from the text without them.
    """
    q = quotes.select("quote_id", F.col("text").alias("q")).where("trim(q) <> ''")
    p = pages.select("page_id", F.col("text").alias("t")).where("t is not null")
    out = quotes.sparkSession.createDataFrame([], q.select("quote_id").schema).join(p.select("page_id").limit(0))
    if mode == "placed":
        out = out.selectExpr("quote_id", "page_id", "int(null) as start", "int(null) as `end`", "boolean(null) as ambiguous")
    kind = to_arrow_type(q.schema["quote_id"].dataType)
    for block in blocks(q):
        shared = quotes.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            of_text = defaultdict(list)  # quotes of one text are looked for once and written out one by one
            for x, q in shared.value:
                of_text[q].append(x)
            wanted, ids = list(of_text), [pa.array(x, kind) for x in of_text.values()]
            find = finder(wanted, mode, whole_words)

            def rows(batch, texts, found):
                cols = {
                    "quote_id": pa.concat_arrays([ids[k] for _, k in found]) if found else pa.array([], kind),
                    "page_id": batch.column(0).take(pa.array(np.repeat([i for i, _ in found], [len(ids[k]) for _, k in found]).astype("int64"))),
                }
                if mode == "placed":
                    places = [p for i, k in found for p in [locate.place(wanted[k], texts[i])] * len(ids[k])]
                    for name, c, x in zip(("start", "end", "ambiguous"), range(3), (pa.int32(), pa.int32(), pa.bool_())):
                        cols[name] = pa.array([p[c] for p in places], x)
                return pa.RecordBatch.from_pydict(cols)

            for batch in batches:
                texts = batch.column(1).to_pylist()
                if transcripts:
                    texts = [gutters.text_of(t) for t in texts]
                found, n = [], 0
                for i, t in enumerate(texts):
                    for k in find(t):
                        found.append((i, k))
                        n += len(ids[k])
                    if n >= ROWS:
                        yield rows(batch, texts, found)
                        found, n = [], 0
                yield rows(batch, texts, found)

        out = out.unionAll(p.mapInArrow(run, out.schema))
    return out


def best_page(hits: DataFrame, reported: DataFrame) -> DataFrame:
    """(quote_id, page_id, verified): the reported page if it holds the quote, else the least page that does; false if none does."""
    h = hits.join(reported.withColumnRenamed("page_id", "said"), "quote_id", "right")
    best = h.groupBy("quote_id").agg(F.max(F.col("page_id") == F.col("said")).alias("own"), F.min("page_id").alias("any"), F.first("said").alias("said"))
    return best.select("quote_id", F.when(F.col("own"), F.col("said")).otherwise(F.col("any")).alias("page_id"), F.col("any").isNotNull().alias("verified"))


def repeated_shingles(rows: DataFrame, item: str, ordinal: str, text: str, words: int = 15) -> DataFrame:
    """(item, n_repeated): words-word shingles of an item that an earlier item (by ordinal) already has; own repeats don't count.

    A shingle is told apart by two 64-bit hashes over the hashes of its words, which are hashed once; no shingle is written out. All
    shingles are shuffled once; one pass in the order of items tells which item has each first and passes over own repeats. What comes
    back to an item is a count.
    """
    w = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    lists = rows.select(item, ordinal, F.transform(w, lambda x: F.xxhash64(x)).alias("w")).where(F.size("w") >= words)
    shingle = lambda i: F.slice("w", i, words)
    own = F.transform(F.sequence(F.lit(1), F.size("w") - words + 1), lambda i: F.struct(F.xxhash64(shingle(i)).alias("s"), F.xxhash64(shingle(i), F.lit(words)).alias("s2")))
    each = lists.select(F.col(item).alias("__item"), F.col(ordinal).alias("__at"), F.explode(own).alias("k")).select("__item", "__at", "k.s", "k.s2")
    in_order = Window.partitionBy("s", "s2").orderBy("__at", "__item")
    again = F.lag("__at").over(in_order).eqNullSafe(F.col("__at")) & F.lag("__item").over(in_order).eqNullSafe(F.col("__item"))
    first = F.min("__at").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    seen = each.select("__item", "__at", first.alias("first"), again.alias("again")).where((F.col("first") < F.col("__at")) & ~F.col("again"))
    return seen.groupBy(F.col("__item").alias(item)).agg(F.count("*").alias("n_repeated"))
