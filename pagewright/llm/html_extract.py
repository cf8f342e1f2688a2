"""Main text of HTML pages: boosted trees over block-tree features, decoded as one consistent labelling of each tree.

Every block node and every run of a block's own text gets the probability of being main text. A best-first choice per page then
labels nodes main, rest or mixed from the root down: what is inside rest is rest, main may hold only main and rest, mixed may hold
all three; so no node contradicts an ancestor.

Defined results: a null, empty or text-free page gives the empty string; white space inside a block becomes one space, blocks are
joined in page order by one space; repeated rows are extracted one by one; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import gbt
from pagewright.llm.common import bounded_batches
from pagewright.llm.html_pages import Node, parse, training_tree

TRAINING_PAGES, SEED = 900, 11
GOOD = re.compile(r"article|post|entry|content|story|main|text|body|blog|news")
RULES = tuple(
    re.compile(p)
    for p in (
        r"\bnav|menu|bread|pag(?:er|inat)", r"head(?:er)?\b|mast|brand", r"foot|copyright|legal|colophon|bottom", r"side|aside|widget|relat|rail|recommend|more-",
        r"\bads?\b|advert|sponsor|promo|adsbox|\bad-|banner", r"cookie|notice|consent|gdpr|alert|popup|modal|overlay", r"form|subscri|newsletter|sign|login|search", r"comment|disqus|respon|repl", r"share|social|tags|meta",
    )
)
TAGS = ("article", "main", "section", "div", "p", "h", "list", "li", "table", "nav", "header", "footer", "aside", "form", "quote", "#text")
KIND = {**{t: t for t in TAGS}, **{f"h{i}": "h" for i in range(1, 7)}, "ul": "list", "ol": "list", "dl": "list", "dd": "li", "dt": "li", "menu": "nav", "blockquote": "quote", "pre": "quote", "figure": "quote",
        **{t: "table" for t in "tr td th tbody thead tfoot caption".split()}, **{t: "form" for t in "button label fieldset legend option".split()}}
PENALTY = 1.5  # log odds that rest inside main must overcome


def featured(root: Node) -> tuple[list[Node], np.ndarray]:
    """All nodes in page order and their features."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.kids[::-1]
    place = {id(n): i for i, n in enumerate(order)}
    n = len(order)
    chars, links, ends, count, words = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n), np.zeros(n)
    for i in range(n - 1, -1, -1):
        node = order[i]
        if node.text:
            t = node.text[0]
            chars[i], links[i], ends[i], words[i] = len(t), node.links, t.count(".") + t.count(",") + t.count("!") + t.count("?"), t.count(" ") + 1
        if node.up is not None:
            j = place[id(node.up)]
            for a in (chars, links, ends, count, words):
                a[j] += a[i]
    total, seen = max(1.0, chars[0]), 0.0
    rows, own = [], {}
    nth = {id(kid): k for x in order for k, kid in enumerate(x.kids)}
    for i, node in enumerate(order):
        kind = KIND.get(node.tag, "")
        up = own.get(id(node.up)) if node.up is not None else None
        hits = [float(bool(p.search(node.words))) for p in RULES] if node.words else [0.0] * len(RULES)
        for k, tag in ((0, "nav"), (1, "header"), (2, "footer"), (3, "aside"), (6, "form")):
            hits[k] = max(hits[k], float(kind == tag))
        good = float(kind in ("article", "main") or bool(node.words and GOOD.search(node.words) and not any(hits)))
        above = [max(a, b) for a, b in zip(up[0], up[1])] if up else [0.0] * len(RULES)
        inside = max(up[2], up[3]) if up else 0.0
        own[id(node)] = (hits, above, good, inside)
        siblings = node.up.kids if node.up is not None else [node]
        c = chars[i]
        size = len(siblings)
        rows.append(
            [
                *(float(kind == t) for t in TAGS), *hits, *above, good, inside, float(node.hidden), float(max(hits) > 0), float(max(above) > 0),
                node.depth, math.log1p(c), links[i] / max(1.0, c), ends[i] / max(1.0, words[i]), math.log1p(words[i]), c / count[i], c / total, seen / total,
                math.log1p(size), nth.get(id(node), 0) / size, math.log1p(chars[place[id(node.up)]] if node.up is not None else c), count[i],
            ]
        )
        if node.text:
            seen += c
    return order, np.array(rows)


@functools.cache
def model() -> gbt.Trees:
    """Fitted on made-up pages with known main text; the same at every call."""
    r, xs, ys = random.Random(SEED), [], []
    for _ in range(TRAINING_PAGES):
        root, good = training_tree(r)
        order, x = featured(root)
        known = [i for i, n in enumerate(order) if good[id(n)] is not None]
        xs.append(x[known])
        ys.append(np.array([good[id(order[i])] for i in known], float))
    return gbt.fit(np.concatenate(xs), np.concatenate(ys), trees=50, depth=4)


def decode(order: list[Node], p: np.ndarray) -> list[bool]:
    """The likeliest consistent labelling: main (0), rest (1) or mixed (2) for each node; True where a text run is main."""
    p = np.clip(p, 1e-4, 1 - 1e-4)
    n = len(order)
    place = {id(x): i for i, x in enumerate(order)}
    main, rest, mixed = np.log(p), np.log(1 - p), np.where([bool(x.kids) for x in order], math.log(0.4), -1e9)
    for i in range(n - 1, 0, -1):
        j = place[id(order[i].up)]
        rest[j] += rest[i]
        main[j] += max(main[i], rest[i] - PENALTY)
        mixed[j] += max(main[i], rest[i], mixed[i])
    label = np.zeros(n, np.int8)
    label[0] = 2 if order[0].kids else 1
    for i in range(1, n):
        up = label[place[id(order[i].up)]]
        if up == 1:
            label[i] = 1
        elif up == 0:
            label[i] = int(rest[i] - PENALTY > main[i])
        else:
            label[i] = int(np.argmax((main[i], rest[i], mixed[i])))
    return [bool(x.text) and label[i] == 0 for i, x in enumerate(order)]


def texts_of(pages: list[str | None], trees: gbt.Trees) -> list[str]:
    parsed = [featured(parse(p or "")) for p in pages]
    if not parsed:
        return []
    p = trees.probability(np.concatenate([x for _, x in parsed]))
    out, at = [], 0
    for order, x in parsed:
        keep = decode(order, p[at : at + len(order)])
        at += len(order)
        out.append(" ".join(n.text[0] for n, k in zip(order, keep) if k))
    return out


def extract(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """The kept columns, text and n_chars of each page (kept columns of those names give way); one pass, nothing is shuffled."""
    trees = model()
    keep = [c for c in keep if c not in ("text", "n_chars")]

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 128):
                part = batch.slice(lo, 128)
                texts = texts_of(part.column(0).to_pylist(), trees)
                out = [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=[*(f"c{i}" for i in range(len(keep))), "text", "n_chars"])

    kinds = "".join(f"c{i} {pages.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    sent = pages.select(F.col(f"`{html_col}`").cast("string").alias("html"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)))
    return bounded_batches(sent).mapInArrow(run, f"{kinds}text string, n_chars long").toDF(*keep, "text", "n_chars")
