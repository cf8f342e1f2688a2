"""Decontamination, mixing, toxicity, secrets, sharding, fixity and HTML text on small invented tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import documents, frame, words
from pagewright.llm import decontaminate, fixity, gbt, html_extract, html_pages, mixing, secrets, sharding, toxicity
from pyspark.sql import functions as F


def row(i, text, source="s"):
    return (i, text, "en", source, 0, 1, "", 1, "", 1)


# ---- decontamination


def least_edits(pattern, text):
    best = prev = list(range(len(pattern) + 1))
    out = prev[-1]
    for c in text:
        now = [0]
        for i, p in enumerate(pattern):
            now.append(min(prev[i] + (p != c), prev[i + 1] + 1, now[i] + 1))
        prev, out = now, min(out, now[-1])
    return out


def test_decontamination_against_dynamic_programming(spark):
    r = random.Random(8)
    items = [(i, words(r, r.randint(4, 20))) for i in range(6)] + [(6, None), (7, ""), (8, "...")]
    rows = []
    for i in range(40):
        t = list(r.choice(items[:6])[1])
        for _ in range(r.randint(0, len(t) // 6)):
            k = r.randrange(len(t))
            t[k : k + 1] = r.choice(([], [r.choice("abc ")], [t[k], "x"]))
        rows.append(row(i, words(r, 10) + " " + "".join(t).upper() + ", " + words(r, 10)))
    rows += [row(90, None), row(91, ""), row(92, "!!")]
    want = set()
    for x in rows:
        for i, item in items:
            p, t = decontaminate.normalise(item), decontaminate.normalise(x[1])
            if p and least_edits(p, t) <= int(0.1 * len(p)):
                want.add((x[0], i, least_edits(p, t)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(h.doc_id, h.item_id, h.edits) for h in decontaminate.hits(frame(spark, rows), bench).collect()}
    assert want and got == want
    kept = decontaminate.clean(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert {k.doc_id for k in kept.collect()} == {x[0] for x in rows} - {w[0] for w in want}
    assert decontaminate.hits(frame(spark, rows), bench.where("item_id > 99")).count() == 0


# ---- mixing


def test_mix_meets_its_targets(spark):
    r = random.Random(2)
    rows = [row(i, words(r, r.randint(0, 60)), ("b", "a", "c", None, "ä")[min(4, int(r.expovariate(1)))]) for i in range(900)] + [row(5, None, "a"), row(5, None, "a")]
    got = mixing.mixed(frame(spark, rows)).collect()
    again = mixing.mixed(frame(spark, rows)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {s: sum(size(x[1]) for x in rows if x[3] == s) for s in {x[3] for x in rows}}
    order = sorted((s for s in sums if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight, total, capped = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sums.values()), set()
    while True:
        left = total - sum(2 * sums[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s in share if share[s] > 2 * sums[s]}
        if not over:
            break
        capped |= over
    goal = {s: share.get(s, 2 * sums[s]) for s in order}
    for s in order:
        own = [g for g in got if g.source == s]
        assert all(abs(g.target - goal[s]) < 1e-6 and g.source_size == sums[s] for g in own)
        assert abs(sum(g.taken for g in own) - goal[s]) <= 120
    assert all(0 <= g.taken <= 2 * g.size for g in got)


def test_mix_of_nothing(spark):
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert [(r.target, r.taken) for r in mixing.mixed(frame(spark, [row(1, "")])).collect()] == [(0.0, 0)]


# ---- toxicity


def test_toxicity_on_held_out_rows(spark):
    r, rows, labels = random.Random(6), [], []
    for i in range(500):
        t = words(r, 40).split()
        toxic = r.random() < 0.3
        if toxic:
            for w in r.choices(("idiot", "moron", "worthless", "pathetic"), k=3):
                t.insert(r.randrange(40), r.choice(("you ", "")) + w)
        rows.append(row(i, " ".join(t)))
        labels.append((i, 1, int(toxic)))
    docs = frame(spark, [*rows, row(901, None), row(902, ""), row(None, "plain text"), row(1, "again")])
    known = spark.createDataFrame([*labels, (3, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.scored(docs, toxicity.train(docs, known))
    got = out.select("doc_id", "score", "predicted", toxicity.held_out(F.col("doc_id")).alias("held")).collect()
    truth = {a: c for a, _, c in labels}
    assert len(got) == 504 and all(0 <= g.score <= 1 and g.predicted == (g.score >= 0.7) for g in got)
    assert all(g.held == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    held = [g for g in got if g.held and g.doc_id in truth]
    assert np.mean([g.predicted == truth[g.doc_id] for g in held]) > 0.95
    assert toxicity.features("y0u 1d10t")[toxicity.FEATURES.index("hidden_hits")] == 1
    assert toxicity.features("an i d i o t, really")[toxicity.FEATURES.index("apart_hits")] == 1
    few = toxicity.train(docs, known.where("doc_id < 5"))
    assert few.trees is None and toxicity.scored(docs, few).count() == 504


def test_trees_and_isotonic():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = gbt.fit(x, y, trees=40)
    assert ((m.probability(x) > 0.5) == y).mean() > 0.95
    knots, p = gbt.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert p.tolist() == [0, 0.5, 1] and (np.diff(knots) > 0).all()


# ---- secrets


def test_secrets_against_plain_patterns(spark):
    r = random.Random(3)
    texts = ["Password = 'abcDEF12345' x", 'é "api_key": "zz.yy-11/22=" token:short', "AKIA" + "A1" * 8 + " AKIA1", "deadbeef" * 5 + "g" + "0" * 31, None, "", "ſecret=abcdefgh1 TOKEN =  qwertyuiop",
             "secret=password=abcdefgh123", "key Zk8vQ2xR7mN4pL9sT1wY6bH3 end", "the_ordinary_identifier_of_value_2 is here", "x" * 500]
    rows = [row(i, t) for i, t in enumerate(texts)]
    for g in secrets.scan(frame(spark, rows)).collect():
        t, spans = texts[g.doc_id] or "", []
        for k, (kind, p, least) in enumerate((("assign", secrets.ASSIGN, 0), ("access", secrets.ACCESS, 16), ("hex", secrets.HEX, 32))):
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(p, t) if m.end() - m.start() >= least and (k or len(m[2]) >= 8)]
        base = ",".join(s for _, _, s in sorted(spans))
        assert g.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(g.spans.split(","))
        assert g.n_markov == (1 if g.doc_id == 8 else 0)
    ratios, own = secrets.train(secrets.labelled_samples()), secrets.labelled_samples(500, seed=r.randrange(1000))
    found = [bool(secrets.markov_spans(t.encode(), True, ratios, [])) for t, label in own if label and re.search("[0-9]", t) and re.search("[A-Za-z]", t)]
    wrong = [bool(secrets.markov_spans(t.encode(), True, ratios, [])) for t, label in own if not label]
    assert np.mean(found) > 0.95 and np.mean(wrong) < 0.02


# ---- sharding


def test_shards_keep_groups_and_balance(spark):
    rows = documents(n=400) + [row(1000 + i, "hot text") for i in range(50)] + [row(2000, None), row(2001, None)]
    got = sharding.shards(frame(spark, rows), n_shards=4).collect()
    assert len(got) == len(rows)
    for s in range(4):
        assert sorted(g.slot for g in got if g.shard == s) == list(range(sum(g.shard == s for g in got)))
    text = {x[0]: x[1] for x in rows}
    where = {}
    for g in got:
        assert where.setdefault(text[g.doc_id], g.shard) == g.shard
        raw = (text[g.doc_id] or "").encode()
        assert (g["size"], g.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    loads = [sum(g["size"] for g in got if g.shard == s) for s in range(4)]
    assert max(loads) - min(loads) <= max(sum(g["size"] for g in got if text[g.doc_id] == t) for t in where)
    assert sharding.shards(frame(spark, [])).count() == 0
    assert sharding.least_loaded([(5, "a"), (4, "b"), (3, "c"), (3, "d")], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}


# ---- fixity


def test_audit_finds_what_was_damaged(spark):
    left = spark.range(300).select("id", F.concat(F.lit("record "), F.col("id").cast("string")).alias("record"))
    right = left.where("id <> 250").withColumn("record", F.expr("case when id in (7, 133) then concat('Record ', id) else record end")).unionAll(spark.sql("select 400L, 'new'"))
    status = {r.id: r.status for r in fixity.audit(left, right).collect()}
    assert {k: v for k, v in status.items() if v not in ("intact", "moved")} == {7: "corrupt", 133: "corrupt", 250: "missing", 400: "extra"}
    assert all(v == "intact" for k, v in status.items() if k < 240 and k not in (7, 133))
    assert {r.status for r in fixity.audit(left, left).collect()} == {"intact"}
    assert fixity.audit(left.where("id < 0"), left.where("id < 0")).count() == 0
    assert fixity.audit(left, left.where("id < 0")).where("status = 'missing'").count() == 300


# ---- HTML


def test_main_text(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a><li><a href="/x">News</a></ul></nav>
        <div class="cookie-notice">We use cookies. <button>OK</button></div><article><h1>A &amp; B</h1><script>var x = "</p>";</script>
        <p>First <b>bold</b>ed\n paragraph, with some words in it. It goes on for a while.<p>Second &eacute; one.<br>Next line of the text here.<!-- no -->
        <div class="ad">Buy now, cheap!</div><ul><li>one item of the list<li>two items of the list</ul></article>
        <section class="comments"><h3>Comments</h3><p>Nice post, thanks for it!</p></section><footer>&copy; nobody</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>"), (5, "u", "<" * 50), (6, "u", "<article><p>only this text stands here.")]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()}
    assert got[1].text == "A & B First bolded paragraph, with some words in it. It goes on for a while. Second é one. Next line of the text here. one item of the list two items of the list"
    assert got[2].text == got[3].text == got[4].text == "" and got[1].n_chars == len(got[1].text)
    assert got[6].text == "only this text stands here."


def test_held_out_pages():
    r, scores = random.Random(123), []
    for _ in range(80):
        root, good = html_pages.training_tree(r)
        order, x = html_extract.featured(root)
        keep = html_extract.decode(order, html_extract.model().probability(x))
        n = [sum(len(a.text[0]) for a, k in zip(order, keep) if a.text and (k, bool(good[id(a)])) == w) for w in ((True, True), (True, False), (False, True))]
        scores.append(2 * n[0] / max(1, 2 * n[0] + n[1] + n[2]))
    assert np.mean(scores) > 0.97


@pytest.mark.parametrize("page", ["<div hidden>x</div>", "<table><tr><td>a<td>b</table>", "<select><option>x</select>", "a<b", "<a href='>'>x</a>", "<p><p></p></div></body>", "&#0;&bogus;&#x110000;"])
def test_odd_pages_do_not_crash(page):
    html_extract.texts_of([page, None], html_extract.model())
