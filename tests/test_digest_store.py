"""Stored digests: what is written reads back byte for byte, faulty documents give their rules, and old JSON lines lose nothing."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagewright.operators import digest_store as store

FORM = store.Form("Maker", {"hearings": [("facts", "Facts & <law>"), ("rest", "Rest")], "reports": [("facts", "Facts"), ("rest", "Rest")], "motions": [("facts", "F"), ("rest", "R")]})
ROWS = "doc_id int, " + ", ".join(f"{c} {t}" for c, t in store.ROW.items())
DOCS = "doc_id int, kind string, case_stem string, version int, metadata string"
TEXTS = ["plain", "# head\n## x (report:0001)\n\n### y (facts)", "No material content.", "No direct quotes.", "- a", "1. b", "12) c\\n", "a --> <!-- &amp; `x` é 😀\r\t\x00\x7f", "\\", "Quote: `a/b/1` — File page 2 — Verified", "é" * 3, " lead", "٣. x"]


def quote(item, n, text, verified=True, **more):
    return {"text": text, "file_page": 2, "quote_id": f"{item}/facts/{n}", "source_sha256": "ab", "verified": verified, "source_start": None, "source_end": None} | more


def row(doc_id, kind, n, text, quotes=(), **more):
    item = f"{store.KINDS[kind]}:{n:04d}"
    cats = [{"id": "facts", "digest": {"text": text, "evidence": [quote(item, i + 1, q, i % 2 == 0, source_start=i or None) for i, q in enumerate(quotes)]}}, {"id": "rest", "digest": None}]
    got = {"doc_id": doc_id, "kind": kind, "item_id": item, "ordinal": n, "label": f"L {text[:9]} — Hearing", "start_page": n, "end_page": n + 2, "input_sha256": "i", "generation_sha256": "g",
           "quality_flags": ["a:1", text[:5]], "categories": cats, "anchor_page": None, "group_metadata": None, "members": None}
    return got | more


def frames(spark, docs, rows):
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame([tuple(r.values()) for r in rows], ROWS)


def plain_escape(text):
    """The rules of the form in plain Python."""
    out = "".join("\\" + c if c in "\\`<>&[]#*_~!=|" else "\\n" if c == "\n" else c for c in text)
    digits = len(text) - len(text.lstrip("".join(c for c in set(text) if c.isdecimal()))) if text[:1].isdecimal() else 0
    if text[:1] in ("-", "+"):
        return "\\" + out
    return out[:digits] + "\\" + out[digits:] if digits and text[digits:][:1] in (".", ")") else out


def plain_json(value):
    return json.dumps(value, sort_keys=True).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def test_texts_and_json(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, ""]], "t string")
    for r in df.select("t", store.escaped(F.col("t")).alias("e"), store.json_text(F.col("t")).alias("j"), store.unescaped(store.escaped(F.col("t"))).alias("u"), store.unescaped(store.escaped_digest(F.col("t"))).alias("d")).collect():
        assert r.e == plain_escape(r.t) and "\n" not in r.e and r.j == plain_json(r.t) and r.u == r.t == r.d, r


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), min_size=1), min_size=1, max_size=60))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", store.json_text(F.col("t")).alias("j"), store.unescaped(store.escaped_digest(F.col("t"))).alias("u")).collect()
    assert all(r.u == r.t and r.j == plain_json(r.t) for r in got)


CATALOG = '{"category_catalog": [{"id": "facts", "title": "T*"}, {"id": "rest", "title": "Rest"}]}'
MEMBER = {"date": "", "date_basis": "filed", "end_page": 4, "naming_rule_id": "", "paper_id": "motion:0003", "role": "lead", "source_title": "M <1>", "start_page": 3}
GROUP = {"date": "", "date_basis": "filed", "filing_party": "", "filing_role": "motion packet", "purpose": "", "relationship_notes": "n", "relationship_to": ""}


def grouped(doc_id, **more):
    second = MEMBER | {"start_page": 5, "end_page": 9, "paper_id": "motion:0005"}
    cats = [{"id": "facts", "digest": {"text": "x", "evidence": [quote("motion:0003", 1, "q", file_page=6)]}}, {"id": "rest", "digest": None}]
    return row(doc_id, "motions", 3, "x", categories=cats, start_page=3, end_page=9, anchor_page=3, group_metadata=GROUP, members=[MEMBER, second], **more)


def test_round_trip(spark):
    kinds = ["hearings", "reports", "motions"]
    docs = [(0, "reports", "case", 1, None), (1, "hearings", "c — 1", 1, None), (2, "reports", 'c"2', 2, CATALOG), (3, "motions", "c", 3, CATALOG), (4, "motions", "c", 1, None), (5, "reports", "x", 1, None)]
    rows = [row(i, kinds[(i - 1) % 3 if i < 3 else 2], n + 1, t, TEXTS[:n % 4]) for i in (1, 2, 4) for n, t in enumerate(TEXTS)] + [grouped(3)]
    rows = [r | {"kind": {1: "hearings", 2: "reports", 4: "motions"}.get(r["doc_id"], "motions")} for r in rows]
    rows = [*rows, row(5, "reports", 1, "x") | {"label": None}]
    d, r = frames(spark, docs, rows)
    texts = store.written(FORM, d, r).cache()
    whole = {t.doc_id: t.markdown for t in texts.collect()}
    assert whole[0].count("\n") == 5 and whole[5] is None and "Source pages: 3-4, 5-9" in whole[3]
    parts = store.blocks(FORM, texts.where("doc_id < 5"))
    assert store.issues(parts).collect() == [] and parts.where("line is not null").count() == 0
    back = [x.asDict(recursive=True) for x in store.rows_of(parts).collect()]
    key = lambda x: (x["doc_id"], x["ordinal"])
    assert sorted(back, key=key) == sorted((x for x in rows if x["doc_id"] < 5), key=key)
    again = store.written(FORM, d.where("doc_id < 5"), store.rows_of(parts))
    assert {t.doc_id: t.markdown for t in again.collect()} == {k: v for k, v in whole.items() if k < 5}
    # The comments are JSON with sorted keys, as a plain writer has it.
    one = next(x for x in whole[3].split("\n") if "digest-row" in x)
    told = json.loads(one.removeprefix("<!-- maker:digest-row ").removesuffix(" -->"))
    assert plain_json(told) in one and told["schema_version"] == 4 and told["members"][0]["source_title"] == "M <1>"
    # The older name of a quotation's page is read where a document has it throughout.
    older = texts.where("doc_id in (1, 2)").withColumn("markdown", F.replace("markdown", F.lit("— Model-reported file page"), F.lit("— File page")))
    assert store.issues(store.blocks(FORM, older)).collect() == []
    mixed = texts.where("doc_id = 1").withColumn("markdown", F.regexp_replace("markdown", "(?s)^(.*?— )Model-reported file page", "$1File page"))
    assert {i.rule for i in store.issues(store.blocks(FORM, mixed)).collect()} == {"not_canonical"}


CASES = [
    (lambda t: t + "\n", "final_newline"), (lambda t: t[:-1], "final_newline"), (lambda t: "", "final_newline"), (lambda t: t.replace("Maker", "Other", 1), "not_canonical"),
    (lambda t: t.replace('"format_version": 1', '"format_version": 9'), "version"), (lambda t: t.replace("maker-summary", "x-summary"), "artifact"), (lambda t: t.replace("Source pages: 1-3", "Source pages: 1-4"), "row_pages"),
    (lambda t: t.replace("## L one", "## L two"), "row_label"), (lambda t: t.replace("Unverified", "Verified"), "not_canonical"), (lambda t: t.replace("(rest)", "(more)", 1), "categories"),
    (lambda t: t.replace('"schema_version": 2', '"schema_version": 3'), "row_version"), (lambda t: t.replace("> q1", "> q*1"), "not_canonical"), (lambda t: t.replace('"ordinal": 1', '"ordinal": 0'), "ordinal"),
    (lambda t: t + t[t.index("\n## "):], "duplicate_item"), (lambda t: t.replace("report:0001", "motion:0001"), "item_id"), (lambda t: t.replace('"input_sha256": "i"', '"input_sha256": ""'), "fingerprint"),
    (lambda t: t.replace("report:0001/facts/2", "report:0001/facts/1"), "quote_id"), (lambda t: t.replace('"source_sha256": "ab"', '"source_sha256": ""'), "quote_hash"), (lambda t: t.replace("\none\n", "\n \n"), "digest_text"),
    (lambda t: t.replace('"kind": "reports"', '"kind": "motions"'), "kind"), (lambda t: t.replace(" -->", " >", 2), "row_comment"), (lambda t: t[: len(t) // 2] + "\n", "not_canonical"),
]


def test_faults(spark):
    d, r = frames(spark, [(0, "reports", "c", 1, None)], [row(0, "reports", 1, "one", ["q1", "q2"]), row(0, "reports", 2, "two")])
    text = store.written(FORM, d, r).first().markdown
    bad = [(n, "reports", "c", f(text)) for n, (f, _) in enumerate(CASES)] + [(99, "reports", "c", text), (98, "reports", "c", None)]
    parts = store.blocks(FORM, spark.createDataFrame(bad, "doc_id int, kind string, case_stem string, markdown string")).cache()
    found = {}
    for i in store.issues(parts).collect():
        found.setdefault(i.doc_id, set()).add(i.rule)
    for n, (_, rule) in enumerate(CASES):
        assert rule in found[n], (n, rule, found[n])
    assert 99 not in found and "final_newline" in found[98]
    assert {x.doc_id for x in store.rows_of(parts).collect()} == {99}
    assert parts.where("doc_id = 6 and block = 1").first().line == 4


@pytest.mark.parametrize("change,rule", [({"end_page": 8}, "members"), ({"anchor_page": 5}, "members"), ({"members": []}, "members"), ({"members": [MEMBER, MEMBER]}, "members"), ({"members": [MEMBER | {"paper_id": "motion:3"}]}, "members")])
def test_members(spark, change, rule):
    d, r = frames(spark, [(3, "motions", "c", 3, CATALOG)], [grouped(3) | change])
    assert rule in {i.rule for i in store.issues(store.blocks(FORM, store.written(FORM, d, r))).collect()}


def test_old_lines(spark):
    rows = [row(0, "reports", n + 1, t, TEXTS[: n % 3]) for n, t in enumerate(TEXTS)]
    _, r = frames(spark, [], rows)
    lines = [x.j for x in r.orderBy("ordinal").select(store.old_json(FORM, F.struct(*store.ROW)).alias("j")).collect()]
    told = [json.loads(x) for x in lines]
    assert all(json.dumps(t) == x.replace("\\u003c", "<").replace("\\u003e", ">").replace("\\u0026", "&") for t, x in zip(told, lines)) and told[1]["categories"][0]["digest"]["text"] == TEXTS[1]
    import hashlib

    text = "\n".join(lines) + "\n"
    digest = hashlib.sha256(text.encode()).hexdigest()
    spoilt = [lines[0][:-1], '[1]', lines[0].replace("summary-digest", "x"), lines[0].replace('"ordinal": 1', '"ordinal": "1"'), lines[0].replace('"label"', '"more": 1, "label"'), lines[0].replace("reports", "motions"), lines[0].replace('"digest": null', '"digest": null, "x": 1')]
    files = [(0, "reports", text, digest), (1, "reports", "\n \r\n" + text, None), (2, "reports", text, "00"), (3, "reports", "", None), (4, "reports", None, None), (5, "reports", "\n".join(spoilt), None)]
    parts = store.from_old_lines(FORM, spark.createDataFrame(files, "doc_id int, kind string, text string, stored_sha256 string")).cache()
    found = sorted({(i.doc_id, i.block, i.rule) for i in store.issues(parts).collect() if i.doc_id < 5})
    assert found == [(2, n + 1, "stored_hash") for n in range(len(lines))]
    wrong = {}
    for i in store.issues(parts.where("doc_id = 5")).collect():
        wrong.setdefault(i.block, set()).add(i.rule)
    expected = {1: "json", 3: "artifact", 4: "lossy", 5: "lossy", 6: "row_kind", 7: "lossy"}
    assert all(rule in wrong[n] for n, rule in expected.items()) and wrong[2]
    moved = store.rows_of(parts)
    assert {x.doc_id for x in moved.select("doc_id").distinct().collect()} == {0, 1}
    d, _ = frames(spark, [(0, "reports", "c", 1, None)], [])
    straight, through = (store.written(FORM, d, x).first().markdown for x in (r, moved))
    assert straight == through


def test_stored_texts_are_not_made_again_for_each_use(spark, tmp_path):
    from pagewright.plans import stores

    turns = [(c, t, "user", f"turn {t} of *{c}* says it") for c in range(16) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = stores.digest_store_issues(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp_" not in plan and "conversations.parquet" not in plan
    assert {r.rule for r in found.where("conv_id < 8").collect()} == {"final_newline", "not_canonical", "row_pages", "duplicate_item", "fingerprint", "case_stem", "categories"}
