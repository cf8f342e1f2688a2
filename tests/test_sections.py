"""Sections: every fallback and flag by hand, and selections and capitals against a plain statement of their rules."""

import json

import pytest

from pagewright.operators import sections

ROWS = "case_id long, item_id string, ordinal int, kind string, categories array<struct<id:string,text:string,evidence:array<struct<quote_id:string,text:string,verified:boolean>>>>"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"


def quotes(*found):
    return [("facts", "The digest.\n\nIts [end](page:0007).", list(found)), ("law", None, [("x", "unseen", True)]), None]


SHORT, GOOD = ("q1", "Too few words.", False), ("q2", "These are just six whole words", True)


@pytest.fixture(scope="module")
def got(spark):
    rows = [(1, i, n, "reports", quotes(SHORT, GOOD)) for n, i in enumerate("abcdefghijk")]
    rows += [(1, "n", 50, "reports", [("facts", None, None)]), (1, "o", 51, "reports", None), (2, "a", 1, "reports", quotes()), (3, "a", 1, "reports", quotes()), (1, None, 60, "reports", quotes()), (4, "a", 1, "hearings", quotes())]
    entries = [
        7, {"item_id": "zz"}, {"paragraphs": []}, {"item_id": "b", "paragraphs": " \n"}, {"item_id": "c", "paragraphs": {"x": 1}}, {"item_id": "d", "paragraphs": ["Old."]},
        {"item_id": " d ", "paragraphs": ["New {{quote: q2 }}\nline.\r\n \r\nSecond [part](page:0012).", 5]},
        {"item_id": "e", "paragraphs": ["{{quote:q1}} and {{quote:q1}} \"so\" input_sha256"]}, {"item_id": "f", "paragraphs": ["{{quote:x}} {{quote:y}} {{quote:y}}"]},
        {"item_id": "g", "paragraphs": ["{{quote:q2}}"], "quote_selections": {"q2": "six whole words"}, "quote_capitalizations": {"q2": "Six whole words"}},
        {"item_id": "h", "paragraphs": ["{{quote:q2}}"], "quote_selections": {"q2": "ix whole"}, "quote_capitalizations": {"q2": "these are just six whole words", "q1": "x"}},
        {"item_id": "i", "paragraphs": [LONG], "quote_selections": None}, {"item_id": "j", "paragraphs": ["But " + LONG, "Nothing.", LONG.replace(" ", "\n")]}, {"item_id": "k", "paragraphs": [LONG[4:]]},
        {"item_id": "n", "paragraphs": ["Made up."]}, {"item_id": "o", "paragraphs": "{{quote:q1}}"},
    ]
    payloads = [(1, json.dumps(entries)), (2, "{}"), (3, "not json"), (4, None)]
    found, remarks = sections.normalised_sections(spark.createDataFrame(rows, ROWS), spark.createDataFrame(payloads, "case_id long, payload string"))
    return {(r.case_id, r.item_id): r for r in found.collect()}, sorted(map(tuple, remarks.collect()))


def test_texts(got):
    found, _ = got
    assert len(found) == 17
    digest = ["The digest.", "Its end."]
    for key in (1, "a"), (1, "b"), (1, "c"), (1, "f"), (2, "a"), (3, "a"), (4, "a"), (1, None):
        assert found[key].paragraphs == digest
    assert found[1, "d"].paragraphs == ["New {{quote: q2 }} line.", "Second part."]
    assert found[1, "n"].paragraphs == found[1, "o"].paragraphs == []
    assert (found[1, "g"].selections, found[1, "g"].capitals) == ({"q2": "six whole words"}, {"q2": "Six whole words"})
    assert (found[1, "h"].selections, found[1, "h"].capitals) == ({}, {"q2": "these are just six whole words"})


def test_flags(got):
    found, remarks = got
    want = {
        "a": ["fallback_section:a"], "b": ["empty_section_fallback:b", "paragraph_string_kept:b"], "c": ["empty_section_fallback:c", "malformed_paragraphs_fallback:c"], "d": [],
        "e": ["duplicate_quote_use:e:q1", "quote_length_out_of_range:e:q1:3", "quote_terminal_punctuation:e:q1", "technical_metadata_in_narrative:e:hash_label", "typed_quotation_marks:e", "unverified_quote_used:e:q1"],
        "f": ["unknown_placeholder:f:2", "unknown_placeholder_fallback:f"], "g": [], "h": ["quote_capitalization_rejected:h", "quote_selection_rejected:h"], "i": ["quote_selection_rejected:i"],
        "j": ["repeated_passage:j:2"], "k": ["repeated_passage:k:1"], "n": ["paragraphs_for_all_null_document:n"], "o": ["paragraph_string_kept:o", "unknown_placeholder:o:1", "unknown_placeholder_fallback:o"],
    }
    assert {i: found[1, i].flags for i in want} == want
    assert remarks == [(1, "malformed_section_ignored:1"), (1, "unknown_section_ignored:unlabeled"), (1, "unknown_section_ignored:zz"), (2, "candidate_unusable:all_fallback"), (3, "candidate_unusable:all_fallback"), (4, "candidate_unusable:all_fallback")]


def test_selections_and_capitals(spark):
    cases = [
        ("the cat's cat", "cat", True), ("the cat's", "cat", False), ("a well-known one", "well", False), ("a b", "b ", False), ("a b", "a b", True), (" a b", " a b", True), ("...", "...", False),
        (r"x \E y (z)", r"\E y (z)", True), ("émile é", "mile", False), ("ab", "", False), (None, "a", False), ("a", None, False), ("concat cat", "cat", True),
    ]
    df = spark.createDataFrame(cases, "o string, c string, want boolean")
    assert df.where(sections.valid_selection(df.o, df.c) != df.want).collect() == []
    cases = [("The Act", "the act", True), ("The Act", "the acts", False), ("Été 1", "été 1", True), ("a-b", "a_b", False), ("", "", True), ("a", None, False), ("𝒳 a", "𝒳 A", True)]
    df = spark.createDataFrame(cases, "o string, c string, want boolean")
    assert df.where(sections.valid_capitals(df.o, df.c) != df.want).collect() == []


def test_empty_tables(spark):
    rows, payloads = spark.createDataFrame([], ROWS), spark.createDataFrame([], "case_id long, payload string")
    assert [d.count() for d in sections.normalised_sections(rows, payloads)] == [0, 0]


def test_texts_go_to_python_once_in_bounded_batches(spark):
    limits = [f"spark.sql.execution.arrow.{k}" for k in ("maxBytesPerBatch", "maxRecordsPerBatch")]
    for key in limits:
        spark.conf.unset(key)
    rows = spark.createDataFrame([(1, "a", 1, "reports", quotes(GOOD)), (1, "b", 2, "reports", quotes(GOOD))], ROWS)
    payload = json.dumps([{"item_id": "a", "paragraphs": [LONG]}, {"item_id": "b", "paragraphs": [LONG + " {{quote:q2}}"]}])
    found, _ = sections.normalised_sections(rows, spark.createDataFrame([(1, payload)], "case_id long, payload string"))
    assert [int(spark.conf.get(k)) for k in limits] == [4 << 20, 2000]
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.item_id: r.flags for r in found.collect()} == {"a": [], "b": ["repeated_passage:b:1"]}
