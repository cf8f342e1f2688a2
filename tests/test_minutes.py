"""Minute candidates: typed fields, located evidence, downgraded states; and checkpoints of which only changed rows are made anew."""

import json

from pyspark.sql import functions as F

from pagewright.operators import minutes

ITEMS = "case_id int, item_id string, fingerprint string, start_page int, end_page int"
GOOD = {"artifact": "minute-candidate", "hearing": " A  hearing ", "orders": "Granted", "next_hearing": "May", "positions": 7}


def person(name="Ann", status="present", evidence=(), **more):
    return {"person": name, "role_label": "Clerk", "status": status, "evidence": list(evidence)} | more


def run(spark, payloads, pages=((0, 1, "Ann was pre-\nsent in  court"), (0, 2, "ﬁne"), (0, 9, "elsewhere"))):
    items = spark.createDataFrame([(0, f"m{n}", f"f{n}", 1, 2) for n in range(len(payloads) + 1)], ITEMS)
    sent = [(0, f"m{n}", p if isinstance(p, str) or p is None else json.dumps(p)) for n, p in enumerate(payloads)] + [(0, "none", "{}")]
    rows, rejected = minutes.candidates(items, spark.createDataFrame(list(pages), "case_id int, page int, text string"), spark.createDataFrame(sent, "case_id int, item_id string, payload string"))
    return {r.item_id: r.asDict(recursive=True) for r in rows.collect()}, {r.item_id: r.reason for r in rejected.collect()}


def test_candidates(spark):
    on = lambda page, text: {"file_page": page, "text": text}
    sent = [
        GOOD | {"appearances": [person(evidence=[on(1, "was present in court"), on(2, "fine"), on(9, "elsewhere"), on(True, "fine"), on("2", "fine"), 5, on(2, "")])]},
        GOOD | {"appearances": [person(evidence=[on(2, "was present")]), person("", "x"), person("Bob", "odd", role_label="r" * 513), 7]},
        GOOD | {"appearances": "no", "next_hearing": None}, GOOD | {"appearances": [person("P%d" % n, "not_present", [on(2, "fine")]) for n in range(130)]}, GOOD | {"hearing": 5}, GOOD | {"artifact": "x"}, "[1]", "{", None,
    ]
    rows, rejected = run(spark, sent)
    assert rejected == {"m4": "empty", "m5": "artifact", "m6": "json", "m7": "json", "m8": "missing", "m9": "missing"}
    assert rows["m0"] == {"case_id": 0, "item_id": "m0", "fingerprint": "f0", "hearing": "A hearing", "orders": "Granted", "next_hearing": "May", "positions": "", "quality_flags": [],
        "appearances": [{"person": "Ann", "role_label": "Clerk", "status": "present", "evidence": [on(1, "was present in court"), on(2, "fine")]}]}
    assert [(a["person"], a["status"], a["role_label"]) for a in rows["m1"]["appearances"]] == [("Ann", "unclear", "Clerk"), ("Bob", "unclear", "Unknown")]
    assert rows["m1"]["quality_flags"] == ["appearance_evidence_unverified", "malformed_appearance", "unresolved_role"]
    assert rows["m2"]["quality_flags"] == ["appearances_unclear", "appearances_unusable", "next_hearing_unusable"] and rows["m2"]["next_hearing"] == minutes.NO_NEXT
    assert len(rows["m3"]["appearances"]) == 128 and rows["m3"]["quality_flags"] == ["appearances_truncated"] and rows["m3"]["appearances"][127]["status"] == "not_present"
    assert run(spark, [], []) == ({}, {"m0": "missing"})


def test_checkpoint(spark):
    items = spark.createDataFrame([(0, f"m{n}", f"f{n}", 1, 2) for n in range(8)], ITEMS)
    pages = spark.createDataFrame([(0, 1, "fine")], "case_id int, page int, text string")
    sent = spark.createDataFrame([(0, f"m{n}", json.dumps(GOOD | {"appearances": [person(evidence=[{"file_page": 1, "text": "fine"}])]})) for n in range(8)], "case_id int, item_id string, payload string")
    stored = minutes.checkpointed(minutes.candidates(items, pages, sent)[0], "c1").cache()
    assert minutes.checkpoint_issues(stored).collect() == [] and minutes.due(items, stored, "c1")[1].collect() == []
    assert {r.why for r in minutes.due(items, stored, "c2")[1].collect()} == {"contract"}
    odd = F.col("item_id")
    spoilt = stored.where(odd != "m0").withColumns({"hearing": F.when(odd == "m1", "other").otherwise(F.col("hearing")), "version": F.when(odd == "m2", 4).when(odd == "m3", 9).otherwise(F.col("version")), "positions": F.when(odd == "m4", None).otherwise(F.col("positions"))})
    rehashed = spoilt.withColumn("row_sha256", F.when(odd == "m1", F.col("row_sha256")).otherwise(minutes.row_hash(F.col("version"), F.col("contract"), spoilt)))
    kept, work = minutes.due(items.withColumn("fingerprint", F.when(odd == "m5", "new").otherwise(F.col("fingerprint"))).where(odd != "m7"), rehashed.union(rehashed.where(odd == "m6")), "c1")
    assert {r.item_id: r.why for r in work.collect()} == {"m0": "missing", "m1": "unsound", "m2": "version", "m3": "unsound", "m4": "unsound", "m5": "changed", "m6": "unsound"} and kept.collect() == []
    found = {(r.item_id, r.rule) for r in minutes.checkpoint_issues(rehashed.union(rehashed.where(odd == "m6"))).collect()}
    assert found == {("m1", "row_hash"), ("m3", "version"), ("m3", "fields"), ("m4", "fields"), ("m6", "repeated")}
    assert [r.item_id for r in minutes.due(items, stored.where(odd == "m7"), "c1")[0].collect()] == ["m7"]
