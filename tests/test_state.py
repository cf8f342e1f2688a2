"""Rules of stored state and rows."""

from pyspark.sql import functions as F

from pagewright.operators import state


def test_pending_rows_come_in_order(spark):
    items = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z"), ("d", 4, "w"), ("e", 5, "v")], "item_id string, ordinal long, fingerprint string")
    stored = spark.createDataFrame([("a", "x"), ("b", "old"), ("gone", "x"), ("d", "w"), ("d", "old"), ("d", "w")], "item_id string, fingerprint string")
    got = state.current_and_pending(items, stored).orderBy("ordinal").collect()
    assert [r.state for r in got] == ["current", "stale", "missing", "current", "missing"]
    assert [r.item_id for r in sorted((r for r in got if r.place is not None), key=lambda r: r.place)] == ["c", "e", "b"]
    assert state.with_current_fingerprint(stored, items).count() == 3


def test_names_signatures_and_pairs(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, " "), (1, 2, "b"), (2, 1, None)], "c int, n int, file_name string")
    assert [tuple(r) for r in state.last_name(rows, ["c"], "n").collect()] == [(1, "b")]
    up = spark.createDataFrame([(1, "p", "x"), (1, "p", "x"), (2, "p", None), (3, "p", "x")], "c int, page string, kind string")
    then = spark.createDataFrame([(1, "p", "x"), (2, "p", None), (3, "p", "x"), (4, "p", "x")], "c int, page string, kind string")
    assert {r.c: r.resumable for r in state.same_checks(up, then, ["c"], ["page", "kind"]).collect()} == {1: False, 2: True, 3: True, 4: False}
    texts = spark.createDataFrame([(1, "0001.txt"), (1, "0002.txt")], "case_id int, file_name string")
    images = spark.createDataFrame([(1, "0001.png", 9), (2, "0002.png", 5)], "case_id int, file_name string, n_bytes int")
    assert sorted((r.file_name, r.image_bytes) for r in state.paired_images(texts, images).collect()) == [("0001.txt", 9), ("0002.txt", 0)]
    groups, members = spark.createDataFrame([(1, 2), (2, 1), (3, 0), (4, None)], "group_id int, declared long"), spark.createDataFrame([(1,), (1,), (2,), (2,)], "group_id int")
    assert sorted(tuple(r) for r in state.declared_counts(groups, members).collect()) == [(2, 1, 2), (4, None, 0)]
    starts = spark.createDataFrame([("w", 1, 5), ("w", 2, 4), ("w", 3, 5), ("v", 1, 1)], "g string, o int, s int")
    assert [(r.g, r.o) for r in state.out_of_order(starts, ["g"], "o", "s").collect()] == [("w", 2)]


def test_small_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    for path, inside in (("a/b", True), ("./a", True), ("a/../b", True), ("..", False), ("a/../../b", False), ("/etc", False), (" ", False), (None, False)):
        assert value(state.inside_root(F.lit(path).cast("string"))) is inside, path
    for payload, flags in (('{"a": 3, "b": 0}', ["x:3"]), ('{"a": true, "b": 2}', ["y:2"]), ('{"a": "3"}', []), ('{"a": -1, "b": 1.5}', []), ("no json", []), (None, [])):
        assert value(state.count_flags(F.lit(payload).cast("string"), {"a": "x", "b": "y"})) == flags, payload
    assert value(state.longest(F.array(F.lit("ab"), F.lit("cd"), F.lit("e")))) == "ab" and value(state.longest(F.array().cast("array<string>"))) is None
    assert tuple(value(state.capped(F.array(*map(F.lit, range(5))), 3))) == ([0, 1, 2], 2)
    assert value(state.log_text(F.lit("a\x00 b\n\nc\n"))) == "a b c" and value(state.log_text(F.lit("a\nb\r\n"), True)) == "a\nb"
    row = F.create_map(F.lit("a"), F.lit(" "), F.lit("b"), F.lit("p12-13"))
    assert value(state.boundary_page(row, "a", "b")) == 12 and value(state.boundary_page(row, "x")) == 0
