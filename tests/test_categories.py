"""Page categories against a plain statement of the rules on random tables, with and without agreement."""

import random

import pytest

from pagewright.operators import categories

PAGE = "case_id long, page int, page_type string, record_type string, citation_series_id string, series_id string, sequence_id string"
SERIES = "case_id long, ordinal int, series_id string, sequence_id string, record_type string"
TYPES = [" RT_body ", "ct_report_first_page", "ct_motion", "CT_index", "cover", "", None, "ct_minute_order"]
OF = {"rt_body": "hearing", "ct_report_first_page": "report", "ct_motion": "motion", "ct_minute_order": "minute_order", "ct_index": "unknown", "cover": "unknown"}


@pytest.mark.parametrize("agreement, block", [(False, 4096), (True, 5)])
def test_against_plain_rules(spark, monkeypatch, agreement, block):
    monkeypatch.setattr(categories, "BLOCK", block)
    r = random.Random(7)
    ids = ["s1", "s2", "", None]
    series = [(1, n, r.choice(["s1", "s2", None]), r.choice(["s1", "s2"]), r.choice(["rt", "CT", "", None])) for n in range(6)]
    tiers = [[(1, r.randrange(0, 45), r.choice(TYPES), r.choice([None, "", "RT ", "ct", "x"]), *r.choices(ids, k=3)) for _ in range(n)] for n in (25, 20)]
    ranges = [(1, 5, 9, "report"), (1, 12, 12, "report"), (1, 8, 14, "motion"), (1, 30, 29, "hearing"), (1, 33, 60, "hearing")]
    listed = [(1, r.randrange(1, 45), r.choice(["Hearings", " FORMS", "Procedural filings ", "Index", None])) for _ in range(25)]
    last = {}
    for _, _, a, b, rec in series:
        last[a or b or ""] = rec
    want = []
    for page in range(1, 41):
        types, names = [set(), set()], set()
        for tier, rows in enumerate(tiers):
            for _, p, t, rec, a, b, c in rows:
                if p != page:
                    continue
                token = (t or "").strip().lower()
                for raw in (rec, last.get(a or b or c or ""), token.split("_")[0]):
                    if (raw or "").strip().upper() in ("RT", "CT"):
                        names.add(raw.strip().upper())
                if token:
                    types[tier].add(OF[token])
        sources = [*types, {c for _, s, e, c in ranges if s <= page <= e}]
        at = next((i for i, s in enumerate(sources) if s), None)
        found, said = (sources[at], ("transcript", "source_map", "boundary")[at]) if at is not None else (set(), "none")
        if agreement:
            found = set().union(*sources)
        heads = {categories.HEADINGS.get((t or "").strip().lower()) for _, p, t in listed if p == page} - {None}
        if said == "none" and len(names) < 2 and heads:
            found, said = heads, "toc"
        one = next(iter(found)) if len(found) == 1 else "unknown"
        must = "RT" if one == "hearing" else "CT" if one != "unknown" else None
        clash = len(found) > 1 or len(names) > 1 or bool(must and names and must not in names)
        want.append((page, "unknown" if clash else one, said, "conflict" if clash else "classified" if one != "unknown" else "unknown", next(iter(names)) if len(names) == 1 else ""))
    from pyspark.sql import functions as F

    s = spark.createDataFrame(series, SERIES)
    typed = None
    for tier, rows in enumerate(tiers):
        part = categories.with_series(spark.createDataFrame(rows, PAGE), s).withColumn("tier", F.lit(tier))
        typed = part if typed is None else typed.unionAll(part)
    pages = spark.createDataFrame([(1, p) for p in [*range(0, 41), 3, 3]], "case_id long, page int")
    cols = spark.createDataFrame(ranges, "case_id long, start_page int, end_page int, category string"), spark.createDataFrame(listed, "case_id long, page int, title string")
    got = categories.page_categories(pages, typed, *cols, agreement=agreement)
    assert sorted(map(tuple, got.drop("case_id").collect())) == want
    assert categories.page_categories(pages.limit(0), typed, *cols).count() == 0
    assert {t[3] for t in want} == {"conflict", "classified", "unknown"} and len({t[2] for t in want}) > 3


def test_headings(spark):
    df = spark.createDataFrame([("Forms",), (" procedural FILINGS",), ("Minute Orders",), ("Index",), (None,)], "t string")
    got = df.select(categories.display_heading(df.t), categories.heading_rank(df.t)).collect()
    assert list(map(tuple, got)) == [("PROC. FILINGS", 0), ("PROC. FILINGS", 0), ("Minute Orders", 4), ("Index", 5), (None, 5)]


def test_ranges_may_come_from_a_union_of_rows_dealt_by_case(spark):
    from pyspark.sql import functions as F

    from pagewright.operators import ranges
    from pagewright.operators.stages import written_once

    conf = {"spark.sql.shuffle.partitions": "20", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        pages = spark.range(5000).select((F.col("id") % 500).alias("case_id"), (F.col("id") / 500 + 1).cast("int").alias("page"))
        pages = written_once(pages.withColumn("page_type", F.when(F.col("page") == 1, "report_first").when(F.col("page") < 4, "report").otherwise("other")))
        found = ranges.report_ranges(pages)
        spans = found.select("case_id", "start_page", "end_page", F.lit("report").alias("category")).unionAll(found.select("case_id", F.col("start_page") + 2, F.col("end_page") + 1, F.lit("motion")))
        none = spark.createDataFrame([], "case_id long, page int, tier int, category string, ids array<string>")
        listed = pages.where("page = 4").select("case_id", "page", F.lit("Forms").alias("title"))
        rows = categories.page_categories(pages, none, spans, listed).groupBy("page", "category", "provenance", "status").count().collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    want = [(1, "report", "boundary", "classified"), (2, "report", "boundary", "classified"), (3, "unknown", "boundary", "conflict"), (4, "motion", "boundary", "classified")]
    assert sorted(map(tuple, rows)) == [(*w, 500) for w in want + [(p, "unknown", "none", "unknown") for p in range(5, 11)]]
