"""Named queries of boundaries, work items and digest rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.operators import boundaries, digests, ranges
from pagewright.operators.stages import written_once
from pagewright.plans import registry
from pagewright.sources.tables import classified_pages, expected_pages, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TYPES = ("report_first", "report", "motion_first", "motion", "minute_start", "minute_body", "hearing_start", "hearing_body", "form_first", "other")
RECORD = f"""{registry.LAST}, rec as (select case_id, page, part % 3 <> 0 as named, case part % 10 {" ".join(f"when {i} then '{t}'" for i, t in enumerate(TYPES))} end as page_type from pages)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def record_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, page, page_type, named) with all kinds of pages."""
    return record_kinds(classified_pages(spark, sf_dir))


def record_kinds(pages: DataFrame) -> DataFrame:
    """Classified pages as those of a record, with all kinds."""
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("part") % len(TYPES) + 1).cast("int"))
    return pages.select("case_id", "page", kind.alias("page_type"), "named")


def islands(name: str, types: str, first: str | None) -> str:
    """Ranges of pages of these types: cut at gaps and, if given, at first pages."""
    cut = f"or page_type = '{first}'" if first else ""
    return f"""{name}0 as (select *, lag(page) over (partition by case_id order by page) as pp from rec where page_type in ({types})),
    {name}1 as (select *, sum(case when pp is null or page <> pp + 1 {cut} then 1 else 0 end) over (partition by case_id order by page) as r from {name}0),
    {name} as (select case_id, cast(min(page) as int) as start_page, cast(max(page) as int) as end_page, count(*) as n_pages, arg_min(page_type, page) as opens, arg_min(named, page) as named from {name}1 group by case_id, r)"""


def started(name: str, start: str, body: str) -> str:
    return f"""{name}0 as (select *, sum(case when page_type = '{start}' then 1 else 0 end) over (partition by case_id order by page) as r from rec where page_type in ('{start}', '{body}')),
    {name}1 as (select *, page - min(page) over (partition by case_id, r) - row_number() over (partition by case_id, r order by page) + 1 as ahead from {name}0 where r > 0),
    {name} as (select case_id, cast(min(page) as int) as start_page, cast(max(page) as int) as end_page from {name}1 where ahead = 0 group by case_id, r)"""


@query(f"with {RECORD}, {islands('h', repr('report_first') + ', ' + repr('report'), None)} select case_id, start_page, end_page, n_pages, true as start_detected from h")
def report_ranges_historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.report_ranges(record_pages(spark, sf_dir), modern=False)


@query(f"with {RECORD}, {islands('m', repr('motion_first') + ', ' + repr('motion'), 'motion_first')} select case_id, start_page, end_page, n_pages from m where opens = 'motion_first' and named")
def motion_boundaries_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.motion_boundaries(record_pages(spark, sf_dir))


ALL_KINDS = f"""{RECORD}, {islands('rep', repr('report_first') + ', ' + repr('report'), 'report_first')}, {islands('mot', repr('motion_first') + ', ' + repr('motion'), 'motion_first')},
    {started('minu', 'minute_start', 'minute_body')}, {started('hear', 'hearing_start', 'hearing_body')},
    docs as (select case_id, 'report' as kind, start_page, end_page from rep where opens = 'report_first' and named union all select case_id, 'motion', start_page, end_page from mot where opens = 'motion_first' and named
    union all select case_id, 'minute_order', start_page, end_page from minu union all select case_id, 'hearing', start_page, end_page from hear
    union all select case_id, 'form', page, page from rec where page_type = 'form_first' and named)"""


@query(f"with {ALL_KINDS} select * from docs")
def selected_documents_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.all_documents(record_pages(spark, sf_dir))


@query(f"""with {ALL_KINDS}, s as (select d.case_id, kind, start_page, case when start_page % 4 = 0 then '' else strftime(o_orderdate, '%Y') end as date from docs d left join orders on o_orderkey = d.case_id where kind in ('hearing', 'minute_order'))
    select *, coalesce(lag(kind) over w = kind and lag(date) over w = date and date <> '', false) as same_date_as_previous from s window w as (partition by case_id order by start_page, kind)""")
def same_date_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of hearings and minute orders whose date is that of the start before them; here every fourth page has no date."""
    found = ranges.all_documents(record_pages(spark, sf_dir)).where("kind in ('hearing', 'minute_order')")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.date_format("o_orderdate", "yyyy").alias("d"))
    date = F.when(F.col("start_page") % 4 == 0, "").otherwise(F.col("d"))
    return ranges.same_date_starts(found.join(orders, "case_id", "left").select("case_id", "kind", "start_page", date.alias("date")))


ENTRIES = """entries as (select o_custkey as case_id, o_orderkey as entry_id, case when o_orderkey % 11 = 0 then 'page' else (o_orderkey % 997 * 7) || '.txt' end as "start",
    cast(o_orderkey % 997 * 7 + o_orderkey % 9 - 2 as varchar) as "end", case when o_orderkey % 5 = 0 then 'soon' else strftime(o_orderdate, '%B %-d, %Y') end as date from orders),
    n as (select *, case when o."start" <> 'page' and cast(replace(o."start", '.txt', '') as int) >= 1 then cast(replace(o."start", '.txt', '') as int) end as s, case when cast("end" as int) >= 1 then cast("end" as int) end as e from entries o),
    i as (select case_id, entry_id, date, s, e, max(case when s <= e then e end) over (partition by case_id order by s nulls first, e nulls first, entry_id rows between unbounded preceding and 1 preceding) as earlier from n),
    issues as (select case_id, entry_id, case when s is null or e is null then 'malformed' when s > e then 'reversed' when s <= earlier then 'overlap' end as rule from i)"""


def saved_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved boundaries made from orders: some are malformed, reversed, overlapping or without a date."""
    key = F.col("o_orderkey")
    at = key % 997 * 7
    start = F.when(key % 11 == 0, "page").otherwise(F.concat(at.cast("string"), F.lit(".txt")))
    date = F.when(key % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), key.alias("entry_id"), start.alias("start"), (at + key % 9 - 2).cast("string").alias("end"), date.alias("date"))


@query(f"with {ENTRIES} select * from issues where rule is not null")
def boundary_structure_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.structure_issues(saved_entries(spark, sf_dir))


@query(f"""with {ENTRIES}, bad as (select distinct case_id from issues where rule is not null)
    select e.entry_id, case when b.case_id is not null then 'refused' when date <> 'soon' then 'kept' else 'omitted' end as status from entries e left join bad b using (case_id)""")
def minute_boundary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.dated_boundaries(saved_entries(spark, sf_dir)).select("entry_id", "status")


@query(f"""with {RECORD}, {started('minu', 'minute_start', 'minute_body')}, o as (select *, row_number() over (partition by case_id order by start_page, end_page) - 1 as rn from minu)
    select case_id, cast(rn // 2 as int) as batch, string_agg(case when start_page = end_page then printf('%04d', start_page) else printf('%04d-%04d', start_page, end_page) end, ', ' order by start_page, end_page) as ranges from o group by case_id, rn // 2""")
def omission_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute ranges as text, here two a line."""
    return boundaries.omission_lines(ranges.started_ranges(record_pages(spark, sf_dir)), 2)


@query(f"""with {ALL_KINDS}, f as (select case_id, kind, start_page, case when start_page % 3 = 0 then ' ' else 'May 1, 2020' end as date, case when start_page % 4 = 0 then '' else 'n' end as name, case when start_page % 5 = 0 then 'unresolved' end as st from docs where kind <> 'form'),
    g as (select case_id, kind, start_page, case when kind = 'hearing' and date = ' ' then 'undated' when kind in ('report', 'motion') and name = '' then 'unnamed' when kind in ('report', 'motion') and st = 'unresolved' then 'unresolved'
    when kind = 'minute_order' and date = ' ' then 'unrecognized_date' end as reason from f) select *, reason is null as keep from g""")
def boundary_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which boundaries are kept for later steps, and why others aren't."""
    at = F.col("start_page")
    rows = ranges.all_documents(record_pages(spark, sf_dir)).where("kind <> 'form'")
    rows = rows.select("case_id", "kind", "start_page", F.when(at % 3 == 0, " ").otherwise("May 1, 2020").alias("date"), F.when(at % 4 == 0, "").otherwise("n").alias("name"), F.when(at % 5 == 0, "unresolved").alias("naming_status"))
    return boundaries.retained(rows).select("case_id", "kind", "start_page", "reason", "keep")


@query(f"""with {RECORD}, {started('hear', 'hearing_start', 'hearing_body')}, items as (select *, row_number() over (partition by case_id order by start_page, end_page) as ordinal, max(end_page) over (partition by case_id order by start_page, end_page rows between unbounded preceding and 1 preceding) as b from hear),
    people as (select case_id, start_page, end_page, count(*) as n, any_value(start_page + 1) as n_people from (select * from hear where start_page % 3 > 0 union all select * from hear where start_page % 3 = 1 union all select case_id, start_page, end_page + 50 from hear where start_page = 2) group by all)
    select coalesce(i.case_id, p.case_id) as case_id, cast(ordinal as int) as ordinal, coalesce(i.start_page, p.start_page) as start_page, coalesce(i.end_page, p.end_page) as end_page, cast(n_people as int) as n_people,
    case when ordinal is null then 'orphan' when i.start_page <= b then 'overlap' when n is null then 'unmatched' when n > 1 then 'repeated' end as issue from items i full join people p on p.case_id = i.case_id and p.start_page = i.start_page and p.end_page = i.end_page""")
def hearing_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hearings with the participant records of just their pages; some records are missing, repeated or belong to no hearing."""
    # The ranges are used four times: written once, they are not made again in the task that joins them.
    found = written_once(ranges.started_ranges(record_pages(spark, sf_dir), "hearing_start", "hearing_body").select("case_id", "start_page", "end_page"))
    odd = found.where("start_page = 2").withColumn("end_page", F.col("end_page") + 50)
    people = found.where("start_page % 3 > 0").unionAll(found.where("start_page % 3 = 1")).unionAll(odd)
    return boundaries.work_items(found, people.withColumn("n_people", (F.col("start_page") + 1).cast("int")))


@query("""select conv_id || ':' || turn as item_id, unnest(list_filter([case when role = 'system' then 'kind' end, case when turn % 6 = 5 then 'pages' end, case when turn % 7 = 3 then 'categories' end, case when turn % 3 = 1 then 'silent_evidence' end,
    case when turn % 5 = 2 then 'quote_id' end, case when turn % 6 = 5 or turn % 4 = 0 then 'quote_page' end], lambda x: x is not null)) as rule from conversations""")
def digest_row_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that digest rows made from turns break."""
    t = F.col("turn")
    quote = lambda n, page: F.struct(F.lit(n).alias("quote_id") if isinstance(n, str) else n.alias("quote_id"), F.lit("said").alias("text"), page.cast("int").alias("file_page"))
    facts = F.struct(F.lit("facts").alias("id"), F.when(t % 3 == 1, " ").otherwise("x").alias("text"), F.array(quote("q1", t + 1), quote(F.when(t % 5 == 2, "q1").otherwise("q2"), F.when(t % 4 == 0, t + 90).otherwise(t + 1))).alias("evidence"))
    rest = F.struct(F.when(t % 7 == 3, "facts").otherwise("rest").alias("id"), F.lit(None).cast("string").alias("text"), F.array().cast(facts_type()).alias("evidence"))
    rows = read(spark, sf_dir, "conversations").select(
        F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string")).alias("item_id"), F.when(F.col("role") == "user", "hearing").when(F.col("role") == "assistant", "report").otherwise("talk").alias("kind"),
        (t + 1).cast("int").alias("start_page"), F.when(t % 6 == 5, t - 1).otherwise(t + 2).cast("int").alias("end_page"), F.array(facts, rest).alias("categories"),
    )
    return digests.row_issues(rows, ["facts", "rest"])


def facts_type() -> str:
    return "array<struct<quote_id:string,text:string,file_page:int>>"


@query("""select doc_id, array_to_string(list_filter([case when doc_id % 3 = 0 then 'page_link' end, case when doc_id % 5 = 0 then 'hash_label' end, case when doc_id % 7 = 0 then 'placeholder' end], lambda x: x is not null), ',') as flags from documents""")
def narrative_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Technical marks put into texts, and found in them."""
    key = F.col("doc_id")
    marks = F.concat(F.when(key % 3 == 0, " [x](page:0012)").otherwise(""), F.when(key % 5 == 0, " input_sha256 ").otherwise(""), F.when(key % 7 == 0, " {{quote:a/1}}").otherwise(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), marks).alias("t"))
    return rows.select("doc_id", F.array_join(digests.metadata_flags(F.col("t")), ",").alias("flags"))


@query("""with t as (select o_custkey as case_id, cast(sum(o_orderkey % 3) as int) as n from orders group by 1) select case_id, cast(page as int) as page, printf('%04d.txt', page) as file_name from (select case_id, unnest(range(1, n + 1)) as page from t)""")
def expected_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page name that the inputs of a case should give."""
    return expected_pages(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 3).alias("n_pages")))


@query("""select event_id, case when event_id % 4 < 2 and event_id % 1000 > 0 then cast(event_id % 1000 as int) end as page, case event_id % 4 when 3 then '?' when 2 then 'x' || event_id else cast(event_id % 1000 as varchar) end as shown,
    'a' || chr(10) || 'b' as body from events""")
def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page numbers read strictly, texts within bounds, and Markdown without its image lines."""
    key = F.col("event_id")
    raw = F.when(key % 4 == 0, (key % 1000).cast("string")).when(key % 4 == 1, F.concat(F.lit(" "), (key % 1000).cast("string"), F.lit(" "))).when(key % 4 == 2, F.concat(F.lit("x"), key.cast("string"))).otherwise("\u0007")
    body = F.concat(F.lit("a\n  ![scan"), key.cast("string"), F.lit("](p.png) \nb"))
    return read(spark, sf_dir, "events").select("event_id", text.positive_page(raw).alias("page"), text.bounded_text(raw, 1024, "?").alias("shown"), text.without_images(body).alias("body"))


@query(f"""with {RECORD}, {started('minu', 'minute_start', 'minute_body')}, o as (select *, row_number() over (partition by case_id order by start_page, end_page) - 1 as rn from minu)
    select case_id, 0 as nth, count(*) || ' minute candidates omitted: minute_date_unresolved. Source pages remain available; missing dates do not prove misclassification.' as message from minu group by case_id
    union all select case_id, cast(rn // 2 as int) + 1, 'Omitted minute source-page ranges: ' || string_agg(case when start_page = end_page then printf('%04d', start_page) else printf('%04d-%04d', start_page, end_page) end, ', ' order by start_page, end_page) || '.' from o group by case_id, rn // 2""")
def omission_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said about minute ranges that are left out, with their number, here two a message."""
    return boundaries.omission_messages(ranges.started_ranges(record_pages(spark, sf_dir)), 2)
