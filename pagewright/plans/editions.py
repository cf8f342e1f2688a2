"""Named queries over printed editions, transcripts and generated sections of the given texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import alignment, contents
from pagewright.operators.stages import written_once
from pagewright.sources.tables import classified_pages, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


PAGE = 1500  # code points of a printed page
EDGES = r"[\s\p{Z}\p{Cc}\p{Cf}]+"
LINE_ENDS = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def printed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sources, pages): each text with quotations and links marked line by line, and what it prints as, cut into pages regardless of lines."""
    clean = F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), LINE_ENDS, " "), '"“”[]', "")
    filled = lambda x: F.trim(x) != ""
    at = lambda i: F.concat(F.lit("page "), i.cast("string"))
    marked = lambda x, i: F.when((i % 4 == 1) & x.rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]"), F.concat(F.lit('"'), x, F.lit('"'))).when(i % 4 == 2, F.concat(F.lit("see ["), at(i), F.lit("](page:"), i.cast("string"), F.lit(") "), x)).otherwise(x)
    shown = lambda x, i: F.when(i % 4 == 2, F.concat(F.lit("see "), at(i), F.lit(" "), x)).otherwise(x)
    docs = read(spark, sf_dir, "documents").select("doc_id", F.split(clean, "\n").alias("l"))
    sources = docs.select("doc_id", F.array_join(F.transform("l", marked), "\n").alias("text"))
    body = F.array_join(F.filter(F.transform("l", shown), filled), " ")
    pages = docs.select("doc_id", F.posexplode(F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))).alias("i", "text"))
    return sources, pages.select("doc_id", (F.col("i") + 1).alias("page_no"), "text")


#: (doc_id, i, p, s, e): each printed line, numbered from 0, with its place in the printed text; pl adds a row a page: its part there.
PRINTED_SQL = r"""
    l as (
        select doc_id, i - 1 as i, l[i] as x from (
            select doc_id, l, unnest(range(1, len(l) + 1)) as i from (
                select doc_id, string_split(translate(regexp_replace(coalesce(text, ''), '[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', ' ', 'g'), '"“”[]', ''), chr(10)) as l from documents
            )
        )
    ), p as (
        select doc_id, i, x, p, cast(sum(length(p) + 1) over w - length(p) - 1 as bigint) as s, cast(sum(length(p) + 1) over w - 1 as bigint) as e from (
            select doc_id, i, x, case when i % 4 = 2 then 'see page ' || i || ' ' || x else x end as p from l
        ) where trim(p) <> '' window w as (partition by doc_id order by i)
    ), pl as (
        select *, substr(p, greatest(page * 1500, s) - s + 1, least(page * 1500 + 1500, e) - greatest(page * 1500, s)) as part from (
            select *, unnest(range(s // 1500, (e - 1) // 1500 + 1)) as page from p
        )
    )
"""


@query(rf"""with {PRINTED_SQL}, c as (
        select doc_id, page, i, lag(i) over (partition by doc_id, page order by i) as before, regexp_replace(regexp_replace(part, '^[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+', ''), '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+$', '') as part
        from pl where regexp_matches(part, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]')
    )
    select doc_id, cast(page + 1 as bigint) as page_no, cast(min(i) + 1 as int) as first_line, cast(max(i) + 1 as int) as last_line, true as equal,
        sha256(string_agg(case when before is null then '' when before = i - 1 then chr(10) else chr(10) || chr(10) end || part, '' order by i)) as restored_sha256
    from c group by all""")
def edition_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source lines that each printed page shows, whether it shows them whole and in order, and its text with the lines restored."""
    found = alignment.align(*printed(spark, sf_dir)).where("first_line > 0")
    trimmed = F.regexp_replace("restored", f"^{EDGES}|{EDGES}$", "")
    return found.select("doc_id", "page_no", "first_line", "last_line", "equal", F.sha2(trimmed, 256).alias("restored_sha256"))


@query(rf"""with {PRINTED_SQL}, q as (
        select doc_id, page + 1 as page_no, part, x as phrase, s, e, page, row_number() over (partition by doc_id, page order by i) as nth,
            greatest(page * 1500, s) - page * 1500 as off,
            length(part) - length(regexp_replace(part, '^[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+', '')) as cut_front,
            length(part) - length(regexp_replace(part, '[\s\p{{Z}}\p{{Cc}}\p{{Cf}}]+$', '')) as cut_back
        from pl where i % 4 = 1 and regexp_matches(part, '[^\s\p{{Z}}\p{{Cc}}\p{{Cf}}]')
    ), spans as (select *, cast(off + cut_front as int) as "start", cast(off + length(part) - cut_back as int) as "end" from q)
    select doc_id, cast(page_no as bigint) as page_no, case (doc_id + page_no) % 3 when 0 then 'missing' when 1 then 'shifted' else 'extra' end as rule,
        sha256(case when (doc_id + page_no) % 3 = 2 then 'not there' else phrase end) as phrase_sha256, case when (doc_id + page_no) % 3 < 2 then "start" end as "start",
        case when (doc_id + page_no) % 3 < 2 then "end" end as "end", cast(case (doc_id + page_no) % 3 when 1 then "start" + 1 when 2 then 0 end as int) as declared_start,
        cast(case (doc_id + page_no) % 3 when 1 then "end" + 1 when 2 then 1 end as int) as declared_end
    from spans where nth = 1 and "end" > "start" """)
def edition_quote_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation spans by the alignment against declared ones, of which the first of each page was left out, shifted or joined by one too many."""
    sources, pages = printed(spark, sf_dir)
    spans = written_once(alignment.align(sources, pages).select("doc_id", "page_no", F.posexplode("spans").alias("nth", "s")).select("doc_id", "page_no", "nth", "s.*"))
    kind = (F.col("doc_id") + F.col("page_no")) % 3
    moved = F.when((F.col("nth") == 0) & (kind == 1), 1).otherwise(0)
    kept = spans.where(~((F.col("nth") == 0) & (kind == 0)))
    declared = kept.select("doc_id", "page_no", (F.col("start") + moved).alias("start"), (F.col("end") + moved).alias("end"), "label", "phrase")
    extra = spans.where((F.col("nth") == 0) & (kind == 2)).select("doc_id", "page_no", F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("?").alias("label"), F.lit("not there").alias("phrase"))
    found = alignment.span_issues(spans, declared.unionAll(extra))
    return found.withColumn("phrase_sha256", F.sha2("phrase", 256)).drop("phrase")


@query("""with l as (
        select o_custkey as toc, o_orderkey as line, case o_orderpriority when '1-URGENT' then 'MINUTE ORDERS' when '5-LOW' then 'HEARINGS' when '4-NOT SPECIFIED' then '' end as head,
            case when o_orderkey % 9 = 8 then 'Date unresolved' else strftime(date_trunc('year', o_orderdate), '%B %-d, %Y') end as said, o_orderstatus = 'P' as flat, date_trunc('year', o_orderdate) as day from orders
    ), s as (
        select *, last_value(nullif(head, '') ignore nulls) over w as heading, cast(count(*) filter (head = 'MINUTE ORDERS') over w as bigint) as nth
        from l window w as (partition by toc order by line rows unbounded preceding)
    ), e as (select *, head is null and not flat and heading = 'MINUTE ORDERS' and said <> 'Date unresolved' as counted from s)
    select toc, line, heading, nth, case when counted then row_number() over (partition by toc, nth, counted, day order by line) > 1 else false end as removed from (select toc, line, heading, nth, coalesce(counted, false) as counted, day from e)""")
def toc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as lines of a table of contents with headings, blank lines and entries: sections and repeated dates."""
    o = read(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderkey") % 9 == 8, "Date unresolved").otherwise(F.date_format(F.date_trunc("year", "o_orderdate"), "MMMM d, yyyy"))
    entry = F.concat(F.when(F.col("o_orderstatus") == "P", "").otherwise("\t"), date, F.lit(" "), F.format_string("%04d", F.col("o_orderkey") % 10_000))
    priority = F.col("o_orderpriority")
    line = F.when(priority == "1-URGENT", "MINUTE ORDERS").when(priority == "5-LOW", " HEARINGS ").when(priority == "4-NOT SPECIFIED", "").otherwise(entry)
    lines = o.select(F.col("o_custkey").alias("toc"), F.col("o_orderkey").alias("line"), line.alias("text"))
    return contents.corrected(lines, "toc", "line", "text").select("toc", "line", "heading", "nth", "removed")


@query("""with last as (
        select * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc, l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc) = 1
    ), p as (
        select l_orderkey as case_id, l_linenumber as page, l_returnflag = 'R' as report, l_returnflag = 'R' and l_linestatus = 'F' as first, l_partkey % 3 <> 0 as named from last
    ), r as (select *, report and not coalesce(lag(case when report then page end) over (partition by case_id order by page) = page - 1, false) as run from p)
    select case_id, page, named and first as listed, (run and not first) or (first and not named) as unresolved from r where report and ((named and first) or (run and not first) or (first and not named))""")
def toc_report_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report pages of each case that have an entry in its contents, and the starts that lack a name or a first page."""
    return contents.report_entries(classified_pages(spark, sf_dir))
