"""Named queries of the engine's own operators over the driver's tables, and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.functions import dates, locate, text
from pagewright.functions.batches import bounded_batches
from pagewright.operators import dedupe, intervals, ranges, reconcile, search
from pagewright.operators.stages import written_once
from pagewright.sources.tables import WRITTEN, classified_pages, event_pages, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "report_boundaries"

LAST = f"""last as (select * from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {", ".join(f"{c} desc" for c in WRITTEN)}) as rn from lineitem) where rn = 1),
pages as (select l_orderkey as case_id, l_linenumber as page, l_partkey as part, l_partkey % 3 <> 0 as named,
    case when l_returnflag = 'R' and l_linestatus = 'F' then 'report_first' when l_returnflag = 'R' then 'report'
         when l_returnflag = 'A' and l_linestatus = 'F' then 'motion_first' when l_returnflag = 'A' then 'motion' else 'other' end as page_type from last)"""
REPORTS = f"""{LAST}, rr as (select *, lag(page) over (partition by case_id order by page) as pp from pages where page_type in ('report', 'report_first')),
rg as (select *, sum(case when pp is null or page <> pp + 1 or page_type = 'report_first' then 1 else 0 end) over (partition by case_id order by page) as r from rr),
reports as (select case_id, cast(min(page) as int) as start_page, cast(max(page) as int) as end_page, count(*) as n_pages, arg_min(page_type, page) = 'report_first' as start_detected from rg group by case_id, r)"""
EVENTS = """numbered as (select *, row_number() over (partition by user_id order by ts, event_id) as rn from events),
pages as (select user_id as case_id, cast(rn + floor(rn / 7) as int) as page,
    case when event_type = 'signup' then 'minute_start' when event_type in ('click', 'view') then 'minute_body' else 'other' end as page_type from numbered)"""
MOTIONS = f"""{LAST}, mr as (select *, page - row_number() over (partition by case_id order by page) as run from pages where page_type in ('motion', 'motion_first')),
ml as (select *, min(case when page_type = 'motion_first' and named then page end) over (partition by case_id, run) as lead_page from mr),
mi as (select *, coalesce(page >= lead_page, false) as inside from ml),
mc as (select *, sum(case when inside and page_type = 'motion_first' then 1 else 0 end) over (partition by case_id, run order by page) as component from mi),
papers as (select case_id, lead_page, component, cast(min(page) as int) as start_page, cast(max(page) as int) as end_page from mc where inside group by all)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def minute_sql(where: str = "true") -> str:
    return f"""with {EVENTS}, m as (select *, sum(case when page_type = 'minute_start' then 1 else 0 end) over (partition by case_id order by page) as r from pages where page_type <> 'other' and {where}),
    k as (select *, page - min(page) over w - row_number() over (partition by case_id, r order by page) + 1 as ahead from m where r > 0 window w as (partition by case_id, r))
    select case_id, min(page) as start_page, max(page) as end_page, count(*) as n_pages from k where ahead = 0 group by case_id, r"""


@query(f"with {LAST} select case_id, page, page_type, part from pages")
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified_pages(spark, sf_dir).select("case_id", "page", "page_type", "part")


@query(f"""with {REPORTS} select r.case_id, start_page, end_page, printf('report:%04d', start_page) as report_id, strftime(o_orderdate, '%B %-d, %Y') || ' - ' || o_orderpriority as label
    from reports r left join orders o on o_orderkey = r.case_id where start_detected""")
def report_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranges.report_ranges(classified_pages(spark, sf_dir)).where("start_detected")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("d"), "o_orderpriority")
    label = text.report_label(F.col("o_orderpriority"), F.col("d"))
    return found.join(orders, "case_id", "left").select("case_id", "start_page", "end_page", text.report_id(F.col("start_page")).alias("report_id"), label.alias("label"))


@query(f"with {REPORTS} select * from reports")
def report_ranges_modern_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.report_ranges(classified_pages(spark, sf_dir))


@query(minute_sql())
def minute_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.started_ranges(event_pages(spark, sf_dir))


@query(minute_sql("page <= 40"))
def hearing_ranges_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Started ranges on the first side of a split at page 40."""
    return ranges.started_ranges(event_pages(spark, sf_dir), last_page=40)


@query(f"""with {MOTIONS} select case_id, printf('motion:%04d', start_page) as paper_id, lead_page as packet_page,
    case when component = 1 then 'lead' else 'continuation' end as role, start_page, end_page from papers""")
def motion_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.motion_packets(classified_pages(spark, sf_dir))


@query(f"with {MOTIONS} select case_id, cast(min(page) as int) as start_page, cast(max(page) as int) as end_page, count(*) as n_pages from mc where not inside group by case_id, run")
def motion_omitted_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.omitted_fragments(classified_pages(spark, sf_dir))


@query(f"""with {MOTIONS}, {REPORTS[len(LAST) + 2:]}
    select case_id, 'report' as kind, start_page, end_page from reports where start_detected
    union all select case_id, 'motion', lead_page, max(end_page) from papers group by case_id, lead_page""")
def selected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.selected_documents(classified_pages(spark, sf_dir))


@query(f"with {REPORTS} select case_id, start_page, end_page, unnest(range(start_page, end_page + 1)) as page from reports")
def interval_page_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.expand(ranges.report_ranges(classified_pages(spark, sf_dir)))
    return found.select("case_id", "start_page", "end_page", F.col("page").cast("long").alias("page"))


@query(f"""with {REPORTS} select p.case_id, p.page, r.start_page, r.end_page from pages p
    left join reports r on r.case_id = p.case_id and p.page between r.start_page and r.end_page""")
def page_to_interval_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = written_once(classified_pages(spark, sf_dir, by_case=True).select("case_id", "page", "page_type"))
    return intervals.containing(pages, ranges.report_ranges(pages))


SPANS = f"""{LAST}, spans as (select case_id, cast(min(page) as int) as start_page, cast(max(page) as int) as end_page from pages where page_type <> 'other' group by case_id)"""


@query(f"""with {SPANS} select s.case_id, start_page, end_page, count(p.page) as n_available, count(p.page) = end_page - start_page + 1 as complete
    from spans s left join pages p on p.case_id = s.case_id and p.page between start_page and end_page group by s.case_id, start_page, end_page""")
def interval_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = classified_pages(spark, sf_dir)
    spans = pages.where("page_type <> 'other'").groupBy("case_id").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    return intervals.completeness(spans, pages)


ORDER_SPANS = """spans as (select o_custkey as case_id, o_orderkey as id, cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as int) as "start",
    cast(date_diff('day', date '1990-01-01', cast(o_orderdate as date)) as int) + cast(o_orderkey % 60 as int) as "end" from orders)"""


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("id"), day.alias("start"), (day + (F.col("o_orderkey") % 60).cast("int")).alias("end")
    )


@query(f"""with {ORDER_SPANS}, m as (select *, max("end") over (partition by case_id order by "start", "end", id rows between unbounded preceding and 1 preceding) as earlier_end from spans)
    select case_id, count(*) as n_overlapping from m where "start" <= earlier_end group by case_id""")
def interval_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlaps(order_spans(spark, sf_dir)).groupBy("case_id").agg(F.count("*").alias("n_overlapping"))


@query(f"""with {ORDER_SPANS}, m as (select *, max("end") over (partition by case_id order by "start", "end" rows between unbounded preceding and 1 preceding) as b from spans),
    i as (select *, sum(case when b is null or "start" > b + 1 then 1 else 0 end) over (partition by case_id order by "start", "end") as island from m)
    select case_id, min("start") as "start", max("end") as "end", count(*) as n_parts from i group by case_id, island""")
def interval_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(order_spans(spark, sf_dir))


@query("""select conv_id as case_id, turn as page, role, lag(turn) over w = turn - 1 as after_previous, coalesce(lag(role) over w = role and lag(turn) over w = turn - 1, false) as same_as_previous,
    case when lead(turn) over w = turn + 1 then lead(role) over w end as next_role from conversations window w as (partition by conv_id order by turn)""")
def neighbour_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with hints from its neighbours, counted only if their numbers are adjacent."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations")
    after = F.lag("turn").over(w) == F.col("turn") - 1
    return turns.select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("page"), "role", after.alias("after_previous"),
        F.coalesce((F.lag("role").over(w) == F.col("role")) & after, F.lit(False)).alias("same_as_previous"),
        F.when(F.lead("turn").over(w) == F.col("turn") + 1, F.lead("role").over(w)).alias("next_role"),
    )


@query(f"""with {LAST}, c as (select case_id, page, 1 as tier, nullif(page_type, 'other') as category from pages
        union all select l_orderkey, l_linenumber, 2, case l_returnflag when 'R' then 'report' when 'A' then 'motion' end from lineitem
        union all select l_orderkey, l_linenumber, 3, 'other' from lineitem),
    b as (select *, min(tier) over (partition by case_id, page) as best from c where category is not null)
    select case_id, page, case when min(category) = max(category) then min(category) end as category, case when min(category) = max(category) then 'classified' else 'conflict' end as status
    from b where tier = best group by case_id, page""")
def category_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("page"), "l_returnflag")
    own = classified_pages(spark, sf_dir).select("case_id", "page", F.lit(1).alias("tier"), F.nullif("page_type", F.lit("other")).alias("category"))
    flag = F.when(F.col("l_returnflag") == "R", "report").when(F.col("l_returnflag") == "A", "motion")
    more = lines.select("case_id", "page", F.lit(2).alias("tier"), flag.alias("category")).unionAll(lines.select("case_id", "page", F.lit(3).alias("tier"), F.lit("other").alias("category")))
    return reconcile.resolve_categories(own.unionAll(more), ["case_id", "page"])


@query("""with s as (select doc_id as item_id, 'quality' as category, cast(quality as varchar) as value from labels union all select doc_id, 'toxic', cast(toxic as varchar) from labels),
    f as (select item_id, category, min(value) as value from s group by all)
    select d.doc_id as item_id, c.ordinal, c.category, f.value from documents d cross join (values (0, 'quality'), (1, 'toxic'), (2, 'language')) c(ordinal, category)
    left join f on f.item_id = d.doc_id and f.category = c.category""")
def catalog_left_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels")
    parts = [labels.select(F.col("doc_id").alias("item_id"), F.lit(c).alias("category"), F.col(c).cast("string").alias("value"), F.col(c).cast("string").alias("seq")) for c in ("quality", "toxic")]
    items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    return reconcile.filled_catalog(items, ["quality", "toxic", "language"], parts[0].unionAll(parts[1]))


@query(f"""with {LAST} select case_id, page, case when p_partkey is null then 'unknown rule' when p_size % 2 = 0 then p_brand else coalesce(nullif(p_type, ''), p_brand) end as name,
    case when p_partkey is null then 'unknown' when p_size % 2 = 0 then 'fixed' else 'source_title' end as mode from pages left join part on p_partkey = part where page_type in ('report_first', 'motion_first')""")
def naming_rule_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of first pages by rule: a fixed rule gives its own name, a source-title rule the title, else the rule's name."""
    rules = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_brand", "p_type", (F.col("p_size") % 2 == 0).alias("fixed"))
    first = classified_pages(spark, sf_dir).where(F.col("page_type").isin("report_first", "motion_first")).join(rules, "part", "left")
    name = F.when(F.col("fixed").isNull(), "unknown rule").when(F.col("fixed"), F.col("p_brand")).otherwise(F.coalesce(F.nullif("p_type", F.lit("")), "p_brand"))
    mode = F.when(F.col("fixed").isNull(), "unknown").when(F.col("fixed"), "fixed").otherwise("source_title")
    return first.select("case_id", "page", name.alias("name"), mode.alias("mode"))


@query("""with e as (select o_orderkey as case_id, unnest(range(1, 5)) as page from orders), f as (select l_orderkey as case_id, l_linenumber as page, count(*) as n from lineitem group by all)
    select coalesce(e.case_id, f.case_id) as case_id, cast(coalesce(e.page, f.page) as int) as page, case when e.page is null then 'unexpected' when n is null then 'missing' else 'repeated' end as status
    from e full join f on e.case_id = f.case_id and e.page = f.page where e.page is null or n is null or n > 1""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 1 to 4 are expected of every order; which lines are missing, unexpected or repeated."""
    expected = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page"))
    found = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("page"))
    return dedupe.coverage(expected, found, ["case_id", "page"])


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.not_done(read(spark, sf_dir, "documents").select("doc_id", "source"), read(spark, sf_dir, "labels"), ["doc_id"])


@query("""with a as (select doc_id as item_id, n_chars % 10 as m from documents), b as (select doc_id as item_id, (quality * 5 + doc_id) % 10 as m from labels)
    select coalesce(a.item_id, b.item_id) as item_id, case when b.item_id is null then 'missing' when a.item_id is null then 'orphan' when a.m = b.m then 'current' else 'stale' end as status
    from a full join b on a.item_id = b.item_id""")
def freshness_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), reconcile.fingerprint(F.col("n_chars") % 10).alias("fingerprint"))
    mark = reconcile.fingerprint((F.col("quality") * 5 + F.col("doc_id")) % 10)
    return reconcile.freshness(items, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), mark.alias("fingerprint")))


@query(f"""with {LAST}, x as (select *, case when part % 5 = 0 then 'yes' when part % 5 = 1 then 'no' end as flag from pages where page_type like 'report%'),
    y as (select *, bool_or(flag is not null) over (partition by case_id) as modern from x)
    select case_id, page, modern, modern and flag is null as violation from y""")
def first_page_check_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """If any row of a case has an explicit first-page flag, every row must have one."""
    rows = classified_pages(spark, sf_dir).where(F.col("page_type").startswith("report"))
    flag = F.when(F.col("part") % 5 == 0, "yes").when(F.col("part") % 5 == 1, "no")
    rows = rows.withColumn("flag", flag).withColumn("modern", F.max(F.col("flag").isNotNull()).over(Window.partitionBy("case_id")))
    return rows.select("case_id", "page", "modern", (F.col("modern") & F.col("flag").isNull()).alias("violation"))


@query("select l_orderkey, l_linenumber, count(*) as n_rows from lineitem group by all having count(*) > 1")
def duplicate_page_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.duplicates(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("""select o_custkey as section, o_orderkey as line, chr(9) || strftime(o_orderdate, '%B %-d, %Y') || ' ' || o_orderkey as toc_line from (
    select *, row_number() over (partition by o_custkey, cast(o_orderdate as date) order by o_orderkey) as rn from orders) where rn = 1""")
def toc_first_per_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents lines of each section, the first of each date only; lines without a date would all stay."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("section"), F.col("o_orderkey").alias("line"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("label"))
    day = dates.recognized(F.col("label"))
    rn = F.row_number().over(Window.partitionBy("section", day).orderBy("line"))
    return orders.withColumn("rn", rn).where((F.col("rn") == 1) | day.isNull()).select("section", "line", text.toc_line(F.col("label"), F.col("line")).alias("toc_line"))


@query("""select o_orderkey, case when o_orderkey % 6 = 5 then null else cast(o_orderdate as date) end as day,
    case when o_orderkey % 6 = 5 then 'soon' else strftime(o_orderdate, '%B %-d, %Y') end as label from orders""")
def date_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in six ways, one of them no date, and read back."""
    d = F.col("o_orderdate")
    written = [F.date_format(d, f) for f in ("MMMM d, yyyy", "MMM d, yyyy", "M/d/yyyy", "yyyy-MM-dd")]
    written.append(F.concat(F.date_format(d, "EEEE"), F.lit(",  "), F.date_format(d, "MMMM  d, yyyy")))
    raw = F.element_at(F.array(*written, F.lit("soon")), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", dates.recognized(raw).alias("day"), dates.long_date(raw).alias("label"))


@query(f"""with {LAST} select case_id, page, case when part % 2 = 0 then 'CT ' || page when part % 3 = 0 then 'RT ' || page else 'file page ' || page end as label,
    case when part % 2 = 0 then 'CT:' || page when part % 3 = 0 then 'RT:' || page else '' end as key from pages""")
def citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical labels and keys of pages; those without a citation are shown by file page."""
    prefix = F.when(F.col("part") % 2 == 0, "CT").when(F.col("part") % 3 == 0, "RT").otherwise("")
    raw = F.when(prefix != "", F.concat(prefix, F.lit("  p.  "), F.col("page").cast("string")))
    label = F.coalesce(text.citation_label(F.nullif(raw, F.lit(""))), F.lit(""))
    rows = classified_pages(spark, sf_dir)
    return rows.select("case_id", "page", F.when(label == "", F.concat(F.lit("file page "), F.col("page").cast("string"))).otherwise(label).alias("label"), text.citation_key(prefix, F.col("page")).alias("key"))


@query("""select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by cast(regexp_extract(c_name, '(\\d+)', 1) as bigint)) as natural_rank from customer""")
def natural_sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(text.natural_key(F.col("c_name")), "c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", rank.cast("long").alias("natural_rank"))


@query("""select event_id, coalesce(json_extract_string(props, '$.k'), '') as value from events""")
def key_normalised_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON properties by a name that differs in case and punctuation."""
    row = F.from_json("props", "map<string,string>")
    return read(spark, sf_dir, "events").select("event_id", text.field(row, "K_", "K").alias("value"))


@query("""select doc_id, sha256(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]', '', 'g')) as clean_sha256,
    octet_length(encode(text)) // 4 as least_tokens, octet_length(encode(text)) // 3 as most_tokens from documents""")
def control_char_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = text.token_range(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.without_controls(F.col("text")), 256).alias("clean_sha256"), low.alias("least_tokens"), high.alias("most_tokens"))


@query("select item_id as quote_id, doc_id as page_id from benchmark b join documents d on contains(d.text, b.text) where trim(b.text) <> ''")
def quote_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return search.quote_hits(quotes, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"))


@query("""select item_id as quote_id, doc_id as page_id from benchmark b join documents d
    on contains(regexp_replace(lower(translate(d.text, '’‘“”–—‑', '''''""---')), '\\s+', ' ', 'g'), trim(regexp_replace(lower(translate(b.text, '’‘“”–—‑', '''''""---')), '\\s+', ' ', 'g')))""")
def quote_search_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return search.quote_hits(quotes, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"), "relaxed")


#: For the SQL of phrase search, over texts without characters that NFKC changes: what characters are searched as, and what parts two words.
SEARCHED_SQL = "translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '’‘“”–—' || chr(160) || '·•|', '''''\"\"--    ')"
JOINED_SQL = r"'[''\"]*(?:[ \t]+|[ \t]*\n[ \t]*|[ \t]*\n[ \t]*\n[ \t]*)(?:\d{1,8}[ \t]*)?[''\"]*'".replace(r"\"", '"')
LETTER_SQL = """case when x[i] = '-' then '-(?:[ ]*\\n[ ]*)?' when x[i] in ('''', '"') then '[''"]' else regexp_escape(x[i]) end
    || case when regexp_matches(x[i], '[\\pL\\pN]') and regexp_matches(x[i + 1], '[\\pL\\pN]') then '[ ]*' else '' end"""


@query(f"""with w as (select item_id, list_filter(string_split_regex(trim({SEARCHED_SQL}), '\\s+'), lambda x: x <> '') as w from benchmark where trim(text) <> ''),
    p as (select item_id, '(?is)' || array_to_string(list_transform(w, lambda x: array_to_string(list_transform(range(1, length(x) + 1), lambda i: {LETTER_SQL}), '')), {JOINED_SQL}) as p from w),
    d as (select doc_id, {SEARCHED_SQL} as t from documents) select item_id as quote_id, doc_id as page_id from p join d on regexp_matches(d.t, p.p)""")
def quote_search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    return search.quote_hits(quotes, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"), "phrase", whole_words=False)


#: Texts as locate.normalised has them, where no character needs NFKC and white space is ASCII.
NORMAL = "trim(regexp_replace(regexp_replace(text, '-\\s+', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""with r as (select role, {NORMAL} as norm, turn from conversations), g as (select role, norm, list_sort(list(distinct turn)) as t from r group by all)
    select role, norm, array_to_string(t, ',') as ordinals from g where len(t) > 1""")
def recurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bounded_batches(read(spark, sf_dir, "conversations")).select("role", locate.normalised(F.col("text")).alias("norm"), "turn")
    return reconcile.recurrence(rows, ["role", "norm"], "turn").select("role", "norm", F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ",").alias("ordinals"))


@query(f"""select conv_id, turn, role, text is null or min(turn) over (partition by conv_id, role, {NORMAL}) < turn as carried from conversations""")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bounded_batches(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", locate.normalised(F.col("text")).alias("norm"))
    return reconcile.carried_forward(rows, ["conv_id", "role", "norm"], "turn").select("conv_id", "turn", "role", "carried")


@query("""with w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') as w from documents),
    s as (select doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 13), lambda i: array_to_string(w[i:i + 14], ' ')))) as s from w where len(w) >= 15),
    o as (select s, min(doc_id) as first from s group by s) select doc_id, count(*) as n_repeated from s join o using (s) where first < doc_id group by doc_id""")
def shingle_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seq"), "text")
    return search.repeated_shingles(docs, "doc_id", "seq", "text", 15)


@query(f"""select item_id, array_to_string(list_filter([case when len(string_split({NORMAL}, ' ')) not between 6 and 12 then 'length' end,
    case when regexp_matches(text, '\\.\\s*\\.\\s*\\.|…') then 'ellipsis' end, case when regexp_matches(text, '[.!?][”"]?\\s*$') then 'terminal' end], lambda x: x is not null), ',') as flags from benchmark""")
def quote_convention_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = text.quote_flags(F.col("text"), locate.normalised(F.col("text")))
    return bounded_batches(read(spark, sf_dir, "benchmark")).select("item_id", F.array_join(flags, ",").alias("flags"))


@query("""with h as (select source, doc_id, sha256(coalesce(text, '')) as h from documents),
    a as (select source, doc_id // 1000 as k, sha256(string_agg(doc_id || ':' || h, ',' order by doc_id)) as h from h group by all), b as (select source, k // 1000 as k, sha256(string_agg(k || ':' || h, ',' order by k)) as h from a group by 1, 2)
    select source, sha256(string_agg(k || ':' || h, ',' order by k)) as content_sha256 from b group by source""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.ordered_hash(read(spark, sf_dir, "documents"), ["source"], "doc_id", "text")


@query("""select source, count(*) as n_items, count(l.doc_id) as n_rows, count_if(quality = 1) as n_current, count_if(toxic = 1) as n_flagged, max(n_chars) as largest
    from documents d left join labels l using (doc_id) group by source""")
def digest_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    rows = docs.join(read(spark, sf_dir, "labels").withColumn("there", F.lit(1)), "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count("*").alias("n_items"), F.count("there").alias("n_rows"), F.count_if(F.col("quality") == 1).alias("n_current"), F.count_if(F.col("toxic") == 1).alias("n_flagged"), F.max("n_chars").alias("largest")
    )


@query("""select conv_id, turn, case when count(*) over (partition by conv_id, lower(role)) = 1 then upper(left(role, 1)) || lower(substr(role, 2)) else role || ' ' || turn end as label from conversations""")
def role_multiplicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role that occurs once in a conversation is shown by its title, others by role and number."""
    n = F.count("*").over(Window.partitionBy("conv_id", F.lower("role")))
    label = F.when(n == 1, F.initcap("role")).otherwise(F.concat_ws(" ", "role", F.col("turn").cast("string")))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", label.alias("label"))


@query("""with n as (select source, doc_id, (row_number() over (partition by source order by doc_id) - 1) // 80 as block from documents)
    select source, block, min(doc_id) as first_doc, max(doc_id) as last_doc, count(*) as n_rows from n group by all""")
def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 80 rows of each source."""
    rows = reconcile.numbered(read(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id")
    rows = rows.select("source", "doc_id", F.floor((F.col("number") - 1) / 80).alias("block"))
    return rows.groupBy("source", "block").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_rows"))


@query("""with h as (select doc_id, lower(text) as head from documents), a as (select *, row_number() over (partition by head order by doc_id) as nth, count(*) over (partition by head) as n from h where doc_id % 2 = 0),
    b as (select *, row_number() over (partition by head order by doc_id) as nth, count(*) over (partition by head) as n from h where doc_id % 2 = 1)
    select a.doc_id as heading, b.doc_id as line from a join b on a.head = b.head and a.nth = b.nth and a.n = b.n""")
def heading_nth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th heading of a label meets the n-th line of that label, if both sides have as many."""
    w = Window.partitionBy("head")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("head"))
    a, b = (rows.where(F.col("doc_id") % 2 == k).withColumn("nth", F.row_number().over(w.orderBy("doc_id"))).withColumn("n", F.count("*").over(w)) for k in (0, 1))
    return a.withColumnRenamed("doc_id", "heading").join(b.withColumnRenamed("doc_id", "line"), ["head", "nth", "n"]).select("heading", "line")


@query("""select doc_id, octet_length(encode(text)) // 3 as most_tokens, case when octet_length(encode(text)) // 3 > 4096 then 'fail' when octet_length(encode(text)) // 3 > 3276 then 'warn' else 'ok' end as decision from documents""")
def token_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text fits a context of 4096 tokens; beyond 80 % it is a warning."""
    n = text.token_range(F.col("text"))[1]
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("most_tokens"), F.when(n > 4096, "fail").when(n > 3276, "warn").otherwise("ok").alias("decision"))


@query("""select conv_id, sha256(string_agg('## ' || role || chr(10) || text, chr(10) || chr(10) order by turn)) as summary_sha256, count(*) as n_parts from conversations group by conv_id""")
def summary_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of each conversation in order as one text."""
    part = F.struct("turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("text")).alias("s"))
    parts = F.sort_array(F.collect_list(part))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(parts.alias("p"), F.count("*").alias("n_parts"))
    return rows.select("conv_id", F.sha2(F.array_join("p.s", "\n\n"), 256).alias("summary_sha256"), "n_parts")


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents)
    select doc_id, cast(n as int) as line_no, cast(sum(length(line) + 1) over (partition by doc_id order by n) - length(line) - 1 as bigint) as "start", cast(sum(length(line) + 1) over (partition by doc_id order by n) - 1 as bigint) as "end" from l""")
def range_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The character range of each line of each text, by cumulative length."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("i"))
    return lines.select("doc_id", (F.col("i") + 1).alias("line_no"), (upto - F.length("line") - 1).alias("start"), (upto - 1).alias("end"))
