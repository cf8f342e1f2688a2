"""Further named queries: page text, quotation places, participants, digests, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import gutters, html_text, ranges_text, replies, text
from pagewright.operators import digests, layout, participants, search
from pagewright.plans import registry
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


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html_text.html_to_text(F.col("html")).alias("text")).select("page_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


BARS, EDGE = "│┃║", text.BORDERS
MARGIN_SQL = "trim(l, chr(32) || chr(9) || chr(12) || chr(13))"
for _pattern, _by in text.MARGINS:
    if "(?=" not in _pattern:
        MARGIN_SQL = f"regexp_replace({MARGIN_SQL}, '{_pattern}', '{_by}', 'g')"
    else:  # the pattern looks ahead, which this dialect can't: the letter is kept instead
        MARGIN_SQL = f"""regexp_replace({MARGIN_SQL}, '^\\s*\\d{{1,2}}\\s+([A-Za-z("''])', '\\1')"""


@query(f"""with l as (select doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '(\\r\\n|\\n)$', ''), '\\r\\n|\\n'), lambda l: trim(l, chr(32) || chr(9) || chr(12) || chr(13))), lambda l: not regexp_matches(l, '^[{EDGE}\\s]*[{EDGE}][{EDGE}\\s]*$')) as l from documents)
    select doc_id, sha256(array_to_string(list_transform(l, lambda l: trim({MARGIN_SQL})), chr(10))) as text_sha256 from l""")
def margin_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(text.strip_margins(F.col("text")), 256).alias("text_sha256"))


@query("""select item_id as quote_id, doc_id as page_id, cast(instr(d.text, trim(b.text)) - 1 as int) as "start", cast(instr(d.text, trim(b.text)) - 1 + length(trim(b.text)) as int) as "end", false as ambiguous
    from benchmark b join documents d on contains(d.text, b.text)""")
def quote_locate_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each quotation stands on the pages that hold it."""
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    pages = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return search.quote_hits(quotes, pages, "placed")


@query("""with h as (select item_id, doc_id from benchmark b join documents d on contains(d.text, b.text))
    select b.item_id as quote_id, case when bool_or(h.doc_id = b.item_id) then b.item_id else min(h.doc_id) end as page_id, count(h.doc_id) > 0 as verified from benchmark b left join h on h.item_id = b.item_id group by b.item_id""")
def quote_best_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reported page of each quotation if it holds it, else the first that does."""
    quotes = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), "text")
    hits = search.quote_hits(quotes, read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text"), "placed")
    return search.best_page(hits, quotes.select("quote_id", F.col("quote_id").alias("page_id")))


#: Every text's letters in rows of 60, 28 rows a page, the last page filled up.
ROWS_SQL = r"""
    w as (select doc_id, regexp_replace(coalesce(text, ''), '[^\p{L}]+', ' ', 'g') as t from documents),
    r as (select doc_id, regexp_extract_all(t || repeat('and so on and so forth ', 74), '.{60}') as rows, greatest(1, (length(t) + 1679) // 1680) as n from w),
    pages as (select doc_id, p + 1 as page_no, list_transform(rows[p * 28 + 1:p * 28 + 28], lambda x: ltrim(x, ' ')) as rows from (select *, unnest(range(n)) as p from r))
"""


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, page): the texts as transcript pages with one of four kinds of printed line numbers."""
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " ")
    n = F.greatest(F.lit(1), F.ceil(F.length("t") / 1680)).cast("int")
    docs = read(spark, sf_dir, "documents").select("doc_id", letters.alias("t"))
    docs = docs.select("doc_id", F.regexp_extract_all(F.concat("t", F.repeat(F.lit("and so on and so forth "), 74)), F.lit(".{60}"), F.lit(0)).alias("rows"), n.alias("n"))
    pages = docs.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("doc_id", (F.col("p") + 1).alias("page_no"), F.slice("rows", F.col("p") * 28 + 1, 28).alias("rows"))
    no = lambda i: F.lpad((i + 1).cast("string"), 2, " ")
    lines = lambda f: F.array_join(F.transform("rows", f), "\n")
    kinds = [
        lines(lambda x, i: F.concat(no(i), F.lit(" | "), x)), lines(lambda x, i: F.concat(no(i), F.lit("  "), x)), lines(lambda x, i: F.concat(no(i), F.lit("\n"), x)),
        F.concat(F.lit("page "), F.array_join(F.transform("rows", lambda x, i: F.concat(no(i), F.lit(" "), x)), " ")),
    ]
    kind = F.pmod("doc_id", F.lit(4))
    return pages.select("doc_id", "page_no", F.when(kind == 0, kinds[0]).when(kind == 1, kinds[1]).when(kind == 2, kinds[2]).otherwise(kinds[3]).alias("page"))


@query(rf"""with {ROWS_SQL}
    select doc_id, cast(page_no as int) as page_no, case doc_id % 4 when 0 then 'barred' when 1 then 'bare' when 2 then 'detached' else 'flattened' end as form,
        sha256(case when doc_id % 4 = 3 then 'page ' || case when len(rows) > 0 then ' ' else '' end || array_to_string(list_transform(rows, lambda x, i: if(i > 1 and i < 10, ' ', '') || x), ' ') else array_to_string(rows, chr(10)) end) as text_sha256,
        true as same_place
    from pages""")
def gutter_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript pages read back without their line numbers, and whether a place of each leads to the same character on the page."""
    out = numbered_pages(spark, sf_dir).withColumn("g", gutters.projection(F.col("page")))
    place = F.least(F.lit(1000), F.length("g.text") - 1)
    same = F.substring("g.text", place + 1, F.lit(1)) == F.substring("page", gutters.source_offset(place, F.col("g.removed")) + 1, F.lit(1))
    return out.select("doc_id", "page_no", "g.form", F.sha2("g.text", 256).alias("text_sha256"), same.alias("same_place"))


@query(rf"""with {ROWS_SQL}, q as (select doc_id, page_no, rows, rows[5] || ' ' || rows[6] as phrase from pages where page_no = 1 and doc_id % 100 = 0)
    select distinct q.doc_id as quote_id, p.doc_id * 100000 + p.page_no as page_id from q join pages p on contains(regexp_replace(array_to_string(p.rows, ' '), '\s+', ' ', 'g'), regexp_replace(trim(q.phrase), '\s+', ' ', 'g'))""")
def quote_search_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that run over a line of every hundredth text's first page, found on transcript pages whose numbers stand between their words."""
    pages = numbered_pages(spark, sf_dir).select((F.col("doc_id") * 100_000 + F.col("page_no")).alias("page_id"), F.col("page").alias("text"))
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " ")
    rows = F.regexp_extract_all(F.concat(letters, F.repeat(F.lit("and so on and so forth "), 74)), F.lit(".{60}"), F.lit(0))
    quotes = read(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("quote_id"), F.concat_ws(" ", F.get(rows, F.lit(4)), F.get(rows, F.lit(5))).alias("text"))
    found = search.quote_hits(quotes, pages.select("page_id", "text"), "phrase", whole_words=False, transcripts=True)
    # Pairs grow with the square of the texts; only ids that repeat can repeat a pair.
    repeated = read(spark, sf_dir, "documents").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return found.distinct() if repeated else found


def hearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hearing per conversation with a participant per turn; some lack evidence, ids repeat by role."""
    evidence = F.when(F.col("turn") % 4 == 3, F.array().cast("array<int>")).otherwise(F.array(F.col("turn").cast("int")))
    person = F.struct(F.col("role").alias("id"), F.concat_ws(" ", "role", "turn").alias("name"), F.when(F.col("turn") % 2 == 0, "witness").otherwise("counsel").alias("role"), evidence.alias("evidence"))
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", person.alias("p")))).alias("t"))
    return turns.select(F.col("conv_id").alias("case_id"), F.lit(1).alias("hearing_id"), F.lit(None).cast("string").alias("status"), F.col("t.p").alias("participants"))


@query("""with k as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as i from conversations where turn % 4 <> 3),
    f as (select *, row_number() over (partition by conv_id, role order by turn) as nth from k), g as (select conv_id, count(*) as n, string_agg(case when nth = 1 then role else 'p' || i end, ',' order by i) as ids, bool_or(nth > 1) as bad from f group by 1),
    c as (select conv_id, bool_or(turn % 4 = 3) as dropped from conversations group by 1)
    select c.conv_id as case_id, 1 as hearing_id, case when coalesce(n, 0) = 0 then 'none' else 'identified' end as status, cast(coalesce(n, 0) as int) as n_participants, coalesce(ids, '') as ids,
    array_to_string(list_filter(['defaulted_status', case when dropped then 'dropped_participant' end, case when bad then 'repaired_id' end], lambda x: x is not null), ',') as codes from c left join g using (conv_id)""")
def participant_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = participants.repair(hearings(spark, sf_dir))
    return fixed.select("case_id", "hearing_id", "status", F.size("participants").alias("n_participants"), F.array_join("participants.id", ",").alias("ids"), F.array_join("codes", ",").alias("codes"))


@query("""select conv_id as case_id, 1 as hearing_id, 'status' as rule from conversations group by conv_id union all
    select conv_id, 1, 'support' from conversations group by conv_id having bool_or(turn % 4 = 3) union all
    select conv_id, 1, 'unique_id' from conversations group by conv_id having count(distinct role) < count(*)""")
def participant_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participants.issues(hearings(spark, sf_dir))


@query("select conv_id as doc_id, cast(turn as int) as ordinal, role as label, case when turn % 5 = 4 then null else text end as digest from conversations")
def digest_markdown_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest rows as Markdown and read back unchanged; null digests stay null."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ordinal"), F.col("role").alias("label"), F.when(F.col("turn") % 5 != 4, F.col("text")).alias("digest"))
    return digests.from_markdown(digests.to_markdown(rows))


@query("""select c.conv_id as item_id, replace('He said "{{quote:0}}", then {{quote:1}}, not {{quote:x}}.', '{{quote:0}}', a.text) as t0, b.text as t1 from (select distinct conv_id from conversations) c
    join conversations a on a.conv_id = c.conv_id and a.turn = 0 join conversations b on b.conv_id = c.conv_id and b.turn = 1""".replace("as t0, b.text as t1", "as half, b.text as second")
    .replace("select c.conv_id", "select item_id, replace(half, '{{quote:1}}', second) as text, 2 as n_used from (select c.conv_id", 1) + ")")
def summary_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of a section replaced by the item's quotations; unknown ones stay."""
    turns = read(spark, sf_dir, "conversations")
    quotes = turns.select(F.col("conv_id").alias("item_id"), F.col("turn").cast("string").alias("quote_id"), F.col("text").alias("quote"))
    both = turns.where("turn in (0, 1)").groupBy("conv_id").agg(F.count("*").alias("n")).where("n = 2")
    sections = both.select(F.col("conv_id").alias("item_id"), F.lit('He said "{{quote:0}}", then {{quote:1}}, not {{quote:x}}.').alias("text"))
    return digests.with_quotes(sections, quotes)


ORDER_LAYOUTS = """layouts as (select o_orderkey as case_id, case o_orderkey % 4 when 0 then 'rt_only' when 1 then 'ct_only' when 2 then 'split' else 'other' end as mode,
    case when o_orderkey % 4 = 2 then cast(o_custkey % 5 as int) end as rt_end, case when o_orderkey % 4 = 2 then cast(o_custkey % 5 + 1 + (case when o_custkey % 7 = 0 then 1 else 0 end) as int) end as ct_start, 5 as n_pages from orders)"""


def order_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, split = F.col("o_orderkey") % 4, (F.col("o_custkey") % 5).cast("int")
    mode = F.when(key == 0, "rt_only").when(key == 1, "ct_only").when(key == 2, "split").otherwise("other")
    start = split + 1 + F.when(F.col("o_custkey") % 7 == 0, 1).otherwise(0)
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), mode.alias("mode"), F.when(key == 2, split).alias("rt_end"), F.when(key == 2, start).alias("ct_start"), F.lit(5).alias("n_pages"))


@query(f"""with {ORDER_LAYOUTS} select case_id, 'mode' as rule from layouts where mode = 'other' union all
    select case_id, 'bounds' from layouts where mode = 'split' and not (rt_end >= 1 and ct_start <= n_pages) union all
    select case_id, 'adjacent' from layouts where mode = 'split' and ct_start <> rt_end + 1""")
def layout_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.layout_issues(order_layouts(spark, sf_dir))


@query(f"""with {registry.LAST}, {ORDER_LAYOUTS} select p.case_id, page, case mode when 'rt_only' then 'RT' when 'ct_only' then 'CT' when 'split' then case when page <= rt_end then 'RT' else 'CT' end end as side
    from pages p left join layouts l on l.case_id = p.case_id""")
def layout_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sides(classified_pages(spark, sf_dir).select("case_id", "page"), order_layouts(spark, sf_dir))


@query("""with h as (select source, doc_id, sha256(printf('%06d.txt', doc_id) || ':' || octet_length(encode(text))) as h from documents),
    a as (select source, doc_id // 1000 as k, sha256(string_agg(doc_id || ':' || h, ',' order by doc_id)) as h from h group by all), b as (select source, k // 1000 as k, sha256(string_agg(k || ':' || h, ',' order by k)) as h from a group by 1, 2)
    select source as case_id, sha256(string_agg(k || ':' || h, ',' order by k)) as layout_signature from b group by source""")
def layout_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").alias("page"), F.format_string("%06d.txt", "doc_id").alias("file_name"), F.octet_length("text").alias("n_bytes"))
    return layout.layout_signature(pages)


@query("""select o_orderkey, least(o_orderkey % 97, o_custkey % 89) || case when o_orderkey % 97 = o_custkey % 89 then '' else '-' || greatest(o_orderkey % 97, o_custkey % 89) end || ', 7' as ranges from orders""")
def range_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat((F.col("o_orderkey") % 97).cast("string"), F.lit(" - "), (F.col("o_custkey") % 89).cast("string"), F.lit(", 7, x"))
    return read(spark, sf_dir, "orders").select("o_orderkey", ranges_text.range_text(ranges_text.range_list(raw)).alias("ranges"))


@query("""with w as (select item_id, text, string_split(text, ' ') as w from benchmark)
    select item_id, true as whole, regexp_matches(text, '(^|[^\\pL\\pN\\pM])' || regexp_escape(substr(w[2], 1, greatest(1, length(w[2]) - 1))) || '($|[^\\pL\\pN\\pM])') as part from w""")
def quote_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a word and a cut word are whole-word selections of a quotation."""
    words = F.split("text", " ")
    cut = F.substring(words[1], F.lit(1), F.greatest(F.lit(1), F.length(words[1]) - 1))
    rows = read(spark, sf_dir, "benchmark")
    whole = ranges_text.whole_words_of(F.concat_ws(" ", words[1], words[2]), F.col("text"))
    return rows.select("item_id", whole.alias("whole"), ranges_text.whole_words_of(cut, F.col("text")).alias("part"))


@query("""select event_id, case event_type when 'click' then 'report' when 'view' then 'motion' when 'signup' then 'minute order' else null end as page_type,
    case when event_id % 3 = 0 then 'yes' when event_id % 3 = 1 then 'no' end as first_page, strftime(ts, '%B %-d, %Y') as date,
    array_to_string(list_filter([case when event_type not in ('click', 'view', 'signup') then 'page_type' end, case when event_id % 3 = 2 then 'first_page' end], lambda x: x is not null), ',') as errors from events""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier answers wrapped in talk, found, read and normalised."""
    kind = F.when(F.col("event_type") == "click", "REPORT").when(F.col("event_type") == "view", " Motion").when(F.col("event_type") == "signup", "minute_order").otherwise("what?")
    flag = F.element_at(F.array(F.lit("Y"), F.lit("false"), F.lit("maybe")), (F.col("event_id") % 3 + 1).cast("int"))
    said = F.concat(F.lit("Sure: "), F.to_json(F.struct(kind.alias("Page-Type"), flag.alias("first_page"), F.date_format("ts", "M/d/yyyy").alias("Date"))), F.lit(" ok"))
    row = F.from_json(replies.json_payload(said), "map<string,string>")
    answer = replies.normal_answer(text.field(row, "page_type"), text.field(row, "first_page"), text.field(row, "date"), ["report", "motion", "minute order"])
    found = read(spark, sf_dir, "events").select("event_id", answer.alias("a"))
    return found.select("event_id", "a.page_type", "a.first_page", "a.date", F.array_join("a.errors", ",").alias("errors"))


@query("""select c_custkey, 'Case_' || c_custkey || case when c_custkey % 2 = 0 then '_/_of_' else '_of_' end || replace(c_mktsegment, ' ', '_') as case_name, case when c_custkey % 2 = 0 then 'characters' else '' end as issues,
    upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as role from customer""")
def case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" Case  "), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, " / of ").otherwise("  of "), F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", replies.case_name(raw).alias("case_name"), F.array_join(replies.case_name_issues(raw), ",").alias("issues"), replies.role_label(F.lower("c_mktsegment")).alias("role"))
