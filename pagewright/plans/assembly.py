"""Named queries of submitted sections, motion groups and page categories, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.operators import categories, corrections, motion_groups, ranges, sections, stages
from pagewright.operators.stages import written_once
from pagewright.plans import boundaries, registry
from pagewright.sources.tables import classified_pages, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def sections_of_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Turns as digest rows and, by case and turn, every kind of submission: none, good, repeated, unknown and blank ones, old ones, wrong types."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = read(spark, sf_dir, "conversations").withColumn("x", F.coalesce("text", F.lit(""))).withColumn("f", F.first("x").over(w))
    t = F.col("turn")
    words = F.split(F.trim(F.regexp_replace("x", r"\s+", " ")), " ")
    quote = F.array_join(F.slice(words, 1, (t + 4).cast("int")), " ")
    facts = F.struct(F.lit("facts").alias("id"), F.when(t % 6 != 4, F.col("x")).alias("text"), F.array(F.struct(F.lit("q1").alias("quote_id"), quote.alias("text"), (t % 2 == 0).alias("verified"))).alias("evidence"))
    rows = turns.select(F.col("conv_id").alias("case_id"), t.cast("string").alias("item_id"), t.alias("ordinal"), F.when(F.col("role") == "assistant", "reports").otherwise("hearings").alias("kind"), F.array(facts).alias("categories"))

    def entry(*texts, **more):
        return F.to_json(F.struct(t.cast("string").alias("item_id"), F.array(*texts).alias("paragraphs"), *(m.alias(k) for k, m in more.items())))

    cut = F.array_join(F.slice(words, 1, 3), " ")
    good = entry(F.concat("x", F.lit(" [y](page:0012)")), F.lit("end {{quote:q1}}"), quote_selections=F.create_map(F.lit("q1"), cut), quote_capitalizations=F.create_map(F.lit("q1"), F.lower(cut)))
    odd = lambda raw: F.concat(F.lit('{"item_id": "'), t.cast("string"), F.lit(f'", "paragraphs": {raw}}}'))
    k = (F.col("conv_id") + t) % 8
    sent = (
        F.when(k == 1, good).when(k == 2, entry(F.lit('{{quote:q1}} "so" {{quote:q1}}'), "x")).when(k == 3, entry(F.lit("{{quote:zz}}"), "x")).when(k == 4, odd('" \\n"')).when(k == 5, entry("f", "f"))
        .when(k == 6, F.concat_ws(",", entry(F.lit("old")), entry(F.concat("x", F.lit(" input_sha256"))))).when(k == 7, odd('{"a": 1}'))
    )
    listed = F.array_join(F.sort_array(F.collect_list(F.when(sent.isNotNull(), F.struct(t, sent.alias("e")))))["e"], ",")
    payloads = turns.groupBy(F.col("conv_id").alias("case_id")).agg(listed.alias("list"))
    payload = F.when(F.col("case_id") % 10 == 9, "{}").when(F.col("case_id") % 4 == 0, F.concat(F.lit('[7,{"item_id":"zz"},'), "list", F.lit("]"))).otherwise(F.concat(F.lit("["), "list", F.lit("]")))
    return rows, payloads.select("case_id", payload.alias("payload"))


TURNS = r"""c as (select conv_id, turn, role, coalesce(text, '') as x, first_value(coalesce(text, '')) over (partition by conv_id order by turn) as f, turn % 6 = 4 as nothing, case when conv_id % 10 = 9 then 0 else (conv_id + turn) % 8 end as k,
    string_split_regex(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') as w from conversations),
    d as (select *, array_to_string(w[1:4 + turn], ' ') as q, array_to_string(w[1:3], ' ') as cut, case when nothing then [] when k = 1 then [x || ' y', 'end {{quote:q1}}'] when k = 2 then ['{{quote:q1}} "so" {{quote:q1}}', x] when k = 5 then [f, f] when k = 6 then [x || ' input_sha256'] else [x] end as raw from c),
    e as (select *, list_filter(list_transform(flatten(list_transform(raw, lambda r: string_split_regex(r, '\n\s*\n'))), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') as ps, not nothing and k in (1, 2) as quoted, len(string_split(q, ' ')) as n from d),
    pw as (select conv_id, turn, i, string_split(trim(regexp_replace(replace(replace(ps[i], '{{quote:q1}}', ' '), '- ', ''), '\s+', ' ', 'g')), ' ') as w from (select *, unnest(range(1, len(ps) + 1)) as i from e where role = 'assistant')),
    run as (select distinct conv_id, turn, i, array_to_string(w[j:j + 14], ' ') as s from (select *, unnest(range(1, len(w) - 13)) as j from pw)),
    own as (select conv_id, s, min(turn) as first from run group by 1, 2), again as (select conv_id, turn, count(distinct i) as times from run join own using (conv_id, s) where first < turn group by 1, 2)"""


@query(rf"""with {TURNS} select conv_id, turn, array_to_string(ps, chr(10)) as body, case when quoted and k = 1 and cut <> q then cut end as selection, case when quoted and k = 1 and lower(cut) <> cut then lower(cut) end as capital,
    array_to_string(list_sort(list_filter([case when k = 0 then 'fallback_section:' || turn end, case when k in (4, 7) and not nothing then 'empty_section_fallback:' || turn end, case when k = 4 then 'paragraph_string_kept:' || turn end,
    case when k = 7 then 'malformed_paragraphs_fallback:' || turn end, case when k = 3 or nothing and k in (1, 2) then 'unknown_placeholder:' || turn || ':1' end, case when k = 3 or nothing and k in (1, 2) then 'unknown_placeholder_fallback:' || turn end,
    case when nothing and k in (5, 6) then 'paragraphs_for_all_null_document:' || turn end, case when nothing and k = 1 then 'quote_selection_rejected:' || turn end, case when nothing and k = 1 then 'quote_capitalization_rejected:' || turn end,
    case when quoted and k = 2 then 'duplicate_quote_use:' || turn || ':q1' end, case when quoted and k = 2 then 'typed_quotation_marks:' || turn end, case when quoted and turn % 2 = 1 then 'unverified_quote_used:' || turn || ':q1' end,
    case when quoted and (n < 6 or n > 12) then 'quote_length_out_of_range:' || turn || ':q1:' || n end, case when quoted and regexp_matches(q, '[.!?]$') then 'quote_terminal_punctuation:' || turn || ':q1' end,
    case when not nothing and k = 6 then 'technical_metadata_in_narrative:' || turn || ':hash_label' end, case when times > 0 then 'repeated_passage:' || turn || ':' || times end], lambda v: v is not null)), ',') as flags
    from e left join again using (conv_id, turn)""")
def section_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section a turn, with what stands in for bad submissions, what its quotation shows, and all flags."""
    found, _ = sections.normalised_sections(*sections_of_turns(spark, sf_dir))
    return found.select(
        F.col("case_id").alias("conv_id"), F.col("ordinal").alias("turn"), F.array_join("paragraphs", "\n").alias("body"), F.element_at("selections", "q1").alias("selection"),
        F.element_at("capitals", "q1").alias("capital"), F.array_join("flags", ",").alias("flags"),
    )


@query("""select distinct conv_id, unnest(case when conv_id % 10 = 9 then ['candidate_unusable:all_fallback'] when conv_id % 4 = 0 then ['malformed_section_ignored:1', 'unknown_section_ignored:zz'] else [] end) as flag from conversations""")
def section_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the submissions of a case hold that belongs to none of its items."""
    return sections.remarks_of(*sections_of_turns(spark, sf_dir)).withColumnRenamed("case_id", "conv_id")


MOTION_PAPERS = rf"""{registry.MOTIONS}, p as (select case_id, printf('motion:%04d', start_page) as paper_id, lead_page as packet, start_page, end_page, 'Motion ' || start_page as title, case when start_page % 2 = 0 then '' else 'May ' || start_page end as date, 'filed' as basis, case_id % 16 as k from papers),
    inv as (select case_id, case when k = 3 and start_page % 2 = 1 then 'paper:' || start_page else paper_id end as paper_id, start_page, end_page, case when k = 1 and start_page = packet then '' when k = 13 then title || ' ' else title end as title, date, case when k = 2 then 'soon' else basis end as basis from p),
    m0 as (select *, row_number() over w - 1 as place, first_value(paper_id) over w as group_id from p window w as (partition by case_id, packet order by start_page)),
    mem as (select case_id, group_id, case when k = 8 then -place else place end as place, paper_id, case when k = 4 or place = 0 then 'lead' else 'continuation' end as role, start_page, end_page + case when k = 6 then 1 else 0 end as end_page from m0 where not (k = 5 and place = 1)
        union all select case_id, 'motion:9999', start_page, paper_id, 'lead', start_page, end_page from m0 where k = 7 and place = 0),
    g0 as (select case_id, paper_id as group_id, start_page + case when k = 10 then 1 else 0 end as anchor, title, case when k = 11 then date || '?' else date end as date, basis, k <> 9 as noted, k from m0 where place = 0 and k <> 12),
    grp as (select * from g0 union all select * from g0 where k = 14 union all select case_id, 'motion:0999', 999, 'x', '', 'filed', true, k from g0 where k = 15)"""


def motion_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(papers, inventory, groups, members) of motion packets; in fifteen of sixteen cases some rule is broken on purpose."""
    start, k = F.col("start_page"), F.col("case_id") % 16
    papers = written_once(ranges.motion_packets(classified_pages(spark, sf_dir, by_case=True)).select(  # what follows uses them many times
        "case_id", "packet_page", "paper_id", "start_page", "end_page", F.concat(F.lit("Motion "), start.cast("string")).alias("title"),
        F.when(start % 2 == 0, "").otherwise(F.concat(F.lit("May "), start.cast("string"))).alias("date"), F.lit("filed").alias("date_basis"),
    ))
    inventory = papers.select(
        "case_id", F.when((k == 3) & (start % 2 == 1), F.concat(F.lit("paper:"), start.cast("string"))).otherwise(F.col("paper_id")).alias("paper_id"), "start_page", "end_page",
        F.when((k == 1) & (start == F.col("packet_page")), "").when(k == 13, F.concat("title", F.lit(" "))).otherwise(F.col("title")).alias("title"), "date", F.when(k == 2, "soon").otherwise(F.col("date_basis")).alias("date_basis"),
    )
    groups, members = motion_groups.canonical(papers)
    twice = members.where((k == 7) & (F.col("place") == 0)).withColumn("group_id", F.lit("motion:9999")).withColumn("place", start)
    members = members.where(~((k == 5) & (F.col("place") == 1))).withColumn("place", F.when(k == 8, -F.col("place")).otherwise(F.col("place")))
    members = members.withColumn("role", F.when(k == 4, "lead").otherwise(F.col("role"))).withColumn("end_page", F.col("end_page") + (k == 6).cast("int")).unionByName(twice)
    groups = groups.where(k != 12).withColumn("anchor_page", F.col("anchor_page") + (k == 10).cast("int")).withColumn("note", F.when(k == 9, "x").otherwise(F.col("note")))
    groups = groups.withColumn("date", F.when(k == 11, F.concat("date", F.lit("?"))).otherwise(F.col("date")))
    made_up = groups.where(k == 15).withColumns({"group_id": F.lit("motion:0999"), "anchor_page": F.lit(999), "title": F.lit("x"), "date": F.lit("")})
    return papers, inventory, groups.unionByName(groups.where(k == 14)).unionByName(made_up), members


@query(rf"""with {MOTION_PAPERS}, i as (select *, max(end_page) over (partition by case_id order by start_page, end_page, paper_id rows between unbounded preceding and 1 preceding) as before, count(*) over (partition by case_id, paper_id) as times from inv),
    h as (select case_id, paper_id, count(*) as n from mem group by 1, 2),
    m as (select m.*, i.paper_id is not null as known, i.start_page as s, i.end_page as e, i.title, row_number() over w as nth, lag(i.end_page) over w as came, exists (select 1 from grp g where g.case_id = m.case_id and g.group_id = m.group_id) as grouped
        from mem m left join inv i on i.case_id = m.case_id and i.paper_id = m.paper_id window w as (partition by m.case_id, m.group_id order by place, m.paper_id)),
    l as (select case_id, group_id, max(e) as reach from m where known group by 1, 2),
    g as (select g.*, i.paper_id is not null as known, i.start_page as s, i.title as t, i.date as d, i.basis as b, l.group_id is not null as held, count(*) over (partition by g.case_id, g.group_id) as times, lag(reach) over (partition by g.case_id order by anchor, g.group_id) as end_before
        from grp g left join inv i on i.case_id = g.case_id and i.paper_id = g.group_id left join l on l.case_id = g.case_id and l.group_id = g.group_id),
    r as (select case_id, paper_id as subject, unnest([case when start_page < 1 or start_page > end_page or start_page <= before then 'invalid_range' end, case when times > 1 or paper_id <> printf('motion:%04d', start_page) then 'duplicate_id' end,
        case when trim(title) <> title then 'invalid_label' end, case when basis not in ('filed', 'document', 'unknown') then 'invalid_fields' end]) as rule from i
    union all select inv.case_id, inv.paper_id, case when n is null then 'incomplete_membership' when n > 1 then 'invalid_membership' end from inv left join h on h.case_id = inv.case_id and h.paper_id = inv.paper_id
    union all select case_id, paper_id, unnest([case when not known then 'invalid_reference' end, case when not grouped then 'unknown_group' end, case when known and (start_page <> s or end_page <> e) then 'invalid_range' end,
        case when role <> case when nth = 1 then 'lead' else 'continuation' end then 'invalid_role' end, case when nth > 1 and not coalesce(came + 1 = s, false) then 'invalid_continuity' end, case when nth = 1 and not coalesce(group_id = paper_id and title <> '', false) then 'invalid_lead' end]) from m
    union all select case_id, group_id, unnest([case when not known or times > 1 then 'invalid_reference' end, case when not held then 'empty_group' end, case when known and anchor <> s then 'invalid_range' end, case when known and (title <> t or date <> d or basis <> b) then 'invalid_lead_metadata' end,
        case when not noted then 'invalid_explanation' end, case when end_before + 1 >= anchor then 'split_continuity' end]) from g)
    select distinct case_id, subject, rule from r where rule is not null""")
def motion_group_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule that motion groups with planted faults break."""
    _, inventory, groups, members = motion_tables(spark, sf_dir)
    return motion_groups.group_issues(inventory, groups, members)


@query(f"""with {MOTION_PAPERS}, good as (select * from m0 where case_id % 5 > 1), c as (select distinct case_id, case_id % 5 as v from p)
    select g.case_id, group_id, paper_id, case when place = 0 then 'lead' else 'continuation' end as role, start_page, end_page, '' as warning from good g where g.case_id % 5 > 2 or g.case_id % 5 = 2 and not exists (select 1 from p where p.case_id = g.case_id and p.start_page % 2 = 0)
    union all select p.case_id, paper_id, paper_id, 'unresolved', start_page, end_page, case when p.case_id % 5 < 2 then '{motion_groups.NO_GROUPS}' else '{motion_groups.STALE_GROUPS}' end from p where (p.case_id % 5 < 2 or p.case_id % 5 = 2 and exists (select 1 from p q where q.case_id = p.case_id and q.start_page % 2 = 0)) and start_page % 3 > 0""")
def motion_groups_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved groups where today's papers are the saved ones, else titled papers alone; two of five cases have none, one has other dates."""
    papers, _, _, _ = motion_tables(spark, sf_dir)
    papers = papers.withColumn("title", F.when(F.col("start_page") % 3 == 0, "").otherwise(F.col("title")))
    _, members = motion_groups.canonical(papers)
    k = F.col("case_id") % 5
    inventory = papers.withColumn("date", F.when((k == 2) & (F.col("start_page") % 2 == 0), "then").otherwise(F.col("date")))
    return motion_groups.current_groups(papers, inventory.where(k > 1), members.where(k > 1))


@query(f"""with {registry.REPORTS}, t as (select case_id, page, part, 0 as tier, case part % 12 when 0 then 'RT_body' when 1 then 'ct_report' when 2 then ' ct_motion_first_page' when 3 then 'ct_index' when 4 then ' ' when 5 then 'cover' end as pt from pages
        union all select case_id, page, part, 1, case part % 7 when 0 then 'CT_report ' when 1 then 'rt_body_first_page' end from pages),
    s as (select o_orderkey as case_id, 's0' as sid, case when o_orderkey % 3 = 0 then 'CT' else 'RT' end as rec from orders union all select o_orderkey, 's1', 'CT' from orders),
    u as (select t.*, lower(trim(pt)) as token, case part % 5 when 0 then 'RT' when 1 then 'CT' end as rec, s.rec as srec from t left join s on s.case_id = t.case_id and s.sid = case when part % 2 = 1 then 's' || part % 3 else 's' || part % 4 end),
    v as (select case_id, page, tier, case regexp_replace(token, '_first_page$', '') when '' then null when 'rt_body' then 'hearing' when 'ct_report' then 'report' when 'ct_motion' then 'motion' else case when token is not null then 'unknown' end end as category,
        list_filter([rec, srec, upper(split_part(token, '_', 1))], lambda i: i in ('RT', 'CT')) as ids from u
    union all select p.case_id, p.page, 2, r.category, [] from pages p join (select case_id, start_page as a, end_page as b, 'report' as category from reports union all select case_id, start_page + 2, end_page + 1, 'motion' from reports) r on r.case_id = p.case_id and p.page between a and b
    union all select case_id, page, 3, case part % 4 when 0 then 'form' else 'hearing' end, [] from pages where part % 4 < 2),
    g as (select case_id, page, list_distinct(flatten(list(ids))) as ids, min(tier) filter (category is not null and tier < 3) as best from v group by 1, 2),
    h as (select g.*, case when best is null and len(ids) < 2 then 3 else best end as tier from g),
    k as (select h.case_id, h.page, h.ids, h.tier, list(distinct v.category) filter (v.category is not null) as cats from h left join v on v.case_id = h.case_id and v.page = h.page and v.tier = h.tier group by all),
    c as (select *, len(coalesce(cats, [])) as n, len(coalesce(cats, [])) > 1 or len(ids) > 1 or (n = 1 and len(ids) = 1 and cats[1] <> 'unknown' and (cats[1] = 'hearing') <> (ids[1] = 'RT')) as clash from k)
    select case_id, page, case when not clash and n = 1 then cats[1] else 'unknown' end as category, case when n = 0 then 'none' when tier = 0 then 'transcript' when tier = 1 then 'source_map' when tier = 2 then 'boundary' else 'toc' end as provenance,
    case when clash then 'conflict' when n = 1 and cats[1] <> 'unknown' then 'classified' else 'unknown' end as status, case when len(ids) = 1 then ids[1] else '' end as record_type from c""")
def page_category_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of all pages from two tables of page types with their series, from ranges of two categories, and from headings."""
    pages = written_once(classified_pages(spark, sf_dir, by_case=True).select("case_id", "page", "page_type", "part"))
    part = F.col("part")
    texts = lambda n, *names: F.element_at(F.array(*map(F.lit, names)), F.when(part % n < len(names), part % n + 1).otherwise(len(names)).cast("int"))
    ids = (F.when(part % 2 == 1, F.concat(F.lit("s"), (part % 3).cast("string"))).otherwise("").alias("citation_series_id"), F.lit(None).cast("string").alias("series_id"), F.concat(F.lit("s"), (part % 4).cast("string")).alias("sequence_id"))
    kinds = texts(12, "RT_body", "ct_report", " ct_motion_first_page", "ct_index", " ", "cover", None), texts(7, "CT_report ", "rt_body_first_page", None)
    key = F.col("o_orderkey")
    one = lambda n, sid, rec: F.struct(F.lit(n).alias("ordinal"), F.lit(sid).alias("series_id"), F.lit(None).cast("string").alias("sequence_id"), rec.alias("record_type"))
    series = F.array(one(0, "s0", F.lit("rt ")), one(1, "s1", F.lit("CT")), one(2, "s0", F.when(key % 3 == 0, "ct").otherwise("RT")))
    series = read(spark, sf_dir, "orders").select(key.alias("case_id"), F.inline(series))
    types = F.inline(F.array(*(F.struct(F.lit(tier).alias("tier"), kind.alias("page_type")) for tier, kind in enumerate(kinds))))
    typed = categories.with_series(pages.select("case_id", "page", texts(5, "rt", "CT", None).alias("record_type"), *ids, types), series)
    span = lambda start, end, kind: F.struct(start.alias("start_page"), end.alias("end_page"), F.lit(kind).alias("category"))
    start, end = F.col("start_page"), F.col("end_page")
    spans = ranges.report_ranges(pages).select("case_id", F.inline(F.array(span(start, end, "report"), span(start + 2, end + 1, "motion"))))
    listed = pages.where(part % 4 < 2).select("case_id", "page", F.when(part % 4 == 0, "Procedural filings").otherwise(" HEARINGS").alias("title"))
    return categories.page_categories(pages, typed, spans, listed)


CHANGED = boundaries.ALL_KINDS.replace(boundaries.RECORD, boundaries.RECORD.replace("rec as (", "rec0 as (") + """, rec as (select r.case_id, r.page, named, case when u.page is not null then case part % 4 when 0 then 'report' when 1 then 'report_first' when 2 then 'minute_body' else page_type end else page_type end as page_type
    from (select rec0.*, part from rec0 join pages using (case_id, page)) r left join (select case_id, min(page) as page from pages where part % 3 = 0 group by 1) u on u.case_id = r.case_id and u.page = r.page)""")


@query(f"""with a as (with {boundaries.ALL_KINDS} select * from docs), b as (with {CHANGED} select * from docs), x as ((select * from a except select * from b) union all (select * from b except select * from a)),
    {registry.LAST}, u as (select case_id, min(page) as page from pages where part % 3 = 0 group by 1) select case_id, page, case_id in (select case_id from x) as kept from u""")
def correction_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the corrections, here one of each case's first unnamed page, change any selected document."""
    names = {"report_first": "CT_report_first_page", "report": "CT_report", "motion_first": "CT_motion_first_page", "motion": "CT_motion", "minute_start": "CT_minute_order_first_page", "minute_body": "CT_minute_order", "hearing_start": "RT_body_first_page", "hearing_body": "RT_body", "form_first": "CT_form_first_page", "other": "CT_other"}
    kind = lambda c: categories.looked_up(c, names)
    part = F.col("part")
    last = written_once(classified_pages(spark, sf_dir).select("case_id", "page", "part", "named"))
    pages = boundaries.record_kinds(last).select("case_id", "page", kind(F.col("page_type")).alias("page_type"), F.when(F.col("named"), "n").otherwise("").alias("name"), F.lit("").alias("date"))
    first = last.where("not named").groupBy("case_id").agg(F.min("page").alias("page"), F.min_by("part", "page").alias("part"))
    new = F.when(part % 4 == 0, "CT_report").when(part % 4 == 1, "CT_report_first_page").when(part % 4 == 2, "CT_minute_order").otherwise(F.col("page_type"))
    changes = written_once(first.join(pages, ["case_id", "page"]).select("case_id", "page", F.lit(1).alias("nth"), new.alias("page_type"), "name", "date"))
    return corrections.effective(pages, changes).drop("nth")


@query("""select source, lang, count(*) as n_docs, count(distinct text) as n_texts, sum(n_chars) as chars from documents group by all""")
def kept_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of sources from a kept stage: computed once for the same rows, read from the shared folder afterwards."""
    rows = read(spark, sf_dir, "documents").select("source", "lang", F.sha2("text", 256).alias("text"), "n_chars")

    def build(rows: DataFrame) -> DataFrame:
        return rows.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.count_distinct("text").alias("n_texts"), F.sum("n_chars").alias("chars"))

    return stages.stage("source_counts", {"rows": rows}, {}, build)[0]
