"""Named queries of stored state and small row rules, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import state
from pagewright.plans import registry
from pagewright.sources.tables import classified_pages, read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""with s as (select doc_id as item_id, count(*) as n, bool_or((quality + doc_id) % 3 = n_chars % 3) as same from labels join documents using (doc_id) group by 1)
    select d.doc_id as item_id, d.doc_id as ordinal, case when same then null when n is null then d.doc_id else d.doc_id + 1099511627776 end as place, case when same then 'current' when n is null then 'missing' else 'stale' end as state
    from documents d left join s on s.item_id = d.doc_id""")
def pending_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items, labels as stored rows: which are current, missing or stale, and the order of what is pending."""
    items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ordinal"), (F.col("n_chars") % 3).alias("fingerprint"))
    stored = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), ((F.col("quality") + F.col("doc_id")) % 3).alias("fingerprint"))
    return state.current_and_pending(items, stored)


@query("select l.doc_id as item_id, quality from labels l join documents d on d.doc_id = l.doc_id and (quality + l.doc_id) % 3 = n_chars % 3")
def rows_with_current_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), (F.col("n_chars") % 3).alias("fingerprint"))
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), ((F.col("quality") + F.col("doc_id")) % 3).alias("fingerprint"), "quality")
    return state.with_current_fingerprint(rows, items).select("item_id", "quality")


@query("select user_id, arg_max(event_type || event_id, event_id) as last_name from events where event_id % 4 > 0 group by user_id")
def resume_high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name of each user's last event that has one; every fourth has none."""
    name = F.when(F.col("event_id") % 4 > 0, F.concat("event_type", F.col("event_id").cast("string"))).otherwise(" ")
    return state.last_name(read(spark, sf_dir, "events").select("user_id", "event_id", name.alias("file_name")), ["user_id"], "event_id")


@query(f"""with {registry.LAST}, u as (select case_id, page, page_type from pages), c as (select case_id, page, case when part % 50 = 0 then 'other' else page_type end as page_type from pages where part % 70 > 0),
    d as (select case_id, page, page_type, sum(d) as d from (select *, 1 as d from u union all select *, -1 from c) group by 1, 2, 3) select case_id, max(abs(d)) = 0 as resumable from d group by case_id""")
def resume_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cached copy of each case's pages still holds the same checks; some pages were changed or left out on purpose."""
    pages = classified_pages(spark, sf_dir)
    cached = pages.where("part % 70 > 0").withColumn("page_type", F.when(F.col("part") % 50 == 0, "other").otherwise(F.col("page_type")))
    return state.same_checks(pages, cached, ["case_id"], ["page", "page_type"])


@query("""select o_orderkey, case when o_orderkey % 3 > 0 then o_custkey else 0 end as image_bytes from orders""")
def image_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey")
    texts = orders.select("case_id", F.lit("0001.txt").alias("file_name"))
    images = orders.where("case_id % 3 > 0").select("case_id", F.lit("0001.png").alias("file_name"), F.col("o_custkey").alias("n_bytes"))
    return state.paired_images(texts, images).select(F.col("case_id").alias("o_orderkey"), "image_bytes")


@query("""with m as (select l_orderkey as group_id, count(*) as n from lineitem group by 1) select o_orderkey as group_id, cast(o_orderkey % 7 as bigint) as declared, coalesce(n, 0) as found from orders left join m on group_id = o_orderkey where o_orderkey % 7 <> coalesce(n, 0)""")
def declared_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("group_id"), (F.col("o_orderkey") % 7).alias("declared"))
    return state.declared_counts(groups, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id")))


@query(f"""with {registry.LAST}, b as (select *, max(part) over (partition by case_id order by page rows between unbounded preceding and 1 preceding) as before from pages) select case_id, page, part from b where part < before""")
def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose value falls below that of an earlier page of their case."""
    return state.out_of_order(classified_pages(spark, sf_dir).select("case_id", "page", "part"), ["case_id"], "page", "part")


@query("select l_orderkey, case when min(l_returnflag) = max(l_returnflag) then min(l_returnflag) end as l_returnflag from lineitem group by 1")
def exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.only_match(read(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("""select event_id, event_type || '/c/' || event_id as quote_id, event_id % 3 <> 1 as inside, case when event_id % 4 = 0 then 'unread:' || event_id % 9 else '' end as flags, case when event_id % 2 = 0 then cast(event_id % 1000 as int) else 0 end as page,
    event_id % 5 > 0 as same_keys, 'three' as longest, 1 as n_dropped, 'a b' as log from events where event_id % 9 > 0""")
def row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote ids, safe paths, counted flags, pages by alias, patches, longest values, caps and log texts of made-up rows."""
    e, key = read(spark, sf_dir, "events").where("event_id % 9 > 0"), F.col("event_id")
    path = F.when(key % 3 == 0, "a/./b/../c.txt").when(key % 3 == 1, "a/../../c.txt").otherwise("c.txt")
    n = (key % 9).cast("string")
    payload = F.when(key % 4 == 0, F.concat(F.lit('{"n": '), n, F.lit("}"))).when(key % 4 == 1, F.concat(F.lit('{"n": "'), n, F.lit('"}'))).when(key % 4 == 2, '{"n": true}').otherwise('{"n": 1.5}')
    names = F.create_map(F.lit("start_page"), F.lit(" "), F.when(key % 2 == 0, "start").otherwise("begin"), F.concat(F.lit("p"), (key % 1000).cast("string"), F.lit(".txt")))
    patch = F.create_map(F.when(key % 5 == 0, "b").otherwise("a"), F.lit(1))
    words = F.array(F.lit("one"), F.lit("three"), F.lit("seven"))
    return e.select(
        "event_id", state.quote_id(F.col("event_type"), F.lit("c"), key).alias("quote_id"), state.inside_root(path).alias("inside"), F.array_join(state.count_flags(payload, {"n": "unread"}), ",").alias("flags"),
        state.boundary_page(names, "start_page", "start").alias("page"), state.same_keys(patch, F.create_map(F.lit("a"), F.lit(2))).alias("same_keys"), state.longest(words).alias("longest"),
        state.capped(words, 2)["n_dropped"].alias("n_dropped"), state.log_text(F.lit(" a\x07 \n b ")).alias("log"),
    )
