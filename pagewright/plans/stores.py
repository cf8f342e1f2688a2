"""Named queries of stored digests and of minute orders, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import digest_store as store
from pagewright.operators import minutes
from pagewright.operators.stages import written_once
from pagewright.sources.tables import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


FORM = store.Form("Pagewright", {kind: [("facts", "Facts"), ("rest", "Rest")] for kind in store.KINDS})
CATALOG = '{"category_catalog": [{"id": "facts", "title": "What *happened*"}, {"id": "rest", "title": "Rest"}]}'
#: Documents by conv_id % 3: kind and version.
FORMS = [("reports", 1), ("hearings", 2), ("motions", 3)]


def stored(spark: SparkSession, sf_dir: str, only_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, rows): a store per conversation with a row per turn, its whole text as digest and up to two quotations of it; all of the first form, or of all three."""
    turns = read(spark, sf_dir, "conversations")
    nth = F.lit(0) if only_first else F.pmod("conv_id", F.lit(3))
    kind = F.element_at(F.array(*(F.lit(k) for k, _ in FORMS)), (nth + 1).cast("int"))
    docs = turns.select(F.col("conv_id").alias("doc_id")).distinct().withColumn("conv_id", F.col("doc_id"))
    metadata = F.when(nth > 0, CATALOG)
    docs = docs.select("doc_id", kind.alias("kind"), F.concat(F.lit("case "), F.col("doc_id").cast("string")).alias("case_stem"), (nth + 1).cast("int").alias("version"), metadata.alias("metadata"))
    t = F.col("turn").cast("int")
    start = t * 3 + 1
    item = F.concat(F.regexp_replace(kind, "s$", ""), F.lit(":"), F.lpad(start.cast("string"), 4, "0"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    source = lambda k: F.sha2(F.concat_ws(":", "role", F.lit(k)), 256)
    quote = lambda k: F.struct(
        F.array_join(F.slice("words", k + 1, 5), " ").alias("text"), (start + k).alias("file_page"), F.concat("item_id", F.lit(f"/facts/{k + 1}")).alias("quote_id"), source(k).alias("source_sha256"),
        (t % 2 == k).alias("verified"), F.lit(k if k else None).cast("int").alias("source_start"), F.lit(None).cast("int").alias("source_end"),
    )
    rows = turns.withColumns({"kind": kind, "item_id": item, "words": words})
    quotes = F.slice(F.array(quote(0), quote(1)), 1, F.when(F.size("words") > 1, t % 3).otherwise(0)).cast(store.EVIDENCE)
    facts = F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.struct(F.col("text").alias("text"), quotes.alias("evidence")))
    member = F.struct(F.lit("").alias("date"), F.lit("filed").alias("date_basis"), (start + 2).alias("end_page"), F.lit("").alias("naming_rule_id"), F.col("item_id").alias("paper_id"), F.lit("lead").alias("role"), F.col("role").alias("source_title"), start.alias("start_page"))
    group = F.struct(*(F.lit(v).alias(c) for c, v in {"date": "", "date_basis": "filed", "filing_party": "", "filing_role": "motion packet", "purpose": "", "relationship_notes": "", "relationship_to": ""}.items()))
    grouped = nth == 2
    values = {
        "kind": "kind", "item_id": "item_id", "ordinal": t + 1, "label": F.concat_ws(" ", F.lit("#"), "role", t.cast("string")), "start_page": start, "end_page": start + 2, "input_sha256": source(7), "generation_sha256": source(8),
        "quality_flags": F.array(F.concat(F.lit("turn:"), t.cast("string"))), "categories": F.array(F.struct(F.lit("facts").alias("id"), facts.alias("digest")), F.struct(F.lit("rest").alias("id"), F.lit(None).cast(f"struct<text string, evidence {store.EVIDENCE}>").alias("digest"))),
        "anchor_page": F.when(grouped, start), "group_metadata": F.when(grouped, group), "members": F.when(grouped, F.array(member)),
    }
    columns = [(F.col(v) if isinstance(v, str) else v).cast(store.ROW[c]).alias(c) for c, v in values.items()]
    return docs, rows.select(F.col("conv_id").alias("doc_id"), *columns)


TURNS = r"""t as (select conv_id, turn, '# ' || role || ' ' || turn as label, case when regexp_matches(text, '[^\x20\x09-\x0D]') then text end as digest,
    list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') as w, row_number() over (partition by conv_id order by turn) as block, count(*) over (partition by conv_id) as n from conversations)"""
READ = "conv_id, cast(turn as int) as turn, label, digest, case when digest is null then 0 when len(w) > 1 then cast(turn % 3 as int) else 0 end as n_quotes, case when len(w) > 1 and turn % 3 > 0 then array_to_string(w[1:5], ' ') end as quote"


def as_read(rows: DataFrame) -> DataFrame:
    facts = F.get("categories", F.lit(0))["digest"]
    return rows.select(
        F.col("doc_id").alias("conv_id"), (F.col("ordinal") - 1).alias("turn"), "label", facts["text"].alias("digest"), F.coalesce(F.size(facts["evidence"]), F.lit(0)).alias("n_quotes"),
        F.get(facts["evidence"], F.lit(0))["text"].alias("quote"),
    )


@query(f"with {TURNS} select {READ} from t")
def digest_store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns written as stored digests of three versions and read back."""
    docs, rows = stored(spark, sf_dir)
    return as_read(store.rows_of(store.blocks(FORM, written_once(store.written(FORM, docs, rows)))))


@query(f"""with {TURNS}, k as (select *, conv_id % 8 as k from t), c as (select distinct conv_id, k, n from k)
    select conv_id, 0 as block, 'final_newline' as rule from c where k in (1, 7) union all select conv_id, n, 'not_canonical' from c where k = 1
    union all select conv_id, block, unnest(['row_pages', 'not_canonical']) from k where k = 2 and turn = 0 union all select conv_id, n, 'duplicate_item' from c where k = 3
    union all select conv_id, block, 'fingerprint' from k where k = 4 union all select conv_id, 0, unnest(['case_stem', 'not_canonical']) from c where k = 5 union all select conv_id, block, 'categories' from k where k = 6""")
def digest_store_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of stored digests of which seven in eight were spoilt on purpose."""
    text, k = F.col("markdown"), F.pmod("doc_id", F.lit(8))
    last = F.regexp_extract(text, r"(?s)^.*(\n## .*)$", 1)
    spoilt = F.when(k == 1, F.concat(text, F.lit("\n"))).when(k == 2, F.replace(text, F.lit("\nSource pages: 1-3\n"), F.lit("\nSource pages: 1-4\n"))).when(k == 3, F.concat(text, last))
    spoilt = spoilt.when(k == 4, F.regexp_replace(text, r'"input_sha256": "\w+"', '"input_sha256": ""')).when(k == 6, F.replace(text, F.lit("\n### Rest (rest)\n"), F.lit("\n### Rest (more)\n")))
    spoilt = spoilt.when(k == 7, F.regexp_replace(text, r"\n\z", "")).otherwise(text)
    texts = store.written(FORM, *stored(spark, sf_dir)).withColumns({"markdown": spoilt, "case_stem": F.when(k == 5, "other").otherwise(F.col("case_stem"))})
    texts = written_once(texts)  # stored, not made again for each thing that is asked of a text
    return store.issues(store.blocks(FORM, texts)).withColumnRenamed("doc_id", "conv_id")


@query(f"with {TURNS} select {READ} from t where conv_id % 5 not in (1, 2)")
def digest_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old JSON lines moved into stored digests and read from there; of five files one has another hash than recorded and one says more than a row holds."""
    docs, rows = stored(spark, sf_dir, only_first=True)
    k = F.pmod("doc_id", F.lit(5))
    line = store.old_json(FORM, F.struct(*store.ROW))
    line = F.when(k == 2, F.regexp_replace(line, r"\}$", ', "more": null}')).otherwise(line)
    files = rows.groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))["line"].alias("lines"))
    text = F.concat(F.array_join("lines", "\n"), F.lit("\n"))
    files = files.select("doc_id", "kind", text.alias("text"), F.when(k == 1, "0").when(k < 4, F.sha2(text, 256)).alias("stored_sha256"))
    moved = store.rows_of(store.from_old_lines(FORM, files))
    kept = docs.join(moved.select("doc_id").distinct(), "doc_id", "left_semi")
    return as_read(store.rows_of(store.blocks(FORM, written_once(store.written(FORM, kept, moved)))))


def minute_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, pages, sent): twenty texts are the pages of a case, two successive ones a minute order, and each page a person of its candidate.

    By doc_id % 5 the evidence is the page's first letters, something that it doesn't say, on a page of another order, of a person in an odd state, or without a role;
    of seven orders one has another artifact and one nothing.
    """
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    page, k = (F.pmod("doc_id", F.lit(20)) + 1).cast("int"), F.pmod("doc_id", F.lit(5))
    pages = docs.select(F.floor(F.col("doc_id") / 20).alias("case_id"), page.alias("page"), "text", k.alias("k"))
    said, n = F.regexp_extract("text", "[A-Za-z]+", 0), F.floor((F.col("page") - 1) / 2)
    evidence = F.array(F.struct((F.col("page") + F.when(F.col("k") == 2, 2).otherwise(0)).alias("file_page"), F.when(F.col("k") == 1, F.concat(F.lit("Xq9Zz "), said)).otherwise(said).alias("text")))
    person = F.struct(F.concat(F.lit("P"), F.col("page").cast("string")).alias("person"), F.when(F.col("k") < 4, "Clerk").alias("role_label"), F.when(F.col("k") == 3, "odd").otherwise("present").alias("status"), evidence.alias("evidence"))
    people = pages.select("case_id", n.alias("n"), F.struct("page", person.alias("p")).alias("x")).groupBy("case_id", "n").agg(F.array_sort(F.collect_list("x"))["p"].alias("appearances"))
    item = F.concat(F.lit("minute:"), (F.col("n") * 2 + 1).cast("string"))
    items = people.select("case_id", item.alias("item_id"), F.sha2(F.concat_ws(":", "case_id", "n"), 256).alias("fingerprint"), (F.col("n") * 2 + 1).cast("int").alias("start_page"), (F.col("n") * 2 + 2).cast("int").alias("end_page"))
    artifact = F.when(F.col("n") % 7 == 3, "other").otherwise(minutes.ARTIFACT)
    payload = F.to_json(F.struct(artifact.alias("artifact"), F.lit(" In  court ").alias("hearing"), F.lit("So ordered").alias("orders"), F.when(F.col("n") % 2 == 0, "May 1").alias("next_hearing"), "appearances"))
    return items, pages.select("case_id", "page", "text"), people.where("n % 7 <> 5").select("case_id", item.alias("item_id"), payload.alias("payload"))


MINUTES = """p as (select doc_id // 20 as case_id, cast(doc_id % 20 + 1 as int) as page, (doc_id % 20) // 2 as n, doc_id % 5 as k, regexp_extract(coalesce(text, ''), '[A-Za-z]+') <> '' as speaks from documents),
    a as (select *, 'minute:' || (2 * n + 1) as item_id, 'P' || page as person, speaks and k in (0, 3, 4) as held from p where n % 7 not in (3, 5)),
    i as (select case_id, item_id, array_to_string(list_filter([case when bool_or(k <> 3 and not held) then 'appearance_evidence_unverified' end, case when n % 2 = 1 then 'next_hearing_unusable' end, case when bool_or(k = 4) then 'unresolved_role' end], lambda f: f is not null), ',') as flags from a group by case_id, item_id, n)"""


@query(f"with {MINUTES} select case_id, item_id, person, case k when 4 then 'Unknown' else 'Clerk' end as role_label, case when held and k <> 3 then 'present' else 'unclear' end as status, cast(held as int) as n_evidence, flags from a join i using (case_id, item_id)")
def minute_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who appeared by which evidence, for candidates over all texts; rejected candidates give no row."""
    rows, _ = minutes.candidates(*minute_orders(spark, sf_dir))
    each = rows.select("case_id", "item_id", F.array_join("quality_flags", ",").alias("flags"), F.explode("appearances").alias("a"))
    return each.select("case_id", "item_id", "a.person", "a.role_label", "a.status", F.size("a.evidence").alias("n_evidence"), "flags")


@query(f"""with {MINUTES}, o as (select distinct case_id, 'minute:' || (2 * n + 1) as item_id, n from p)
    select case_id, item_id, case when n % 7 in (3, 5) then 'missing' when n = 1 then 'unsound' when n = 2 then 'version' when n = 4 then 'changed' end as why from o where n in (1, 2, 4) or n % 7 in (3, 5)""")
def minute_rows_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which minute orders a rerun makes anew, and why: of ten in a case one was altered, one is of an older version, one has another source now, and two were never accepted."""
    items, pages, sent = minute_orders(spark, sf_dir)
    stored = minutes.checkpointed(minutes.candidates(items, pages, sent)[0], "contract-1")
    of = lambda n: F.col("item_id") == f"minute:{2 * n + 1}"
    stored = stored.withColumn("version", F.when(of(2), 4).otherwise(F.col("version")))
    stored = stored.withColumn("row_sha256", minutes.row_hash(F.col("version"), F.col("contract"), stored)).withColumn("orders", F.when(of(1), "Denied").otherwise(F.col("orders")))
    now = items.withColumn("fingerprint", F.when(of(4), "new").otherwise(F.col("fingerprint")))
    return minutes.due(now, stored, "contract-1")[1].select("case_id", "item_id", "why")
