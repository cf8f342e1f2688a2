"""Readers: tolerant JSONL, page text folders, and adapters from the driver's star schema to classified pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import field, natural_key
from pagewright.operators.dedupe import last_wins


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(source, row MAP<STRING,STRING>) of each line that is a JSON object; blank lines, bad JSON and other values are dropped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("source"), F.trim("value").alias("line"))
    lines = lines.where(F.col("line").startswith("{") & F.expr("try_parse_json(line)").isNotNull())
    return lines.select("source", F.from_json("line", "map<string,string>").alias("row")).where("row is not null")


def read_jsonl_sorted(spark: SparkSession, paths: list[str], key: str = "file_name") -> DataFrame:
    """The rows of several JSONL files together, in natural order of their file names; rows without one come last."""
    rows = None
    for path in paths:
        rows = read_jsonl(spark, path) if rows is None else rows.unionAll(read_jsonl(spark, path))
    name = F.nullif(F.trim(field(F.col("row"), key)), F.lit(""))
    return rows.orderBy(natural_key(name).asc_nulls_last(), "source")


def names_in(rows: DataFrame, key: str = "file_name") -> DataFrame:
    """(file_name): the distinct names that are not blank."""
    name = F.trim(field(F.col("row"), key))
    return rows.select(name.alias("file_name")).where("file_name <> ''").distinct()


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """(row MAP<STRING,STRING>) of a file that holds one JSON array of objects; anything else gives no row."""
    text = spark.read.text(path, wholetext=True).where(F.expr("try_parse_json(value)").isNotNull() & F.ltrim("value").startswith("["))
    return text.select(F.explode(F.from_json("value", "array<map<string,string>>")).alias("row")).where("row is not null")


def read_page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, page, text, n_bytes) of the files named by exactly four digits and .txt."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))
    files = files.where(F.col("file_name").rlike(r"^[0-9]{4}\.txt$"))
    return files.select("file_name", F.substring("file_name", 1, 4).cast("int").alias("page"), "text", F.octet_length("text").alias("n_bytes"))


def expected_pages(counts: DataFrame) -> DataFrame:
    """(case_id, page, file_name): every page number of a case's inputs (case_id, n_pages) together, as names of four digits or more."""
    totals = counts.groupBy("case_id").agg(F.sum("n_pages").cast("int").alias("n")).where("n > 0")
    pages = totals.select("case_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page"))
    return pages.withColumn("file_name", F.format_string("%04d.txt", "page"))


#: Total order of rows that repeat a page: the greatest is the last written.
WRITTEN = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def page_type(flag, status):
    return (
        F.when((flag == "R") & (status == "F"), "report_first")
        .when(flag == "R", "report")
        .when((flag == "A") & (status == "F"), "motion_first")
        .when(flag == "A", "motion")
        .otherwise("other")
    )


def classified_pages(spark: SparkSession, sf_dir: str, by_case: bool = False) -> DataFrame:
    """(case_id, page, page_type, part, named): one row per page of each order, the last written row of a page wins.

    by_case: for those who read each case in page order anyway. Rows are dealt by case before they are deduped, so one shuffle and one sort
    serve both, and nothing is sorted where it is read.
    """
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *WRITTEN)  # no column travels that isn't asked for
    rows = rows.repartition("l_orderkey") if by_case else rows
    last = last_wins(rows, ["l_orderkey", "l_linenumber"], WRITTEN)
    return last.select(
        F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("page"), page_type(F.col("l_returnflag"), F.col("l_linestatus")).alias("page_type"),
        F.col("l_partkey").alias("part"), (F.col("l_partkey") % 3 != 0).alias("named"),
    )


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, page, page_type, ts): each user's events numbered by time; every third page number is left out to make gaps."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "events").withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    kind = F.when(F.col("event_type") == "signup", "minute_start").when(F.col("event_type").isin("click", "view"), "minute_body").otherwise("other")
    page = F.col("rn") + F.floor(F.col("rn") / 7)
    return rows.select(F.col("user_id").alias("case_id"), page.cast("int").alias("page"), kind.alias("page_type"), "ts")
