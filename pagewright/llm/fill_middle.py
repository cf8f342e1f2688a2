"""Fill-in-middle transformation: DuckDB inside mapInArrow, one SQL statement over each registered Arrow batch.

Defined results: a null text counts as empty and stays plain, as does a text that holds a marker; a null id draws as the empty id; repeated
rows are transformed one by one and alike; extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import bounded_batches

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKS = ("<P>", "<S>", "<M>")
SETTINGS = {"threads": 1, "memory_limit": "1GB", "autoinstall_known_extensions": False, "autoload_known_extensions": False, "temp_directory": ""}

#: Draws are four unsigned numbers of a digest of seed and id; cuts fall between tokens.
STATEMENT = """
with t as (
    select id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{token}') as tokens,
        sha256('{seed}:' || coalesce(cast(id as varchar), '')) as h
    from batch
), d as (
    select *, len(tokens) as n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) as r from t
), c as (
    select *, least(r[1] % (n + 1), r[2] % (n + 1)) as lo, greatest(r[1] % (n + 1), r[2] % (n + 1)) as hi,
        case when text = '' or contains(text, '{p}') or contains(text, '{s}') or contains(text, '{m}') or r[3] % 100 >= {rate} then 'plain'
            when r[4] % 100 < {spm} then 'spm' else 'psm' end as form
    from d
), w as (
    select id, text, n, form, array_to_string(list_slice(tokens, 1, lo), '') as prefix, array_to_string(list_slice(tokens, lo + 1, hi), '') as middle,
        array_to_string(list_slice(tokens, hi + 1, n), '') as suffix
    from c
)
select id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
    case form when 'plain' then text when 'psm' then '{p}' || prefix || '{s}' || suffix || '{m}' || middle
        else '{s}' || suffix || '{p}' || prefix || '{m}' || middle end as output
from w
"""

#: The inverse. No marker is in a part, and none can begin inside one and end in the next, so each marker's first place is its own.
INVERSE = """
select *, case form when 'plain' then output
        when 'psm' then substr(output, 4, strpos(output, '{s}') - 4) || substr(output, strpos(output, '{m}') + 3)
            || substr(output, strpos(output, '{s}') + 3, strpos(output, '{m}') - strpos(output, '{s}') - 3)
        else substr(output, strpos(output, '{p}') + 3, strpos(output, '{m}') - strpos(output, '{p}') - 3) || substr(output, strpos(output, '{m}') + 3)
            || substr(output, 4, strpos(output, '{p}') - 4) end as restored
from ({rows}) as rows
"""
DIGESTS = "select id, n, form, prefix_chars, middle_chars, sha256(output) as output_sha256, sha256(restored) as restored_sha256 from ({rows}) as rows"


def in_duckdb(rows: DataFrame, statement: str, schema: str) -> DataFrame:
    """The statement's rows for each Arrow batch of rows, which it reads as the view batch; one connection a task, one thread, no disk."""

    def run(batches):
        with duckdb.connect(":memory:", config=SETTINGS) as con:
            for batch in batches:
                if len(batch):
                    con.register("batch", pa.Table.from_batches([batch]))
                    yield from con.sql(statement).to_arrow_table().to_batches()
                    con.unregister("batch")

    return bounded_batches(rows).mapInArrow(run, schema)


def _statement(seed: int, rate: int, spm: int) -> str:
    p, s, m = MARKS
    return STATEMENT.format(token=TOKEN, seed=int(seed), rate=int(rate), spm=int(spm), p=p, s=s, m=m)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row: the text itself or cut into prefix, middle and suffix and dealt anew.

    rate: percent of texts that are cut; spm: percent of those whose suffix comes first. Nothing is shuffled.
    """
    out = in_duckdb(_rows(docs, id_col, text_col), _statement(seed, rate, spm), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restored(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, form, output, restored) of transformed rows: the exact texts, rebuilt from output and form alone."""
    p, s, m = MARKS
    sql = INVERSE.format(p=p, s=s, m=m, rows="select id, form, output from batch")
    out = in_duckdb(rows.select(F.col(id_col).cast("long").alias("id"), "form", "output"), sql, "id long, form string, output string, restored string")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): transformed and restored in one pass, of which only digests leave DuckDB."""
    p, s, m = MARKS
    sql = DIGESTS.format(rows=INVERSE.format(p=p, s=s, m=m, rows=_statement(seed, rate, spm)))
    schema = "id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return in_duckdb(_rows(docs, id_col, text_col), sql, schema).withColumnRenamed("id", id_col)
