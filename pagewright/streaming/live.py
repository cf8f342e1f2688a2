"""EXTENSION: the same page tables over streams. The batch operators are the reference; these follow them within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_page_rows(stream: DataFrame, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream without the repeats of (case_id, page) that arrive within the watermark."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["case_id", "page"])


def activity(stream: DataFrame, time_col: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """(window, page_type, n_pages) in tumbling windows."""
    counted = stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), "page_type")
    return counted.agg(F.count("*").alias("n_pages"))


def upsert_batches(stream: DataFrame, path: str, key: list[str]):
    """A writer of the rows of each micro-batch whose key no earlier batch has, one folder batch=N below path for each batch.

    A batch that is tried again replaces its own folder and looks only at earlier ones, so it adds nothing twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(key)
        if batch_id > 0:
            done = batch.sparkSession.read.schema(batch.select(*key).schema.add("batch", "long")).parquet(path)
            rows = rows.join(done.where(F.col("batch") < batch_id).select(*key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write)
