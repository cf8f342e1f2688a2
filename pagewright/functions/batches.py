"""What goes to Python workers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Of one Arrow batch that goes to a Python worker.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches hold at most BATCH_BYTES, so that what a Python worker holds doesn't grow with the texts.

    Both are limits of the session: they hold for every later query of it, and lower ones that are set already stay.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = int(conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df
