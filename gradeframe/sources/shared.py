"""Tables that are computed once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder and read from there on. A local master without one gets a temporary folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured is None and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="gradeframe-"))
    return df.checkpoint()


#: Rows for one task of a table that is dealt by its own size.
ROWS = 1 << 15


def parts(df: DataFrame, rows: int | None = None) -> int:
    """Partitions that a table is dealt into (ROWS rows each), so that a task's share doesn't grow with it. Of a Parquet table only the footers are read."""
    return df.count() // (rows or ROWS) + 1


#: Partitions up to which Spark writes a shuffle's rows as they come (its spark.shuffle.sort.bypassMergeThreshold).
STREAMED = 200


def spread_out(df: DataFrame, n: int, key: str) -> DataFrame:
    """df, by key in STREAMED partitions if it is to be dealt into more (n) by that key afterwards.

    A task keeps the rows that it writes to more than STREAMED partitions in memory. What a
    task reads of a file is as many rows as fit its bytes, so such rows are dealt twice. Between the
    two has to be a projection that renames or computes something, or Spark takes both for one.
    """
    return df.repartition(STREAMED, key) if n > STREAMED else df
