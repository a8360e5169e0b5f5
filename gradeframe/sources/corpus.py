"""Parquet corpora: shard choice, pruned scans, late materialisation of heavy columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def smallest_shard(spark: SparkSession, folder: str) -> str | None:
    """The smallest Parquet file of a folder, the first by name of equals."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    found = smallest(files, "path", F.col("length")).collect()
    return found[0].path if found else None


def smallest(rows: DataFrame, shard: str, size: Column) -> DataFrame:
    """shard, size: the shard whose rows' sizes sum to least, the first by name of equals. Null sizes count as 0; no rows give none."""
    sizes = rows.groupBy(shard).agg(F.sum(F.coalesce(size.cast("long"), F.lit(0))).alias("size"))
    return sizes.orderBy("size", F.asc_nulls_last(shard)).limit(1)


def with_ordinals(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The columns with each row's file and place in it; nothing else is read."""
    return spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))


#: Files that a filter names at most.
FILES = 10_000


def materialise(spark: SparkSession, path: str, chosen: DataFrame, *columns: str) -> DataFrame:
    """The (heavy) columns of the chosen (file, row_index) only.

    The chosen rows' files are found when this is called, and the scan leaves all
    other files out; a choice from more than FILES files scans all of them. Inside a
    file all of the columns are read: places of rows have no statistics to skip by.
    """
    chosen = chosen.select("file", "row_index")
    files = [r.file for r in chosen.select("file").distinct().limit(FILES + 1).collect()]  # a name for each file
    rows = spark.read.parquet(path)
    if len(files) <= FILES:
        rows = rows.filter(F.col("_metadata.file_path").isin(files))
    rows = rows.select(*columns, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    return rows.join(chosen, ["file", "row_index"], "left_semi")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Image files as bytes; decoding is left to whoever has a codec."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path", "length", "content")
