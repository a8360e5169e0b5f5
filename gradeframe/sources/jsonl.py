"""JSONL logs and manifests, read as text so that mixed-type values keep their kind."""

from __future__ import annotations

import json
import os

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.functions.parsing import parse_prediction
from gradeframe.functions.text import strip
from gradeframe.sources.lines import SPLIT, placed_lines
from gradeframe.types import PREDICTION, PROPERTIES


def read_lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """value and ord (file, row) of each line that isn't blank; row is the line's offset, files go by their names."""
    return placed_lines(spark, path, split).filter(strip(F.col("value")) != "").select("value", F.struct("file", F.col("offset").alias("row")).alias("ord"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The append-only prediction log: id, raw, n_tokens, seconds, gen_error, ord."""
    row = F.from_json("value", PREDICTION)
    return read_lines(spark, path).select(row.alias("r"), "ord").select("r.*", "ord")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """id, image, gold (record), scored_fields, properties; the last row of an id counts."""
    outer = F.from_json("value", f"id string, image string, scored_fields array<string>, properties {PROPERTIES}, source string")
    rows = read_lines(spark, path).select(outer.alias("r"), F.get_json_object("value", "$.gold").alias("gold"), "ord").select("r.*", "gold", "ord")
    last = rows.groupBy("id").agg(F.max_by(F.struct("image", "gold", "scored_fields", "properties", "source"), "ord").alias("r"), F.max("ord").alias("ord"))
    return last.select("id", "r.*", "ord").withColumn("gold", parse_prediction(F.col("gold"), lenient=False).chart)


def first_rows(df: DataFrame, n: int | None, order: str = "ord") -> DataFrame:
    """The first n rows in file order."""
    return df if n is None else df.orderBy(order).limit(n)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with nulls written; mode append for logs."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


#: How a score file names the tolerances.
SHOWN_TOLERANCES = {"va_01": "1%", "va_05": "5%", "va_10": "10%"}


def score_layout(row: dict) -> dict:
    """One summary row as a score file has it: accuracies by tolerance under one name, and the fully annotated samples."""
    out = {k: v for k, v in row.items() if k not in ("level", "key", "n_partially_annotated", *SHOWN_TOLERANCES)}
    return out | {"n_fully_annotated": row["n"] - row["n_partially_annotated"], "value_accuracy": {shown: row[k] for k, shown in SHOWN_TOLERANCES.items()}}


def score_json(summary: DataFrame, extra: dict | None = None) -> str:
    """A run's summary rows, a few dozen, and what else is said of it, as one indented JSON text."""
    rows = sorted((r.asDict() for r in summary.collect()), key=lambda r: r["key"])
    level = lambda name: {r["key"]: score_layout(r) for r in rows if r["level"] == name}
    return json.dumps({"overall": level("overall").get("all", {}), "by_chart_type": level("chart_type"), "by_series_count": level("series_count"), **(extra or {})}, indent=2)


def write_text(path: str, text: str) -> None:
    """A small text from the driver to a local path or a URI; folders are made, a file that is there is replaced."""
    fs, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(place) as out:
        out.write(text.encode())


def read_text(path: str) -> str | None:
    """The text of a small file; None if there is no such file."""
    fs, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))
    if fs.get_file_info(place).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(place) as f:
        return f.read().decode()
