"""The prediction log as a stream: the last row of each id, and a summary that takes back what a later row replaces."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from gradeframe.functions.text import strip
from gradeframe.operators.scoring import counters, summarise_counters
from gradeframe.plans.evaluate import score_rows
from gradeframe.sources.append import AppendLog
from gradeframe.sources.lines import SPLIT, placed_lines_stream
from gradeframe.types import PREDICTION


def read_log_stream(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """Rows of a JSONL file that grows, or of a folder of them; ord is (file, offset), as in read_predictions()."""
    lines = placed_lines_stream(spark, path, split).filter(strip(F.col("value")) != "")
    return lines.select(F.from_json("value", PREDICTION).alias("r"), F.struct("file", F.col("offset").alias("row")).alias("ord")).select("r.*", "ord")


def compact_stream(log: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Keyed last-write-wins state. There is no watermark: a retry must win however late it is."""
    rest = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(key, "last.*")


def start(log: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands the ids that changed in each batch to handle, e.g. to score them again, until the input is used up."""
    return compact_stream(log).writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Replace(StatefulProcessor):
    """Per id the last row by (file, row): a later one is given out with sign 1, and the one that it replaces with sign -1."""

    def __init__(self, schema: StructType):
        self.fields = schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.fields)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        place = lambda r: (r["file"], r["row"])
        latest = max(rows, key=place)
        names = self.fields.names
        old = Row(**dict(zip(names, self.last.get()))) if self.last.exists() else None
        if old is None or place(old) < place(latest):
            self.last.update(tuple(latest[c] for c in names))
            if old is not None:
                yield Row(**{c: -1 if c == "sign" else old[c] for c in names})
            yield Row(**{c: latest[c] for c in names})

    def close(self) -> None:
        pass


def changes(scored: DataFrame) -> DataFrame:
    """counters() of a stream of scored rows (with id and ord), with sign -1 for those that a later row of their id has replaced.

    Needs the RocksDB state store. Rows of one id may come in any order and in any batches.
    """
    rows = counters(scored, ("id", "ord")).select("id", F.col("ord.file").alias("file"), F.col("ord.row").alias("row"), *(c for c in counters(scored).columns))
    return rows.groupBy("id").transformWithState(Replace(rows.schema), rows.schema, "Update", "None")


def stream_summary(manifest: DataFrame, log: DataFrame, into: AppendLog, checkpoint: str, lenient: bool = True) -> StreamingQuery:
    """Scores a stream of log rows and adds the changes to the summary's counters to a log, each batch once. Ends when the input is used up."""
    out = changes(score_rows(manifest, log, lenient))
    return out.writeStream.outputMode("update").foreachBatch(into.sink()).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_log(spark: SparkSession, path: str, manifest: DataFrame) -> AppendLog:
    """The log that stream_summary() adds to."""
    none = spark.createDataFrame([], f"{PREDICTION}, ord struct<file: string, row: bigint>")
    fields = counters(score_rows(manifest, none)).schema
    return AppendLog(spark, path, "id string, file string, row bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields))


def summary_of_changes(log: AppendLog) -> DataFrame:
    """summarise() of the samples that the changes leave: what was taken back cancels out."""
    return summarise_counters(log.read().drop("id", "file", "row", "ord"))
