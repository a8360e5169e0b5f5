"""An append-only table that a run can be killed at and started again: each batch counts once or not at all."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.operators.log import pending
from gradeframe.sources.lines import opened


class AppendLog:
    """Batches of rows, a folder of Parquet files each, and a ledger of those that are whole.

    A batch is written to its own folder, anew if it is there, and then marked in the
    ledger; readers go by the ledger. So a run that died while it wrote leaves nothing
    that is read, and one that comes again with a batch that is marked leaves it alone.
    Rows come back with `ord`, struct<batch, row>: their order is that of the batches.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _at(self, name: str) -> tuple[pafs.FileSystem, str]:
        return opened(f"{self.path}/{name}")

    def batches(self) -> list[int]:
        """Numbers of the batches that are whole."""
        fs, place = self._at("ledger")
        return sorted(int(f.base_name) for f in fs.get_file_info(pafs.FileSelector(place, allow_not_found=True)) if f.base_name.isdigit())

    def read(self) -> DataFrame:
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], f"{self.schema}, ord struct<batch: bigint, row: bigint>")
        rows = self.spark.read.schema(f"{self.schema}, append_batch bigint, append_row bigint").option("basePath", self.path).parquet(*(f"{self.path}/append_batch={n}" for n in found))
        return rows.withColumn("ord", F.struct(F.col("append_batch").cast("long").alias("batch"), F.col("append_row").alias("row"))).drop("append_batch", "append_row")

    def append(self, rows: DataFrame, batch: int) -> None:
        """Adds rows as a batch of this number, unless there is one."""
        if batch in self.batches():
            return
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        rows.select(*names, F.monotonically_increasing_id().alias("append_row")).write.mode("overwrite").parquet(f"{self.path}/append_batch={batch}")
        fs, place = self._at("ledger")
        fs.create_dir(place, recursive=True)
        with fs.open_output_stream(f"{place}/{batch}"):
            pass

    def run(self, work: DataFrame, step: Callable[[DataFrame], DataFrame], key: str = "id", parts: int = 1) -> int:
        """Does what is left of work: rows whose key has no success here yet, `parts` batches of them. Returns how many batches were added.

        A run that is killed loses the batch that it was at; the next one begins with
        what is pending then. step gives rows with the key and gen_error.
        """
        left = pending(work, self.read(), key)
        first = max(self.batches(), default=-1) + 1
        for k in range(parts):
            self.append(step(left.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == k)), first + k)
        return parts

    def sink(self, step: Callable[[DataFrame], DataFrame] = lambda rows: rows, key: str | None = None) -> Callable[[DataFrame, int], None]:
        """A handler for foreachBatch: the stream's batch n is batch n here, so a restarted stream adds it once. With a key, rows whose key has a success go before step."""

        def handle(rows: DataFrame, batch: int) -> None:
            if batch not in self.batches():
                self.append(step(rows if key is None else pending(rows.dropDuplicates([key]), self.read(), key)), batch)

        return handle
