"""What the document operators share: checkpoints, skew-safe joins, table access."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is the session's checkpoint folder. Only a local master, as in tests, may
    get one of its own in a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="gradeframe-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df once to the shared checkpoint folder and cuts its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(path: str) -> None:
    """Deletes a folder of the shared file system, given as a URI, if it is there."""
    fs, folder = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(folder).type == pafs.FileType.Directory:
        fs.delete_dir(folder)


#: Narrow rows that a written file should have at least.
ROWS = 50_000


class Scratch:
    """Tables that an operator writes to the shared folder, in less space than a checkpoint, and deletes at its end.

    Only for what no result still reads: leave with a checkpoint of it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.count = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.path)

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """df, written and read again. With a bound on its rows (narrow ones), no more files than they are worth."""
        self.count += 1
        if rows is not None:
            df = df.coalesce(rows // ROWS + 1)
        path = f"{self.path}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_type(docs: DataFrame) -> str:
    """The type of doc_id, for the schemas of Arrow functions that carry it: ids may be integers or texts."""
    return docs.schema["doc_id"].dataType.simpleString()


def id_text(col: str = "doc_id") -> Column:
    """doc_id as text; null counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


#: Rows up to which a join needs no care: one key can't have more, and one task takes as many easily.
FEW = 1 << 17


def join_counted(rows: DataFrame, stats: DataFrame, key: str | list[str], count: str, total: int, share: int = 256, how: str = "inner") -> DataFrame:
    """Inner (or left) join of rows with one stats row per key, where stats[count] is the key's number of rows.

    Keys that hold more than total / share of the rows are at most `share` by the
    pigeonhole principle, so broadcasting them is bounded; a shuffle join takes
    the others, none of which holds more than that part of the rows.
    """
    keys = [key] if isinstance(key, str) else key
    if total <= FEW:
        return rows.join(stats, keys, how)
    is_hot = F.col(count) * share > total
    hot = stats.filter(is_hot)
    by_broadcast = rows.join(F.broadcast(hot), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return by_broadcast.unionByName(cold.join(stats.filter(~is_hot), keys, how))


def join_split(rows: DataFrame, wide: DataFrame, key: str, total: int, part: int = 256) -> DataFrame:
    """Inner join of rows with one wide row per key, where wide["pairs"] is the key's number of rows.

    Of keys with many rows, the wide row is copied once for each `part` of them and
    they are dealt to the copies, so no task gets more of one key.
    """
    if total <= 32 * part:
        return rows.join(wide.drop("pairs"), key)
    parts = F.ceil(F.col("pairs") / part)
    counts = join_counted(rows, wide.select(key, "pairs").filter(F.col("pairs") > part), key, "pairs", total)
    dealt = counts.select(*rows.columns, F.pmod(F.xxhash64(*rows.columns), parts).alias("__part"))
    many, few = F.col("pairs") > part, F.col("pairs") <= part
    copies = wide.filter(many).withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("pairs")
    return dealt.join(copies, [key, "__part"]).drop("__part").unionByName(rows.join(wide.filter(few).drop("pairs"), key))
