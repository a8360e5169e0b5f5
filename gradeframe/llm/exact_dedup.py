"""Exact dedup over a persistent digest index.

The index is a bucketed table, sorted by digest inside its buckets. A batch is
reduced to one row per digest before it meets the index, so that neither join
sees a group of copies; the index side of both joins is read without a shuffle.
"""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.llm.common import SPACES, checkpoint, join_counted, remove, shared_dir, table


def normalised(text: str | Column = "text") -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(col, F.lit("")), SPACES, " ")


#: Rows of the index that a bucket should have, about.
BUCKET_ROWS = 1_000_000


def buckets_for(rows: int) -> int:
    """Buckets for an index of so many rows: a power of two, 64 at least."""
    return max(64, 1 << max(0, rows // BUCKET_ROWS).bit_length())


class DigestIndex:
    """SHA-256 digests of all texts seen so far, each with the id that stays.

    The table lies in versions under `path`, by default a folder of the shared
    one, so it outlives the session if the path does: a session whose catalog
    doesn't know the last whole version takes it up. A version keeps the number of
    buckets that it was written with, which its folder's name says; `buckets` is for a
    new index only. Appends add a file to each bucket; compact() writes a new
    version with one sorted file a bucket, and may change their number.

    An append's rows carry its number and count once its mark is there, so one
    that died midway leaves nothing behind that is read. Re-running an append is
    harmless: digests that are there already are not appended again and keep their id.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None):
        self.spark, self.name, self.new_buckets = spark, name, buckets
        self.path = path or f"{shared_dir(spark)}/{name}"

    def _folders(self) -> list[tuple[int, int, str]]:
        """(number, buckets, folder) of whole versions, the last one first."""
        fs, folder = pafs.FileSystem.from_uri(self.path)
        found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
        whole = [f.base_name for f in found if f.base_name[:1] == "v" and fs.get_file_info(f"{f.path}/_SUCCESS").type == pafs.FileType.File]
        return sorted(((*map(int, v[1:].split("-")), v) for v in whole), reverse=True)

    def versions(self) -> list[str]:
        """Names of whole versions, the last one first."""
        return [f"v{number}" for number, _, _ in self._folders()]

    @property
    def buckets(self) -> int:
        """Buckets of the last whole version, or of the first one to be."""
        there = self._folders()
        return there[0][1] if there else self.new_buckets

    def exists(self) -> bool:
        there = self._folders()
        known = self.spark.catalog.tableExists(self.name)
        if known and there and not self.spark.sql(f"DESCRIBE FORMATTED {self.name}").filter("col_name = 'Location'").first().data_type.rstrip("/").endswith(f"/{there[0][2]}"):
            self.spark.sql(f"DROP TABLE {self.name}")  # of an older version; its files stay
            known = False
        if not known and there:
            _, buckets, folder = there[0]
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.spark.read.parquet(f"{self.path}/{folder}").schema)
            self.spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        return bool(there)

    def _appended(self, folder: str) -> list[int]:
        """Numbers of the appends that count, from 0."""
        fs, at = pafs.FileSystem.from_uri(f"{self.path}/{folder}")
        return sorted(int(f.base_name[8:]) for f in fs.get_file_info(pafs.FileSelector(at)) if f.base_name.startswith("_append-"))

    def read(self) -> DataFrame:
        """digest, keep_id of all appends that count."""
        self.exists()
        return self.spark.table(self.name).filter(F.col("append").isin(self._appended(self._folders()[0][2]))).select("digest", "keep_id")

    def _write(self, rows: DataFrame, table_name: str, folder: str, buckets: int, append: int) -> None:
        dealt = rows.select("digest", "keep_id", F.lit(append).alias("append")).repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest")
        dealt.mode("append").format("parquet").option("path", f"{self.path}/{folder}").saveAsTable(table_name)
        fs, at = pafs.FileSystem.from_uri(f"{self.path}/{folder}")
        with fs.open_output_stream(f"{at}/_append-{append}"):
            pass

    def append(self, groups: DataFrame) -> None:
        """Adds the digests of groups (digest, keep_id, ...; one row each) that are new."""
        new, (_, buckets, folder), number = groups.select("digest", "keep_id"), (0, self.new_buckets, f"v0-{self.new_buckets}"), 0
        if self.exists():
            new = new.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
            _, buckets, folder = self._folders()[0]
            number = self.spark.table(self.name).agg(F.max("append")).first()[0]
            number = 0 if number is None else number + 1  # an append that died has had its number
        self._write(new, self.name, folder, buckets, number)

    def compact(self, buckets: int | None = None) -> None:
        """Writes all rows as a new version, then removes the old ones; readers of those must be done."""
        if not self.exists():
            return
        old = self._folders()
        to, number = buckets or old[0][1], old[0][0] + 1
        self._write(self.read(), f"{self.name}_v{number}", f"v{number}-{to}", to, 0)
        self.spark.sql(f"DROP TABLE {self.name}_v{number}")  # the files are the version; exists() takes it up
        self.exists()
        for _, _, folder in old:
            remove(f"{self.path}/{folder}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.path)


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Appends docs to the index; a row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest doc_id of the batch that first brought the text, and
    group_size counts this batch's copies. Null texts count as empty and equal.
    Null ids lose to any other; a text with null ids only has a null keep_id.
    Of repeated rows (same id and text) one is kept. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows = checkpoint(
        docs.select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"))
        .groupBy("digest", "doc_id")
        .agg(F.count("*").alias("times"))
    )
    groups = checkpoint(
        rows.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"), F.count("*").alias("ids"))
    )
    before = index.exists()
    known = checkpoint(index.read().select("digest").hint("merge").join(groups.select("digest"), "digest", "left_semi")) if before else None
    index.append(groups)
    of_index = groups.drop("keep_id").join(index.read().hint("merge"), "digest")
    if known is None:
        of_index = of_index.withColumn("seen", F.lit(False))
    else:
        of_index = of_index.join(known.withColumn("seen", F.lit(True)), "digest", "left").fillna(False, ["seen"])
    resolved = checkpoint(of_index)
    joined = join_counted(rows, resolved, "digest", "ids", rows.count())
    first = (F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("seen")
    return joined.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("nth")).select(
        "doc_id", "keep_id", "group_size", first.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", buckets_for(docs.count()))
    try:
        return deduplicate(docs, index)
    finally:
        index.drop()  # what the result needs of it is checkpointed


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
