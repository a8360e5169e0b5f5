"""A uniform shuffle into shards of exact size.

Partition p sends A[p, s] rows to shard s, where the matrix A is drawn from the
law that a uniform permutation of all rows would give it: row by row
multivariate hypergeometric over the room that is left in the shards. Each
partition permutes its rows and deals them out by its row of A; each shard then
permutes what it got. Which rows meet is decided by random draws only, so equal
texts are dealt out like any others.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import e, floor, lgamma, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeframe.llm.common import checkpoint, id_type, table

#: Partitions that deal rows; more are merged first, which bounds the matrix.
DEALERS = 4096
#: Rows that one task orders inside a shard.
BLOCK = 4000


def stirling_error(n: float) -> float:
    """log n! less Stirling's formula for it, n log n - n + log(2 pi n) / 2."""
    if n < 16:
        return lgamma(n + 1) - (n + 0.5) * log(n) + n - 0.5 * log(2 * pi) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * m)) / m) / m) / n


def deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, by a series where these nearly cancel."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * log(x / mean) + mean - x
    v = (x - mean) / (x + mean)
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while True:
        term *= v * v
        k += 2
        if total + term / k == total:
            return total
        total += term / k


def log_binomial(x: int, n: int, p: float) -> float:
    """log of the binomial probability of x, to full precision for n of any size (Loader's saddle point)."""
    if x == 0:
        return n * log1p(-p)
    if x == n:
        return n * log(p)
    error = stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
    return error - 0.5 * (log(2 * pi * x) + log1p(-x / n))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` rows out of good + bad are good; exact in law for counts far beyond 2^31.

    Rejection by the ratio of uniforms (Stadlober), the probabilities being those of
    two binomials whose sum is known.
    """
    total = good + bad
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    p = drawn / total
    log_of = lambda k: log_binomial(k, good, p) + log_binomial(drawn - k, bad, p)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    top, mean = log_of(mode), drawn * (good / total)
    width = 2 * sqrt(2 / e) * sqrt(mean * (bad / total) * ((total - drawn) / max(1, total - 1)) + 0.5) + 3 - 2 * sqrt(3 / e)
    while True:
        u, v = rng.random(2)
        if u == 0:
            continue
        k = floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * log(u) <= log_of(k) - top:
            return k


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows of each dealer for each shard; shard sizes differ by one at most."""
    rng = np.random.default_rng(seed)
    total = int(counts.sum())
    room = [total // shards] * shards
    for s in rng.permutation(shards)[: total % shards]:
        room[s] += 1
    out = np.zeros((len(counts), shards), dtype=np.int64)
    for p, n in enumerate(counts.tolist()):
        rest = sum(room)
        for s in range(shards):
            rest -= room[s]
            out[p, s] = got = hypergeometric(rng, room[s], rest, n)
            room[s] -= got
            n -= got
    return out


def assign(docs: DataFrame, shards: int = 40, seed: int = 7) -> DataFrame:
    """A row per input row: doc_id, size, text_crc32, shard, slot.

    size is the text's UTF-8 bytes plus 16; a null text has no bytes and the crc
    of none. Null and repeated ids and equal rows are rows like any others: the
    law `rows` (shard counts at most one apart) counts rows. Slots of a shard run
    from 0 without gaps. An empty table gives an empty result; other columns are
    ignored.

    The rows' keys are checkpointed before anything is drawn, so a lost executor
    recomputes the same shuffle from the same partitions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keys = checkpoint(keys)
    if keys.rdd.getNumPartitions() > DEALERS:
        keys = checkpoint(keys.coalesce(DEALERS))
    n_parts = keys.rdd.getNumPartitions()
    counts = np.zeros(n_parts, dtype=np.int64)
    for p, n in keys.groupBy(F.spark_partition_id().alias("p")).count().collect():  # at most DEALERS rows
        counts[p] = n
    matrix = communication_matrix(counts, shards, seed)
    total = int(counts.sum())
    blocks = max(1, -(-total // (shards * BLOCK)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, p])
        to = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), matrix[p]))
        at = 0
        for batch in batches:
            n = batch.num_rows
            again = rng.integers(0, 1 << 62, n, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to[at : at + n]), pa.array(again)], names=[*batch.schema.names, "shard", "key"])
            at += n

    dealt = keys.mapInArrow(deal, f"doc_id {id_type(docs)}, size long, text_crc32 long, shard int, key long")
    dealt = checkpoint(dealt.withColumn("block", F.expr(f"cast((key >> 31) * {blocks} >> 31 as int)")))
    per_block = dealt.groupBy("shard", "block").count()
    earlier = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = per_block.select("shard", "block", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "block").orderBy("key", "doc_id", "text_crc32", "size")
    return dealt.join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(inside) - 1).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 7) -> DataFrame:
    """Writes the documents as path/shard=N/, each in slot order, with their slot; returns the assignment.

    Null and repeated ids and equal rows are rows like any others: rows that are
    alike in id, size and crc are interchangeable and get their places in any
    order. Input columns `shard` and `slot` are written as input_shard and
    input_slot. An empty table writes no rows.
    """
    where = checkpoint(assign(docs, shards, seed))
    renamed = docs.withColumnsRenamed({c: f"input_{c}" for c in docs.columns if c in ("shard", "slot")})
    key = lambda size, crc: F.md5(F.concat_ws("|", F.coalesce(F.concat(F.lit("+"), F.col("doc_id").cast("string")), F.lit("-")), size, crc))
    alike = F.row_number().over(W.partitionBy("__key").orderBy("__key"))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = renamed.withColumn("__key", key((F.octet_length(text) + 16).cast("long"), F.crc32(text.cast("binary")))).withColumn("__nth", alike)
    places = where.select(key(F.col("size"), F.col("text_crc32")).alias("__key"), "shard", "slot").withColumn("__nth", F.row_number().over(W.partitionBy("__key").orderBy("shard", "slot")))
    whole = own.join(places, ["__key", "__nth"]).drop("__key", "__nth")
    files = max(shards, where.count() // 1_000_000)
    whole.repartitionByRange(files, "shard", "slot").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return where.select("doc_id", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
