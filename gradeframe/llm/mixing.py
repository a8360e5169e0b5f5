"""Mixing sources to target weights along a training curriculum.

Each source has a target amount of words and a weight schedule over training
time 0 to 1, linear from `start` to `end`. The integral of the schedule, scaled
to the target, is the source's cumulative demand; a document that begins at
offset c of its source's stream is due when the demand reaches c, which a
quadratic formula inverts. Documents are then range-sorted by that position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeframe.llm.common import WORDS, checkpoint, table

#: No source is taken more than this many times over.
MOST = 3
#: Rows of a source that one window partition orders.
BLOCK = 4000
#: The sources' table is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 10_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets for (skey, source, source_size, n_rows): one row per source is read and returned.

    Sources in code point order, null last, weigh 1, 2, 3, repeating. All sizes
    are shared out by weight; a target stops at MOST times its source's size and
    the excess is shared by weight again. The fixed point of that is a level at
    which every source gets the lesser of weight * level and its cap, found here
    with prefix sums over the sources in the order in which they reach their cap.
    """
    by_cap = W.orderBy("reach", "nth").rowsBetween(W.unboundedPreceding, W.currentRow)
    everyone = W.partitionBy()
    ranked = (
        sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", ((F.col("nth") - 1) % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * float(MOST))
        .withColumn("reach", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everyone).cast("double"))
        .withColumn("capped", F.sum("cap").over(by_cap))
        .withColumn("left_weight", F.sum("weight").over(everyone) - F.sum("weight").over(by_cap) + F.col("weight"))
        # the level if this source and all that reach their cap later are below theirs
        .withColumn("level", (F.col("total") - F.col("capped") + F.col("cap")) / F.col("left_weight"))
    )
    level = F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(everyone)
    share = F.coalesce(F.col("weight") * level, F.col("cap"))
    return ranked.withColumn("target", F.round(F.least(share, F.col("cap")), 6)).select(
        "skey", "source", "source_size", "n_rows", "target", "nth", "weight"
    )


def source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))


def due(demand: Column, weight: Column) -> Column:
    """The training time, 0 to 1, at which a source of this weight has given this part of its target.

    Its schedule leads from the weight at time 0 to 4 less the weight at time 1: later sources of a trio gain,
    earlier ones lose.
    """
    start, slope = weight, 4.0 - 2 * weight
    part = F.least(F.lit(1.0), demand)
    when = F.when(slope == 0, part).otherwise((F.sqrt(start * start + 4 * slope * part) - start) / F.nullif(slope, F.lit(0.0)))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), when)), 9)


def schedule(docs: DataFrame, whole: bool = False) -> DataFrame:
    """A row per input row: skey, doc_id, size, source_size, target, taken, copies, position, `row` (a digest of the text), offset (words before it in its source's stream) and weight.

    Documents stand in their source's stream in the order of a digest of their
    id. All are taken floor(target / source_size) times and the stream's start,
    up to the remainder, once more; so only the last one of these can be cut,
    and with `whole` it is taken if half of it or more would be. position is the
    training time, 0 to 1, of the document's first copy. copies counts started
    copies. Rerunning gives the same rows.

    A null source is one of the sources; null and empty texts have size 0, take
    nothing and have no copies; equal rows are told apart by their order only.
    """
    ids = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = checkpoint(
        docs.select(source_key().alias("skey"), "doc_id", word_count().alias("size"), ids.alias("place"), F.md5(F.coalesce("text", F.lit(""))).alias("row"))
    )
    per_source = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    source = F.when(F.col("skey") == "-", F.lit(None)).otherwise(F.substring("skey", 2, 1 << 30))
    targets = checkpoint(source_targets(per_source.withColumn("source", source)))
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    # 16 bits of the digest order a source's blocks; blocks of about BLOCK rows are ordered inside
    part = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BLOCK))
    blocked = rows.join(targets.drop("source"), "skey").withColumn("block", F.shiftright(part * blocks, 32))
    before = W.partitionBy("skey").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        blocked.groupBy("skey", "block")
        .agg(F.sum("size").alias("block_size"))
        .select("skey", "block", F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("block_start"))
    )
    inside = W.partitionBy("skey", "block").orderBy("place", "doc_id", "size", "row").rowsBetween(W.unboundedPreceding, -1)
    offset = F.col("block_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    begun = blocked.join(starts, ["skey", "block"]).withColumn("offset", offset)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target")).cast("long") - F.col("full") * F.col("source_size")
    part_taken = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset")))
    if whole:
        part_taken = F.when(2 * part_taken >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    taken = begun.withColumn("full", full).withColumn("rest", rest).withColumn("more", part_taken.cast("long"))
    demand = F.when(F.col("target") > 0, F.col("offset") / F.col("target")).otherwise(F.lit(0.0))
    return taken.select(
        "skey",
        "doc_id",
        "row",
        "size",
        "source_size",
        "target",
        (F.col("full") * F.col("size") + F.col("more")).cast("long").alias("taken"),
        F.when(F.col("size") == 0, F.lit(0)).otherwise(F.col("full") + (F.col("more") > 0).cast("long")).cast("long").alias("copies"),
        due(demand, F.col("weight")).alias("position"),
        "offset",
        "weight",
    )


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, whole, once per copy and range-sorted by training position, with the columns of docs.

    The k-th copy (from 0) of a document has its own position: where its source's
    demand reaches k times the source's size and the document's offset. So a source
    that is taken twice gives its second copies in the second half of its stream,
    among the other sources' documents of that time.

    Null and empty texts have no words and aren't taken; null ids and sources are
    values like others. Rows with equal id, text and source share their copies,
    one plan row each. An empty table gives an empty result.
    """
    names = docs.columns
    part = lambda c: F.coalesce(F.concat(F.lit("+"), c), F.lit("-"))
    key = lambda row: F.md5(F.concat_ws("|", part(F.col("doc_id").cast("string")), row, F.col("skey")))
    given = ("copies", "offset", "source_size", "target", "weight")
    plan = schedule(docs, whole=True).filter("copies > 0").select(key(F.col("row")).alias("__key"), F.struct(*given).alias("__plan"))
    plan = checkpoint(plan.withColumn("__nth", F.row_number().over(W.partitionBy("__key").orderBy("__plan"))))
    counted = plan.groupBy("__key").agg(F.max("__nth").alias("__rows"), F.min(F.when(F.col("__nth") == 1, F.col("__plan"))).alias("__first"))
    text_row = F.md5(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.withColumn("__key", F.md5(F.concat_ws("|", part(F.col("doc_id").cast("string")), text_row, source_key())))
    joined = keyed.join(counted, "__key").withColumn("__nth", F.row_number().over(W.partitionBy("__key").orderBy("__key")))
    joined = joined.filter(F.col("__nth") <= F.col("__rows"))
    once = joined.filter("__nth = 1").select(*names, "__key", F.col("__first").alias("__plan"))
    again = joined.filter("__nth > 1").select(*names, "__key", "__nth").join(plan.filter("__nth > 1"), ["__key", "__nth"]).select(*names, "__key", "__plan")
    rows = once.unionByName(again)
    spread = rows.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__plan.copies") - 1)))
    demand = (F.col("__copy") * F.col("__plan.source_size") + F.col("__plan.offset")) / F.col("__plan.target")
    placed = spread.withColumn("__position", due(demand, F.col("__plan.weight"))).drop("__plan")
    by = ["__position", "__key", "__copy"]
    return placed.repartitionByRange(*by).sortWithinPartitions(*by).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = schedule(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken", "copies", "position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place, md5(coalesce(text, '')) AS tie
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
  FROM d GROUP BY source
), fill AS (  -- rounds of sharing: those above their cap stop there
  SELECT 0 AS round, source, source_size, weight, false AS stopped FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         stopped OR weight * (sum(source_size) OVER () - coalesce(sum(source_size * 3.0) FILTER (stopped) OVER (), 0))
                    / (sum(weight) FILTER (NOT stopped) OVER ()) > 3.0 * source_size
  FROM fill WHERE round < 12
), t AS (
  SELECT source, source_size, weight,
         round(least(3.0 * source_size, CASE WHEN stopped THEN 3.0 * source_size ELSE
           weight * (sum(source_size) OVER () - coalesce(sum(source_size * 3.0) FILTER (stopped) OVER (), 0))
           / (sum(weight) FILTER (NOT stopped) OVER ()) END)::DOUBLE, 6) AS target
  FROM fill WHERE round = 12
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, floor(t.target / nullif(t.source_size, 0)) AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size, d.tie
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, greatest(0, least(size, round(target)::BIGINT - (coalesce(whole, 0) * source_size)::BIGINT - start))::BIGINT AS more,
         CASE WHEN target > 0 THEN least(1.0, start / target) ELSE 0 END AS demand, 4 - 2 * weight AS slope
  FROM o
)
SELECT doc_id, size, source_size, target, (coalesce(whole, 0) * size)::BIGINT + more AS taken,
       CASE WHEN size = 0 THEN 0 ELSE coalesce(whole, 0)::BIGINT + (more > 0)::BIGINT END AS copies,
       round(least(1, greatest(0, CASE WHEN slope = 0 THEN demand
             ELSE (sqrt(weight * weight + 2 * slope * (demand * 4 / 2)) - weight) / slope END))::DOUBLE, 9) AS position
FROM p
"""
