"""Exact order statistics and running sums over tables of any size.

No task holds a group's values. A statistic is found by rounds of histograms, each
combined before its shuffle: a bucket is a non-decreasing function of the value, so
the bucket that has the wanted place has its value. A running sum adds up blocks of
the order first, then the rows inside each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeframe.sources.shared import checkpointed

#: Buckets for each factor of e, of the first round; what keeps them apart from 0; and where infinity and NaN go.
FINE, OFFSET, END = 45, 40_000, 100_000
#: Buckets of a later round. Doubles of one first bucket are fewer than SPLIT ** ROUNDS.
SPLIT, ROUNDS = 1 << 17, 3
#: Rows that one task puts in order easily.
FEW = 1 << 17


def coarse(value: Column) -> Column:
    """At most 2 x END whole numbers that grow with a double: by its logarithm."""
    size = F.floor(F.log(F.abs(value)) * FINE) + OFFSET
    return F.when(F.isnan(value), END + 1).when(F.abs(value) == float("inf"), F.signum(value) * END).when(value == 0, 0).otherwise(F.signum(value) * size).cast("long")


def fine(value: Column, low: Column, high: Column) -> Column:
    """0 to SPLIT by a value's place between two others; halves, so that no difference is infinite."""
    large = F.abs(low) + F.abs(high) > 1e300
    part = F.when(large, F.try_divide(value / 2 - low / 2, high / 2 - low / 2)).otherwise(F.try_divide(value - low, high - low))
    return F.floor(part * SPLIT).cast("long")


def _same(by: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by))


def middles(df: DataFrame, by: list[str], value: str, times: str | None = None) -> DataFrame:
    """by, n, low, high: of each group of a double's values that aren't null, those at (n - 1) // 2 and n // 2 in order, NaN last.

    Groups of nulls only have a row with n = 0; keys may be null. With `times`, rows
    count that often; what sums to nothing isn't there. The (by, value, count) rows,
    in which equal values are one, are computed once, when this is called. Up to FEW of
    them are put in order as they are, which one task can do.
    """
    keys = [F.col(c) for c in by] or [F.lit(0).alias("all")]
    names = by or ["all"]
    each = F.lit(1) if times is None else F.col(times)
    counts = df.select(*keys, F.col(value).cast("double").alias("v"), each.cast("long").alias("times")).groupBy(*names, "v").agg(F.sum(F.when(F.col("v").isNull(), 0).otherwise(F.col("times"))).alias("times"))
    counts = checkpointed(counts)
    sizes = counts.groupBy(*names).agg(F.sum("times").alias("n"))
    rows = counts.filter(F.col("v").isNotNull() & (F.col("times") > 0))
    wanted = sizes.select(*names, "n", F.floor((F.col("n") - 1) / 2).alias("i"), F.floor(F.col("n") / 2).alias("j"))
    found = _in_order(rows, wanted, names) if counts.count() <= FEW else _by_rounds(rows, wanted, names)
    done = sizes.alias("r").join(found.alias("s"), _same(names), "left").select(*(f"r.{c}" for c in names), "r.n", "s.low", "s.high")
    return done.select(*by, "n", "low", "high")


def _in_order(rows: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    before = W.partitionBy(*names).orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("times").over(before), F.lit(0)))
    both = placed.alias("r").join(wanted.alias("s"), _same(names))
    has = lambda k: (F.col(k) >= F.col("start")) & (F.col(k) < F.col("start") + F.col("times"))
    of = lambda k: F.max(F.when(has(k), F.col("v")))
    return both.filter(has("i") | has("j")).groupBy(*(F.col(f"s.{c}").alias(c) for c in names)).agg(of("i").alias("low"), of("j").alias("high"))


def _by_rounds(rows: DataFrame, wanted: DataFrame, names: list[str]) -> DataFrame:
    state = None
    for _ in range(ROUNDS + 1):  # each round reads the one before once, so the plan grows by the round only
        summed = (F.sum("times").alias("times"), F.min("v").alias("from"), F.max("v").alias("to"))
        before = W.partitionBy(*names).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # 2 x END or SPLIT buckets at most
        sofar = F.coalesce(F.sum("times").over(before), F.lit(0))
        if state is None:
            hist = rows.groupBy(*names, coarse(F.col("v")).alias("bucket")).agg(*summed).withColumn("start", sofar)
            none = F.lit(None).cast("double")
            both = hist.alias("r").join(wanted.alias("s"), _same(names)).select(*(f"s.{c}" for c in (*names, "n", "i", "j")), "times", "from", "to", "start", none.alias("low"), none.alias("high"))
        else:
            inside = F.when(F.col("s.low").isNull(), (F.col("r.v") >= F.col("s.from")) & (F.col("r.v") <= F.col("s.to"))).otherwise(F.col("r.v") == F.col("s.low"))  # what is found stays, as one row
            kept = [*names, "n", "i", "j", "under", "low", "high"]
            near = rows.alias("r").join(state.alias("s"), _same(names) & inside)
            hist = near.select(*(f"s.{c}" for c in kept), fine(F.col("r.v"), F.col("s.from"), F.col("s.to")).alias("bucket"), "r.v", "r.times").groupBy(*kept, "bucket").agg(*summed)
            both = hist.withColumn("start", F.col("under") + sofar)
        has = lambda k: F.col("low").isNull() & (F.col(k) >= F.col("start")) & (F.col(k) < F.col("start") + F.col("times"))
        of = lambda k, c: F.max(F.when(has(k), F.col(c)))
        found = both.filter(has("i") | has("j") | F.col("low").isNotNull()).groupBy(*names, "n", "i", "j").agg(
            of("i", "start").alias("under"), of("i", "from").alias("from"), of("i", "to").alias("to"), of("j", "from").alias("from_j"), of("j", "start").alias("under_j"), F.max("low").alias("low"), F.max("high").alias("high")
        )
        apart, one = F.col("under") < F.col("under_j"), F.col("from") == F.col("to")
        low = F.coalesce("low", F.when(apart | one, F.col("to")))  # next to each other in the order: the last of one bucket and the first of the next
        high = F.coalesce("high", F.when(apart, F.col("from_j")).when(one, F.col("from")))
        state = found.select(*names, "n", "i", "j", "under", "from", "to", low.alias("low"), high.alias("high"))
    return state.select(*names, "low", "high")


def median(df: DataFrame, by: list[str], value: str, times: str | None = None) -> DataFrame:
    """by and median: the mean of the two middle values; null without any."""
    return middles(df, by, value, times).select(*by, ((F.col("low") + F.col("high")) / 2).alias("median"))


#: Rows of a block, about, whose running sums one task makes, and cuts that one step of a search looks at.
BLOCK, STEP = 100_000, 64


def block_of(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are less than a value: first among every STEP-th of them, then among those that follow it."""
    if not cuts:
        return F.lit(0)
    less = lambda some: F.size(F.filter(some, lambda c: c < value))
    at = F.greatest(less(F.lit(cuts[::STEP])) - 1, F.lit(0)) * STEP
    return at + less(F.slice(F.lit(cuts), at + 1, STEP))


def running_sums(df: DataFrame, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """order, value, nth (from 1), n_values (that aren't null) and total so far, in the order of a number column, null first.

    Rows of one place in the order count in the order of their values and share a
    block; otherwise a block has about `block` rows, as its ends are approximate
    quantiles of the order. Blocks are added up before the shuffle, and a window
    sees the rows of one block only. The quantiles are found when this is called.
    """
    counts = df.select(F.col(order).alias("o"), F.col(value).alias("v")).groupBy("o", "v").agg(F.count("*").alias("times"))
    parts = max(1, -(-df.count() // block))
    cuts = df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], max(10_000, 10 * parts))).first()[0] if parts > 1 else []
    placed = counts.withColumn("block", F.when(F.col("o").isNull(), -1).otherwise(block_of(F.col("o"), sorted(set(cuts or [])))))
    placed = placed.withColumn("some", F.when(F.col("v").isNotNull(), F.col("times")).otherwise(0)).withColumn("sum", F.coalesce(F.col("v") * F.col("times"), F.lit(0)))
    sums = ("times", "some", "sum")
    blocks = placed.groupBy("block").agg(*(F.sum(c).alias(c) for c in sums))
    earlier = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    starts = blocks.select("block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in sums))
    inner = W.partitionBy("block").orderBy("o", "v").rowsBetween(W.unboundedPreceding, -1)
    begun = placed.join(starts, "block").select("o", "v", "times", *((F.col(f"{c}_before") + F.coalesce(F.sum(c).over(inner), F.lit(0))).alias(f"{c}_before") for c in sums))
    each = begun.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    present = F.when(F.col("v").isNotNull(), F.col("copy")).otherwise(0)
    return each.select(
        F.col("o").alias(order), F.col("v").alias(value), (F.col("times_before") + F.col("copy")).alias("nth"), (F.col("some_before") + present).alias("n_values"),
        (F.col("sum_before") + F.coalesce(F.col("v") * F.col("copy"), F.lit(0))).alias("total"),
    )
