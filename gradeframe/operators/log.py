"""Views of an append-only log in which the last row of an id counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.operators.ranks import middles


def is_error(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def compact(log: DataFrame, key: str | list[str] = "id", order: str = "ord") -> DataFrame:
    """The last row of each key, which may be several columns. One aggregation, combined before its shuffle."""
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in log.columns if c not in (*keys, order)]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("last"), F.max(order).alias(order)).select(*keys, "last.*", order)


def resume_view(log: DataFrame, key: str = "id", order: str = "ord", error: str = "gen_error") -> DataFrame:
    """Keys that need no retry: their last row is a success."""
    return compact(log, key, order).filter(~is_error(F.col(error)))


def pending(work: DataFrame, log: DataFrame, key: str = "id") -> DataFrame:
    return work.join(resume_view(log, key).select(key), key, "left_anti")


def scoring_view(log: DataFrame, key: str | list[str] = "id", order: str = "ord") -> DataFrame:
    """The last row of each key, failed ones too."""
    return compact(log, key, order)


def upper_median(c: str) -> Column:
    """Aggregate: the element at n // 2 of the sorted values, for groups of a few rows, which one task's buffer holds."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")


def timing(compacted: DataFrame, seconds: str = "seconds", tokens: str = "n_tokens") -> DataFrame:
    """One row: median_seconds, the upper one of all rows, found by rounds of histograms, and mean_tokens."""
    rows = compacted.select(F.lit(0).alias("all"), seconds, tokens)
    middle = middles(rows, ["all"], seconds).select("all", F.col("high").alias("median_seconds"))
    mean = rows.agg(F.avg(tokens).alias("mean_tokens")).withColumn("all", F.lit(0))
    return mean.join(middle, "all", "left").select("median_seconds", "mean_tokens")
