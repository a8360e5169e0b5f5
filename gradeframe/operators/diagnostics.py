"""Frequency tables, run comparison, failures, repetition and measurement rows."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gradeframe.functions.text import html_escape
from gradeframe.operators.log import upper_median
from gradeframe.operators.ranks import running_sums


def frequencies(df: DataFrame, column: str, order: str | None = None) -> DataFrame:
    """Counts of a column's values (of an array's, exploded) and their share of the rows, most frequent first."""
    total = df.agg(F.count("*").alias("total"))
    kind = df.schema[column].dataType.typeName()
    values = df.select(F.explode(column).alias("value")) if kind == "array" else df.select(F.col(column).alias("value"))
    counts = values.groupBy("value").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("value", "n", F.try_divide(F.col("n").cast("double"), "total").alias("share"))  # total is one row


def failure_rates(df: DataFrame, by: str, failed: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.avg(failed.cast("double")).alias("failure_rate"))


def run_difference(a: DataFrame, b: DataFrame, key: str, raw: str) -> DataFrame:
    """One row: ids in both runs, how many of them have byte-identical answers, and ids that only the first or the second run has."""
    left, right = (df.select(key, F.col(raw).alias(name), F.lit(True).alias(f"in_{name}")) for df, name in ((a, "a"), (b, "b")))
    every, has_a, has_b = left.join(right, key, "full"), F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    same = has_a & has_b & F.col("a").eqNullSafe(F.col("b"))
    return every.agg(F.count_if(has_a & has_b).alias("n"), F.count_if(same).alias("n_identical"), F.count_if(~has_b).alias("n_only_first"), F.count_if(~has_a).alias("n_only_second"))


def draws(key: Column, k: Column, seed: int) -> Column:
    """A fraction from 0 to below 1 for the k-th draw of a row, from a digest of seed, row and k."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"), F.lit(":"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


#: Chances that a Poisson draw of mean 1 is over 0, 1, 2, ...: what is beyond has less than 2^-32.
OVER = [1 - exp(-1) * sum(1 / factorial(j) for j in range(n + 1)) for n in range(12)]


def paired_differences(samples: DataFrame, metrics: list[str], base: str, key: str = "id", rounds: int = 200, seed: int = 0) -> DataFrame:
    """run, metric, n, mean, low, high: of each other run's samples less those of run `base` with the same key.

    low and high are the 2.5 and 97.5 % points of the mean over `rounds` bootstrap
    rounds. A sample counts in each round by a Poisson draw of its key, the same for
    all runs and metrics, so a round needs no order of rows and is one aggregation.
    Samples without a value in either run don't count.
    """
    of_base = samples.filter(F.col("run") == base).select(key, F.struct(*metrics).alias("theirs"))
    both = samples.filter(F.col("run") != base).select("run", key, *metrics).join(of_base, key)
    differences = F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(m).cast("double") - F.col(f"theirs.{m}").cast("double")).alias("d")) for m in metrics))
    each = both.select("run", key, F.explode(differences).alias("x")).select("run", key, "x.*").filter(F.col("d").isNotNull())
    weighed = each.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))  # round 0 is the data itself
    u = draws(F.col(key), F.col("round"), seed)
    weight = F.when(F.col("round") == 0, 1).otherwise(sum((u < p).cast("int") for p in OVER[1:]) + (u < OVER[0]).cast("int"))
    means = weighed.withColumn("w", weight).groupBy("run", "metric", "round").agg(F.try_divide(F.sum(F.col("d") * F.col("w")), F.sum("w")).alias("mean"), F.count("*").alias("n"))
    at = lambda p: F.expr(f"percentile(CASE WHEN round > 0 THEN mean END, {p})")  # noqa: E731  of `rounds` values
    return means.groupBy("run", "metric").agg(F.max(F.when(F.col("round") == 0, F.col("n"))).alias("n"), F.max(F.when(F.col("round") == 0, F.col("mean"))).alias("mean"), at(0.025).alias("low"), at(0.975).alias("high"))


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs under a column `run`; columns that a run lacks are null."""
    named = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def failures(samples: DataFrame) -> DataFrame:
    return samples.filter(~((F.col("va_05") >= 0.9) & F.col("valid_json")))


def first_failures(samples: DataFrame, n: int, order: str) -> DataFrame:
    return failures(samples).orderBy(order).limit(n)


def repetition(items: Column) -> Column:
    """struct<n, n_unique> of an array: many items of few kinds are a loop."""
    return F.struct(F.size(items).alias("n"), F.size(F.array_distinct(items)).alias("n_unique"))


def running_mean(df: DataFrame, value: str, order: str, every: int = 10) -> DataFrame:
    """order, nth, running_mean: the mean so far at every `every`-th row; values that are null don't count."""
    sums = running_sums(df, order, value).filter(F.col("nth") % every == 0)
    return sums.select(order, "nth", F.try_divide(F.col("total").cast("double"), "n_values").alias("running_mean"))


def throughput(df: DataFrame, by: str, order: str, size: str, seconds: str, stall: float = 0.01) -> DataFrame:
    """MB a second since the row before, within `by`, and whether that is a stall."""
    before = W.partitionBy(by).orderBy(order)
    rate = F.try_divide((F.col(size) - F.lag(size).over(before)) / 1e6, F.col(seconds))
    return df.select(by, order, rate.alias("mb_s"), (rate < stall).alias("stalled"))


def group_sums(df: DataFrame, by: str, value: str, parts: dict[str, Column]) -> DataFrame:
    """Sums of a value by group: `total`, and of the rows that each named condition holds for."""
    own = [F.sum(F.when(condition, F.col(value)).otherwise(0)).alias(name) for name, condition in parts.items()]
    return df.groupBy(by).agg(F.sum(value).alias("total"), *own)


def median_of_runs(df: DataFrame, by: str, warm_up: str, seconds: str, nth: str) -> DataFrame:
    """Upper median of the timed runs: one if the warm-up took over 3 s, else three."""
    used = df.filter(F.col(nth) <= F.when(F.col(warm_up) > 3, 1).otherwise(3))
    return used.groupBy(by).agg(upper_median(seconds).alias("median_s"), F.count("*").alias("runs"))


def chips(sample: dict[str, Column], fields: Column) -> Column:
    """array<struct<label, state>>: ok, bad, or n/a for fields that aren't scored."""
    state = lambda ok: F.when(ok, "ok").otherwise("bad")
    out = [F.struct(F.lit("JSON").alias("label"), state(sample["valid_json"]).alias("state"))]
    for name in ("chart_type", "title", "x_label", "y_label"):
        scored = F.when(F.array_contains(fields, name), state(sample[f"{name}_ok"])).otherwise("n/a")
        out.append(F.struct(F.lit(name.replace("_", " ")).alias("label"), scored.alias("state")))
    out.append(F.struct(F.lit("value@5%").alias("label"), state(sample["va_05"] >= 0.9).alias("state")))
    return F.array(*out)


def shown_repairs(repairs: Column) -> Column:
    """The first three distinct repairs, escaped."""
    return html_escape(F.array_join(F.slice(F.array_sort(F.array_distinct(repairs)), 1, 3), ", "))


def details() -> Column:
    """array<struct<label, state>> for the columns of scored samples: chips(), counts, and what was unusual about the match."""
    label = lambda parts, state: F.struct(F.concat(*parts).alias("label"), state.alias("state"))
    number = lambda c: c.cast("string")
    note, none = F.lit("note"), F.lit(None).cast("struct<label: string, state: string>")
    series = lambda c: F.size(F.coalesce(F.col(f"{c}.series"), F.array()))
    every = chips({c: F.col(c) for c in ("valid_json", "va_05", "chart_type_ok", "title_ok", "x_label_ok", "y_label_ok")}, F.col("fields"))
    more = F.array(
        label([F.lit("series "), number(series("pred")), F.lit("/"), number(series("gold"))], F.when(F.col("series_count_ok"), "ok").otherwise("bad")),
        label([F.lit("points "), number(F.col("n_matched")), F.lit("/"), number(F.col("gold_points")), F.lit(", missing "), number(F.col("n_missing")), F.lit(", extra "), number(F.col("n_spurious"))], note),
        F.when(F.size("scale_errors") > 0, label([F.lit("scale x"), number(F.get("scale_errors", F.lit(0)))], F.lit("bad"))).otherwise(none),
        F.when(F.col("fallback"), label([F.lit("matched by position")], note)).otherwise(none),
        F.when(F.size("repairs") > 0, label([F.lit("repaired: "), shown_repairs(F.col("repairs"))], note)).otherwise(none),
    )
    return F.array_compact(F.concat(every, more))
