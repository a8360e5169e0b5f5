"""Per-sample metrics on nested columns, and their summary. No shuffle before the summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.functions.assignment import assign_normalised
from gradeframe.functions.numbers import EPSILON, TOLERANCES, ape, array_mean, array_median, relative_error, series_bucket
from gradeframe.functions.text import normalize_text, text_correct
from gradeframe.operators.matching import keyed, match_series
from gradeframe.operators.ranks import median
from gradeframe.sources.shared import checkpointed
from gradeframe.types import ALL_FIELDS, SERIES

SHORT = {0.01: "01", 0.05: "05", 0.10: "10"}


def n_points(series: Column) -> Column:
    return F.aggregate(series, F.lit(0), lambda a, s: a + F.size(s.data))


def score_samples(df: DataFrame) -> DataFrame:
    """df with columns gold (record), pred (record or null), error, repairs and scored_fields (null: all), plus metrics.

    Points of predicted series without a partner are not counted; those of gold
    series are missing. Without a prediction all is zero and nothing is counted
    as missing, but the sample stays in the denominators.
    """
    none = F.array().cast(f"array<{SERIES}>")
    valid = F.col("pred").isNotNull()
    fields = F.coalesce(F.col("scored_fields"), F.array(*map(F.lit, ALL_FIELDS)))
    # names are made once, in a step of their own: the lambdas below read them many times. Points' keys are made for the matching alone
    compared = lambda series: F.transform(series, lambda s: F.struct(normalize_text(s["name"]).alias("name"), s.data.alias("data")))
    keys = lambda series: F.transform(series, lambda s: F.struct(keyed(s.data).alias("data")))
    df = df.withColumns(
        {"fields": fields, "valid_json": valid, "gold_series": compared(F.coalesce(F.col("gold.series"), none)), "pred_series": compared(F.coalesce(F.col("pred.series"), none))}
    ).withColumn("series_pairs", assign_normalised(F.col("gold_series"), F.col("pred_series")))
    df = df.withColumn("matched", match_series(keys("gold_series"), keys("pred_series"), F.col("series_pairs")))
    total = lambda name: F.aggregate("matched", F.lit(0), lambda a, m: a + m[name])
    paired = F.transform("series_pairs", lambda q: q.g)
    unpaired = F.aggregate(F.transform("gold_series", lambda s, i: F.when(F.array_contains(paired, i), 0).otherwise(F.size(s.data))), F.lit(0), lambda a, n: a + n)
    of = lambda name, i: F.get(F.col(name), i)["name"]
    df = df.withColumns(
        {
            "errors": F.transform(F.flatten(F.transform("matched", lambda m: m.pairs)), lambda q: relative_error(q.g, q.p)),
            "n_missing": F.when(valid, total("missing") + unpaired).otherwise(0),
            "n_spurious": total("spurious"),
            "fallback": F.exists("matched", lambda m: m.fallback),
            "scale_errors": F.filter(F.transform("matched", lambda m: m.scale), lambda f: f.isNotNull()),
            "gold_points": n_points(F.col("gold_series")),
            "pred_points": n_points(F.col("pred_series")),
            "names_ok": F.size(F.filter("series_pairs", lambda q: of("gold_series", q.g) == of("pred_series", q.p))).cast("double"),
        }
    )
    correct = {f: valid & text_correct(F.col(f"gold.{f}"), F.col(f"pred.{f}")) for f in ("title", "x_label", "y_label")}
    correct["chart_type"] = valid & F.coalesce(F.col("gold.chart_type") == F.col("pred.chart_type"), F.lit(False))
    within = lambda t: F.size(F.filter("errors", lambda e: ~F.isnan(e) & (e <= t)))
    hits = {SHORT[t]: within(t) for t in TOLERANCES}
    df = df.withColumns(
        {
            "n_matched": F.size("errors"),
            **{f"hits_{t}": c for t, c in hits.items()},
            **sample_ape(F.col("errors")),
            "series_names": F.when(~valid, F.lit(0.0)).otherwise(F.coalesce(F.try_divide("names_ok", F.size("gold_series")), F.lit(1.0))),
            "series_count_ok": valid & (F.size("gold_series") == F.size("pred_series")),
            "point_count_ok": valid & (F.col("gold_points") == F.col("pred_points")),
            **{f"{f}_ok": ok for f, ok in correct.items()},
        }
    )
    share = lambda c, of: F.coalesce(F.try_divide(F.col(c).cast("double"), of), F.lit(0.0))
    names = ~F.array_contains("fields", "series_names") | (F.abs(F.col("series_names") - 1) <= EPSILON)
    structural = valid & F.col("series_count_ok") & F.col("point_count_ok") & names
    for f in correct:
        structural = structural & (~F.array_contains("fields", f) | F.col(f"{f}_ok"))
    return df.withColumns(
        {
            **{f"va_{t}": share(f"hits_{t}", "n_matched") for t in hits},
            "recall": share("n_matched", "gold_points"),
            "structural": structural,
            "conforms": valid & (F.size(F.coalesce("repairs", F.array().cast("array<string>"))) == 0),
            "chart_type": F.col("gold.chart_type"),
            "bucket": series_bucket(F.size("gold_series")),
        }
    ).drop("matched", "series_pairs", "gold_series", "pred_series", "errors", "names_ok")


def fully_annotated(fields: Column, names: tuple[str, ...] = ALL_FIELDS) -> Column:
    """Whether all of the names are scored."""
    return F.array_sort(F.array_distinct(fields)) == F.lit(sorted(names))


def micro_average(hits: Column, matched: Column) -> Column:
    """Aggregate: hits of all samples over matches of all samples, so a sample counts by its points; 0 without matches."""
    return F.coalesce(F.try_divide(F.sum(hits).cast("double"), F.sum(matched)), F.lit(0.0))


def sample_ape(errors: Column) -> dict[str, Column]:
    """mape and median_ape, in percent, of a sample's relative errors; infinite ones don't count."""
    finite = ape(errors)
    return {"mape": 100 * array_mean(finite), "median_ape": 100 * array_median(finite)}


def counters(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A narrow row per sample: by, chart_type, bucket, sign (1), what is added up over samples, and ape, its median error if it parsed.

    Rows may be taken back: the same row again with sign -1 undoes one.
    """
    valid, one = F.col("valid_json"), lambda c: F.coalesce(c, F.lit(False)).cast("long")
    parsed = lambda c, zero=0: F.coalesce(F.when(valid, F.col(c)), F.lit(zero))
    scored = lambda f: F.array_contains("fields", f)
    of = {
        "valid": one(valid), "conforming": one(F.col("conforms")), "repaired": one(valid & ~F.col("conforms")),
        **{f"{f}_scored": one(scored(f)) for f in ALL_FIELDS}, **{f"{f}_right": one(scored(f) & F.col(f"{f}_ok")) for f in ALL_FIELDS[:4]},
        "series_names_right": F.when(scored("series_names"), F.col("series_names")).otherwise(0.0), "partial": one(~fully_annotated(F.col("fields"))),
        **{c: one(F.col(c)) for c in ("series_count_ok", "point_count_ok", "structural", "fallback")}, "scaled": one(F.size("scale_errors") > 0),
        **{c: parsed(c).cast("long") for c in ("n_matched", "n_missing", "n_spurious", *(f"hits_{t}" for t in SHORT.values()))},
        "mape_sum": parsed("mape", 0.0), "mape_n": one(valid & F.col("mape").isNotNull()), "recall": F.col("recall"),
    }
    return samples.select(*by, "chart_type", "bucket", F.lit(1).alias("sign"), *(c.alias(name) for name, c in of.items()), F.when(valid, F.col("median_ape")).alias("ape"))


def summarise_counters(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """counters() overall, by chart type and by series bucket, each within `by`: column `level` tells them apart.

    The narrow rows are computed once, when this is called: the sums, which are one
    aggregation, and the exact medians of ape read them from the checkpoint.
    """
    rows = checkpointed(rows)
    added = [c for c in rows.columns if c not in (*by, "chart_type", "bucket", "sign", "ape")]
    keys = rows.withColumnsRenamed({"chart_type": "by_type", "bucket": "by_bucket"})
    sets = [[*by], [*by, "by_type"], [*by, "by_bucket"]]
    sums = keys.groupingSets(sets, *by, "by_type", "by_bucket").agg(F.grouping_id().alias("gid"), F.sum("sign").alias("n"), *(F.sum(F.col(c) * F.col("sign")).alias(c) for c in added))
    sums = sums.filter(((F.col("gid") != 1) | F.col("by_type").isNotNull()) & (F.col("n") > 0))  # samples without a type are in no type's group
    level = F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "chart_type").otherwise("series_count")
    per = lambda c, of="n": F.try_divide(F.col(c).cast("double"), of)
    rates = {
        "valid_json_rate": per("valid"), "schema_conformance_rate": per("conforming"), "n_repaired": F.col("repaired"),
        **{f"{f}_accuracy": per(f"{f}_right", f"{f}_scored") for f in ALL_FIELDS[:4]}, "series_name_accuracy": per("series_names_right", "series_names_scored"), "n_partially_annotated": F.col("partial"),
        "series_count_accuracy": per("series_count_ok"), "point_count_accuracy": per("point_count_ok"), "exact_structural_match": per("structural"),
        **{f"va_{t}": F.coalesce(per(f"hits_{t}", "n_matched"), F.lit(0.0)) for t in SHORT.values()}, "mape": per("mape_sum", "mape_n"), "point_recall": per("recall"),
        **{f"n_{k}_points": F.col(f"n_{k}") for k in ("matched", "missing", "spurious")}, "n_positional_fallback": F.col("fallback"), "n_scale_errors": F.col("scaled"),
    }
    summary = sums.select(*by, level.alias("level"), F.coalesce("by_type", "by_bucket", F.lit("all")).alias("key"), "n", *(c.alias(name) for name, c in rates.items()))
    groups = F.array(*(F.struct(F.lit(name).alias("level"), key.alias("key")) for name, key in (("overall", F.lit("all")), ("chart_type", F.col("chart_type")), ("series_count", F.col("bucket")))))
    each = rows.select(*by, F.explode(groups).alias("g"), "ape", "sign").select(*by, "g.*", "ape", "sign").filter(F.col("key").isNotNull())
    medians = median(each, [*by, "level", "key"], "ape", "sign").withColumnRenamed("median", "median_ape")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "level", "key")]
    return summary.alias("a").join(medians.alias("b"), same, "left").select("a.*", "b.median_ape")


def summarise(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rates and counts of score_samples() rows, see summarise_counters()."""
    return summarise_counters(counters(samples, by), by)


def parse_errors(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """error, n: the different errors and how many samples have each, a row each."""
    return samples.filter(F.col("error").isNotNull()).groupBy(*by, "error").agg(F.count("*").alias("n"))


def common_errors(samples: DataFrame, k: int = 20, tracked: int = 10_000) -> DataFrame:
    """error, n: about the k most common errors, from a summary of `tracked` of them that tasks merge; exact while there are no more."""
    return samples.agg(F.expr(f"approx_top_k(error, {k}, {tracked})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias("error"), F.col("t.count").alias("n")).filter(F.col("error").isNotNull())


def repair_histogram(samples: DataFrame, order: str) -> DataFrame:
    """Samples per distinct repair, most frequent first, ties by first appearance."""
    each = samples.select(order, F.explode(F.array_distinct("repairs")).alias("repair"))
    return each.groupBy("repair").agg(F.count("*").alias("n"), F.min(order).alias("first")).orderBy(F.desc("n"), "first")
