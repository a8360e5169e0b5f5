"""Markdown pipe tables into nested records, and the choice of tables to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeframe.functions.numbers import parse_number
from gradeframe.functions.text import strip
from gradeframe.types import POINT

#: First headers that name nothing.
PLACEHOLDERS = ("characteristic", "category", "unnamed: 0", "")


def cells(line: Column) -> Column:
    bare = F.regexp_replace(strip(line), r"^\|+|\|+$", "")
    return F.transform(F.split(bare, r"\|"), lambda c: strip(c))


def parse_table(table: Column) -> Column:
    """struct<x_header, names, rows: array<array<string>>>, null if malformed. Ragged rows are left out."""
    lines = F.filter(F.transform(F.split(table, r"\r\n|\n|\r"), lambda x: strip(x)), lambda x: x != "")
    header = cells(F.get(lines, F.lit(0)))
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    is_rule = F.regexp_replace(F.get(body, F.lit(0)), rf"(?U)[\s\x1C-\x1F|\-]", "") == ""
    body = F.when(is_rule, F.slice(body, 2, F.size(body))).otherwise(body)
    rows = F.filter(F.transform(body, cells), lambda r: F.size(r) == F.size(header))
    fits = (F.size(lines) >= 2) & (F.size(header) >= 2) & (F.size(rows) > 0)
    return F.when(fits, F.struct(F.get(header, F.lit(0)).alias("x_header"), F.slice(header, 2, F.size(header) - 1).alias("names"), rows.alias("rows")))


def series_of(parsed: Column) -> Column:
    """The table's series, x being the first column's labels.

    Cells without a number make no point and series without points are left
    out. Of columns with one name the last one's values count for all of them.
    """
    def column(name: Column) -> Column:
        last = F.size(parsed["names"]) - F.array_position(F.reverse(parsed["names"]), name)  # 0-based
        points = F.transform(
            parsed["rows"],
            lambda r: F.struct(F.lit("str").alias("x_kind"), F.get(r, F.lit(0)).alias("x_str"), F.lit(None).cast("double").alias("x_num"), parse_number(F.get(r, (last + 1).cast("int"))).alias("y")),
        )
        return F.filter(points, lambda p: p.y.isNotNull()).cast(f"array<{POINT}>")

    return F.filter(F.transform(parsed["names"], lambda n: F.struct(n.alias("name"), column(n).alias("data"))), lambda s: F.size(s.data) > 0)


def x_label(parsed: Column) -> Column:
    head = strip(parsed["x_header"])
    return F.when(F.lower(head).isin(*PLACEHOLDERS), None).otherwise(head)


def scored_fields(parsed: Column) -> Column:
    """Fields that the table annotates, sorted."""
    return F.when(x_label(parsed).isNotNull(), F.array(F.lit("series_names"), F.lit("x_label"))).otherwise(F.array(F.lit("series_names")))


def ingest(df: DataFrame, table: str = "table") -> DataFrame:
    """df with gold (record; a placeholder chart type) and scored_fields; both null for tables that make no record."""
    parsed = df.withColumn("parsed", parse_table(F.col(table))).withColumn("series", series_of(F.col("parsed")))
    none = F.lit(None).cast("string")
    gold = F.struct(F.lit("bar").alias("chart_type"), none.alias("title"), x_label(F.col("parsed")).alias("x_label"), none.alias("y_label"), F.col("series").alias("series"))
    fits = F.coalesce(F.size("series"), F.lit(0)) > 0
    return parsed.withColumn("gold", F.when(fits, gold)).withColumn("scored_fields", F.when(fits, scored_fields(F.col("parsed")))).drop("parsed", "series")


def eligibility(n_series: Column, n_points: Column, most_series: int = 6, most_points: int = 24) -> Column:
    """The first reason that rules a table out, or 'eligible'; null counts mean that it didn't parse."""
    return (
        F.when(n_series.isNull(), "unparseable")
        .when(n_series > most_series, "too_many_series")
        .when(n_points > most_points, "too_dense")
        .when(n_points == 0, "empty")
        .otherwise("eligible")
    )


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows (all, if fewer) without replacement: the least digests of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def summary(df: DataFrame) -> DataFrame:
    """Tables by number of series: n, mean points, fields scored."""
    points = F.aggregate("gold.series", F.lit(0), lambda a, s: a + F.size(s.data))
    fields = F.array_sort(F.array_distinct(F.flatten(F.collect_set("scored_fields"))))
    return df.groupBy(F.size("gold.series").alias("n_series")).agg(F.count("*").alias("n"), F.avg(points).alias("mean_points"), fields.alias("fields"))
