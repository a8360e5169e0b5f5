"""Work that must grow no faster than the tables: what a value costs, and how rows are dealt to tasks."""

import json
import re

from pyspark.sql import functions as F

from gradeframe.functions.numbers import magnitude
from gradeframe.functions.parsing import canonical_json, parse_prediction
from gradeframe.operators.synth import long_values, specs, stacked, stacked_values, with_gold
from gradeframe.plans.queries import QUERIES
from gradeframe.sources import shared
from gradeframe.sources.corpus import smallest

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stacked_values_without_shuffle(spark):
    charts = specs(spark, 200, 5)
    got, want = stacked_values(charts), stacked(long_values(charts))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.select(*got.columns).collect()}
    assert got.filter("base > 0").count() > 0
    window = plan(QUERIES["synth_stacked"](spark, SF))
    assert "Window" not in window


def test_a_value_has_one_digest(spark):
    text = plan(specs(spark, 10, 2).select("values"))
    assert text.count("md5(") < 25  # one for each decision about the chart and one for the value; 38 before


def test_charts_are_dealt_by_count(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 100)
    rows = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert QUERIES["synth_stacked"](spark, SF).rdd.getNumPartitions() == rows // 100 + 1


def test_records_of_charts(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 100)
    df = QUERIES["synth_records"](spark, SF)
    assert df.rdd.getNumPartitions() == spark.read.parquet(f"{SF}/orders.parquet").count() // 100 + 1
    assert plan(df).count("Class ") == 1  # an expression of its own, not one for each point


def test_points_of_records_are_zipped(spark):
    df = with_gold(specs(spark, 60, 4))
    text = plan(QUERIES["synth_records"](spark, SF))
    assert "arrays_zip" in text and "cast(transform" not in text  # no struct, kind and cast for each point
    assert "abs(" not in text  # nor a step for each value to find the largest
    for r in df.collect():
        labels = [(None, float(j + 1)) if r.numeric_x else (c, None) for j, c in enumerate(r.categories)]
        kind = "num" if r.numeric_x else "str"
        want = [(name, [(kind, *x, y) for x, y in zip(labels, ys, strict=True)]) for name, ys in zip(r.series_names, r["values"], strict=True)]
        assert [(s.name, [tuple(p) for p in s.data]) for s in r.gold.series] == want


def test_magnitude_of_all_signs(spark):
    cases = [([-250.0, 3.0], 2), ([0.0, -0.0], 0), ([], 0), ([None, 12.5], 1), ([-0.004], -3), (None, 0)]
    df = spark.createDataFrame([(v, i) for i, (v, _) in enumerate(cases)], "v array<double>, i int")
    assert [r.m for r in df.select(magnitude(F.col("v")).alias("m"), "i").orderBy("i").collect()] == [m for _, m in cases]


def test_self_check_makes_no_keys_of_points(spark, monkeypatch):
    monkeypatch.setattr(shared, "ROWS", 100)
    df = QUERIES["synth_self_check"](spark, SF)
    assert "^[0-9]{1,15}$" not in plan(df)  # points' keys are for the matching, which this query doesn't read
    assert all(r.n == r.n_perfect for r in df.collect())


def test_scored_runs_are_dealt_by_count(spark, monkeypatch):
    monkeypatch.setattr("gradeframe.plans.queries.ROWS", 25)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100 + 1
    assert QUERIES["scored_run"](spark, SF).rdd.getNumPartitions() == n  # joined and scored as dealt, without another shuffle
    text = plan(QUERIES["scored_sweep"](spark, SF))
    assert len(re.findall(rf"RepartitionByExpression \[id#\d+\], {n}\b", text)) >= 2  # log and gold records


def test_rows_of_files_are_dealt_twice(spark, monkeypatch):
    want = {tuple(r) for r in QUERIES["scored_sweep"](spark, SF).collect()}
    monkeypatch.setattr("gradeframe.plans.queries.ROWS", 25)
    monkeypatch.setattr(shared, "STREAMED", 8)
    df = QUERIES["scored_sweep"](spark, SF)
    text = plan(df)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100 + 1
    for key in ("l_orderkey", "o_orderkey"):  # rows as read: by key in few partitions, which take no memory to write, then in many
        assert len(re.findall(rf"RepartitionByExpression \[sample#\d+L?\], {n}\b\s*[:|\s]*\+- Project .*\s*[:|\s]*\+- RepartitionByExpression \[{key}#\d+L?\], 8\b", text)) == 3
    assert {tuple(r) for r in df.collect()} == want


def test_plain_json_is_written_as_it_is(spark):
    point = "struct<x_kind: string, x_str: string, x_num: double, y: double>"
    chart = f"struct<chart_type: string, title: string, x_label: string, y_label: string, series: array<struct<name: string, data: array<{point}>>>>"
    data = [("str", "a b", None, 1.0), ("str", 'a"b\\\n', None, 1e10), ("num", None, 0.1, 1e-5), ("str", "line\n", None, -0.0)]
    df = spark.createDataFrame([(("bar", "t [1]", None, "", [("n]", data)]),)], f"c {chart}")
    text = canonical_json(F.col("c"))
    r = df.select(text.alias("json"), parse_prediction(text, False).chart.eqNullSafe(F.col("c")).alias("same")).first()
    assert r.same and json.loads(r.json)["series"][0]["data"][1] == {"x": 'a"b\\\n', "y": 1e10}


def test_round_trip_is_dealt_by_count_and_parsed_in_arrow(spark, monkeypatch):
    monkeypatch.setattr("gradeframe.plans.queries.ROWS", 25)
    text = QUERIES["canonical_round_trip"](spark, SF)._jdf.queryExecution().toString()
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100 + 1
    assert re.search(rf"RepartitionByExpression \[sample#\d+L?\], {n}\b", text) and "ArrowEvalPython" in text


def test_shard_choice_reads_its_table(spark):
    assert "documents.parquet" in " ".join(QUERIES["shard_choice"](spark, SF).inputFiles())


def test_smallest_shard_of_rows(spark):
    rows = spark.createDataFrame([("b", 3), ("a", 1), ("a", 2), ("c", 9), ("d", 3)], "name string, n int")
    assert [tuple(r) for r in smallest(rows, "name", F.col("n")).collect()] == [("a", 3)]
    nulls = spark.createDataFrame([("b", None), ("a", 1)], "name string, n int")
    assert [tuple(r) for r in smallest(nulls, "name", F.col("n")).collect()] == [("b", 0)]
    assert smallest(rows.limit(0), "name", F.col("n")).count() == 0
