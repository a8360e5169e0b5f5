"""Sources, sinks, the streamed log, tables and text functions on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import numbers as N
from gradeframe.functions import text as T
from gradeframe.functions.parsing import json_schema
from gradeframe.operators import diagnostics as D
from gradeframe.operators import log as L
from gradeframe.operators import tables as P
from gradeframe.plans.evaluate import config, probe, report
from gradeframe.sources.corpus import materialise, smallest_shard, with_ordinals
from gradeframe.sources.jsonl import first_rows, read_lines, read_predictions, read_scores, write_json
from gradeframe.streaming.log import read_log_stream, start


def row(i, raw, error=None, **more):
    return json.dumps({"id": i, "raw": raw, "n_tokens": 1, "seconds": 1.0, "gen_error": error, **more})


@pytest.mark.parametrize(
    "log,done,views",
    [
        ([], set(), {}),
        ([row("a", "x"), row("b", "y", "E")], {"a"}, {"a": None, "b": "E"}),
        ([row("a", "x", "E"), row("a", "new")], {"a"}, {"a": None}),
        ([row("a", "x"), row("a", "y", "E")], set(), {"a": "E"}),
        ([row(f"i{n}", "", "E") for n in range(150)], set(), {f"i{n}": "E" for n in range(150)}),
        ([row("a", "x"), "", "  ", row("b", "y", "")], {"a", "b"}, {"a": None, "b": ""}),
    ],
)
def test_replay(spark, tmp_path, log, done, views):
    (tmp_path / "log.jsonl").write_text("\n".join(log))
    rows = read_predictions(spark, str(tmp_path))
    assert {r.id for r in L.resume_view(rows).collect()} == done
    assert {r.id: r.gen_error for r in L.scoring_view(rows).collect()} == views
    work = spark.createDataFrame([(i,) for i in ["a", "b", "zz"]], "id string")
    assert {r.id for r in L.pending(work, rows).collect()} == {"a", "b", "zz"} - done


def test_file_order(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join(str(i) for i in range(100)))
    assert [r.value for r in first_rows(read_lines(spark, str(tmp_path)), 3).collect()] == ["0", "1", "2"]


def test_streamed_log(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join([row("a", "1", seq=0), row("b", "1", seq=1), row("a", "2", "E", seq=2), ""]))
    seen = {}

    def handle(df, epoch):
        seen.update({r.id: (r.raw, r.gen_error) for r in df.collect()})

    start(read_log_stream(spark, str(folder)), str(tmp_path / "state"), handle).awaitTermination(120)
    assert seen == {"a": ("2", "E"), "b": ("1", None)}
    import os

    (folder / "b.jsonl").write_text(row("a", "3", seq=0) + "\n")
    os.utime(folder / "b.jsonl", (4e9, 4e9))
    seen.clear()
    start(read_log_stream(spark, str(folder)), str(tmp_path / "state"), handle).awaitTermination(120)
    assert seen == {"a": ("3", None)}


def test_nulls_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", None)], "id string, x string")
    write_json(df, str(tmp_path / "o"))
    write_json(df, str(tmp_path / "o"), "append")
    lines = [r.value for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert lines == ['{"id":"a","x":null}'] * 2
    (tmp_path / "s.json").write_text(json.dumps({"overall": {"n": 3}}, indent=2))
    assert read_scores(spark, str(tmp_path / "s.json")).first().overall.n == 3


def test_shards_and_late_materialisation(spark, tmp_path):
    big, small = str(tmp_path / "c/b.parquet"), str(tmp_path / "c/a.parquet")
    for path, n in ((big, 5000), (small, 20)):
        spark.range(n).selectExpr("id", "cast(id AS string) AS heavy").coalesce(1).write.parquet(path + ".dir")
    import glob
    import shutil

    for path in (big, small):
        shutil.move(glob.glob(path + ".dir/*.parquet")[0], path)
    assert smallest_shard(spark, str(tmp_path / "c")).endswith("a.parquet")
    chosen = with_ordinals(spark, small, "id").filter("id IN (3, 7)")
    plan = chosen._jdf.queryExecution().toString()
    assert "heavy" not in plan.split("Physical Plan")[1]
    assert sorted(r.heavy for r in materialise(spark, small, chosen, "heavy").collect()) == ["3", "7"]


def scanned(df):
    """Files that scans of the column `heavy` read; without adaptive stages, so that all scans are in one plan."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return [s.metrics().apply("numFiles").value() for s in scans if "heavy" in s.toString()]


def test_materialisation_reads_chosen_files_only(spark, tmp_path, monkeypatch):
    from gradeframe.sources import corpus

    path = str(tmp_path / "t")
    spark.range(400).selectExpr("id", "cast(id AS string) AS heavy").repartitionByRange(8, "id").write.parquet(path)
    chosen = with_ordinals(spark, path, "id").filter("id IN (3, 5, 399)")
    got = materialise(spark, path, chosen, "heavy")
    assert sorted(r.heavy for r in got.collect()) == ["3", "399", "5"] and scanned(got) == [2]
    assert materialise(spark, path, chosen.limit(0), "heavy").count() == 0
    monkeypatch.setattr(corpus, "FILES", 1)
    got = materialise(spark, path, chosen, "heavy")
    assert sorted(r.heavy for r in got.collect()) == ["3", "399", "5"] and scanned(got) == [8]


TABLES = [
    ("| Year | A | B |\n|---|---|---|\n| 2019 | $1,200.5 | - |\n| 2020 | 3 % | 4 |", ("Year", {"A": [("2019", 1200.5), ("2020", 3.0)], "B": [("2020", 4.0)]})),
    ("Characteristic | A\n2019 | 5\nragged | 1 | 2\n2020-21 | (7)", (None, {"A": [("2019", 5.0), ("2020-21", 7.0)]})),
    ("| X | A | A |\n| p | 1 | 2 |", ("X", {"A": [("p", 2.0)]})),
    ("| X |\n| 1 |", None),
    ("| X | A |\n|---|---|", None),
    ("| X | A |\n| p | n/a |", None),
    ("| X | A |", None),
    ("", None),
    (None, None),
]


def test_pipe_table_with_tabs(spark):
    table = "| Year\t|\u2003Wheat \x1f|\n|\t---|--- |\n|\t1999 |\t12\u2003|\n\t\n2000\t| 7 |"
    r = P.ingest(spark.createDataFrame([(table,)], "table string")).first()
    assert r.gold.x_label == "Year" and [s.name for s in r.gold.series] == ["Wheat"]
    assert [(p.x_str, p.y) for p in r.gold.series[0].data] == [("1999", 12.0), ("2000", 7.0)]


def test_pipe_tables(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TABLES)], "i int, table string")
    for r in P.ingest(df).orderBy("i").collect():
        want = TABLES[r.i][1]
        if want is None:
            assert r.gold is None and r.scored_fields is None
            continue
        assert r.gold.x_label == want[0] and {s.name: [(p.x_str, p.y) for p in s.data] for s in r.gold.series} == want[1]
        assert r.scored_fields == (["series_names", "x_label"] if want[0] else ["series_names"])


def test_pipe_tables_from_sql(spark):
    """The table function gives the points that the expressions give, beside columns of its row."""
    from gradeframe.functions import pipes

    pipes.register(spark)
    more = ["| Year\t|\u2003Wheat \x1f|\n|\t---|--- |\n|\t1999 |\t12\u2003|\n\t\n2000\t| 7 |", "a|b|b|c\r\nx|1,5|2|-\rq|(3)|none|1e5\n", "||a|b||\n|x|1|"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*(t for t, _ in TABLES), *more])], "i int, table string")
    df.createOrReplaceTempView("pipe_test")
    got = spark.sql("SELECT t.i, p.* FROM pipe_test t, LATERAL pipe_points(t.table) p").collect()
    gold = P.ingest(df).select("i", "gold.x_label", F.explode("gold.series").alias("s")).select("i", "x_label", F.col("s.name").alias("series"), F.explode("s.data").alias("p"))
    want = gold.select("i", "x_label", "series", F.col("p.x_str").alias("x"), F.col("p.y").alias("y")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want))) and len(want) > 8
    assert sorted(map(str, pipes.with_points(df).drop("table").collect())) == sorted(map(str, got))


def test_eligibility_order(spark):
    rows = [(None, None, "unparseable"), (7, 30, "too_many_series"), (6, 25, "too_dense"), (2, 0, "empty"), (6, 24, "eligible")]
    df = spark.createDataFrame(rows, "s int, p int, want string")
    assert df.filter(P.eligibility(F.col("s"), F.col("p")) != F.col("want")).count() == 0


def values(spark, kind, items, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_text(spark):
    messy = ["Revenue (USD)", "revenue  (usd", "  Quarter ", "Sales:", "A  B", "%", "-5", None, "Straße", "ΑΣ", "é a b(%)"]
    assert values(spark, "string", messy, T.normalize_text) == ["revenue (usd", "revenue (usd", "quarter", "sales", "a b", "", "5", "", "strasse", "ασ", "é a b"]
    odd = ["\ufb03x", "\u0149", "\u0130\u0131I", "\u1e9e\u017f", "\u00b5m", "\u212a", "\x1c a\u2003b\x1f", "\u039f\u03a3 \u03c2", "\ud835\udfd9".encode("utf-16", "surrogatepass").decode("utf-16")]
    import re

    python = lambda t: re.sub(r"^[\W_]+|[\W_]+$", "", " ".join(t.split()).casefold())
    assert values(spark, "string", odd, T.normalize_text) == [python(t) for t in odd]
    assert values(spark, "string", ['{"en": "a"}', '{"de": "b"}', "plain", None], lambda c: T.locale_pick(c, "en", F.lit("?"))) == ["a", "?", "plain", "?"]
    assert values(spark, "string", ["kitten", "", "sitting"], lambda c: T.common_subsequence(c, F.lit("sitting"))) == [4, 0, 7]
    assert values(spark, "string", ["kitten"], lambda c: T.name_similarity(c, F.lit("Sitting!")))[0] == pytest.approx(8 / 13)
    assert values(spark, "string", ["", "%"], lambda c: T.name_similarity(c, F.lit("-"))) == [0.0, 0.0]


def test_case_folding_of_all_letters(spark):
    """Every letter that Python knows or folds, but those that the two libraries' versions of Unicode disagree on."""
    letters = [chr(i) for i in range(0x30000) if not 0xD800 <= i < 0xE000 and (chr(i).isalpha() or chr(i).casefold() != chr(i))]
    rows = spark.createDataFrame([(c, c.casefold()) for c in letters], "c string, want string").repartition(4)
    wrong = [r.c for r in rows.filter(T.casefold(F.col("c")) != F.col("want")).select("c").collect()]
    assert len(letters) > 100_000 and all(ord(c) > 0x1C80 for c in wrong) and len(wrong) <= 20, [hex(ord(c)) for c in wrong]


def test_common_subsequence(spark):
    """Names of up to 200 characters, several numbers of bits long, as the big integers of Python say."""
    import random

    from gradeframe.functions.assignment import common_subsequence

    r = random.Random(7)
    name = lambda n: "".join(r.choice("ab\u00e9\U0001f600 c"[: r.randint(2, 6)]) for _ in range(n))
    sizes = [0, 1, 2, 61, 62, 63, 123, 124, 125, 200]
    rows = [(name(m), name(n)) for m in sizes for n in (0, 1, 62, 63, 200)] + [("x" * 124, "x" * 124), ("x" * 62 + "y", "y" + "x" * 62), (None, "a")]
    got = spark.createDataFrame(rows, "a string, b string").repartition(3).select("a", "b", T.common_subsequence(F.col("a"), F.col("b")).alias("n")).collect()
    assert len(got) == len(rows) and all(g.n == common_subsequence(g.a, g.b) for g in got if g.a is not None)


def test_numbers(spark):
    assert values(spark, "double", [10.35, 0.0005, 2.675, 12345.0, 12350.0, -10.25, None, float("inf")], N.readable) == [10.3, 0.001, 2.675, 12300.0, 12400.0, -10.2, None, float("inf")]
    assert values(spark, "string", ["\u0663\u0664", " \uff11,\uff12\x1d", "\t7\u2003", ", 5"], N.as_float) == [34.0, 12.0, 7.0, 5.0]
    assert values(spark, "string", ["ca \u0663 kg", "\tn/a\u2003", "\x1f--"], N.parse_number) == [3.0, None, None]
    texts = ["12", " 3 ", "1,000", "1_000", "1__0", "1d", "nan", "1e999", "-.5", "+5.", "", "abc", None]
    assert values(spark, "string", texts, N.as_float) == [12.0, 3.0, 1000.0, 1000.0, None, None, None, None, -0.5, 5.0, None, None, None]
    cells = ["2019-20", "(5)", "1.234.567", "−3", "$3.2m", "1e5", " N/A ", "*", "none", "5 000", None]
    assert values(spark, "string", cells, N.parse_number) == [2019.0, 5.0, 1.234, 3.0, 3.2, 1.0, None, None, None, 5000.0, None]
    assert values(spark, "array<double>", [[0.0], [], [0.02, -150.0], [1000.0]], N.magnitude) == [0, 0, 2, 3]
    assert values(spark, "double", [0.0, 1234.0, 12.34, 1.23456, 98765.0], N.readable) == [0.0, 1230.0, 12.3, 1.235, 98800.0]
    assert values(spark, "int", [0, 1, 2, 3, 5, 6], N.series_bucket) == ["1", "1", "2-3", "2-3", "4-5", "6+"]
    assert values(spark, "double", [5.0, 0.0], lambda c: N.relative_error(F.lit(0.0), c)) == [float("inf"), 0.0]


def test_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,)], "v double")
    assert df.agg(L.upper_median("v")).first()[0] == 10.0 and df.agg(F.median("v")).first()[0] == 6.0


def test_probe(spark):
    rows = [("Paris", ["paris", "x"], None), ("  par  is", ["par is"], None), ("Pariz", ["Paris"], None), ("zzzzz", ["Paris"], None), ("", [""], None), ("é", ["e"], None), ("Paris", ["Paris"], "E")]
    got = probe(spark.createDataFrame(rows, "prediction string, answers array<string>, error string")).first()
    assert (got.anls, got.exact_match, got.n, got.n_errors) == (round((1 + 1 + 0.8 + 0 + 1 + 0 + 0) / 7, 4), round(3 / 7, 4), 7, 1)


def test_diagnostics(spark):
    df = spark.createDataFrame([(1, "a b a b a b"), (2, "a b c")], "id int, t string")
    assert [tuple(r.r) for r in df.select("id", D.repetition(F.split("t", " ")).alias("r")).orderBy("id").collect()] == [(6, 2), (3, 3)]
    assert values(spark, "array<string>", [["b", "a", "b", "<c>", "d"]], D.shown_repairs) == ["&lt;c&gt;, a, b"]
    assert config({"model": "m", "preds": __import__("pathlib").Path("a/b"), "secret": 1, "constrained": True}) == {"model": "m", "preds": "a/b", "constrained": True}
    assert report({}, "t").startswith("# t") and json_schema()["required"] == ["chart_type"]
