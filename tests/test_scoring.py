"""Scoring of nested records, from parsing to the summary."""

import itertools
import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.__main__ import main
from gradeframe.functions.assignment import assign
from gradeframe.functions.parsing import canonical_json, parse_one, parse_prediction
from gradeframe.operators.scoring import repair_histogram, score_samples, summarise
from gradeframe.operators.synth import long_values, specs, stacked, with_gold
from gradeframe.plans.evaluate import report, score, self_check
from gradeframe.sources.jsonl import read_manifest, read_predictions, score_json

CHART = {
    "chart_type": "line",
    "title": "Rainfall at two stations",
    "x_label": "Month",
    "y_label": "Millimetres",
    "series": [
        {"name": "Harbour", "data": [{"x": "May", "y": 61.0}, {"x": "June", "y": 48.4}, {"x": "July", "y": 52.9}]},
        {"name": "Hill top", "data": [{"x": "May", "y": 104.7}, {"x": "June", "y": 96.3}, {"x": "July", "y": 88.8}]},
    ],
}


def changed(f):
    chart = json.loads(json.dumps(CHART))
    return f(chart) or chart


def one_series(xs, ys, name="S"):
    return {**CHART, "series": [{"name": name, "data": [{"x": x, "y": y} for x, y in zip(xs, ys)]}]}


def scored(spark, cases, fields=None):
    rows = [(i, json.dumps(g), None if p is None else p if isinstance(p, str) else json.dumps(p), fields) for i, (g, p) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, g string, p string, scored_fields array<string>")
    df = df.withColumn("gold", parse_prediction(F.col("g"), False).chart).withColumn("q", parse_prediction(F.col("p"))).cache()
    return score_samples(df.select("id", "gold", "scored_fields", F.col("q.chart").alias("pred"), F.col("q.error").alias("error"), F.col("q.repairs").alias("repairs")))


def drop_point(c):
    for s in c["series"]:
        s["data"] = s["data"][:1]


def extra_point(c):
    c["series"][0]["data"].append({"x": "August", "y": 1.0})


def unnamed(c):
    for s in c["series"]:
        s["name"] = " "


def unnamed_and_turned(c):
    unnamed(c)
    c["series"].reverse()


def turned_points(c):
    for s in c["series"]:
        s["data"].reverse()


LEVELS = [7.5, 12.0, 31.0, 44.0]
CASES = {
    "same": ((CHART, CHART), dict(va_01=1.0, mape=0.0, recall=1.0, structural=True, n_missing=0)),
    "reversed": ((CHART, changed(lambda c: c["series"].reverse())), dict(va_01=1.0, structural=True)),
    "reversed points": ((CHART, changed(turned_points)), dict(va_01=1.0, n_matched=6)),
    "truncated": ((CHART, changed(drop_point)), dict(va_01=1.0, n_matched=2, n_missing=4, recall=1 / 3, structural=False)),
    "extra": ((CHART, changed(extra_point)), dict(n_spurious=1, n_matched=6)),
    "dropped series": ((CHART, {**CHART, "series": CHART["series"][1:]}), dict(n_missing=3, recall=0.5, series_count_ok=False)),
    "extra series": ((CHART, {**CHART, "series": [*CHART["series"], {"name": "Valley", "data": [{"x": "May", "y": 1.0}]}]}), dict(n_spurious=0, n_missing=0)),
    "tolerance": ((one_series(["k"], [250.0]), one_series(["k"], [260.0])), dict(va_01=0.0, va_05=1.0, va_10=1.0, mape=4.0)),
    "scale": ((one_series("pqrs", LEVELS), one_series("pqrs", [v / 100 for v in LEVELS])), dict(va_10=0.0, scale_errors=[0.01], structural=True)),
    "two points are no scale": ((one_series("pq", LEVELS[:2]), one_series("pq", [v * 1e6 for v in LEVELS[:2]])), dict(scale_errors=[])),
    "uneven scale": ((one_series("pqr", LEVELS[:3]), one_series("pqr", [7500.0, 12000.0, 40.0])), dict(scale_errors=[])),
    "x kinds": ((one_series([40, 41.5], [1.0, 2.0]), one_series([" 41.50", "4_0"], [2.0, 1.0])), dict(n_matched=2, va_01=1.0, fallback=False)),
    "x of other scripts": ((one_series(["12", "ß ŉ"], [1.0, 2.0]), one_series(["SS \u02bcN", "\u0661\u0662"], [2.0, 1.0])), dict(n_matched=2, va_01=1.0, fallback=False)),
    "fallback": ((one_series(["red", "green", "blue"], LEVELS[:3]), one_series(["one", "two", "three"], LEVELS[:3])), dict(fallback=True, n_matched=3)),
    "half is enough": ((one_series("kl", [3.0, 4.0]), one_series("km", [3.0, 4.0])), dict(fallback=False, n_matched=1, n_missing=1, n_spurious=1)),
    "none": ((CHART, None), dict(valid_json=False, recall=0.0, n_missing=0, n_matched=0, va_05=0.0)),
    "blank names": ((changed(unnamed), changed(unnamed_and_turned)), dict(va_01=1.0)),
    "twice x": ((one_series("kk", [3.0, 9.0]), one_series("kk", [3.0, 9.0])), dict(n_matched=2, va_01=1.0)),
    "zero": ((one_series("kl", [0.0, 0.0]), one_series("kl", [0.0, 0.25])), dict(va_10=0.5, mape=0.0)),
    "no series": (({**CHART, "series": []}, {**CHART, "series": []}), dict(structural=True, recall=0.0, mape=None)),
}


def test_cases(spark):
    got = {r.id: r for r in scored(spark, [c for c, _ in CASES.values()]).collect()}
    for i, (name, (_, want)) in enumerate(CASES.items()):
        for k, v in want.items():
            assert got[i][k] == (pytest.approx(v) if isinstance(v, float) else v), (name, k)


def test_scored_fields_mask(spark):
    wrong = {**CHART, "title": "other"}
    masked = summarise(scored(spark, [(CHART, wrong)], ["series_names"])).filter("level = 'overall'").first()
    assert masked.title_accuracy is None and masked.series_name_accuracy == 1 and masked.exact_structural_match == 1 and masked.n_partially_annotated == 1
    full = summarise(scored(spark, [(CHART, wrong)])).filter("level = 'overall'").first()
    assert full.title_accuracy == 0 and full.exact_structural_match == 0


def test_micro_average_and_levels(spark):
    a = (one_series("abc", [1.0, 2, 3]), one_series("abc", [1.0, 2, 3]))
    b = ({**one_series("a", [100.0]), "chart_type": "pie"}, {**one_series("a", [200.0]), "chart_type": "pie"})
    rows = {(r.level, r.key): r for r in summarise(scored(spark, [a, b, (CHART, None)])).collect()}
    assert rows["overall", "all"].va_05 == pytest.approx(0.75) and rows["overall", "all"].n == 3
    assert rows["chart_type", "pie"].va_05 == 0 and ("chart_type", "all") not in rows and set(k for level, k in rows if level == "series_count") == {"1", "2-3"}
    assert rows["overall", "all"].n_missing_points == 0 and "by_chart_type" in json.loads(score_json(summarise(scored(spark, [a]))))
    file = json.loads(score_json(summarise(scored(spark, [a]))))
    assert file["overall"]["value_accuracy"] == {"1%": 1.0, "5%": 1.0, "10%": 1.0} and file["overall"]["n_fully_annotated"] == 1
    assert "| r | 1 |" in report({"r": file}, "t")


PARSING = [
    (json.dumps(CHART), None, []),
    ("```json\n" + json.dumps(CHART) + "\n```", None, ["stripped markdown fence"]),
    ("```\n" + json.dumps(CHART), None, ["stripped markdown fence"]),
    ("Here: " + json.dumps(CHART) + " done", None, ["extracted from prose"]),
    ("[" + json.dumps(CHART) + "]", None, ["extracted from prose"]),
    (json.dumps(CHART) + " trailing", "invalid JSON: Extra data", []),
    ("", "empty output", []),
    (None, "empty output", []),
    ("No figures visible here", "no JSON object found", []),
    ('{"chart_type": "bar",}', "invalid JSON: ", []),
    ('{"chart_type": "donut", "series": []}', "schema violation: 1 validation error for ChartData", []),
    ('{"chart_type": "bar", "series": 5}', "schema violation: 1 validation error for ChartData", []),
    ('{"chart_type": "bar", "chart_type": "line"}', None, []),
    ('{"chart_type": "bar", "note": 1, "series": [{"name": "a", "points": [{"label": "q", "value": "12", "z": 0}]}]}', None, ["data<-points", "x<-label", "y<-value", "dropped point.z", "dropped note"]),
    ('{"chart_type": "bar", "series": [{"name": "a", "data": [{"x": "q", "label": "r", "y": 1}]}]}', None, ["dropped point.label"]),
    ('{"chart_type": "bar", "series": [{"name": "a", "data": [{"x": "q", "y": "1,000"}]}]}', "schema violation: 1 validation error for ChartData", []),
    ('{"chart_type": "bar", "series": [{"name": 3, "data": [{"x": null, "y": null}]}]}', "schema violation: 4 validation errors for ChartData", []),
    ('{"chart_type": "bar", "series": [{"name": "a", "data": [{"x": NaN, "y": "NaN"}]}]}', None, []),
]


@pytest.mark.parametrize("raw,error,repairs", PARSING)
def test_parsing(raw, error, repairs):
    got = parse_one(raw)
    assert got["repairs"] == repairs
    assert (got["error"] is None) == (error is None) and (error is None or got["error"].startswith(error))


def test_strict_parsing_repairs_nothing():
    assert parse_one('{"chart_type": "bar", "series": [{"name": "a", "points": []}]}', lenient=False)["error"].startswith("schema violation: 2 ")


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        g, p = rng.integers(0, 6, 2)
        score = rng.random((g, p)).round(1)
        got = assign(score)
        assert len(got) == min(g, p) and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
        small, large = (score, p) if g <= p else (score.T, g)
        best = max((sum(small[i, j] for i, j in enumerate(q)) for q in itertools.permutations(range(large), len(small))), default=0)
        assert sum(score[a, b] for a, b in got) == pytest.approx(best)


def test_generated_charts_score_perfectly(spark):
    gold = with_gold(specs(spark, 40, seed=3)).withColumn("ord", F.col("seed")).withColumn("scored_fields", F.lit(None).cast("array<string>"))
    assert self_check(gold.cache()).count() == 0
    assert specs(spark, 40, seed=3).orderBy("id").collect() == specs(spark, 40, seed=3).repartition(7).orderBy("id").collect()
    base = stacked(long_values(specs(spark, 20))).groupBy("id", "j").agg(F.count_if(F.col("base") == 0).alias("n")).agg(F.min("n")).first()[0]
    assert base >= 1
    back = gold.select("gold", parse_prediction(canonical_json(F.col("gold")), False).alias("b")).filter(~F.col("gold").eqNullSafe(F.col("b.chart")))
    assert back.count() == 0


def test_log_to_scores(spark, tmp_path):
    rows = [("a", CHART), ("b", CHART), ("c", CHART)]
    (tmp_path / "m.jsonl").write_text("\n\n".join(json.dumps({"id": i, "image": "x", "gold": g}) for i, g in rows))
    log = [("a", json.dumps(CHART), None), ("b", "", "RuntimeError: x"), ("b", json.dumps(CHART), None), ("c", json.dumps(CHART), None), ("c", json.dumps({**CHART, "extra": 1}), "OOM"), ("zz", "{}", None)]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"id": i, "raw": r, "n_tokens": 5, "seconds": n, "gen_error": e}) for n, (i, r, e) in enumerate(log)))
    out = score(read_manifest(spark, str(tmp_path / "m.jsonl")), read_predictions(spark, str(tmp_path / "p.jsonl")))
    total = out["summary"].filter("level = 'overall'").first()
    assert (total.n, total.valid_json_rate) == (3, pytest.approx(2 / 3))
    assert [tuple(r) for r in out["parse_errors"].collect()] == [("OOM", 1)] and [(r.repair, r.n) for r in out["repairs"].collect()] == [("dropped extra", 1)]
    assert tuple(out["timing"].first()) == (4.0, 5.0)  # 0, 2, 4, 5 seconds


def longest_common(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-1][j], rows[-2][j + 1]))
    return rows[-1][-1]


def plain_score(gold, pred):
    """One chart scored by loops: points and errors of the best assignment of series."""
    label = lambda t: re.sub(r"^[\W_]+|[\W_]+$", "", " ".join(t.split()).casefold())
    off = lambda g, p: abs(p - g) / abs(g) if abs(g) >= 1e-9 else 0.0 if abs(p) < 1e-9 else math.inf

    def alike(g, p):
        a, b = label(g["name"]), label(p["name"])
        name = 2 * longest_common(a, b) / (len(a) + len(b)) if a or b else 0.0
        near = sum(off(x["y"], y["y"]) <= 0.1 for x, y in zip(g["data"], p["data"]))
        most = max(len(g["data"]), len(p["data"]))
        return 0.85 * name + 0.15 * (near / most if g["data"] and p["data"] else 0.0)

    gs, ps = gold["series"], pred["series"]
    few, many, turn = (gs, ps, False) if len(gs) <= len(ps) else (ps, gs, True)
    best = max(itertools.permutations(range(len(many)), len(few)), key=lambda q: sum(alike(*((many[j], few[i]) if turn else (few[i], many[j]))) for i, j in enumerate(q)))
    matched = [(gs[j], ps[i]) if turn else (gs[i], ps[j]) for i, j in enumerate(best)]
    pairs, missing, spurious, fallback = [], sum(len(g["data"]) for g in gs if not any(g is m for m, _ in matched)), 0, False
    for g, p in matched:
        free, own = list(p["data"]), []
        for x in g["data"]:
            fit = next((y for y in free if label(y["x"]) == label(x["x"])), None)
            if fit:
                own.append((x["y"], fit["y"]))
                free.remove(fit)
        shorter = min(len(g["data"]), len(p["data"]))
        if shorter and len(own) < shorter / 2:
            own, fallback = [(x["y"], y["y"]) for x, y in zip(g["data"], p["data"])], True
        pairs += own
        missing += len(g["data"]) - len(own)
        spurious += len(p["data"]) - len(own)
    errors = [off(*q) for q in pairs]
    finite = sorted(e for e in errors if e < math.inf)
    n = len(finite)
    return dict(
        n_matched=len(pairs), n_missing=missing, n_spurious=spurious, fallback=fallback, hits_01=sum(e <= 0.01 for e in errors), hits_05=sum(e <= 0.05 for e in errors), hits_10=sum(e <= 0.10 for e in errors),
        mape=100 * sum(finite) / n if n else None, median_ape=50 * (finite[(n - 1) // 2] + finite[n // 2]) if n else None,
        recall=len(pairs) / max(1, sum(len(g["data"]) for g in gs)), series_count_ok=len(gs) == len(ps),
    )


def test_known_run(spark, tmp_path):
    """A run written as files, scored from them and by plain loops: the whole way from manifest and log to the summary."""
    r = random.Random(8)
    words = ["North sea", "Alps", "Straße", "lake", "Delta (upper)", "coast", "Moor"]
    gold, log, want = [], [], []
    for i in range(60):
        series = [{"name": n, "data": [{"x": f"P{k}", "y": round(r.uniform(0, 90), 2) * (r.random() > 0.05)} for k in range(r.randint(1, 6))]} for n in r.sample(words, r.randint(1, 4))]
        chart = {"chart_type": r.choice(["bar", "line", "pie"]), "title": f"T{i}", "x_label": None, "y_label": "u", "series": series}
        said = json.loads(json.dumps(chart))
        for s in said["series"]:
            s["name"] = s["name"].upper() if r.random() < 0.4 else s["name"] + "!"
            for p in s["data"]:
                p["y"] = round(p["y"] * r.choice([1, 1.005, 1.04, 1.08, 1.5]), 4)
                p["x"] = f" {p['x'].lower()}" if r.random() < 0.5 else p["x"] if i % 7 else f"Q{p['x']}"
            s["data"] = [p for p in s["data"] if r.random() > 0.15]
            r.shuffle(s["data"])
        r.shuffle(said["series"])
        if i % 5 == 0 and len(said["series"]) > 1:
            said["series"].pop()
        elif i % 5 == 1:
            said["series"].append({"name": "zzz", "data": [{"x": "P0", "y": 1.0}]})
        gold.append({"id": f"c{i}", "image": "x", "gold": chart})
        log.append({"id": f"c{i}", "raw": "{" if i % 6 == 0 else "x", "n_tokens": 3, "seconds": 1.0, "gen_error": "late"})
        log.append({"id": f"c{i}", "raw": "```json\n" + json.dumps(said) + "\n```", "n_tokens": i, "seconds": float(i), "gen_error": None})
        want.append(plain_score(chart, said))
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, gold)))
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, log)))
    out = score(read_manifest(spark, str(tmp_path / "gold.jsonl")), read_predictions(spark, str(tmp_path / "log.jsonl")))
    got = {x.id: x for x in out["samples"].collect()}
    for i, w in enumerate(want):
        for k, v in w.items():
            assert got[f"c{i}"][k] == (pytest.approx(v) if isinstance(v, float) else v), (i, k)
    total = out["summary"].filter("level = 'overall'").first()
    hits, pairs = sum(w["hits_05"] for w in want), sum(w["n_matched"] for w in want)
    assert (total.n, total.n_matched_points, total.n_missing_points) == (60, pairs, sum(w["n_missing"] for w in want))
    assert total.va_05 == pytest.approx(hits / pairs) and total.n_positional_fallback == sum(w["fallback"] for w in want) > 0
    assert total.mape == pytest.approx(np.mean([w["mape"] for w in want if w["mape"] is not None]))
    assert total.median_ape == pytest.approx(np.median([w["median_ape"] for w in want if w["median_ape"] is not None]))
    assert tuple(out["timing"].first()) == (30.0, 29.5)


def test_command_line(spark, tmp_path, capsys):
    other = {**CHART, "title": "<b>", "series": CHART["series"][:1]}
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"id": i, "image": "x", "gold": CHART}) for i in "abc"))
    log = [("a", json.dumps(CHART)), ("b", json.dumps(other)), ("c", "no < json")]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps({"id": i, "raw": r, "n_tokens": 5, "seconds": 2.0, "gen_error": None}) for i, r in log))
    at = lambda name: str(tmp_path / name)
    assert main(["selfcheck", "--manifest", at("m.jsonl")]) == 0 and "all perfect" in capsys.readouterr().out
    empty = json.dumps({"id": "z", "image": "x", "gold": {**CHART, "series": []}})
    (tmp_path / "bad.jsonl").write_text(empty)
    assert main(["selfcheck", "--manifest", at("bad.jsonl")]) == 1 and "z" in capsys.readouterr().out
    assert main(["score", "--manifest", at("m.jsonl"), "--preds", at("p.jsonl"), "--out", at("s/one.json"), "--model", "m1"]) == 0
    assert main(["score", "--manifest", at("m.jsonl"), "--preds", at("p.jsonl"), "--out", at("s/two.json"), "--limit", "1"]) == 0
    one, two = (json.loads((tmp_path / "s" / f"{x}.json").read_text()) for x in ("one", "two"))
    assert (one["overall"]["n"], two["overall"]["n"]) == (3, 1) and one["config"]["model"] == "m1" and one["timing"] == {"median_seconds": 2.0, "mean_tokens": 5.0}
    assert one["parse_errors"] == ["no JSON object found"] and one["overall"]["n_missing_points"] == 3
    assert main(["report", "--run", f"one={at('s/one.json')}", "--run", f"none={at('s/none.json')}", "--run", f"two={at('s/two.json')}", "--out", at("r.md"), "--preamble", "Hello."]) == 0
    page = (tmp_path / "r.md").read_text()
    assert "| one | 3 |" in page and "none" not in page.split("## Runs")[1] and "model: m1" in page and "Hello." in page
    assert main(["inspect", "--manifest", at("m.jsonl"), "--preds", at("p.jsonl"), "--out", at("i.html"), "--all"]) == 0
    page = (tmp_path / "i.html").read_text()
    assert page.count("<article>") == 3 and "&lt;b&gt;" in page and "no &lt; json" in page and "series 1/2" in page and "missing 3" in page
    main(["inspect", "--manifest", at("m.jsonl"), "--preds", at("p.jsonl"), "--out", at("i.html")])
    assert (tmp_path / "i.html").read_text().count("<article>") == 1


def test_empty_inputs(spark):
    none = scored(spark, [(CHART, CHART)]).filter("false")
    assert summarise(none).count() == 0
    assert repair_histogram(none.withColumn("ord", F.lit(1)), "ord").count() == 0
