"""Runs from logs to scores: score, self-check, probe and report."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeframe.functions.parsing import canonical_json, parse_prediction
from gradeframe.functions.text import anls, exact_match
from gradeframe.operators.log import is_error, scoring_view, timing
from gradeframe.operators.scoring import parse_errors, repair_histogram, score_samples, summarise
from gradeframe.sources.jsonl import read_text, score_json, write_text

#: What a score file says about its run.
CONFIG = ("manifest", "preds", "model", "adapter", "dtype", "prompt", "prompt_version", "constrained", "long_edge", "max_new_tokens")


def score_rows(manifest: DataFrame, rows: DataFrame, lenient: bool = True) -> DataFrame:
    """Scored rows of a log as it is: predictions whose id the manifest has. A failed generation has no record but keeps its repairs.

    A column `run` is kept, so rows of several runs are scored at once. Rows without a gold record aren't parsed.
    """
    keys = [c for c in ("run", "id") if c in rows.columns]
    joined = rows.select(*keys, "raw", "n_tokens", "seconds", "gen_error", "ord").join(manifest.select("id", "gold", "scored_fields", "properties"), "id")
    joined = joined.withColumn("parsed", parse_prediction(F.col("raw"), lenient))
    failed = is_error(F.col("gen_error"))
    pred = F.when(~failed, F.col("parsed.chart"))
    error = F.when(failed, F.col("gen_error")).otherwise(F.col("parsed.error"))
    return score_samples(joined.withColumn("pred", pred).withColumn("error", error).withColumn("repairs", F.col("parsed.repairs")).drop("parsed"))


def dealt(df: DataFrame, parts: int | None) -> DataFrame:
    """df by id in so many partitions, which compaction and join then share; None leaves it to Spark, whose partitions grow with large runs."""
    return df if parts is None else df.repartition(parts, "id")


def samples(manifest: DataFrame, log: DataFrame, lenient: bool = True, parts: int | None = None) -> DataFrame:
    """score_rows() of the last row of each id."""
    return score_rows(dealt(manifest, parts), scoring_view(dealt(log, parts)), lenient)


def sweep(manifest: DataFrame, logs: DataFrame, lenient: bool = True, parts: int | None = None) -> DataFrame:
    """samples() of logs of several runs (column run), in one plan: one compaction, one join with the gold records."""
    return score_rows(dealt(manifest, parts), scoring_view(dealt(logs, parts), ["run", "id"]), lenient)


def score(manifest: DataFrame, log: DataFrame, lenient: bool = True) -> dict[str, DataFrame]:
    """samples, summary, parse_errors, repairs and timing of a run. All but timing come from samples: persist it to have it computed once, as write_scores does."""
    rows = samples(manifest, log, lenient)
    return {"samples": rows, "summary": summarise(rows), "parse_errors": parse_errors(rows), "repairs": repair_histogram(rows, "ord"), "timing": timing(scoring_view(log))}


def self_check(manifest: DataFrame) -> DataFrame:
    """Samples whose own gold, written and read back, doesn't score perfectly. Should be empty."""
    own = manifest.select("id", canonical_json(F.col("gold")).alias("raw"), F.lit(0).alias("n_tokens"), F.lit(0.0).alias("seconds"), F.lit(None).cast("string").alias("gen_error"), "ord")
    return imperfect(samples(manifest, own))


def imperfect(s: DataFrame) -> DataFrame:
    """Scored samples that aren't right in all."""
    perfect = F.col("valid_json") & F.col("structural") & (F.col("recall") == 1) & (F.col("va_01") == 1) & (F.col("n_missing") == 0) & (F.col("n_spurious") == 0) & F.coalesce(F.col("mape") == 0, F.lit(False))
    return s.filter(~perfect)


def probe(rows: DataFrame) -> DataFrame:
    """Question-answer rows (prediction, answers, error) to anls, exact_match, n, n_errors; means are of unrounded scores."""
    p = F.when(is_error(F.col("error")), F.lit("")).otherwise(F.coalesce("prediction", F.lit("")))
    return rows.agg(
        F.round(F.avg(anls(p, F.col("answers"))), 4).alias("anls"),
        F.round(F.avg(exact_match(p, F.col("answers")).cast("double")), 4).alias("exact_match"),
        F.count("*").alias("n"),
        F.count_if(is_error(F.col("error"))).alias("n_errors"),
    )


def config(flags: dict) -> dict:
    """The whitelisted settings of a run, paths as text. The prompt's version comes with the run, not from the scorer."""
    return {k: v if v is None or isinstance(v, (bool, int, float)) else str(v) for k, v in flags.items() if k in CONFIG}


def percent(x: float | None) -> str:
    return "n/a" if x is None else f"{100 * x:.1f}%"


def write_scores(out: dict[str, DataFrame], flags: dict, path: str) -> None:
    """score()'s frames as one score file: summary, parse errors, repairs, configuration and timing."""
    timed = out["timing"].first()
    out["samples"].persist(StorageLevel.DISK_ONLY)  # scored once for all that follows
    try:
        extra = {
            "parse_errors": [r.error for r in out["parse_errors"].orderBy("error").toLocalIterator()],
            "repairs": {r.repair: r.n for r in out["repairs"].collect()},  # a name for each kind of repair
            "config": config(flags),
            "timing": {"median_seconds": timed.median_seconds, "mean_tokens": timed.mean_tokens},
        }
        write_text(path, score_json(out["summary"], extra))
    finally:
        out["samples"].unpersist()


def read_runs(items: list[str]) -> dict[str, dict]:
    """Score files by NAME=PATH; those that aren't there are left out."""
    pairs = (item.partition("=") for item in items)
    texts = {name.strip(): read_text(path.strip()) for name, _, path in pairs}
    return {name: json.loads(text) for name, text in texts.items() if text is not None}


def table_row(*cells: object) -> str:
    return f"| {' | '.join(map(str, cells))} |"


def run_line(name: str, run: dict) -> str:
    """What a run was made with."""
    said = [f"{k}: {v}" for k, v in run.get("config", {}).items() if v is not None]
    timed = run.get("timing", {})
    if timed.get("median_seconds") is not None:
        said.append(f"{timed['median_seconds']:.1f} s a sample (median)")
    if timed.get("mean_tokens") is not None:
        said.append(f"{timed['mean_tokens']:.0f} tokens (mean)")
    return f"- **{name}**: {'; '.join(said) or 'nothing is known'}"


def report(runs: dict[str, dict], title: str, preamble: str = "") -> str:
    """Markdown of some runs, given as score files have them: a table of all, groups of each, and what they were made with."""
    rates = {"valid JSON": "valid_json_rate", "chart type": "chart_type_accuracy", "series names": "series_name_accuracy", "structural": "exact_structural_match"}
    head = ["run", "n", *rates, "value@1%", "**value@5%**", "value@10%", "median APE", "recall"]
    lines = [f"# {title}", "", *([preamble, ""] if preamble else []), table_row(*head), "|" + "---|" * len(head)]
    for name, run in runs.items():
        r, va = run["overall"], run["overall"]["value_accuracy"]
        median = "n/a" if r["median_ape"] is None else f"{r['median_ape']:.0f}%"
        lines.append(table_row(name, r["n"], *(percent(r[k]) for k in rates.values()), percent(va["1%"]), f"**{percent(va['5%'])}**", percent(va["10%"]), median, percent(r["point_recall"])))
    for name, run in runs.items():
        for level, label in (("by_chart_type", "chart type"), ("by_series_count", "series count")):
            if run.get(level):
                lines += ["", f"## {name}: by {label}", "", table_row(label, "n", "value@5%", "structural", "recall"), "|---|---|---|---|---|"]
                lines += [table_row(k, r["n"], percent(r["value_accuracy"]["5%"]), percent(r["exact_structural_match"]), percent(r["point_recall"])) for k, r in run[level].items()]
    if runs:
        lines += ["", "## Runs", "", *(run_line(name, run) for name, run in runs.items())]
    return "\n".join(lines) + "\n"


STYLE = "body{font:15px sans-serif;margin:2em}article{border:1px solid #bbb;margin:1em 0;padding:1em}.two{display:flex;gap:1em}pre{flex:1;overflow:auto;background:#f3f3f3;padding:.6em}.ok{color:#060}.bad{color:#b00}.note{color:#850}"


def inspector(rows: DataFrame, n: int, only_failures: bool = True) -> str:
    """A self-contained page of the first n scored samples by id, or of those that fail: verdicts, gold and prediction (its raw text, if there is one and it didn't parse) side by side."""
    from gradeframe.functions.text import html_escape
    from gradeframe.operators.diagnostics import details, failures

    picked = (failures(rows) if only_failures else rows).orderBy("id").limit(n)
    raw = F.col("raw") if "raw" in rows.columns else F.lit(None).cast("string")
    text = lambda c: html_escape(F.coalesce(c, F.lit("")))
    shown = picked.select(text(F.col("id")).alias("id"), details().alias("chips"), text(F.col("error")).alias("error"), text(canonical_json(F.col("gold"))).alias("gold"), text(F.coalesce(F.when(F.col("pred").isNotNull(), canonical_json(F.col("pred"))), raw)).alias("pred"))

    def card(r) -> str:
        chips = " ".join(f'<span class="{c.state}">{c.label}</span>' for c in r.chips)
        return f'<article><h2>{r.id}</h2><p>{chips}</p><p class="bad">{r.error}</p><div class="two"><pre>{r.gold}</pre><pre>{r.pred}</pre></div></article>'

    return f"<!doctype html><meta charset=utf-8><style>{STYLE}</style>" + "".join(map(card, shown.collect()))  # n rows
