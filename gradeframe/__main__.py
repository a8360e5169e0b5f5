"""python -m gradeframe score | selfcheck | report | inspect: whole runs from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from gradeframe.plans import evaluate as E
from gradeframe.sources.jsonl import first_rows, read_manifest, read_predictions, write_text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gradeframe", description=__doc__)
    sub = top.add_subparsers(dest="what", required=True)
    for name, told in (("score", "score a log of predictions"), ("inspect", "a page of a run's samples"), ("selfcheck", "whether the gold scores perfectly against itself; exit code 1 if not")):
        own = sub.add_parser(name, help=told)
        own.add_argument("--manifest", required=True)
        own.add_argument("--limit", type=int, help="only the first rows of the manifest")
        if name != "selfcheck":
            own.add_argument("--preds", required=True)
            own.add_argument("--out", required=True)
        if name == "score":
            for flag in ("model", "adapter", "dtype", "prompt", "prompt-version", "long-edge", "max-new-tokens"):
                own.add_argument(f"--{flag}")
        if name == "inspect":
            own.add_argument("-n", type=int, default=20)
            own.add_argument("--all", action="store_true", help="not only failures")
    own = sub.add_parser("report", help="compare score files")
    own.add_argument("--run", action="append", default=[], metavar="NAME=PATH")
    own.add_argument("--out", required=True)
    own.add_argument("--title", default="Runs")
    own.add_argument("--preamble", default="")
    return top


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    if a.what == "report":
        write_text(a.out, E.report(E.read_runs(a.run), a.title, a.preamble))
        return 0
    spark = SparkSession.builder.appName("gradeframe").getOrCreate()
    manifest = first_rows(read_manifest(spark, a.manifest), a.limit)
    if a.what == "selfcheck":
        wrong = [r.id for r in E.self_check(manifest).select("id").limit(20).collect()]
        print(f"not perfect: {', '.join(wrong)}" if wrong else "all perfect")
        return int(bool(wrong))
    if a.what == "score":
        E.write_scores(E.score(manifest, read_predictions(spark, a.preds)), vars(a), a.out)
    else:
        write_text(a.out, E.inspector(E.samples(manifest, read_predictions(spark, a.preds)), a.n, not a.all))
    return 0


if __name__ == "__main__":
    sys.exit(main())
