"""Comparisons of runs against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest

from gradeframe.operators import diagnostics as D


def weight(seed, k, key):
    u = int(hashlib.md5(f"{seed}:{k}:{key}".encode()).hexdigest()[:8], 16) / 2**32
    n = 0
    while u < 1 - math.exp(-1) * sum(1 / math.factorial(j) for j in range(n + 1)):
        n += 1
    return n


def test_paired_differences(spark):
    r = random.Random(2)
    value = lambda: r.choice([None, r.random(), r.random()])
    rows = [(run, f"s{i}", value(), r.random() < 0.7) for run in ("base", "x", "y") for i in range(40) if r.random() < 0.9]
    got = D.paired_differences(spark.createDataFrame(rows, "run string, id string, m double, ok boolean"), ["m", "ok"], "base", rounds=25, seed=3)
    got = {(g.run, g.metric): g for g in got.collect()}
    assert set(got) == {(run, m) for run in ("x", "y") for m in ("m", "ok")}
    for (run, metric), g in got.items():
        at = 2 if metric == "m" else 3
        base = {i: row[at] for row in rows if row[0] == "base" for i in [row[1]]}
        d = {row[1]: float(row[at]) - float(base[row[1]]) for row in rows if row[0] == run and row[at] is not None and base.get(row[1]) is not None}
        means = [np.average(list(d.values()), weights=[weight(3, k, i) for i in d]) for k in range(1, 26)]
        assert g.n == len(d) and g.mean == pytest.approx(sum(d.values()) / len(d))
        assert (g.low, g.high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_weights_are_poisson():
    n = [weight(0, k, "a") for k in range(20_000)]
    assert abs(np.mean(n) - 1) < 0.03 and abs(np.var(n) - 1) < 0.05


def test_run_difference(spark):
    a = spark.createDataFrame([("1", "x"), ("2", None), ("3", "y"), ("4", "only")], "id string, raw string")
    b = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z"), ("5", "p"), ("6", None)], "id string, raw string")
    assert tuple(D.run_difference(a, b, "id", "raw").first()) == (3, 2, 1, 2)
    assert tuple(D.run_difference(a.limit(0), b, "id", "raw").first()) == (0, 0, 0, 5)
