"""Order statistics and running sums without a task that holds them all, against Python."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import ranks


def any_double(r):
    return struct.unpack("d", struct.pack("Q", r.getrandbits(64)))[0]


def groups_of(seed):
    r = random.Random(seed)
    near = lambda x, n: [struct.unpack("d", struct.pack("q", struct.unpack("q", struct.pack("d", x))[0] + r.randint(0, n)))[0] for _ in range(41)]
    out = {
        "bits": [any_double(r) for _ in range(301)], "even": [any_double(r) for _ in range(60)], "neighbours": near(0.3, 3), "close": near(-7e9, 10**6), "subnormal": near(0.0, 5),
        "ties": [r.choice([1.0, 2.0]) for _ in range(99)], "one": [5.5], "two": [1.0, 1e6], "far": [-1.7e308, 1.7e308, 1e-320, -1e-320], "zeros": [0.0, -0.0, 0.0, 1.0], "nan": [math.nan, 1.0, math.nan], "inf": [math.inf, -math.inf, 3.0, math.inf],
        "small": [r.gauss(0, 1) for _ in range(500)], "apart": [-1e300, 1 - 2**-53, 1.0, 2.0], None: [4.0, 3.0],
    }
    return {k: v + [None] * r.randint(0, 3) for k, v in out.items()} | {"nulls": [None, None]}


def order(x):
    return (1, 0.0) if math.isnan(x) else (0, x)


@pytest.mark.parametrize("seed, few", [(1, 0), (2, 0), (1, 1 << 17)])
def test_middles(spark, monkeypatch, seed, few):
    monkeypatch.setattr(ranks, "FEW", few)
    groups = groups_of(seed)
    rows = [(k, v) for k, own in groups.items() for v in own]
    random.Random(seed).shuffle(rows)
    got = {r.k: (r.n, r.low, r.high) for r in ranks.middles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(got) == set(groups)
    for k, own in groups.items():
        s = sorted((v for v in own if v is not None), key=order)
        want = (len(s), s[(len(s) - 1) // 2], s[len(s) // 2]) if s else (0, None, None)
        assert str(got[k]).replace("-0.0", "0.0") == str(want).replace("-0.0", "0.0"), k


@pytest.mark.parametrize("few", [0, 100])
def test_middles_with_times(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    rows = [("a", 1.0, 3), ("a", 2.0, 1), ("a", 2.0, -1), ("a", 9.0, 2), ("b", 1.0, 1), ("b", 1.0, -1)]
    df = spark.createDataFrame(rows, "k string, v double, t int")
    assert sorted(map(tuple, ranks.median(df, ["k"], "v", "t").collect())) == [("a", 1.0), ("b", None)]
    assert ranks.middles(df.limit(0), ["k"], "v").count() == 0
    assert ranks.middles(df, [], "v").collect()[0].n == 6


@pytest.mark.parametrize("block", [3, 40, 10**6])
def test_running_sums(spark, block):
    r = random.Random(block)
    rows = [(r.choice([None, *range(60)]), r.choice([None, 1.5, float(r.randint(0, 9))])) for _ in range(200)]
    got = [tuple(x) for x in ranks.running_sums(spark.createDataFrame(rows, "o int, v double"), "o", "v", block).orderBy("nth").collect()]
    first = lambda x: (x is not None, x or 0)
    n, total, want = 0, 0.0, []
    for i, (o, v) in enumerate(sorted(rows, key=lambda x: (first(x[0]), first(x[1]))), 1):
        n, total = n + (v is not None), total + (v or 0.0)
        want.append((o, v, i, n, total))
    assert got == want


def test_blocks_of_many_cuts(spark):
    cuts = sorted(random.Random(1).sample(range(10_000), 700))
    rows = [(x,) for x in (*cuts, -5, 0, 9_999, 20_000, *range(0, 10_000, 37))]
    import bisect

    got = spark.createDataFrame(rows, "x int").select("x", ranks.block_of(F.col("x"), cuts).alias("b")).collect()
    assert all(g.b == bisect.bisect_left(cuts, g.x) for g in got)
