"""The operators on vectors against brute force."""

import hashlib
import math
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import clustering, neighbours
from gradeframe.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"


def rows_of(n, dim, seed=0):
    r = np.random.default_rng(seed)
    return [(i, r.normal(size=dim).tolist(), 0) for i in range(n)]


def odd_rows(dim):
    rows = rows_of(60, dim)
    same = rows[3][1]
    bad = [None, [], same[:-1], [*same, 1.0], [None, *same[1:]], [math.nan, *same[1:]], [math.inf, *same[1:]]]
    return rows + [(3, same, None), (3, same, 1), (None, same, 1), (None, rows[5][1], 1), *((100 + i, same, 1) for i in range(30)), *((200 + i, b, 1) for i, b in enumerate(bad)), (300, [0.0] * dim, 1), (3, rows[9][1], 1)]


def lloyd(rows, k, rounds, dim, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    text = lambda i: "" if i is None else str(i)
    centroids = [q for _, q in sorted(((hashlib.sha256(f"{seed}:{text(i)}".encode()).hexdigest(), q) for i, q in kept))[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    end = [(i, *nearest(q)) for i, q in kept]
    total = sum(d for _, d, _ in end)
    of = lambda j: sum(d for _, d, c in end if c == j)
    return sorted(((i, c, d, of(c), total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in end), key=str)


@pytest.mark.parametrize("k, dim, scale", [(5, 6, 64), (3, 4, 2_000_000), (200, 6, 64)])
def test_clustering(spark, k, dim, scale):
    rows = odd_rows(dim)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("q", "weight", "cluster", "h", "distance", "s0"):
        df = df.withColumn(c, F.lit("x"))
    got = sorted(map(tuple, clustering.cluster(df, k, 3, dim, scale, 1).collect()), key=str)
    assert got == lloyd(rows, k, 3, dim, scale, 1)
    assert clustering.cluster(df.limit(0), k, 3, dim, scale).count() == 0


def test_too_large_components(spark):
    most = clustering.largest(4) / 64
    rows = [(1, [0.99 * most] * 4, 0), (2, [-0.99 * most] * 4, 0), (3, [1.01 * most] * 4, 0)]
    got = clustering.cluster(spark.createDataFrame(rows, SCHEMA), 1, 0, 4).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == [1, 2]
    assert sorted(r.distance for r in got) == [0, 4 * (math.floor(64 * 0.99 * most) - math.floor(-64 * 0.99 * most)) ** 2]


def test_sums_of_heavy_weights(spark):
    """Weights of a trillion times components of 28 bits: beyond 64 bits, exact all the same."""
    rows = [([2**27 - 1, -(2**27)], 10**12 + 7), ([5, -3], 3), ([2**27 - 5, 1], 2**40)]
    got = clustering.sums(spark.createDataFrame(rows, "q array<int>, weight long").coalesce(1), np.array([[0, 0], [2**27, 0]])).collect()
    want = {0: [5 * 3, -9], 1: [sum(q[0] * w for q, w in rows if q[0] > 5), sum(q[1] * w for q, w in rows if q[0] > 5)]}
    assert {r.cluster: [r.s0, r.s1] for r in got} == {c: list(map(Decimal, s)) for c, s in want.items()}
    assert {r.cluster: r.weight for r in got} == {0: 3, 1: 10**12 + 7 + 2**40}


# ---- neighbours -------------------------------------------------------------------


def nearest_rows(rows, asks, k):
    """{(query's place, rank): (query_id, vec_id, score)} by brute force, zeros behind shorter vectors."""
    fits = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    kept = [(i, np.array(v + [0.0] * (max(len(r[1] or []) for r in rows) - len(v)))) for i, v, *_ in rows if fits(v)]
    kept = [(i, v / np.abs(v).max()) for i, v in kept]
    out = []
    for a, (i, v) in enumerate(kept):
        if i is not None and asks(i):
            others = [(-round(float(v @ w) / math.sqrt(v @ v) / math.sqrt(w @ w), 12), j is None, j or 0, j) for b, (j, w) in enumerate(kept) if b != a]
            out += [(i, n, j, -s) for n, (s, _, _, j) in enumerate(sorted(others, key=lambda o: o[:3])[:k], 1)]
    return sorted(out, key=str)


def rounded(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in df.collect()), key=str)


@pytest.mark.parametrize("part, visits", [(1 << 14, 1 << 12), (16, 8)])
def test_neighbours_of_odd_rows(spark, monkeypatch, part, visits):
    monkeypatch.setattr(neighbours, "PART", part)
    monkeypatch.setattr(neighbours, "VISITS", visits)
    rows = odd_rows(6) + [(400, [1e200] * 6, 0), (401, [1e-200] * 6, 0), (402, [-1e300, 1e-300, 0.0, 0.0, 0.0, 0.0], 0), (403, [2.0 * x for x in rows_of(4, 6)[3][1]], 0), (3, rows_of(4, 6)[3][1], 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("x", "did", "times", "tree", "leaf", "ids", "score", "rank"):
        df = df.withColumn(c, F.lit("x"))
    got = rounded(neighbours.search(df, F.col("vec_id") % 3 == 0, 5))
    assert got == nearest_rows(rows, lambda i: i % 3 == 0, 5)
    assert neighbours.search(df.limit(0), F.col("vec_id") % 3 == 0, 5).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0], 0), (2, None, 0)], SCHEMA)
    assert rounded(neighbours.search(few, F.col("vec_id") == 0, 5)) == [(0, 1, 1, 1.0)]


def clustered(n, dim, seed=0):
    """Vectors round a few hundred centres, a third of them copies of one or nearly so."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(300, dim))
    x = centres[r.integers(0, 300, n)] + 0.3 * r.normal(size=(n, dim))
    x[: n // 6] = x[0]
    x[n // 6 : n // 3] = x[0] + 0.01 * r.normal(size=(n // 3 - n // 6, dim))
    return x


def test_recall_of_a_forest(spark, monkeypatch):
    """Many small leaves: the measured number of visits reaches the wanted recall, and for vectors with structure it is a small part of the forest."""
    monkeypatch.setattr(neighbours, "LEAF", 32)
    monkeypatch.setattr(neighbours, "FIT_ROWS", 2000)
    x = clustered(6000, 24)
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    seen = []
    needed = neighbours.visits_needed
    monkeypatch.setattr(neighbours, "visits_needed", lambda *a: seen.append((needed(*a), a[1])) or seen[-1][0])
    got = {}
    for r in neighbours.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 20):
        s = u @ u[q]
        s[q] = -2
        least = np.sort(s)[-5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and q not in {v for v, _ in got[q].values()}
        assert all(abs(s[v] - c) < 1e-12 for v, c in got[q].values())
        hits += sum(s[v] >= least - 1e-12 for v, _ in got[q].values())
    assert hits >= 0.92 * 300 * 5
    (visits, forest), leaves = seen[0], neighbours.TREES << seen[0][1].depth
    assert forest.depth == 8 and visits < leaves / 10


def test_visits_come_nearest_first():
    """The queue's order is that of all leaves' distances, which are added up along their paths."""
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 8))
    d = np.linalg.qr(r.normal(size=(8, 8)))[0][:, :4]
    forest = neighbours.Forest(np.array([d, d[:, ::-1]]), [], 4)
    forest.cuts = [neighbours.medians(p, 4).tolist() for p in forest.projections(x)]
    leaves = forest.leaves(x)
    assert all(np.bincount(own, minlength=16).min() >= 30 for own in leaves)
    p = forest.projections(x[:1])[:, 0].tolist()

    def far(t, leaf):
        node, total = 1, 0.0
        for level in range(4):
            right = leaf >> (3 - level) & 1
            gap = p[t][level] - forest.cuts[t][node]
            total += gap * gap if (gap > 0) != right else 0.0
            node = 2 * node + right
        return total

    order = list(forest.visits(p))
    assert sorted(order) == [(t, n) for t in range(2) for n in range(16)] and order[0][1] == leaves[order[0][0]][0]
    away = [far(t, n) for t, n in order]
    assert away == sorted(away)


def test_neighbours_query(spark, sf):
    """Over the whole table, against brute force: every query's row of five, and a recall of 0.9."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = nearest_rows(rows, lambda i: i % 50 == 0, 5)
    got = rounded(QUERIES["op13_neighbours"](spark, sf))
    assert [(q, n) for q, n, *_ in got] == [(q, n) for q, n, *_ in want]
    assert len({(q, v) for q, _, v, _ in got} & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
