"""Points and series matched in batches, against loops that follow the definitions."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from gradeframe.functions import assignment as A
from gradeframe.operators import matching as M

KEY = pa.struct([("num", pa.float64()), ("text", pa.string())])
SERIES = pa.list_(pa.struct([("name", pa.string()), ("data", pa.list_(pa.struct([("key", KEY), ("y", pa.float64())])))]))
PAIRS = pa.list_(pa.struct([("g", pa.int32()), ("p", pa.int32())]))
SCALES = (1e-6, 1e-3, 1e-2, 1e2, 1e3, 1e6)


def near(a, b):
    return abs(a - b) <= 1e-6 * max(abs(a), abs(b), 1)


def fits(g, p):
    both = g["num"] is not None and p["num"] is not None
    return near(g["num"], p["num"]) if both else g["text"] == p["text"]


def scale(pairs):
    usable = [(g, p) for g, p in pairs if abs(g) > 1e-9 and abs(p) > 1e-9]
    error = lambda g, p: abs(p - g) / abs(g) if abs(g) >= 1e-9 else float("inf")
    return next((f for f in SCALES if len(usable) >= 3 and sum(error(g * f, p) <= 0.05 for g, p in usable) >= 0.8 * len(usable)), None)


def first_fit(gold, pred):
    free, pairs = list(range(len(pred))), []
    for g in gold:
        at = next((i for i in free if fits(g["key"], pred[i]["key"])), None)
        if at is not None:
            free.remove(at)
            pairs.append((g["y"], pred[at]["y"]))
    shorter = min(len(gold), len(pred))
    fallback = shorter > 0 and len(pairs) < 0.5 * shorter
    if fallback:
        pairs = [(g["y"], p["y"]) for g, p in zip(gold, pred)]
    return {"pairs": [{"g": g, "p": p} for g, p in pairs], "fallback": fallback, "missing": len(gold) - len(pairs), "spurious": len(pred) - len(pairs), "scale": scale(pairs)}


def xs(r, kind):
    number = lambda x: {"num": float(x), "text": str(float(x))}
    text = lambda t: {"num": None, "text": t}
    if kind == "text":
        return lambda: text(r.choice("abcde"))
    if kind == "number":
        return lambda: number(r.choice([0, 1, 2, 5, 1e9, -3]))
    if kind == "close":  # equal by the tolerance, and chains in which only neighbours are
        return lambda: number(1 + r.randint(0, 6) * r.choice([0.3e-6, 0.9e-6]))
    return lambda: r.choice([number(5), text("5"), {"num": 5.0, "text": "5"}, text("5.0"), text("a"), number(7)])


def some_series(r, n, kinds):
    return [{"name": r.choice("xyz"), "data": [{"key": x(), "y": r.choice([0.0, 1.0, 100.0, 2.5, 1e-10])} for _ in range(r.randint(0, 9))]} for x in (xs(r, r.choice(kinds)) for _ in range(n))]


@pytest.mark.parametrize("seed, kinds", [(1, ["text"]), (2, ["number"]), (3, ["close"]), (4, ["mixed"]), (5, ["text", "number", "close", "mixed"])])
def test_points(seed, kinds):
    r = random.Random(seed)
    gold = [some_series(r, r.randint(0, 3), kinds) for _ in range(150)] + [None, []]
    pred = [some_series(r, r.randint(0, 3), kinds) for _ in range(150)] + [[], None]
    pairs = [[{"g": i, "p": i} for i in range(min(len(g or []), len(p or [])))] for g, p in zip(gold, pred)]
    for cut in (slice(None), slice(60, 61), slice(3, 90), slice(0, 0)):  # batches may be parts of larger arrays
        got = M.match(pa.array(gold, SERIES)[cut], pa.array(pred, SERIES)[cut], pa.array(pairs, PAIRS)[cut]).to_pylist()
        assert got == [[first_fit(g[q["g"]]["data"], p[q["p"]]["data"]) for q in own] for g, p, own in zip(gold[cut], pred[cut], pairs[cut])]


def test_scale_of_long_series():
    r = random.Random(3)
    gold = [{"key": {"num": float(i), "text": ""}, "y": r.uniform(1, 2)} for i in range(100_000)]
    pred = [{"key": g["key"], "y": g["y"] * 1000} for g in reversed(gold)]
    one = lambda data: pa.array([[{"name": "", "data": data}]], SERIES)
    (got,) = M.match(one(gold), one(pred), pa.array([[{"g": 0, "p": 0}]], PAIRS)).to_pylist()[0]
    assert got["scale"] == 1e3 and got["missing"] == got["spurious"] == 0 and all(q["p"] == q["g"] * 1000 for q in got["pairs"])


def plain_scores(gold, pred):
    def data(g, p):
        error = lambda a, b: abs(b - a) / abs(a) if abs(a) >= 1e-9 else 0.0 if abs(b) < 1e-9 else float("inf")
        return sum(error(x["y"], y["y"]) <= 0.1 for x, y in zip(g, p)) / max(len(g), len(p)) if g and p else 0.0

    return np.array([[0.85 * A.name_score(g["name"], p["name"]) + 0.15 * data(g["data"], p["data"]) for p in pred] for g in gold]).reshape(len(gold), len(pred))


@pytest.mark.parametrize("small", [False, True])
def test_series(monkeypatch, small):
    """Totals are the largest ones, for shapes that are tried whole and for others; where names say nothing, points decide."""
    if small:
        monkeypatch.setattr(A, "ORDERS", 3)
        monkeypatch.setattr(A, "POINTS", 5)
    r = random.Random(8)
    gold = [some_series(r, r.randint(0, 4), ["text"]) for _ in range(120)] + [None, [], some_series(r, 6, ["text"])]
    pred = [some_series(r, r.randint(0, 4), ["text"]) for _ in range(120)] + [[], None, some_series(r, 5, ["text"])]
    got = A.solve(pa.array(gold, SERIES), pa.array(pred, SERIES)).to_pylist()
    for g, p, pairs in zip(gold, pred, got):
        g, p = g or [], p or []
        score, own = plain_scores(g, p), [(q["g"], q["p"]) for q in pairs]
        assert own == sorted(own) and len(own) == min(len(g), len(p)) == len({a for a, _ in own}) == len({b for _, b in own})
        few, turn = min(len(g), len(p)), len(g) > len(p)
        best = max(sum(score[(j, i) if turn else (i, j)] for i, j in enumerate(o)) for o in itertools.permutations(range(max(len(g), len(p))), few))
        assert sum(score[q] for q in own) == pytest.approx(best)
    same = [{"name": "", "data": [{"key": None, "y": y}]} for y in (1.0, 2.0, 3.0)]
    turned = A.solve(pa.array([same], SERIES), pa.array([same[::-1]], SERIES)).to_pylist()
    assert turned == [[{"g": i, "p": 2 - i} for i in range(3)]]


def test_many_series():
    """300 x 300: as the solver by itself says."""
    r = random.Random(4)
    series = lambda: [{"name": "".join(r.choice("abcdef") for _ in range(6)), "data": [{"key": None, "y": r.random()} for _ in range(3)]} for _ in range(300)]
    gold, pred = series(), series()
    got = A.solve(pa.array([gold], SERIES), pa.array([pred], SERIES)).to_pylist()[0]
    assert [(q["g"], q["p"]) for q in got] == A.assign(plain_scores(gold, pred))
