"""Optimal one-to-one matching of a sample's gold and predicted series.

The scores of a whole batch are made at once: names are compared once for each pair of
different ones, points position by position in flat arrays. Small matrices of one shape
are solved together, larger ones each by itself.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeframe.functions.nested import lists, spread
from gradeframe.functions.numbers import EPSILON
from gradeframe.functions.text import normalize_text
from gradeframe.types import PAIRS

#: The weight of names, and the error up to which two points are alike.
NAME_WEIGHT = 0.85
ALIKE = 0.10
#: Orders of columns that are tried for small matrices, and points that are compared at a time.
ORDERS, POINTS = 120, 1 << 21


def assign(score: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column), min(rows, columns) of them, of the largest total score.

    Shortest augmenting paths with potentials; ties go to the lowest index.
    """
    if score.size == 0:
        return []
    if score.shape[0] > score.shape[1]:
        return sorted((r, c) for c, r in assign(score.T))
    n, m = score.shape
    cost = score.max() - score
    row_price, column_price = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)  # 1-based row of each column; column 0 holds the row being placed
    for row in range(1, n + 1):
        owner[0], at = row, 0
        slack, came = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int)
        done = np.zeros(m + 1, dtype=bool)
        while owner[at]:
            done[at] = True
            offer = cost[owner[at] - 1] - row_price[owner[at]] - column_price[1:]
            better = ~done[1:] & (offer < slack[1:])
            slack[1:][better], came[1:][better] = offer[better], at
            nearest = int(np.where(done[1:], np.inf, slack[1:]).argmin()) + 1
            step = slack[nearest]
            row_price[owner[done]] += step
            column_price[done] -= step
            slack[~done] -= step
            at = nearest
        while at:
            owner[at], at = owner[came[at]], came[at]
    return sorted((int(owner[c]) - 1, c - 1) for c in range(1, m + 1) if owner[c])


def assign_alike(score: np.ndarray) -> np.ndarray | None:
    """For matrices of one shape (matrix, row, column) the column of each row, -1 for none, by trying all orders; None if those are too many."""
    _, n, m = score.shape
    if n > m:
        rows = assign_alike(score.transpose(0, 2, 1))  # the row of each column
        if rows is None:
            return None
        out = np.full((len(score), n), -1)
        matrix, column = np.nonzero(rows >= 0)
        out[matrix, rows[matrix, column]] = column
        return out
    count = 1
    for k in range(n):
        count *= m - k
    if count > ORDERS:
        return None
    orders = np.array(list(permutations(range(m), n)), dtype=np.int64).reshape(count, n)
    totals = sum((score[:, r, orders[:, r]] for r in range(n)), np.zeros((len(score), count)))
    return orders[totals.argmax(axis=1)]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: one row of the usual table as the bits of an integer."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def name_score(a: str, b: str) -> float:
    """As functions.text.name_similarity(), of normalised names."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 0.0


def name_scores(gold: pa.Array, pred: pa.Array, g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """name_score() of gold[g] and pred[p], once for each pair of different names."""
    if not len(g):
        return np.zeros(0)
    both = pa.concat_arrays([gold, pred]).fill_null("").dictionary_encode()
    names, code = both.dictionary.to_pylist(), both.indices.to_numpy().astype(np.int64)
    pair, back = np.unique(code[g] * len(names) + code[len(gold) + p], return_inverse=True)
    return np.array([name_score(names[x // len(names)], names[x % len(names)]) for x in pair.tolist()])[back]


def data_scores(gold: tuple[np.ndarray, np.ndarray], pred: tuple[np.ndarray, np.ndarray], g: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Share of points that are alike position by position, of the longer series' points, for each pair of series; 0 if either is empty.

    gold and pred are (ends, values) of all series.
    """
    (g_ends, y), (p_ends, z) = gold, pred
    g_size, p_size = np.diff(g_ends)[g], np.diff(p_ends)[p]
    shorter, hits, upto = np.minimum(g_size, p_size), np.zeros(len(g)), np.concatenate([[0], np.cumsum(np.minimum(g_size, p_size))])
    at = 0
    while at < len(g):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + POINTS, side="right")) - 1)
        pair, place, _ = spread(np.zeros(end - at, np.int64), shorter[at:end])
        a, b = y[g_ends[g[at:end]][pair] + place], z[p_ends[p[at:end]][pair] + place]
        zero = np.abs(a) < EPSILON
        with np.errstate(all="ignore"):
            error = np.where(zero, np.where(np.abs(b) < EPSILON, 0.0, np.inf), np.abs(b - a) / np.abs(np.where(zero, 1, a)))
        hits[at:end] = np.bincount(pair, error <= ALIKE, minlength=end - at)
        at = end
    return hits / np.maximum(np.maximum(g_size, p_size), 1)


def solve(gold: pa.Array, pred: pa.Array, name_weight: float = NAME_WEIGHT) -> pa.Array:
    """PAIRS for each row of two arrays of series (structs with a normalised name and data: structs with y)."""
    (g_rows, g_series), (p_rows, p_series) = lists(gold), lists(pred)
    n, m = np.diff(g_rows), np.diff(p_rows)
    row, at, _ = spread(np.zeros(len(n), np.int64), n * m)
    g, p = g_rows[row] + at // np.maximum(m[row], 1), p_rows[row] + at % np.maximum(m[row], 1)
    values = [(ends, points.field("y").to_numpy(zero_copy_only=False) if len(points) else np.zeros(0)) for ends, points in (lists(s.field("data")) for s in (g_series, p_series))]
    score = name_weight * name_scores(g_series.field("name"), p_series.field("name"), g, p) + (1 - name_weight) * data_scores(*values, g, p)

    first = np.concatenate([[0], np.cumsum(n * m)])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in np.unique(np.stack([n, m], axis=1)[(n > 0) & (m > 0)], axis=0).tolist():
        rows = np.flatnonzero((n == i) & (m == j))
        for some in np.array_split(rows, max(1, len(rows) * min(i * j, ORDERS) // POINTS)):
            matrices = score[first[some][:, None] + np.arange(i * j)].reshape(len(some), i, j)
            columns = assign_alike(matrices)
            if columns is None:
                each = [np.array([(r, *pair) for pair in assign(x)]) for r, x in zip(some.tolist(), matrices)]
                found.append(tuple(np.concatenate(each).T))
            else:
                which, own = np.nonzero(columns >= 0)
                found.append((some[which], own, columns[which, own]))
    r, own, theirs = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in range(3)) if found else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((own, r))
    pairs = pa.StructArray.from_arrays([pa.array(x[order].astype(np.int32)) for x in (own, theirs)], names=["g", "p"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(n)))]), pa.int32()), pairs)


def assign_normalised(gold: Column, pred: Column) -> Column:
    """array<struct<g, p>> of 0-based places in two arrays of struct<name, data: array<struct<y, ...>>>, names normalised, ordered by g."""

    @F.arrow_udf(PAIRS)
    def run(g: pa.Array, p: pa.Array) -> pa.Array:
        return solve(g, p)

    def needed(series: Column) -> Column:
        return F.transform(series, lambda s: F.struct(s["name"].alias("name"), F.transform(s.data, lambda q: F.struct(q.y.alias("y"))).alias("data")))

    return run.asNondeterministic()(needed(gold), needed(pred))  # so the optimiser neither repeats it nor moves it into a lambda


def assign_series(gold: Column, pred: Column) -> Column:
    """assign_normalised() of series as they come."""
    named = lambda series: F.transform(series, lambda s: F.struct(normalize_text(s["name"]).alias("name"), s.data.alias("data")))
    return assign_normalised(named(gold), named(pred))
