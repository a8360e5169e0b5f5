"""Matching of points inside matched series, on nested columns: no shuffle, and linear but for sorting.

First fit by x is a join on (x, how many points of its series had that x before)
wherever equality of x is an equivalence, which is checked for each series: all x are
numbers, in groups that lie apart, or one side has texts only. The points of a
whole batch are sorted and joined at once. Only series of mixed kinds are matched
one point after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeframe.functions.nested import lists, spread
from gradeframe.functions.numbers import EPSILON, SCALE_LEAST, SCALE_SHARE, SCALE_TOLERANCE, SCALES, X_TOLERANCE, x_key

#: Fixed value: the share of points that must be found by x.
FALLBACK = 0.5
MATCHED = "array<struct<pairs: array<struct<g: double, p: double>>, fallback: boolean, missing: int, spurious: int, scale: double>>"


def keyed(points: Column) -> Column:
    """array<struct<key, y>> of a series' points."""
    return F.transform(points, lambda p: F.struct(x_key(p.x_kind, p.x_str, p.x_num).alias("key"), p.y.alias("y")))


def close(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    return np.abs(a - b) <= X_TOLERANCE * np.maximum(np.maximum(np.abs(a), np.abs(b)), 1)


def number_groups(pair: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each value, pairs for which groups don't do).

    Neighbours in order that are close are in one group; it does if its ends are
    close by the tolerance of its least member, for then all of it is.
    """
    order = np.lexsort((value, pair))
    v, p = value[order], pair[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | ~close(v[1:], v[:-1])
    group = np.empty(len(v), np.int64)
    group[order] = np.cumsum(new) - 1
    if not len(v):
        return group, p
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(v)) - 1
    wide = v[last] - v[first] > X_TOLERANCE * np.maximum(np.minimum.reduceat(np.abs(v), first), 1)
    return group, np.unique(p[first[wide]])


def joined(pair: np.ndarray, key: np.ndarray, is_pred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of gold points and of their partners: of a pair's points with one key, each side in order, the n-th with the n-th."""
    order = np.lexsort((is_pred, key, pair))  # stable, so points of a side stay in order
    p, k, side = pair[order], key[order], is_pred[order]
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
    run = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    golds = np.bincount(run[~side], minlength=len(begin))
    sizes = np.bincount(run, minlength=len(begin))
    nth = np.arange(len(p)) - begin[run] if len(p) else np.zeros(0, np.int64)
    has = ~side & (nth < (sizes - golds)[run]) if len(p) else np.zeros(0, bool)
    at = np.flatnonzero(has)
    return order[at], order[at + golds[run[at]]]


def one_by_one(g_num: np.ndarray, g_text: np.ndarray, p_num: np.ndarray, p_text: np.ndarray) -> list[tuple[int, int]]:
    """First fit as it is said, for series whose x are of mixed kinds."""
    free, out = np.ones(len(p_num), dtype=bool), []
    for i, (number, text) in enumerate(zip(g_num, g_text)):
        fits = np.where(np.isnan(p_num) | np.isnan(number), p_text == text, close(number, p_num)) & free
        if len(fits) and fits[j := int(fits.argmax())]:
            free[j] = False
            out.append((i, j))
    return out


def scales(pair: np.ndarray, g: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """numbers.scale_error() of each of n pairs of series, given all their points' values; NaN for none."""
    with np.errstate(all="ignore"):
        usable = (np.abs(g) > EPSILON) & (np.abs(p) > EPSILON)
        out, count = np.full(n, np.nan), np.bincount(pair, usable, minlength=n)
        for factor in reversed(SCALES):  # so that the first one stays
            near = usable & (np.abs(g * factor) >= EPSILON) & (np.abs(p - g * factor) / np.abs(g * factor) <= SCALE_TOLERANCE)
            out[(count >= SCALE_LEAST) & (np.bincount(pair, near, minlength=n) >= SCALE_SHARE * count)] = factor
    return out


def match(gold: pa.Array, pred: pa.Array, pairs: pa.Array) -> pa.Array:
    """A MATCHED per row of arrays of series (structs with data: keyed() points) and pairs (g, p) of their places."""
    (g_rows, g_series), (p_rows, p_series), (ends, q) = lists(gold), lists(pred), lists(pairs)
    (g_ends, g_points), (p_ends, p_points) = lists(g_series.field("data")), lists(p_series.field("data"))
    row = np.repeat(np.arange(len(gold)), np.diff(ends))
    gs, ps = g_rows[row] + q.field("g").to_numpy(), p_rows[row] + q.field("p").to_numpy()
    g_size, p_size = np.diff(g_ends)[gs], np.diff(p_ends)[ps]
    (g_pair, g_at, g), (p_pair, p_at, p) = spread(g_ends[gs], g_size), spread(p_ends[ps], p_size)
    numbers = lambda points: points.field("key").field("num").to_numpy(zero_copy_only=False)  # noqa: E731  NaN for null
    texts = pa.chunked_array([points.field("key").field("text") for points in (g_points, p_points) if len(points)], pa.string()).combine_chunks().fill_null("").dictionary_encode().indices.to_numpy()
    num = np.concatenate([numbers(g_points)[g], numbers(p_points)[p]])
    key = np.concatenate([texts[: len(g_points)][g], texts[len(g_points) :][p]]).astype(np.int64)
    pair, is_pred = np.concatenate([g_pair, p_pair]), np.arange(len(g) + len(p)) >= len(g)

    n = len(row)
    has = lambda of, values: np.bincount(of, ~np.isnan(values), minlength=n)
    g_has, p_has = has(g_pair, num[: len(g)]), has(p_pair, num[len(g) :])
    numeric = (g_has == g_size) & (p_has == p_size)
    mixed = ~numeric & (g_has > 0) & (p_has > 0)
    of_numbers = np.flatnonzero(numeric[pair])
    key[of_numbers], wide = number_groups(pair[of_numbers], num[of_numbers])
    mixed[wide] = True

    by_key = np.flatnonzero(~mixed[pair])
    left, right = joined(pair[by_key], key[by_key], is_pred[by_key])
    left, right = by_key[left], by_key[right] - len(g)
    for at in np.flatnonzero(mixed):
        a, b = np.flatnonzero(g_pair == at), np.flatnonzero(p_pair == at)
        found = np.array(one_by_one(num[a], key[a], num[len(g) + b], key[len(g) + b]), dtype=np.int64).reshape(-1, 2)
        left, right = np.concatenate([left, a[found[:, 0]]]), np.concatenate([right, b[found[:, 1]]])

    shorter = np.minimum(g_size, p_size)
    fallback = (shorter > 0) & (np.bincount(g_pair[left], minlength=n) < FALLBACK * shorter)
    stays = ~fallback[g_pair[left]]
    by_place = np.flatnonzero(fallback[g_pair] & (g_at < shorter[g_pair]))
    first_p = np.cumsum(p_size) - p_size
    left, right = np.concatenate([left[stays], by_place]), np.concatenate([right[stays], first_p[g_pair[by_place]] + g_at[by_place]])
    order = np.argsort(left)  # golds are in the order of pairs and places
    left, right = left[order], right[order]
    found = np.bincount(g_pair[left], minlength=n)

    both = pa.StructArray.from_arrays([g_points.field("y").take(pa.array(g[left])), p_points.field("y").take(pa.array(p[right]))], names=["g", "p"])
    whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found)]), pa.int32()), both)
    scale = scales(g_pair[left], *(c.to_numpy(zero_copy_only=False).astype(np.float64) for c in both.flatten()), n)
    counts = [pa.array(fallback), pa.array((g_size - found).astype(np.int32)), pa.array((p_size - found).astype(np.int32)), pa.array(scale, mask=np.isnan(scale))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([whole, *counts], names=["pairs", "fallback", "missing", "spurious", "scale"]))


def match_series(gold: Column, pred: Column, pairs: Column) -> Column:
    """For each of pairs (g, p) of series, struct<pairs, fallback, missing, spurious, scale> of their keyed() points.

    If fewer than half as many pairs are found by x as the shorter side has
    points, the points are paired by position instead. Null arrays count as empty.
    """

    @F.arrow_udf(MATCHED)
    def run(g: pa.Array, p: pa.Array, q: pa.Array) -> pa.Array:
        return match(g, p, q)

    points = lambda series: F.transform(series, lambda s: F.struct(s.data.alias("data")))
    return run.asNondeterministic()(points(gold), points(pred), pairs)  # so the optimiser neither repeats it nor moves it into a lambda


def match_points(gold: Column, pred: Column) -> Column:
    """match_series() of two arrays of keyed() points."""
    alone = lambda points: F.array(F.struct(points.alias("data")))
    first = F.array(F.struct(F.lit(0).alias("g"), F.lit(0).alias("p")))
    return F.element_at(match_series(alone(gold), alone(pred), first), 1)
