"""Nested Arrow columns as flat arrays, and values that lambdas read."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being computed once a row: a lambda that reads an expression otherwise computes it for each element, and as often as it reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(ends, values): the lists of a column, null as empty, one after another."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), column.flatten()


def spread(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, place in the run, place in all) of each member of runs that begin somewhere and have sizes."""
    run = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return run, at, begins[run] + at
