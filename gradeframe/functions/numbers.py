"""Numeric expressions: lenient numbers, errors, tolerances, scales."""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gradeframe.functions.text import ASCII, PLAIN, normalize_text, strip

#: What counts as zero, tolerances of values, and the tolerance of numeric x.
EPSILON = 1e-9
TOLERANCES = (0.01, 0.05, 0.10)
X_TOLERANCE = 1e-6
#: Factors by which whole series are known to be off, how near points must then be, the share that must be, of how many at least.
SCALES = (1e-6, 1e-3, 1e-2, 1e2, 1e3, 1e6)
SCALE_TOLERANCE, SCALE_SHARE, SCALE_LEAST = 0.05, 0.8, 3
#: Fixed value: what reads as a number.
FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
#: Cells that hold no number, and what a number looks like in others.
NULL_CELLS = ("-", "--", "", "n/a", "na", "null", "none", "*")
NUMBER = r"-?[\d,]*\.?\d+"


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


@lru_cache(maxsize=1)
def digits() -> tuple[str, str]:
    """The decimal digits of all other scripts, and the ASCII digits in their places."""
    found = [chr(i) for i in range(128, 0x110000) if chr(i).isdecimal()]
    return "".join(found), "".join(str(unicodedata.decimal(d)) for d in found)


def ascii_digits(c: Column) -> Column:
    """The decimal digits of all scripts as ASCII ones."""
    return F.when(c.rlike(ASCII), c).otherwise(F.translate(c, *digits()))


def as_float(c: Column) -> Column:
    """A string as a finite double, thousands commas and digit underscores allowed; else null."""
    bare = ascii_digits(strip(F.replace(c, F.lit(","), F.lit(""))))
    digits = F.when(bare.rlike(FLOAT), F.replace(bare, F.lit("_"), F.lit("")))
    return finite(digits.try_cast("double"))


def parse_number(cell: Column) -> Column:
    """The first number of a table cell, whatever stands around it; null for cells without one."""
    text = strip(cell)
    found = F.regexp_extract(ascii_digits(F.replace(text, F.lit(" "), F.lit(""))), NUMBER, 0)
    number = F.replace(found, F.lit(","), F.lit("")).try_cast("double")
    return F.when(F.lower(text).isin(*NULL_CELLS), None).otherwise(number)


def relative_error(gold: Column, pred: Column) -> Column:
    """|pred - gold| / |gold|; against zero 0 for zero and infinity for the rest."""
    at_zero = F.when(F.abs(pred) < EPSILON, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.when(F.abs(gold) < EPSILON, at_zero).otherwise(F.try_divide(F.abs(pred - gold), F.abs(gold)))


def within(gold: Column, pred: Column, tolerance: float) -> Column:
    error = relative_error(gold, pred)
    return ~F.isnan(error) & (error <= tolerance)


def x_matches(gold: Column, pred: Column) -> Column:
    """Points' x: numerically if both are numbers, else as text. Structs with `num` and `text`."""
    close = F.abs(gold.num - pred.num) <= X_TOLERANCE * F.greatest(F.abs(gold.num), F.abs(pred.num), F.lit(1.0))
    return F.when(gold.num.isNotNull() & pred.num.isNotNull(), close).otherwise(gold.text == pred.text)


def x_key(kind: Column, text: Column, number: Column) -> Column:
    """What x_matches() compares: struct<num, text>. Labels that begin with a letter are no numbers, whole numbers are read as they are."""
    as_text = F.when(kind == "num", number.cast("string")).otherwise(text)
    read = F.when(text.rlike("^[A-Za-z]") & text.rlike(PLAIN), None).when(text.rlike("^[0-9]{1,15}$"), text.cast("double")).otherwise(as_float(text))
    num = F.when(kind == "num", finite(number)).otherwise(read)
    return F.struct(num.alias("num"), normalize_text(as_text).alias("text"))


def ape(errors: Column) -> Column:
    """The finite ones of an array of errors."""
    return F.filter(errors, lambda e: ~F.isnan(e) & (e < float("inf")))


def array_mean(c: Column) -> Column:
    return F.try_divide(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.size(c))


def array_median(c: Column) -> Column:
    """Interpolated median of an array; null if empty."""
    s, n = F.array_sort(c), F.size(c)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def scale_error(pairs: Column) -> Column:
    """The first factor that explains 80 % of at least three pairs (g, p) away from zero; else null."""
    usable = F.filter(pairs, lambda q: (F.abs(q.g) > EPSILON) & (F.abs(q.p) > EPSILON) & ~F.isnan(q.p))
    factors = F.array(*map(F.lit, SCALES))
    hit = lambda f: F.size(F.filter(usable, lambda q: within(q.g * f, q.p, SCALE_TOLERANCE)))
    found = F.get(F.filter(factors, lambda f: hit(f) >= SCALE_SHARE * F.size(usable)), F.lit(0))
    return F.when(F.size(usable) >= SCALE_LEAST, found)


def series_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 3, "2-3").when(n <= 5, "4-5").otherwise("6+")


BUCKETS = ("1", "2-3", "4-5", "6+")


def magnitude(values: Column) -> Column:
    """Power of ten of the largest of an array of doubles; 0 if none is away from zero."""
    top = F.greatest(F.array_max(values), -F.array_min(values))
    return F.when(top > 0, F.floor(F.log10(top))).otherwise(F.lit(0)).cast("int")


def shown(value: float | None) -> float | None:
    """Rounded as a chart would show it: three figures from 1000 on, a decimal from 10, else three; ties by the binary value."""
    if value is None or not math.isfinite(value) or value == 0:
        return value
    places = math.floor(math.log10(abs(value)))
    return round(value, 2 - places if places >= 3 else 1 if places >= 1 else 3)


@F.pandas_udf(DoubleType())
def readable(value: pd.Series) -> pd.Series:
    """shown() of a column. Spark's own rounding goes by the decimal text, so 10.35 would become 10.4."""
    return value.map(shown, na_action="ignore")


def over_capacity(peak: Column, capacity: Column) -> Column:
    """Whether a peak spilled over what there was."""
    return peak > capacity


def scaled_side(side: Column, long_edge: Column, target: int, upscale: bool = True) -> Column:
    """A side of an image whose long edge becomes target pixels; halves round to even."""
    scale = F.try_divide(F.lit(float(target)), long_edge)
    scaled = F.greatest(F.lit(1), F.rint(side * scale).cast("int"))
    return scaled if upscale else F.when(long_edge <= target, side.cast("int")).otherwise(scaled)
