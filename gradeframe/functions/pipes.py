"""Pipe tables from SQL: a table function, joined laterally, that gives a row per point.

The same tables as operators.tables, which reads them with expressions and without Python; this is
for queries that want points beside other columns in one FROM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeframe.functions.numbers import NULL_CELLS, NUMBER
from gradeframe.operators.tables import PLACEHOLDERS

POINTS = "x_label string, series string, x string, y double"


def number(cell: str) -> float | None:
    """numbers.parse_number() of one cell."""
    if cell.lower() in NULL_CELLS:
        return None
    found = re.search(NUMBER, cell.replace(" ", ""))
    return float(found[0].replace(",", "")) if found else None


def points(table: str | None) -> Iterator[tuple[str | None, str, str, float]]:
    lines = [line for part in re.split(r"\r\n|\n|\r", table or "") if (line := part.strip())]
    grid = [[cell.strip() for cell in line.strip("|").split("|")] for line in lines]
    if len(grid) < 2 or len(grid[0]) < 2:
        return
    (head, *names), body = grid[0], grid[1:]
    if not re.sub(r"[\s|\-]", "", lines[1]):
        body = body[1:]
    body = [row for row in body if len(row) == len(grid[0])]
    last = {name: column for column, name in enumerate(names, 1)}
    label = None if head.lower() in PLACEHOLDERS else head
    for name in names:
        for row in body:
            if (y := number(row[last[name]])) is not None:
                yield label, name, row[0], y


@F.udtf(returnType=POINTS, useArrow=True)
class PipePoints:
    """x_label, series, x and y of each point of a pipe table; none for texts that are no table."""

    def eval(self, table: str) -> Iterator[tuple[str | None, str, str, float]]:
        yield from points(table)


def register(spark: SparkSession) -> None:
    """Makes pipe_points(table) known to SQL: SELECT ... FROM t, LATERAL pipe_points(t.table)."""
    spark.udtf.register("pipe_points", PipePoints)


def with_points(df: DataFrame, table: str = "table") -> DataFrame:
    """df with a row for each point of its tables; rows without any go."""
    return df.lateralJoin(PipePoints(F.col(table).outer()))
