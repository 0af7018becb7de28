"""Table functions for SQL text and lateral joins: numbers of a text, cells of an HTML table, one row each.

They give the same as ``numbers.numbers`` and ``tables.grid``; rows travel in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbers import scan
from .tables import table_grid


@F.udtf(returnType="pos int, raw string, start int, end int, value double, percent boolean", useArrow=True)
class NumberTokens:
    """Numbers of a text in order of their place, counted from 1; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        for pos, found in enumerate(scan(text), 1):
            yield (pos, *found)


@F.udtf(returnType="row int, col int, header boolean, text string", useArrow=True)
class TableCells:
    """Cells of an HTML table by row and column from 0, spanning cells repeated; a null text has none."""

    def eval(self, html: str) -> Iterator[tuple]:
        grid, head = table_grid(html)
        for i, line in enumerate(grid):
            for j, cell in enumerate(line):
                yield i, j, i < head, cell


def register(spark: SparkSession) -> None:
    """``number_tokens(text)`` and ``table_cells(html)`` in SQL."""
    spark.udtf.register("number_tokens", NumberTokens)
    spark.udtf.register("table_cells", TableCells)


def with_numbers(rows: DataFrame, text: str) -> DataFrame:
    """Each row once for each number of its text, with the number's columns; rows without any go."""
    return rows.lateralJoin(NumberTokens(F.col(text).outer()))


def with_cells(rows: DataFrame, html: str) -> DataFrame:
    """Each row once for each cell of its table; rows without any go."""
    return rows.lateralJoin(TableCells(F.col(html).outer()))
