"""Boxes, cells and gaps: predicates, selection, order and grouping."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.grid import rectangles, touching
from docloom.tables import by_group


def overlap_share(a: str, b: str) -> Column:
    """Area that two boxes share against the area of the first; a and b are prefixes of x0, y0, x1, y1."""
    c = F.col
    w = F.greatest(F.lit(0.0), F.least(c(f"{a}x1"), c(f"{b}x1")) - F.greatest(c(f"{a}x0"), c(f"{b}x0")))
    h = F.greatest(F.lit(0.0), F.least(c(f"{a}y1"), c(f"{b}y1")) - F.greatest(c(f"{a}y0"), c(f"{b}y0")))
    area = (c(f"{a}x1") - c(f"{a}x0")) * (c(f"{a}y1") - c(f"{a}y0"))
    return F.when(area > 0, w * h / area).otherwise(F.lit(0.0))


def outside(inner: DataFrame, tables: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """Elements of which less than ``share`` lies in any table of their page."""
    prefixed = tables.select(*keys, *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    named = inner.select(*inner.columns)
    marked = named.withColumns({f"i_{c}": F.col(c) for c in ("x0", "y0", "x1", "y1")})
    on = [marked[k].eqNullSafe(prefixed[k]) for k in keys] + [overlap_share("i_", "t_") >= share]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return marked.join(prefixed, condition, "left_anti").select(*inner.columns)


def gap_groups(df: DataFrame, keys: list[str], order: str, gap) -> DataFrame:
    """The rows with ``group_no``: a new group begins where the order jumps by more than ``gap``."""
    window = Window.partitionBy(*keys).orderBy(order)
    jump = F.col(order) - F.lag(order).over(window)
    return df.withColumn("_new", F.when(jump > gap, 1).otherwise(0)).withColumn("group_no", F.sum("_new").over(window)).drop("_new")


def upper_median(values: Column) -> Column:
    """The upper of the two middle values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def reading_order(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The boxes with ``no``, from top to bottom, then from left to right."""
    return boxes.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("y0", "x0", "id")))


_RECTANGLE = {"region": "int", "row0": "int", "row1": "int", "col0": "int", "col1": "int", "cells": "int"}


def cell_components(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, region, row0, row1, col0, col1, cells``: rectangles around cells that touch by a side, from top to bottom.

    One sheet is labelled at a time, as its cells are a bounded grid; sheets go in parallel.
    """

    def label(rows: list[tuple]) -> Iterator[tuple]:
        yield from ((i, *box) for i, box in enumerate(sorted(touching(set(rows)), key=lambda b: (b[0], b[2], b[1], b[3]))))

    return by_group(cells.select(*keys, F.col("row").cast("int"), F.col("col").cast("int")), keys, label, _RECTANGLE)


#: Rows and columns of a sheet that are looked at for tables.
MOST_ROWS, MOST_COLUMNS = 1000, 100


def sheet_regions(cells: DataFrame, keys: list[str], rows: int = MOST_ROWS, columns: int = MOST_COLUMNS) -> DataFrame:
    """``keys, region, row0, row1, col0, col1, cells``: the tables of a sheet, out of ``row, col, bordered`` of its cells that hold something or have a border.

    Cells with a border that touch are a table, then those without one; tables that overlap or have at most one row
    or column between them are one, until none are left to join. Only the first ``rows`` and ``columns`` count, as the
    reader of sheets has it; ``cells`` counts those of a table.
    """
    inside = cells.where(F.col("row").between(1, rows) & F.col("col").between(1, columns))
    picked = inside.groupBy(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.bool_or(F.coalesce("bordered", F.lit(False))).alias("bordered"))

    def each(held: list[tuple]) -> Iterator[tuple]:
        yield from ((i, *box) for i, box in enumerate(rectangles({(r, c): border for r, c, border in held})))

    return by_group(picked, keys, each, _RECTANGLE)


def _edges(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{x}") for x in ("row0", "row1", "col0", "col1")]


def ranges_adjacent(a: str, b: str, tolerance: int = 1) -> Column:
    """Whether two ranges of cells have at most ``tolerance`` rows and columns between them; a and b are prefixes of row0, row1, col0, col1."""
    (a0, a1, a2, a3), (b0, b1, b2, b3) = _edges(a), _edges(b)
    gap = lambda low, high: F.greatest(F.lit(0), low - high - 1)
    return (gap(F.greatest(a0, b0), F.least(a1, b1)) <= tolerance) & (gap(F.greatest(a2, b2), F.least(a3, b3)) <= tolerance)


def ranges_overlap(a: str, b: str) -> Column:
    """Whether two ranges of cells share one."""
    (a0, a1, a2, a3), (b0, b1, b2, b3) = _edges(a), _edges(b)
    return (a0 <= b1) & (b0 <= a1) & (a2 <= b3) & (b2 <= a3)


def range_contains(a: str, row: Column, col: Column) -> Column:
    """Whether a cell lies in a range."""
    a0, a1, a2, a3 = _edges(a)
    return row.between(a0, a1) & col.between(a2, a3)


def merged_range(a: str, b: str) -> list[Column]:
    """The range around two ranges, as row0, row1, col0 and col1."""
    return [(F.least if k in (0, 2) else F.greatest)(x, y) for k, (x, y) in enumerate(zip(_edges(a), _edges(b)))]


def has_border(*styles: Column) -> Column:
    """Whether one of the sides of a cell has a style that isn't ``none``."""
    return F.exists(F.array(*styles), lambda s: F.coalesce(s != "none", F.lit(False)))
