"""Tables in text: rows, packing by rows, inference of delimiters, headers and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

ROW = r"(?is)<tr[^>]*>.*?</tr>"
CELL = r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"
#: Signs counted for a table's frame and for the mark of its part.
FRAME, MARK = 30, 30
DELIMITERS = (",", "\t", ";", "|")


def html_rows(table: Column) -> Column:
    """The rows of an HTML table, each as its source, cells and whether it is a header."""
    return F.transform(
        F.regexp_extract_all(table, F.lit(ROW), F.lit(0)),
        lambda r: F.struct(r.alias("html"), F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))).alias("cells"), r.rlike("(?i)<th[^>]*>").alias("header")),
    )


def packed_rows(rows: Column, header: Column, size: int) -> Column:
    """Groups of rows, greedily as many as fit with the header repeated; each group as an array of rows."""
    room = F.lit(size - FRAME - MARK) - F.length(header)
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, r: Column) -> Column:
        full = (acc["n"] + F.length(r) > room) & (F.size(acc["held"]) > 0)
        out = F.when(full, F.concat(acc["out"], F.array(acc["held"]))).otherwise(acc["out"])
        held = F.when(full, F.array(r)).otherwise(F.concat(acc["held"], F.array(r)))
        return F.struct(out.alias("out"), held.alias("held"), F.when(full, F.length(r)).otherwise(acc["n"] + F.length(r)).alias("n"))

    return F.aggregate(rows, start, step, lambda a: F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(a["held"]))).otherwise(a["out"]))


def delimiter_scores(lines: DataFrame, key: str, line: str) -> DataFrame:
    """``key, delimiter, mean, spread, score``: counts of each delimiter over the lines of a file.

    A constant positive count scores ten times itself, another its mean less its spread.
    """
    d = F.explode(F.array(*(F.lit(x) for x in DELIMITERS))).alias("delimiter")
    count = (F.length(line) - F.length(F.replace(F.col(line), F.col("delimiter"), F.lit("")))).cast("double")
    counted = lines.select(key, line, d).withColumn("n", count)
    sums = counted.groupBy(key, "delimiter").agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.stddev_pop("n"), 6).alias("spread"))
    return sums.withColumn("score", F.when((F.col("spread") == 0) & (F.col("mean") > 0), F.col("mean") * 10).otherwise(F.col("mean") - F.col("spread")))


def has_header(first: Column, second: Column) -> Column:
    """Whether the first row is a header: none of its cells numeric, and the second has a number or the first no cell twice."""
    some = lambda c: F.filter(c, lambda x: F.trim(x) != "")
    words = F.forall(some(first), lambda x: ~T.is_numeric(x))
    return words & (F.exists(some(second), T.is_numeric) | (F.size(F.array_distinct(first)) == F.size(first)))


def horizontal_spans(cells: DataFrame, keys: list[str], row: str, col: str, value: str) -> DataFrame:
    """Cells that aren't blank with ``span``: the blank ones right of each in its row belong to it."""
    order = Window.partitionBy(*keys, row).orderBy(col)
    owner = F.sum(F.when(F.trim(F.coalesce(F.col(value), F.lit(""))) != "", 1).otherwise(0)).over(order)
    grouped = cells.withColumn("_owner", owner).where(F.col("_owner") > 0)
    return grouped.groupBy(*keys, row, "_owner").agg(F.min(col).alias(col), F.min_by(value, col).alias(value), F.count("*").alias("span")).drop("_owner")


def vertical_spans(cells: DataFrame, keys: list[str], row: str, col: str, value: str) -> DataFrame:
    """Cells of the first column that aren't blank with ``span``: the blank ones below each belong to it."""
    first = cells.where(F.col(col) == 0)
    owner = F.sum(F.when(F.trim(F.coalesce(F.col(value), F.lit(""))) != "", 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(row))
    grouped = first.withColumn("_owner", owner).where(F.col("_owner") > 0)
    return grouped.groupBy(*keys, "_owner").agg(F.min(row).alias(row), F.min_by(value, row).alias(value), F.count("*").alias("span")).drop("_owner")
