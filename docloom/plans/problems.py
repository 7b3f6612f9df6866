"""The queries of the general data problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import csv_rows, timestamps
from docloom.tables import read, read_wide


def p2_found(spark, folder):
    """Pairs of records of one file whose times denote the same second."""
    return timestamps.same_moment(timestamps.normalise(read_wide(spark, folder, "doc_metadata")))


def p2_times(spark, folder):
    """Every time as a moment in UTC, or why it denotes none."""
    return timestamps.normalise(read_wide(spark, folder, "doc_metadata"))


def p2_classes(spark, folder):
    """Each record with the class of those of its file that denote the same second, and its number of links."""
    return timestamps.classes(timestamps.normalise(read_wide(spark, folder, "doc_metadata")))


def _csv(spark, folder):
    return (read(spark, folder, t) for t in ("csv_records", "csv_metadata", "csv_schemas"))


def p3_found(spark, folder):
    """Records that fail, with the first reason."""
    return csv_rows.rejects(*_csv(spark, folder))


def p3_rows(spark, folder):
    """Records that are rows of their schema."""
    return csv_rows.rows(*_csv(spark, folder))


def p3_files(spark, folder):
    """Rows and rejects of each file under its real delimiter."""
    judged = csv_rows.judged(*_csv(spark, folder))
    count = lambda k: F.sum((F.col("outcome") == k).cast("long"))
    return judged.groupBy("csv_id", "delimiter_no").agg(count(csv_rows.OK).alias("rows"), *(count(k).alias(f"failed_{v}") for k, v in csv_rows.REASONS.items()))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_times": p2_times, "p2_classes": p2_classes, "p3_found": p3_found, "p3_rows": p3_rows, "p3_files": p3_files}
