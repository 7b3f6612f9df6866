"""Holds queries against their SQL: python tests/against_sql.py FOLDER [NAME...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return v


def compare(spark, name: str, folder: str) -> str:
    """Empty if the rows agree, else what differs."""
    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} and {sorted(columns)}"
    order = sorted(columns)
    ours = sorted((repr([plain(r[c]) for c in order]) for r in got.collect()))
    at = [columns.index(c) for c in order]
    theirs = sorted((repr([plain(r[i]) for i in at]) for r in cur.fetchall()))
    if ours == theirs:
        return ""
    left, right = set(ours), set(theirs)
    a, b = [x for x in ours if x not in right][:2], [x for x in theirs if x not in left][:2]
    return f"{len(ours)} and {len(theirs)} rows; {[x[:400] for x in a]} and {[x[:400] for x in b]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    import __spark_entry__ as entry

    for name in sys.argv[2:] or entry.oracle_sql():
        began = time.time()
        try:
            said = compare(spark, name, sys.argv[1])
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        print(name, "ok" if not said else said, round(time.time() - began, 1), flush=True)
