"""Reading of the input tables and small helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables (a file or a directory of files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_wide(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """As ``read``, for work that is heavy per row: a table of fewer splits than there are cores is dealt out to all
    of them. A large table has more splits and isn't moved; rows and results are the same."""
    df, cores = read(spark, folder, name), spark.sparkContext.defaultParallelism
    # a scan alone: its splits are known without running anything
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_folder(spark: SparkSession, fallback: str = "/tmp/docloom-checkpoints") -> str:
    """The folder all executors share; the fallback is for a session on one machine that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = fallback
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor costs no recomputation of the past."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read back: lineage is cut, and what is read of them later
    is only the columns asked for."""
    at = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Rows of a kept table up to which it is sent to the other side of a join; some hundred bytes each.
MOST_SENT = 200_000


def sent(kept: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A kept table of narrow rows, to be sent to the other side of a join where it has few enough rows, else to be met by a shuffle."""
    return F.broadcast(kept) if kept.count() <= most else kept.hint("merge")


def by_group(df: DataFrame, keys: list[str], each: Callable[[list[tuple]], Iterable[tuple]], fields: dict[str, str]) -> DataFrame:
    """``keys`` and ``fields`` of what a function makes of the rows of each group, one group held at a time.

    For groups of a bounded size, such as the elements of a page; the rows come without their keys, sorted. Many
    small groups cost one pass over a partition, not a call each.
    """
    others = [c for c in df.columns if c not in keys]
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"`{n}` {t}" for n, t in fields.items())])
    kinds = to_arrow_schema(_parse_datatype_string(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns)))
        held: list[tuple] = []
        for key, group in groupby(rows, lambda r: r[: len(keys)]):
            held += ((*key, *made) for made in each([r[len(keys) :] for r in group]))
            if len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], kinds.names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], kinds.names)

    ordered = df.select(*keys, *others).repartition(*keys).sortWithinPartitions(*keys, *others)
    return bounded_batches(ordered).mapInArrow(run, schema)


def stripped(c: Column) -> Column:
    """``str.strip`` for Unicode white space; SQL ``trim`` knows only the blank."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bounded_batches(df: DataFrame, most: str = "16m") -> DataFrame:
    """Bound the bytes of a batch that goes to a Python worker, where the session leaves them unbounded.

    Rows may be large texts; a batch bounded by rows alone could outgrow a worker.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        if conf.get(key) in ("-1", str(2**31 - 1), f"{2**31 - 1}b"):
            conf.set(key, most)
    except Exception:  # a Spark without this setting
        pass
    return df
