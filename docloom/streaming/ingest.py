"""Files as a stream: what arrives is extracted once, by its content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import Settings
from docloom.engine import extracted, result_key


def arriving(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """New files below a folder as rows of path, extension, arrival and content."""
    df = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return df.select("path", F.lower(F.regexp_extract(name, r"[^.].*?\.([^.]+)$", 1)).alias("extension"), F.col("modificationTime").alias("arrived"), "content")


def once(stream: DataFrame, late: str = "1 day", settings: Settings = Settings()) -> DataFrame:
    """The stream without content that was there within the watermark; state is bounded by it."""
    return stream.withColumn("key", result_key("content", "extension", settings)).withWatermark("arrived", late).dropDuplicatesWithinWatermark(["key"])


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings = Settings(), available_now: bool = True) -> StreamingQuery:
    """Extract arriving files into a table; started again it goes on where it stopped."""
    new = once(arriving(spark, folder), settings=settings)
    result = extracted(new, ["path", "extension", "key"], "content", "extension", settings)
    writer = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
