"""Queries of reading and chunking; what needs a parser has no SQL and is tested on small fixtures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from docloom import engine
from docloom.operators.chunkers import chunked
from docloom.sources import delimited, jsonpaths, webpage
from docloom.tables import bounded_batches, read, read_wide

CATALOG: dict = {}


def query(sql: str | None = None):
    def keep(f):
        CATALOG[f.__name__] = (f, sql)
        return f

    return keep


def _mapped(df, function, out: str, kind: pa.DataType, sql_kind: str):
    """A narrow pass of a function over the last column; the columns before it stay."""
    names = df.columns[:-1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            done = [None if v is None else function(v) for v in part.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(done, kind)], [*names, out])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names]
    return bounded_batches(df).mapInArrow(run, ", ".join([*fields, f"{out} {sql_kind}"]))


@query()
def extract_heads(spark, d):
    """Every file by its reader, as far as its bytes are there; failures as values."""
    return engine.extracted(read_wide(spark, d, "file_contexts"), ["file_id", "ingested_at"], "file_data", "file_extension").drop("metadata", "tables")


@query()
def chunk_router(spark, d):
    """Chunks of every text by the strategy that fits it and its own settings."""
    texts = read_wide(spark, d, "extracted_texts").join(read(spark, d, "chunking_configs"), "config_id", "left")
    return chunked(texts, ["text_id"], "text", None, "chunk_size", "chunk_overlap", "preserve_tables")


@query()
def html_text(spark, d):
    """The text of every page by a walk over its tree."""
    return _mapped(read_wide(spark, d, "html_converted").select("html_id", "ingested_at", "html_text"), webpage.text_of, "text", pa.string(), "string")


@query()
def html_tables(spark, d):
    """Rows of cells of every table of every page."""
    pages = read_wide(spark, d, "html_converted").select("html_id", "ingested_at", "html_text")
    found = _mapped(pages, lambda t: [[[c.text for c in r] for r in rows] for rows in webpage.read(t).tables], "tables", pa.list_(pa.list_(pa.list_(pa.string()))), "array<array<array<string>>>")
    return found.select("html_id", "ingested_at", F.posexplode("tables").alias("table_no", "rows")).select("html_id", "ingested_at", "table_no", F.posexplode("rows").alias("row_no", "cells"))


@query()
def csv_sniff(spark, d):
    """The delimiter of each file by the first lines that the sniffer looks at, and how sure it is."""
    head = read(spark, d, "csv_records").where(F.col("record_no") <= delimited.SAMPLE).dropDuplicates(["csv_id", "record_no"])
    lines = head.groupBy("csv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("record_no", "raw_record"))), lambda x: x["raw_record"]).alias("lines"))

    def guess(parts):
        sign, sure = delimited.sniff("\n".join(p.decode("utf-8", "replace") for p in parts))
        return {"delimiter": delimited.NAMES[sign], "confidence": round(sure, 6)}

    kind = pa.struct([("delimiter", pa.string()), ("confidence", pa.float64())])
    return _mapped(lines, guess, "guess", kind, "struct<delimiter: string, confidence: double>").select("csv_id", "guess.*")


_PART = "CASE WHEN {k} IS NULL AND {v} IS NULL THEN 'parts[{i}]: {{}}' ELSE concat_ws(E'\\n', 'parts[{i}].k: \"' || {k} || '\"', 'parts[{i}].v: \"' || {v} || '\"') END"


@query(f"""SELECT doc_id, concat_ws(E'\\n', 'doc_id: ' || doc_id, 'lang: "' || lang || '"', '', {_PART.format(i=0, k='source', v='version_no::VARCHAR')}, '', {_PART.format(i=1, k='group_code', v='subject_area')}) AS lines FROM documents""")
def json_nested(spark, d):
    """Nested objects as lines of path and value."""
    nested = F.to_json(F.struct("doc_id", "lang", F.array(F.struct(F.col("source").alias("k"), F.col("version_no").cast("string").alias("v")), F.struct(F.col("group_code").alias("k"), F.col("subject_area").alias("v"))).alias("parts")))
    return _mapped(read_wide(spark, d, "documents").select("doc_id", nested.alias("j")), jsonpaths.flatten, "lines", pa.string(), "string")
