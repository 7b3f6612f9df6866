"""The engine in SQL: functions, a table function of chunks, and a source of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf, udtf

from docloom import engine
from docloom.config import Settings
from docloom.sources import jsonpaths, webpage


def _each(function):
    return lambda values: values.map(lambda v: None if v is None else function(v))


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class DocumentReader(DataSourceReader):
    """Files below a folder that all executors reach, some to a partition, each read by its extension."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("load needs a path")
        self.folder, self.files = options["path"], int(options.get("filesPerPartition", "64"))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = engine._filesystem(self.folder)
        found = sorted(f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file)
        return [Files(found[i : i + self.files]) for i in range(0, len(found), self.files)] or [Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _ = engine._filesystem(self.folder)
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            ext = name.rsplit(".", 1)[-1].lower() if "." in name.lstrip(".") else ""
            with system.open_input_file(path) as f:
                data = f.read()
            got, error = engine.read_one(data, ext)
            yield (path, ext, len(data), None if got is None else got.text, None if got is None else dict(got.metadata), error)


class Documents(DataSource):
    """``spark.read.format("documents").load(folder)``: path, extension, size, text, metadata and error of each file."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "path string, extension string, size bigint, text string, metadata map<string,string>, error string"

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(dict(self.options))


class Chunks:
    """Number, strategy and text of the chunks of a text."""

    def eval(self, text: str, extension: str = "", size: int = 1000, overlap: int = 200):
        kind, found = engine.chunk(text, extension or "", size, overlap)
        for k, c in enumerate(found):
            yield k, kind, c


def register(spark: SparkSession, settings: Settings = Settings()) -> None:
    """Make ``doc_text(content, extension)``, ``html_text``, ``html_tables``, ``json_paths``, ``doc_chunks`` and the source ``documents`` known to a session."""

    @pandas_udf("string")
    def doc_text(content: pd.Series, extension: pd.Series) -> pd.Series:
        texts = ((engine.read_one(c, e or "", settings)[0]) for c, e in zip(content, extension))
        return pd.Series([None if t is None else t.text for t in texts], dtype=object)

    @pandas_udf("string")
    def html_text(source: pd.Series) -> pd.Series:
        return _each(webpage.text_of)(source)

    @pandas_udf("array<array<array<string>>>")
    def html_tables(source: pd.Series) -> pd.Series:
        return _each(lambda t: [[[c.text for c in r] for r in rows] for rows in webpage.read(t).tables])(source)

    @pandas_udf("string")
    def json_paths(text: pd.Series) -> pd.Series:
        return _each(jsonpaths.flatten)(text)

    for f in (doc_text, html_text, html_tables, json_paths):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("doc_chunks", udtf(Chunks, returnType="no int, strategy string, chunk string"))
    spark.dataSource.register(Documents)
