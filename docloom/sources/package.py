"""Packages as tables: parts, relations, cells and images of each file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.sources import ooxml, pdfpage
from docloom.tables import bounded_batches

_DATA_URI = re.compile(rb"data:image/([a-z+.-]+);base64,([A-Za-z0-9+/=\s]+)")


def _rows(df: DataFrame, key: str, content: str, each, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, out = [], []
            for i, data in enumerate(part.column(1).to_pylist()):
                try:
                    got = list(each(data)) if data else []
                except Exception:  # a broken file has no rows here; extraction tells why
                    got = []
                at += [i] * len(got)
                out += got
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], [key, *names])

    return bounded_batches(df.select(key, content)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")


def parts(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, part, size, digest`` of each part of each package."""
    def each(data):
        p = ooxml.Package(data)
        return [(n, len(b := p.part(n)), hashlib.sha256(b).hexdigest()) for n in p.names]

    return _rows(df, key, content, each, "part string, size bigint, digest string", [pa.string(), pa.int64(), pa.string()])


def relations(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, source, id, type, target`` of each relation of each package."""
    def each(data):
        p = ooxml.Package(data)
        sources = [re.sub(r"_rels/([^/]*)\.rels$", r"\1", n) for n in p.names if n.endswith(".rels")]
        return [(s, i, t, target) for s in sources for i, (t, target) in p.relations(s).items()]

    return _rows(df, key, content, each, "source string, id string, type string, target string", [pa.string()] * 4)


def cells(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key, sheet, row, col, value`` of each cell of each workbook that holds something."""
    def each(data):
        return [(s["name"], r, c, v) for s in ooxml.sheets(ooxml.Package(data)) for (r, c), v in s["cells"].items()]

    return _rows(df, key, content, each, "sheet string, row int, col int, value string", [pa.string(), pa.int32(), pa.int32(), pa.string()])


def images(df: DataFrame, key: str, content: str = "content", most: int = 50 << 20) -> DataFrame:
    """``key, digest, name, bytes`` of each different image in packages and pages, named by its digest; none above ``most`` bytes."""
    def each(data):
        if data[:4] == b"PK\x03\x04":
            p = ooxml.Package(data)
            found = [(p.part(n), n.rsplit(".", 1)[-1].lower()) for n in p.names if re.search(r"/media/[^/]+\.\w+$", n)]
        else:
            found = [(base64.b64decode(b, validate=False), k.decode().replace("svg+xml", "svg")) for k, b in _DATA_URI.findall(data)]
        return [(d := hashlib.sha256(b).hexdigest(), f"{d[:16]}.{k}", b) for b, k in found if 0 < len(b) <= most]

    return _rows(df, key, content, each, "digest string, name string, bytes binary", [pa.string(), pa.string(), pa.binary()]).dropDuplicates([key, "digest"])


_ELEMENT = {"page": "int", "kind": "string", "element": "int", "x0": "double", "y0": "double", "x1": "double", "y1": "double", "text": "string", "size": "double", "lines": "int", "curves": "int", "rects": "int", "filled": "boolean", "color": "string", "stroke": "double"}
_KINDS = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def elements(df: DataFrame, key: str, content: str = "content") -> DataFrame:
    """``key`` and the positioned elements of the pages of each PDF file: a row of kind ``page`` with its size, and its texts, drawings and images.

    The tables of ``operators.pages`` are its rows by kind, with ``key`` and ``page`` as keys.
    """
    return _rows(df, key, content, pdfpage.elements, ", ".join(f"{k} {v}" for k, v in _ELEMENT.items()), [_KINDS[v] for v in _ELEMENT.values()])


def page_tables(found: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Pages, drawings, texts and images out of elements, as ``operators.pages`` takes them."""
    of = lambda kind, *columns: found.where(found["kind"] == kind).select(key, "page", *columns)
    box = ("x0", "y0", "x1", "y1")
    return of("page", found["x1"].alias("width"), found["y1"].alias("height")), of("drawing", "element", *box, "lines", "curves", "rects", "filled", "color", "stroke"), of("text", "element", *box, "text", "size"), of("image", "element", *box)
