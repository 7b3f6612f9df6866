"""Files to text, metadata, tables and chunks: one row per file, failures as values.

``registry`` maps extensions to readers; a reader takes bytes and returns a ``Read``. Files are rows of
``path, content`` (as the binaryFile source gives them) or of any table with a name and bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLong
from contextvars import ContextVar, copy_context
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import Settings
from docloom.functions.formats import CATEGORIES, SIGNATURES
from docloom.functions.render import LABELS
from docloom.operators.chunkers import chunk
from docloom.sources import decode, delimited, jsonpaths, ole, ooxml, pdf, rtf, webpage
from docloom.sources.grid import Cell, as_html, as_markdown, rectangles
from docloom.tables import bounded_batches


@dataclass
class Read:
    text: str = ""
    metadata: dict[str, str] = field(default_factory=dict)
    tables: list[list[list[Cell]]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    encoding: str | None = None


#: The settings that a file is read under.
_SETTINGS: ContextVar[Settings] = ContextVar("settings", default=Settings())


def _plain(data: bytes, ext: str) -> Read:
    text, encoding = decode.decode(data)
    kind = next((k for k, exts in CATEGORIES.items() if ext in exts.split()), "text")
    warnings = []
    most = _SETTINGS.get().most_values
    if ext == "json" and (flat := jsonpaths.flatten(text, most)) is not None:
        warnings = [f"values beyond {most} left out"] if flat.endswith(f"\n{jsonpaths.CUT}") else []
        text = flat
    elif kind in ("code", "config", "script", "web"):
        text = text.rstrip().replace("\t", "    ")
    else:
        text = re.sub(r"\n\s*\n\s*\n+", "\n\n", text).strip()
    return Read(text, warnings=warnings, encoding=encoding)


def _html(data: bytes, ext: str) -> Read:
    source, encoding = decode.decode_html(data)
    page = webpage.read(source)
    return Read("\n\n".join(p for p in page.parts if p.strip()), page.meta, page.tables, encoding=encoding)


def _csv(data: bytes, ext: str) -> Read:
    source, encoding = decode.decode(data)
    limits = _SETTINGS.get()
    text, cells, about = delimited.read(source, "\t" if ext == "tsv" else None, limits.most_rows, limits.most_columns)
    warnings = [f"rows beyond {limits.most_rows} or columns beyond {limits.most_columns} left out"] if "truncated" in about else []
    return Read(text, about | {"encoding": encoding}, [cells] if cells else [], warnings, encoding)


def _package(reader: Callable) -> Callable[[bytes, str], Read]:
    def read(data: bytes, ext: str) -> Read:
        package = ooxml.Package(data)
        text, tables = reader(package)
        return Read(text, ooxml.properties(package), tables)

    return read


def _rtf(data: bytes, ext: str) -> Read:
    text, tables, info = rtf.read(data)
    return Read(text, info, tables)


def _image(data: bytes, ext: str) -> Read:
    kind = sniffed(data)
    if kind == "unknown":
        raise ValueError("no known image")
    return Read(f"[Image:{hashlib.sha256(data).hexdigest()[:16]}.{kind}]", {"format": kind, "size": str(len(data))})


def _old(reader: Callable[[ole.Compound], str | tuple[str, list]]) -> Callable[[bytes, str], Read]:
    def read(data: bytes, ext: str) -> Read:
        c = ole.Compound(data)
        got = reader(c)
        text, tables = (got, []) if isinstance(got, str) else got
        return Read(text, ole.properties(c), tables)

    return read


def _old_workbook(data: bytes, ext: str) -> Read:
    c = ole.Compound(data)
    parts, tables = [], []
    for name, cells in ole.workbook_cells(c):
        parts.append(f"[Sheet: {name}]")
        regions = rectangles(dict.fromkeys(cells, False))
        for no, box in enumerate(regions, 1):
            rows = ooxml.region_rows(cells, [], box)
            tables.append(rows)
            parts.append(f"[Table {no}]\n{as_markdown(rows)}" if len(regions) > 1 else as_markdown(rows))
    return Read("\n\n".join(parts), ole.properties(c), tables)


def _ends(e, name: str) -> list:
    return [x for x in e if x.tag.endswith("}" + name)]


def _hwpx_table(table, tables: list) -> str:
    """A table by the addresses of its cells: one cell as its text, one column as paragraphs, else HTML."""
    grid: dict[tuple[int, int], Cell] = {}
    for tr in _ends(table, "tr"):
        for tc in _ends(tr, "tc"):
            number = lambda child, key, rest: next((int(x.get(key)) for x in _ends(tc, child) if (x.get(key) or "").isdigit()), rest)  # noqa: B023, E731
            inner = _ends(tc, "subList") or [tc]
            text = "\n".join(t for t in (_hwpx_paragraph(p, tables) for p in _ends(inner[0], "p")) if t.strip())
            row = number("cellAddr", "rowAddr", 0)
            grid[row, number("cellAddr", "colAddr", 0)] = Cell(text, max(1, number("cellSpan", "rowSpan", 1)), max(1, number("cellSpan", "colSpan", 1)), row == 0)
    if not grid:
        return ""
    said = lambda key: int(table.get(key)) if (table.get(key) or "").isdigit() else 0
    n_rows, n_cols = said("rowCnt") or max(r for r, _ in grid) + 1, said("colCnt") or max(c for _, c in grid) + 1
    if (n_rows, n_cols) == (1, 1):
        return next(iter(grid.values())).text
    if n_cols == 1:
        return "\n\n".join(c.text for _, c in sorted(grid.items(), key=lambda x: x[0]) if c.text)
    by_row: dict[int, list[Cell]] = {}
    for (r, _), cell in sorted(grid.items(), key=lambda x: x[0]):
        by_row.setdefault(r, []).append(cell)
    tables.append([by_row[r] for r in sorted(by_row)])
    return as_html(tables[-1])


def _hwpx_paragraph(p, tables: list) -> str:
    """Text and tables of a paragraph's runs, in order."""
    out = []
    for run in _ends(p, "run"):
        for e in run:
            if e.tag.endswith("}t"):
                out.append("".join(e.itertext()))
            elif e.tag.endswith("}tbl"):
                out.append("\n" + _hwpx_table(e, tables) + "\n")
    return "".join(out).strip("\n")


def _hwpx(package: ooxml.Package) -> tuple[str, list]:
    """Paragraphs and tables of the sections of a packed Hangul document, sections by their number."""
    names = sorted((n for n in package.names if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    out, tables = [], []
    for n in names:
        out += [t for t in (_hwpx_paragraph(p, tables) for p in _ends(package.xml(n), "p")) if t.strip()]
    return "\n".join(out), tables


def _pdf(data: bytes, ext: str) -> Read:
    text, info, tables = pdf.read(data)
    return Read(text, info, tables, ["a scan; it needs recognition"] if "scanned" in info else [])


registry: dict[str, Callable[[bytes, str], Read]] = {}


def register(extensions: str, reader: Callable[[bytes, str], Read]) -> None:
    """Let a reader handle extensions, parted by blanks; the last one registered counts."""
    for e in extensions.split():
        registry[e.lower().lstrip(".")] = reader


def unregister(extension: str) -> None:
    registry.pop(extension.lower().lstrip("."), None)


for _kind in ("text", "code", "config", "script", "log"):
    register(CATEGORIES[_kind], _plain)
register("svg rst scss bash", _plain)
register("html htm xhtml", _html)
register("csv tsv", _csv)
register("docx", _package(ooxml.word_text))
register("xlsx", _package(ooxml.workbook_text))
register("pptx", _package(ooxml.slides_text))
register("rtf", _rtf)
register("doc", _old(ole.word_text))
register("ppt", _old(ole.slides_text))
register("xls", _old_workbook)
register("hwp", _old(ole.hangul_text))
register("hwpx", _package(_hwpx))
register("pdf", _pdf)
register(CATEGORIES["image"] + " tiff tif", _image)


def discover(group: str = "docloom.readers") -> list[str]:
    """Register the readers that installed packages offer: entry points that load a pair of extensions and a reader. Those that fail are left out."""
    from importlib.metadata import entry_points

    found = []
    for point in entry_points(group=group):
        try:
            extensions, reader = point.load()
            register(extensions, reader)
        except Exception:  # a broken package must not keep the others out
            continue
        found.append(point.name)
    return found


def is_supported(extension: str) -> bool:
    return extension.lower().lstrip(".") in registry


def supported_extensions() -> list[str]:
    return sorted(registry)


def sniffed(data: bytes) -> str:
    """The format that the first bytes tell."""
    code = data[:12].hex().upper()
    if re.match("52494646.{8}57454250", code):
        return "webp"
    return next((k for s, k in SIGNATURES if code.startswith(s)), "unknown")


def effective_extension(data: bytes, extension: str) -> str:
    """What a file is by its bytes where its name says an older format than it holds."""
    kind = sniffed(data)
    if extension in ("doc", "rtf", "ppt", "xls", "hwp"):
        if kind == "rtf":
            return "rtf"
        if kind == "zip":
            return {"doc": "docx", "rtf": "docx", "ppt": "pptx", "xls": "xlsx", "hwp": "hwpx"}[extension]
        if extension in ("doc", "xls") and data[:512].lstrip().lower().startswith((b"<html", b"<!doctype html")):
            return "html"
    return extension


def metadata_block(metadata: dict[str, str], language: str = "ko", indent: str = "  ") -> str:
    """Metadata as a tagged block in the order of the fields, then what else there is; an empty string for none."""
    labels = LABELS[language]
    lines = [f"{indent}{labels[k]}: {metadata[k].strip()}" for k in labels if metadata.get(k, "").strip()]
    lines += [f"{indent}{k}: {v.strip()}" for k, v in metadata.items() if k not in labels and v.strip()]
    return "\n".join(["[Document-Metadata]", *lines, "[/Document-Metadata]"]) if lines else ""


def code_of(error: Exception) -> str:
    """An error's code: its class in capitals."""
    name = re.sub(r"Error$", "", type(error).__name__)
    return "E_" + re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).upper()


def read_one(data: bytes | None, extension: str, settings: Settings = Settings()) -> tuple[Read | None, str | None]:
    """What a file holds, or the code and text of what went wrong."""
    try:
        if data is None:
            raise ValueError("no content")
        if settings.most_bytes is not None and len(data) > settings.most_bytes:
            raise ValueError("the file is larger than allowed")
        ext = effective_extension(data, extension.lower().lstrip("."))
        if ext not in registry:
            return None, f"E_UNSUPPORTED_FORMAT: {ext}"
        got = _within(settings, registry[ext], data, ext)
        got.text = tidied(got.text)
        return got, None
    except TooLong:
        return None, f"E_TIMEOUT: more than {settings.seconds} s"
    except Exception as e:
        return None, f"{code_of(e)}: {e}"


def tidied(text: str) -> str:
    """At most one blank line in a row, no blanks before a line feed, no white space at both ends."""
    if "\n\n\n" in text:
        text = re.sub(r"\n{3,}", "\n\n", text)
    if " \n" in text or "\t\n" in text:
        text = "\n".join(line.rstrip(" \t") for line in text.split("\n"))
    return text.strip()


def _within(settings: Settings, reader: Callable[[bytes, str], Read], data: bytes, ext: str) -> Read:
    """What a reader gives under the settings, within the seconds they allow; a reader that takes longer is left to end by itself."""
    token = _SETTINGS.set(settings)
    try:
        if settings.seconds is None:
            return reader(data, ext)
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(copy_context().run, reader, data, ext).result(timeout=settings.seconds)
        finally:
            pool.shutdown(wait=False)
    finally:
        _SETTINGS.reset(token)


def files(spark: SparkSession, path: str) -> DataFrame:
    """The files below a path as rows of path, extension, size and content; files of no bytes are left out by the source."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return df.select("path", F.lower(F.regexp_extract(name, r"[^.].*?\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), "modificationTime", "content")


_FIELDS = "text string, metadata map<string,string>, tables array<array<array<struct<content: string, row_span: int, col_span: int, is_header: boolean>>>>, encoding string, warnings array<string>, error string"


def as_cells(tables: Iterable[list[list[list[Cell]]] | None]) -> pa.Array:
    """The tables of some files as one array of rows of cells, built column by column."""
    files, rows_at, cells_at, cells = [0], [0], [0], []
    missing = []
    for held in tables:
        missing.append(held is None)
        for table in held or ():
            for row in table:
                cells += row
                cells_at.append(len(cells))
            rows_at.append(len(cells_at) - 1)
        files.append(len(rows_at) - 1)
    fields = [pa.array([c.text for c in cells], pa.string()), pa.array([c.rows for c in cells], pa.int32()), pa.array([c.cols for c in cells], pa.int32()), pa.array([c.header for c in cells], pa.bool_())]
    out = pa.StructArray.from_arrays(fields, ["content", "row_span", "col_span", "is_header"])
    for offsets in (cells_at, rows_at):
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), out)
    return pa.ListArray.from_arrays(pa.array(files, pa.int32()), out, mask=pa.array(missing, pa.bool_()))


def extracted(df: DataFrame, keys: list[str], content: str = "content", extension: str = "extension", settings: Settings = Settings(), with_metadata: bool = True) -> DataFrame:
    """``keys`` and text, metadata, tables, encoding, warnings and error of each file; no file fails the job.

    A null content, an unknown extension and broken files give an error and null text; empty files the
    empty text. Keys may be null and repeat.
    """
    n = len(keys)
    readers = dict(registry)

    kinds = [pa.string(), pa.map_(pa.string(), pa.string()), None, pa.string(), pa.list_(pa.string()), pa.string()]
    names = [*keys, "text", "metadata", "tables", "encoding", "warnings", "error"]

    def row(data: bytes | None, ext: str) -> tuple:
        got, error = read_one(data, ext, settings)
        if got is None:
            return None, None, None, None, None, error
        block = metadata_block(got.metadata, settings.metadata.language, settings.metadata.indent) if with_metadata else ""
        return f"{block}\n\n{got.text}" if block else got.text, list(got.metadata.items()), got.tables, got.encoding, got.warnings, None

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry.update(readers)
        for part in parts:
            held, first, weight = [], 0, 0
            for i in range(part.num_rows):
                held.append(row(part.column(n)[i].as_py(), part.column(n + 1)[i].as_py() or ""))
                weight += 3 * len(held[-1][0] or "") + 64
                if weight >= 1 << 23 or i + 1 == part.num_rows:
                    size = len(held)
                    yield pa.RecordBatch.from_arrays([*(part.column(k).slice(first, size) for k in range(n)), *(as_cells(c) if k is None else pa.array(c, k) for c, k in zip(zip(*held), kinds))], names)
                    held, first, weight = [], i + 1, 0

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), _FIELDS])
    return bounded_batches(df.select(*keys, content, extension)).mapInArrow(run, schema)


def chunks(df: DataFrame, keys: list[str], content: str = "content", extension: str = "extension", settings: Settings = Settings()) -> DataFrame:
    """``keys, strategy, no, chunk`` of each file that could be read."""
    from docloom.operators.chunkers import chunked

    got = extracted(df, [*keys, extension], content, extension, settings) if extension not in keys else extracted(df, keys, content, extension, settings)
    c = settings.chunking
    return chunked(got, keys, "text", extension, c.chunk_size, c.chunk_overlap, c.preserve_tables)


def chunk_text(text: str, extension: str = "", settings: Settings = Settings()) -> list[str]:
    """The chunks of one text, for use outside of a job."""
    c = settings.chunking
    return chunk(text, extension, c.chunk_size, c.chunk_overlap, c.preserve_tables)[1]


def result_key(content: str = "content", extension: str = "extension", settings: Settings = Settings()):
    """The key that a result is kept under: digest of the bytes, the extension and all settings."""
    return F.sha2(F.concat_ws("|", F.sha2(F.col(content), 256), F.lower(extension), F.lit(json.dumps(settings.to_dict(), sort_keys=True, default=str))), 256)


def extracted_once(df: DataFrame, keys: list[str], kept: str, content: str = "content", extension: str = "extension", settings: Settings = Settings()) -> DataFrame:
    """As ``extracted``, through a table of results at ``kept``: only content not seen yet is read, once, and added."""
    spark = df.sparkSession
    keyed = df.withColumn("_key", result_key(content, extension, settings))
    todo = keyed.dropDuplicates(["_key"])
    try:
        todo = todo.join(spark.read.parquet(kept).select("_key"), "_key", "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # nothing is kept yet
            raise
    extracted(todo, ["_key"], content, extension, settings).write.mode("append").parquet(kept)
    # two writers may have added one content at the same time
    return keyed.select(*keys, "_key").join(spark.read.parquet(kept).dropDuplicates(["_key"]), "_key").drop("_key")


RESULT = f"struct<{_FIELDS.replace(' ', ': ', 1).replace(', metadata ', ', metadata: ').replace(', tables ', ', tables: ').replace(', encoding ', ', encoding: ').replace(', warnings ', ', warnings: ').replace(', error ', ', error: ')}>"


def as_json(results: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, json``: each result as one JSON text, tables within."""
    return results.select(*keys, F.to_json(F.struct("text", "metadata", "tables", "encoding", "warnings", "error")).alias("json"))


def of_json(df: DataFrame, keys: list[str], json: str = "json") -> DataFrame:
    """Results out of JSON as ``as_json`` makes it; texts that are none give nulls."""
    return df.select(*keys, F.from_json(json, RESULT).alias("r")).select(*keys, "r.*")


def loaded(df: DataFrame, source: str = "path", content: str = "content", extension: str = "extension", settings: Settings = Settings(), chunked: bool = False, more: dict[str, str] | None = None) -> DataFrame:
    """``text, metadata`` of each file, or of each of its chunks: source, name and extension, the chunk's number and page.

    Files that can't be read have no rows.
    """
    named = {"source": F.col(source), "file_name": F.regexp_extract(source, r"([^/\\]+)$", 1), "file_extension": F.lower(extension), **{k: F.lit(v) for k, v in (more or {}).items()}}
    got = extracted(df, list(dict.fromkeys([source, extension])), content, extension, settings).where(F.col("error").isNull())
    about = lambda extra: F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k in (*named, *extra))), F.array(*(c.cast("string") for c in (*named.values(), *extra.values())))), lambda _, v: v.isNotNull())
    if not chunked:
        return got.select("text", about({}).alias("metadata"))
    from docloom.operators import structure
    from docloom.operators.chunkers import chunked as cut

    c = settings.chunking
    keys = list(dict.fromkeys([source, extension]))
    pieces = structure.in_force(cut(got, keys, "text", extension, c.chunk_size, c.chunk_overlap, c.preserve_tables), source, "no", "chunk", "page")
    return pieces.select(F.col("chunk").alias("text"), about({"chunk_index": F.col("no"), "page_number": F.col("label")}).alias("metadata"))


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def safe_name(name: str) -> str:
    """A name for a file or folder; one that leads out of its folder is an error."""
    if "/" in name or "\\" in name or "\0" in name or name in ("", ".", ".."):
        raise ValueError(f"no name for a file: {name!r}")
    return name


def write_chunks(chunked: DataFrame, key: str, folder: str, prefix: str = "chunk", separator: str = "---", header: bool = False, page: str | None = None) -> None:
    """A Markdown file for each chunk below ``folder/key=...``, numbered from 1, named by prefix and number.

    ``folder`` is a URI of any file system that all executors reach (a plain path is for a single machine or a mounted share).
    With ``header`` comments with the chunk's number and, of a column ``page``, its page stand ahead. Written again, files stay the same.
    """

    def write(rows: Iterable) -> None:
        system, root = _filesystem(folder)
        for r in rows:
            at = f"{root.rstrip('/')}/{key}={safe_name(str(r[key]))}"
            system.create_dir(at, recursive=True)
            head = [f"<!-- chunk_index: {r['no']} -->", *([f"<!-- page: {r[page]} -->"] if page and r[page] is not None else []), separator, ""] if header else []
            with system.open_output_stream(f"{at}/{safe_name(prefix)}_{r['no'] + 1:04d}.md") as f:
                f.write("\n".join([*head, r["chunk"]]).encode())

    chunked.select(key, "no", "chunk", *([page] if page else [])).foreachPartition(write)


def store_images(images: DataFrame, folder: str, key: str, name: str = "name", content: str = "bytes") -> DataFrame:
    """``key, name, path, tag`` of images written below ``folder``, each different one once; ``folder`` as for ``write_chunks``.

    A name that leads out of the folder is an error.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _filesystem(folder)
        system.create_dir(root, recursive=True)
        for part in parts:
            paths = []
            for n, data in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                paths.append(f"{root.rstrip('/')}/{safe_name(n)}")
                with system.open_output_stream(paths[-1]) as f:
                    f.write(data)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(paths, pa.string()), pa.array([f"[Image:{p}]" for p in paths], pa.string())], [key, name, "path", "tag"])

    kind = images.schema[key].dataType.simpleString()
    return bounded_batches(images.select(key, name, content)).mapInArrow(run, f"`{key}` {kind}, `{name}` string, path string, tag string")
