"""Typed rows out of the records of CSV files, and the records that fail with their reason.

Structural indexing: over the bytes of a whole batch, a mask of quotes and its prefix parity within each
record tell which delimiters divide fields and whether every quote stands where it may; counts and
types then make a record a row or a reject. All four delimiters are tried in one scan, as a file's own
is the one that fits most of its records.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.tables import bounded_batches, sent, stored

DELIMITERS = (b",", b"\t", b";", b"|")
OK, ENCODING, QUOTING, COLUMNS, VALUE, HEADER = range(6)
REASONS = {ENCODING: "encoding", QUOTING: "quoting", COLUMNS: "columns", VALUE: "value"}
BOM = codecs.BOM_UTF8
#: What counts as numeric text.
DECIMAL = tuple(
    re.compile(p)
    for p in (r"-?\d+", r"-?\d+\.\d+", r"-?\d{1,3}(,\d{3})*(\.\d+)?", r"-?\d+(\.\d+)?%", r"\$-?\d+(\.\d+)?", r"₩-?\d+(,\d{3})*")
)
INT = re.compile(rb"[+-]?0*([0-9]+)")
DOUBLE = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
DATE = re.compile(rb"([0-9]{4})-([0-9]{2})-([0-9]{2})")


@lru_cache(maxsize=256)
def codec(name: str | None) -> str:
    """Python's name of an encoding; none is UTF-8, an unknown one the empty string."""
    try:
        found = codecs.lookup((name or "").strip() or "utf-8").name
    except LookupError:
        return ""
    return "utf-8" if found == "utf-8-sig" else found


def _is_int(v: bytes) -> bool:
    m = INT.fullmatch(v)
    return m is not None and len(m[1]) <= 10 and -(1 << 31) <= (-int(m[1]) if v[:1] == b"-" else int(m[1])) < 1 << 31


def _is_date(v: bytes) -> bool:
    m = DATE.fullmatch(v)
    if not m:
        return False
    try:
        date(*map(int, m.groups()))
    except ValueError:
        return False
    return True


def _is_decimal(v: bytes, encoding: str) -> bool:
    text = v.decode(encoding)
    return any(p.fullmatch(text) for p in DECIMAL)


def fits(kind: str, nullable: bool, value: bytes, encoding: str) -> bool:
    """Whether a field's bytes, without quotes and surrounding blanks, are a value of the column."""
    if not value:
        return nullable
    if kind == "INT":
        return _is_int(value)
    if kind == "DOUBLE":
        return DOUBLE.fullmatch(value) is not None
    if kind == "DECIMAL":
        return _is_decimal(value, encoding)
    if kind == "DATE":
        return _is_date(value)
    return True


@lru_cache(maxsize=4096)
def columns_of(signature: str | None) -> tuple[tuple[str, bool], ...]:
    """Type and nullability of each column, as ``schema_signatures`` writes them."""
    return tuple((c[:-1], c[-1] == "?") for c in (signature or "").split(",") if c)


class Index:
    """Structural index of the records of a batch."""

    def __init__(self, records: list[bytes], first: list[bool], encodings: list[str]):
        strip = [f and e == "utf-8" and r.startswith(BOM) for r, f, e in zip(records, first, encodings)]
        records = [r[3:] if s else r for r, s in zip(records, strip)]
        self.blob = b"".join(records)
        sizes = np.fromiter(map(len, records), np.int64, len(records))
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.bytes = np.frombuffer(self.blob, np.uint8)
        self.quote = np.flatnonzero(self.bytes == 34)
        before = np.searchsorted(self.quote, self.start)
        self.quotes = np.searchsorted(self.quote, self.end) - before
        owner = np.repeat(np.arange(len(records)), self.quotes)
        self.opens = ((np.arange(len(self.quote)) - before[owner]) & 1) == 0
        self.owner = owner
        self.bad = [not e or not _decodes(r, e) for r, e in zip(records, encodings)]

    def delimiters(self, sign: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the delimiters outside of quotes, each record's first of them and number of them."""
        at = np.flatnonzero(self.bytes == sign[0])
        owner = np.searchsorted(self.end, at, "right")
        inside = np.searchsorted(self.quote, at) - np.searchsorted(self.quote, self.start[owner]) if len(at) else at
        at = at[(inside & 1) == 0]
        first = np.searchsorted(at, self.start)
        return at, first, np.searchsorted(at, self.end) - first

    def misquoted(self, sign: bytes) -> np.ndarray:
        """Records with a quote that neither opens nor closes a field nor is one of two."""
        bad = (self.quotes & 1) == 1
        if len(self.quote):
            n, q, d = len(self.bytes), self.quote, sign[0]
            prev, nxt = self.bytes[np.maximum(q - 1, 0)], self.bytes[np.minimum(q + 1, n - 1)]
            at_start = (q == self.start[self.owner]) | (prev == d) | (prev == 34)
            at_end = (q + 1 == self.end[self.owner]) | (nxt == d) | (nxt == 34)
            wrong = np.where(self.opens, ~at_start, ~at_end)
            bad[self.owner[wrong]] = True
        return bad


def _decodes(record: bytes, encoding: str) -> bool:
    try:
        record.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _field(raw: bytes) -> bytes:
    """A field without enclosing quotes and surrounding blanks."""
    if raw[:1] == b'"':
        raw = raw[1:-1].replace(b'""', b'"')
    return raw.strip(b" ")


def outcomes(records: list[bytes | None], first: list[bool], header: list[bool], encodings: list[str | None], signatures: list[str | None], delimiters: list[int] | None = None, values: bool = False):
    """The outcome of each record under each delimiter (or under the one given for it).

    Returns codes of shape (records, 4), whether the number of fields is right, and with ``values`` the
    fields of the records that are rows under their own delimiter.
    """
    n = len(records)
    known = [codec(e) for e in encodings]
    index = Index([r or b"" for r in records], first, known)
    bad = np.array(index.bad, bool) | np.array([r is None for r in records], bool)
    header = np.array(header, bool)
    width = np.array([len(columns_of(s)) for s in signatures], np.int64)
    codes, right = np.full((n, 4), ENCODING, np.int8), np.zeros((n, 4), bool)
    fields: list[list[str | None] | None] = [None] * n
    wanted = None if delimiters is None else np.array(delimiters)
    groups: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(signatures, known)):
        groups.setdefault(key, []).append(i)
    groups = {k: np.array(v) for k, v in groups.items()}
    for d, sign in enumerate(DELIMITERS):
        at, begin, count = index.delimiters(sign)
        right[:, d] = ok = (count + 1 == width) & ~bad
        code = np.where(bad, ENCODING, np.where(index.misquoted(sign), QUOTING, np.where(ok, OK, COLUMNS)))
        code[header & ~bad] = HEADER
        own = np.ones(n, bool) if wanted is None else wanted == d
        for (signature, encoding), members in groups.items():
            rows = members[(code[members] == OK) & own[members]]
            if not len(rows):
                continue
            kinds = columns_of(signature)
            cuts = at[begin[rows][:, None] + np.arange(len(kinds) - 1)] if len(kinds) > 1 else np.empty((len(rows), 0), np.int64)
            starts = np.hstack([index.start[rows][:, None], cuts + 1])
            stops = np.hstack([cuts, index.end[rows][:, None]])
            fit, blob, parts = np.ones(len(rows), bool), index.blob, []
            for c, (kind, nullable) in enumerate(kinds):
                column = [_field(blob[a:b]) for a, b in zip(starts[:, c].tolist(), stops[:, c].tolist())]
                fit &= np.fromiter((fits(kind, nullable, v, encoding) for v in column), bool, len(column))
                parts.append(column)
            code[rows[~fit]] = VALUE
            if values:
                for k in np.flatnonzero(fit):
                    fields[rows[k]] = [p[k].decode(encoding) or None for p in parts]
        codes[:, d] = code
    return codes, right, fields


def schema_signatures(schemas: DataFrame) -> DataFrame:
    """``schema_id`` and ``signature``: the columns' types in order, ``?`` after a nullable, ``!`` after another one."""
    column = F.struct("col_index", F.concat(F.col("col_type"), F.when(F.col("nullable"), "?").otherwise("!")).alias("kind"))
    return schemas.groupBy("schema_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(column)), lambda x: x["kind"])).alias("signature"))


def _joined(records: DataFrame, metadata: DataFrame, schemas: DataFrame) -> DataFrame:
    files = metadata.groupBy("csv_id").agg(F.min_by(F.struct("schema_id", "encoding", "has_header"), F.struct("extracted_at", "schema_id")).alias("m")).select("csv_id", "m.*")
    # kept, so that its size is known when the join is planned: a small one goes to the records, not they to it
    files = sent(stored(files.join(schema_signatures(schemas), "schema_id", "left")))
    header = (F.col("record_no") == 1) & F.coalesce(F.col("has_header") == "Yes", F.lit(False))
    return records.select("record_id", "csv_id", "record_no", "raw_record").join(files, "csv_id", "left").select(
        "record_id", "csv_id", "schema_id", F.coalesce(F.col("record_no") == 1, F.lit(False)).alias("first"),
        F.coalesce(header, F.lit(False)).alias("header"), "encoding", "signature", "raw_record",
    )


def tried(records: DataFrame, metadata: DataFrame, schemas: DataFrame) -> DataFrame:
    """``record_id, csv_id`` and ``code``, the outcome under each delimiter in three bits, ``fit`` in one bit each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            c = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            codes, right, _ = outcomes(*(c[k].to_pylist() for k in ("raw_record", "first", "header", "encoding", "signature")))
            packed = (codes.astype(np.int32) << np.array([0, 3, 6, 9], np.int32)).sum(1)
            fit = ((codes == OK) | ((codes == HEADER) & right)).astype(np.int32)
            packed += (fit << np.array([12, 13, 14, 15], np.int32)).sum(1) + (right.astype(np.int32) << np.array([16, 17, 18, 19], np.int32)).sum(1)
            yield pa.RecordBatch.from_arrays([c["record_id"], c["csv_id"], pa.array(packed, pa.int32())], ["record_id", "csv_id", "code"])

    return bounded_batches(_joined(records, metadata, schemas)).mapInArrow(run, "record_id bigint, csv_id bigint, code int")


def _bit(k: int) -> Column:
    return F.shiftright(F.col("code"), k).bitwiseAND(F.lit(1)).cast("long")


def file_delimiters(outcome: DataFrame) -> DataFrame:
    """``csv_id`` and ``delimiter_no`` of the delimiter that fits most records; then the one with the right
    number of fields in most; then the first of DELIMITERS."""
    sums = outcome.groupBy("csv_id").agg(*(F.sum(_bit(12 + d)).alias(f"fit{d}") for d in range(4)), *(F.sum(_bit(16 + d)).alias(f"right{d}") for d in range(4)))
    best = F.greatest(*(F.struct(F.col(f"fit{d}").alias("fit"), F.col(f"right{d}").alias("right"), F.lit(-d).alias("no")) for d in range(4)))
    return sums.select("csv_id", (-best["no"]).alias("delimiter_no"))


def judged(records: DataFrame, metadata: DataFrame, schemas: DataFrame) -> DataFrame:
    """``record_id, csv_id, delimiter_no, outcome`` of each record under its file's real delimiter.

    A null record fails by ``encoding``; one whose file or schema is unknown by ``columns``, as no number
    of fields is right; a record delivered more than once counts as often as it is there. A file with no
    records has no delimiter. Columns beyond those named in the tables are not looked at.
    """
    tries = stored(tried(records, metadata, schemas))
    best = file_delimiters(tries)
    code = F.expr("shiftright(code, 3 * delimiter_no) & 7")
    best = best.withColumnRenamed("csv_id", "own")
    return tries.join(best, F.col("csv_id").eqNullSafe(F.col("own"))).select("record_id", "csv_id", "delimiter_no", code.alias("outcome"))


def rejects(records: DataFrame, metadata: DataFrame, schemas: DataFrame) -> DataFrame:
    """``record_id, reason`` of each record that fails, once, with the first reason that applies."""
    failed = judged(records, metadata, schemas).where(F.col("outcome").isin(*REASONS))
    names = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))
    return failed.groupBy("record_id").agg(F.min("outcome").alias("outcome")).select("record_id", names[F.col("outcome")].alias("reason"))


def rows(records: DataFrame, metadata: DataFrame, schemas: DataFrame) -> DataFrame:
    """``record_id, csv_id, schema_id, delimiter, values`` of each record that is a row, once.

    ``values`` are the fields in the schema's order, decoded, unquoted, without surrounding blanks; an
    empty field is null. ``typed`` casts them.
    """
    best = sent(stored(file_delimiters(stored(tried(records, metadata, schemas)))).withColumnRenamed("csv_id", "own"))
    source = _joined(records, metadata, schemas)
    source = source.join(best, F.col("csv_id").eqNullSafe(F.col("own"))).drop("own")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            c = {name: part.column(i) for i, name in enumerate(part.schema.names)}
            own = c["delimiter_no"].to_pylist()
            codes, _, fields = outcomes(*(c[k].to_pylist() for k in ("raw_record", "first", "header", "encoding", "signature")), own, True)
            keep = pa.array([f is not None and codes[i, own[i]] == OK for i, f in enumerate(fields)], pa.bool_())
            signs = pa.array([DELIMITERS[d].decode() for d in own], pa.string())
            out = pa.RecordBatch.from_arrays([c["record_id"], c["csv_id"], c["schema_id"], signs, pa.array(fields, pa.list_(pa.string()))], ["record_id", "csv_id", "schema_id", "delimiter", "values"])
            yield out.filter(keep)

    out = bounded_batches(source).mapInArrow(run, "record_id bigint, csv_id bigint, schema_id int, delimiter string, values array<string>")
    return out.dropDuplicates(["record_id"])


def first_rows(records: DataFrame, metadata: DataFrame, schemas: DataFrame) -> DataFrame:
    """``csv_id, first, cells`` of the first two records of each file, under its real delimiter and encoding, whether
    they are rows or not.

    ``cells`` are the fields, decoded and unquoted; bytes that the encoding doesn't have become U+FFFD, an unknown
    encoding counts as UTF-8, a null record has null.
    """
    best = file_delimiters(tried(records, metadata, schemas)).withColumnRenamed("csv_id", "own")
    source = _joined(records.where("record_no <= 2"), metadata, schemas)
    source = source.join(best, F.col("csv_id").eqNullSafe(F.col("own"))).select("csv_id", "first", "encoding", "delimiter_no", "raw_record")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            first, encodings, own, raw = (part.column(k).to_pylist() for k in range(1, 5))
            known = [codec(e) or "utf-8" for e in encodings]
            index = Index([r or b"" for r in raw], first, known)
            found = [index.delimiters(sign) for sign in DELIMITERS]
            cells: list[list[str] | None] = []
            for i, (r, d) in enumerate(zip(raw, own)):
                at, begin, count = found[d]
                cuts = at[begin[i] : begin[i] + count[i]].tolist()
                bounds = zip([int(index.start[i]), *(c + 1 for c in cuts)], [*cuts, int(index.end[i])])
                cells.append(None if r is None else [_unquoted(index.blob[a:b]).decode(known[i], "replace") for a, b in bounds])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cells, pa.list_(pa.string()))], ["csv_id", "first", "cells"])

    return bounded_batches(source).mapInArrow(run, "csv_id bigint, first boolean, cells array<string>")


def _unquoted(raw: bytes) -> bytes:
    """A field without enclosing quotes; blanks stay."""
    return raw[1:-1].replace(b'""', b'"') if len(raw) > 1 and raw[:1] == raw[-1:] == b'"' else raw


def typed(parsed: DataFrame, schema: list[tuple[str, str]], schema_id: int) -> DataFrame:
    """The rows of one schema with its columns by name and type; ``schema`` lists name and type in order.

    Money, percent and thousands signs go from a DECIMAL; a percentage is divided by a hundred.
    """

    def cast(i: int, kind: str) -> Column:
        v = F.col("values")[i]
        if kind == "DECIMAL":
            number = F.regexp_replace(v, "[$₩,%]", "").cast("decimal(38,10)")
            return F.when(v.endswith("%"), number / 100).otherwise(number).cast("decimal(38,10)")
        return v.cast({"INT": "int", "DOUBLE": "double", "DATE": "date"}.get(kind, "string"))

    return parsed.where(F.col("schema_id") == schema_id).select("record_id", "csv_id", *(cast(i, kind).alias(name) for i, (name, kind) in enumerate(schema)))
