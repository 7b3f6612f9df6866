"""Delimited text of unknown dialect: delimiter with confidence, rows, header, metadata."""

from __future__ import annotations

import csv
import io
import re
from statistics import mean, pstdev

from docloom.sources.grid import Cell, as_html

#: Lines that are looked at for the delimiter.
SAMPLE = 20
DELIMITERS = (",", "\t", ";", "|")
NAMES = {",": "Comma (,)", "\t": "Tab (\\t)", ";": "Semicolon (;)", "|": "Pipe (|)"}
_NUMBER = re.compile(r"-?\d+|-?\d+\.\d+|-?\d{1,3}(,\d{3})*(\.\d+)?|-?\d+(\.\d+)?%|\$-?\d+(\.\d+)?|₩-?\d+(,\d{3})*")


def is_numeric(value: str) -> bool:
    return bool(_NUMBER.fullmatch(value.strip()))


def sniff(text: str) -> tuple[str, float]:
    """The delimiter and how sure it is: 1 where all lines agree, else by their spread; a comma for nothing."""
    lines = [x for x in text.split("\n")[:SAMPLE] if x.strip()]
    best = (",", 0.0, 0.0)
    for d in DELIMITERS:
        counts = [len(next(csv.reader([x], delimiter=d), [])) - 1 for x in lines]
        if not counts or mean(counts) == 0:
            continue
        spread = pstdev(counts)
        score = mean(counts) * 10 if spread == 0 else mean(counts) - spread
        sure = 1.0 if spread == 0 else max(0.0, 0.7 + 0.3 * (1 - spread / mean(counts)))
        if score > best[1]:
            best = (d, score, sure)
    return best[0], best[2]


def parse(text: str, delimiter: str, most_rows: int | None = None, most_columns: int | None = None) -> tuple[list[list[str]], bool]:
    """Rows that aren't blank, and whether there was more than is asked for; a plain split where quoting is broken."""
    csv.field_size_limit(1 << 30)
    try:
        rows, cut = [], False
        for i, row in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter, skipinitialspace=True)):
            if most_rows is not None and i >= most_rows:
                cut = True
                break
            if any(c.strip() for c in row):
                rows.append(row[:most_columns])
                cut = cut or len(rows[-1]) < len(row)
        return rows, cut
    except csv.Error:
        lines = text.split("\n")
        rows = [x.strip().split(delimiter) for x in lines[:most_rows] if x.strip()]
        return [r[:most_columns] for r in rows], (most_rows is not None and len(lines) > most_rows) or (most_columns is not None and any(len(r) > most_columns for r in rows))


def tabbed(rows: list[list[str]]) -> str:
    """Rows as lines with tabs, where a table can't be drawn."""
    return "\n".join("\t".join(" ".join(c.split()) for c in r) for r in rows)


def has_header(rows: list[list[str]]) -> bool:
    if len(rows) < 2:
        return False
    words = all(not is_numeric(c) for c in rows[0] if c.strip())
    return words and (any(is_numeric(c) for c in rows[1] if c.strip()) or len(set(rows[0])) == len(rows[0]))


def read(text: str, delimiter: str | None = None, most_rows: int | None = None, most_columns: int | None = None) -> tuple[str, list[list[Cell]], dict[str, str]]:
    """The table as text, its cells and what is known of the file."""
    delimiter = delimiter or sniff(text)[0]
    rows, cut = parse(text, delimiter, most_rows, most_columns)
    header = has_header(rows)
    width = max((len(r) for r in rows), default=0)
    cells = [[Cell(c.strip(), 1, 1, header and i == 0) for c in (r if len(r) == width else [*r, *[""] * (width - len(r))])] for i, r in enumerate(rows)]
    about = {"delimiter": NAMES.get(delimiter, delimiter), "row_count": str(len(rows)), "col_count": str(width), "has_header": "Yes" if header else "No"}
    if header:
        about["column_names"] = ", ".join(rows[0][:10]) + (f" (+{len(rows[0]) - 10} more)" if len(rows[0]) > 10 else "")
    if cut:
        about["truncated"] = "Yes"
    try:
        return as_html(cells), cells, about
    except (MemoryError, RecursionError):
        return tabbed(rows), cells, about
