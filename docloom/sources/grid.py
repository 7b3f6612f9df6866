"""Tables while a file is read: cells with spans, and their text."""

from __future__ import annotations

import html
from collections.abc import Iterator, Mapping
from dataclasses import dataclass


@dataclass(slots=True)
class Cell:
    text: str
    rows: int = 1
    cols: int = 1
    header: bool = False


def as_html(rows: list[list[Cell]]) -> str:
    """Simple HTML with spans above one."""
    if not rows:
        return ""
    out = ["<table border='1'>"]
    for row in rows:
        out.append("  <tr>")
        for c in row:
            name, text = "th" if c.header else "td", c.text
            if "&" in text or "<" in text or ">" in text:
                text = html.escape(text, quote=False)
            if "\n" in text:
                text = text.replace("\n", "<br>")
            if c.rows == 1 == c.cols:
                out.append(f"    <{name}>{text}</{name}>")
            else:
                spans = (f" rowspan='{c.rows}'" if c.rows > 1 else "") + (f" colspan='{c.cols}'" if c.cols > 1 else "")
                out.append(f"    <{name}{spans}>{text}</{name}>")
        out.append("  </tr>")
    out.append("</table>")
    return "\n".join(out)


def as_markdown(rows: list[list[Cell]]) -> str:
    width = max((len(r) for r in rows), default=0)
    lines = []
    for i, row in enumerate(rows):
        cells = [" ".join(c.text.split()).replace("|", "\\|") for c in row]
        lines.append("| " + " | ".join(cells + [""] * (width - len(cells))) + " |")
        if i == 0:
            lines.append("| " + " | ".join(["---"] * width) + " |")
    return "\n".join(lines)


def touching(cells: set[tuple[int, int]]) -> Iterator[list[int]]:
    """First and last row, first and last column and number of cells of each group of cells that touch by a side."""
    left = set(cells)
    while left:
        todo, part = [left.pop()], []
        while todo:
            r, c = todo.pop()
            part.append((r, c))
            for near in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if near in left:
                    left.remove(near)
                    todo.append(near)
        rows, cols = [r for r, _ in part], [c for _, c in part]
        yield [min(rows), max(rows), min(cols), max(cols), len(part)]


def rectangles(cells: Mapping[tuple[int, int], bool]) -> list[list[int]]:
    """The tables of a sheet, out of its cells and whether each has a border, from top to bottom.

    Cells with a border that touch are a table, then those without one; tables that overlap or have at most one row or
    column between them are one, until none are left to join.
    """
    boxes = [b for kind in (True, False) for b in sorted(touching({k for k, border in cells.items() if bool(border) == kind}))]
    joined = True
    while joined:
        joined, kept = False, []
        for box in boxes:
            hit = next((k for k in kept if max(k[0], box[0]) - min(k[1], box[1]) <= 2 and max(k[2], box[2]) - min(k[3], box[3]) <= 2), None)
            if hit is None:
                kept.append(box)
            else:
                hit[:] = min(hit[0], box[0]), max(hit[1], box[1]), min(hit[2], box[2]), max(hit[3], box[3]), hit[4] + box[4]
                joined = True
        boxes = kept
    return sorted(boxes, key=lambda b: (b[0], b[2]))
