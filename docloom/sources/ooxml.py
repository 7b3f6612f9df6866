"""Packages of XML: documents, workbooks and presentations, by the standard library alone."""

from __future__ import annotations

import copy
import hashlib
import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from docloom.sources.grid import Cell, as_html, as_markdown, rectangles

#: Bytes that a package may hold when unpacked.
MOST_UNPACKED = 1 << 30
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Elements of the core properties and the fields they fill.
CORE = {"title": "title", "subject": "subject", "creator": "author", "keywords": "keywords", "description": "comments", "lastModifiedBy": "last_saved_by", "created": "create_time", "modified": "last_saved_time", "category": "category", "revision": "revision"}


class Package:
    """A package of parts and their relations; parts changed are written anew, all others keep their bytes."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        if sum(i.file_size for i in self.zip.infolist()) > MOST_UNPACKED:
            raise ValueError("the package is larger than allowed when unpacked")
        self.changed: dict[str, bytes] = {}
        self.gone: set[str] = set()

    @property
    def names(self) -> list[str]:
        return [n for n in dict.fromkeys([*self.zip.namelist(), *self.changed]) if n not in self.gone]

    def part(self, name: str) -> bytes | None:
        if name in self.gone:
            return None
        if name in self.changed:
            return self.changed[name]
        return self.zip.read(name) if name in self.zip.NameToInfo else None

    def xml(self, name: str) -> ET.Element | None:
        data = self.part(name)
        return None if data is None else ET.fromstring(data)

    def put(self, name: str, data: bytes) -> None:
        self.gone.discard(name)
        self.changed[name] = data

    def remove(self, name: str) -> None:
        self.changed.pop(name, None)
        self.gone.add(name)

    def relations(self, source: str = "") -> dict[str, tuple[str, str]]:
        """Id to type and target of the relations of a part, of the package for none."""
        folder, base = posixpath.split(source)
        root = self.xml(posixpath.join(folder, "_rels", f"{base}.rels"))
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
        return out

    def save(self) -> bytes:
        """Entries in their order, the new ones last; an entry that wasn't changed keeps its bytes, time and attributes."""
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for info in self.zip.infolist():
                if info.filename not in self.gone:
                    z.writestr(info, self.changed.get(info.filename, None) or self.zip.read(info.filename), compress_type=info.compress_type)
            for name, data in self.changed.items():
                if name not in self.zip.NameToInfo:
                    z.writestr(name, data, compress_type=zipfile.ZIP_DEFLATED)
        return out.getvalue()


def properties(package: Package) -> dict[str, str]:
    root = package.xml("docProps/core.xml")
    out = {}
    for e in root if root is not None else ():
        field = CORE.get(e.tag.rsplit("}", 1)[-1])
        if field and (e.text or "").strip():
            out[field] = e.text.strip()
    return out


def _runs(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag == f"{W}tab":
            out.append("\t")
        elif e.tag in (f"{W}br", f"{W}cr") and e.get(f"{W}type") != "page":
            out.append("\n")
    return "".join(out)


def _word_table(table: ET.Element) -> list[list[Cell]]:
    rows: list[list[Cell]] = []
    held: dict[int, Cell] = {}
    for i, tr in enumerate(table.findall(f"{W}tr")):
        row, col = [], 0
        before = tr.find(f"{W}trPr/{W}gridBefore")
        col += int(before.get(f"{W}val", "0")) if before is not None else 0
        for tc in tr.findall(f"{W}tc"):
            pr = tc.find(f"{W}tcPr")
            span = pr.find(f"{W}gridSpan") if pr is not None else None
            merge = pr.find(f"{W}vMerge") if pr is not None else None
            cols = int(span.get(f"{W}val", "1")) if span is not None else 1
            if merge is not None and merge.get(f"{W}val") != "restart" and col in held:
                held[col].rows += 1
            else:
                cell = Cell("\n".join(_runs(p) for p in tc.iter(f"{W}p")).strip(), 1, cols, i == 0)
                row.append(cell)
                held.pop(col, None)
                if merge is not None:
                    held[col] = cell
            col += cols
        rows.append(row)
    return rows


DIAGRAM = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"
CHART = "{http://schemas.openxmlformats.org/drawingml/2006/chart}chart"
VML = "{urn:schemas-microsoft-com:vml}"


def image_tag(package: Package, name: str) -> str:
    """The tag of an image by the digest of its bytes; an empty string where there are none."""
    data = package.part(name)
    return f"[Image:{hashlib.sha256(data).hexdigest()[:16]}.{name.rsplit('.', 1)[-1].lower()}]" if data else ""


def drawings(package: Package, source: str, e: ET.Element, related: dict[str, tuple[str, str]]) -> list[str]:
    """Charts, diagrams and images below an element, in order, as text."""
    from docloom.sources import charts

    out = []
    for d in e.iter():
        target = lambda k: related.get(d.get(k, ""), ("", ""))[1]  # noqa: B023, E731
        if d.tag == CHART or (d.tag.endswith("}chart") and d.get(f"{R}id")):
            out.append(charts.of_part(package, target(f"{R}id")))
        elif d.tag == f"{DIAGRAM}relIds" and (data := package.xml(target(f"{R}dm"))) is not None:
            texts = ["".join(t.text or "" for t in p.iter(f"{A}t")).strip() for p in data.iter(f"{A}p")]
            out.append("\n".join(["[Diagram]", *(t for t in texts if t)]))
        elif d.tag == f"{A}blip" and d.get(f"{R}embed"):
            out.append(image_tag(package, target(f"{R}embed")))
        elif d.tag == f"{VML}imagedata" and d.get(f"{R}id"):
            out.append(image_tag(package, target(f"{R}id")))
    return [t for t in out if t]


def word_text(package: Package) -> tuple[str, list[list[list[Cell]]]]:
    """Paragraphs, drawings and tables of a document in order, page tags at page breaks; then headers, footers, notes."""
    root, related = package.xml("word/document.xml"), package.relations("word/document.xml")
    parts, tables, page = [], [], 1
    for e in root.find(f"{W}body") if root is not None else ():
        if e.tag == f"{W}p":
            if any(b.get(f"{W}type") == "page" for b in e.iter(f"{W}br")) or e.find(f".//{W}lastRenderedPageBreak") is not None:
                if page == 1:
                    parts.insert(0, "[Page Number: 1]")
                page += 1
                parts.append(f"[Page Number: {page}]")
            style = e.find(f"{W}pPr/{W}pStyle")
            m = re.fullmatch(r"(?:Heading|heading )(\d)", style.get(f"{W}val", "")) if style is not None else None
            text = _runs(e)
            if text.strip():
                parts.append(("#" * int(m[1]) + " " if m else "") + text)
            parts += drawings(package, "word/document.xml", e, related)
        elif e.tag == f"{W}tbl":
            rows = _word_table(e)
            tables.append(rows)
            parts.append(as_html(rows))
    for name in package.names:
        if re.fullmatch(r"word/(?:header|footer|footnotes|endnotes)\d*\.xml", name):
            text = "\n".join(t for t in (_runs(p) for p in package.xml(name).iter(f"{W}p")) if t.strip())
            if text:
                parts.append(text)
    return "\n\n".join(parts), tables


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(number: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def bordered_styles(package: Package) -> set[str]:
    """The numbers of the cell styles that have a border on some side."""
    root = package.xml("xl/styles.xml")
    if root is None:
        return set()
    with_border = [any(side.get("style", "none") != "none" for side in b) for b in root.findall(f"{S}borders/{S}border")]
    at = lambda xf: int(xf.get("borderId", "0"))
    return {str(k) for k, xf in enumerate(root.findall(f"{S}cellXfs/{S}xf")) if at(xf) < len(with_border) and with_border[at(xf)]}


def sheets(package: Package) -> list[dict]:
    """The visible sheets of a workbook: name, part, cells by row and column, cells with a border, merged ranges, formulas, the used range."""
    book, related = package.xml("xl/workbook.xml"), package.relations("xl/workbook.xml")
    strings = package.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in strings.findall(f"{S}si")] if strings is not None else []
    out, styles = [], bordered_styles(package)
    for s in book.iter(f"{S}sheet") if book is not None else ():
        if s.get("state", "visible") != "visible":
            continue
        part = related.get(s.get(f"{R}id", ""), ("", ""))[1]
        root = package.xml(part)
        cells: dict[tuple[int, int], str] = {}
        bordered: set[tuple[int, int]] = set()
        formulas: dict[str, str] = {}
        for c in root.iter(f"{S}c") if root is not None else ():
            m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
            if m and c.get("s", "0") in styles:
                bordered.add((int(m[2]), column_number(m[1])))
            if (f := c.find(f"{S}f")) is not None and f.text:
                formulas[c.get("r", "")] = f.text
            value, kind = c.find(f"{S}v"), c.get("t", "n")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in c.iter(f"{S}t"))
            elif value is None or value.text is None:
                continue
            elif kind == "s":
                text = shared[int(value.text)] if int(value.text) < len(shared) else ""
            elif kind == "b":
                text = "TRUE" if value.text == "1" else "FALSE"
            else:
                text = value.text
                if kind == "n" and re.fullmatch(r"-?\d+\.0+", text):
                    text = text.split(".")[0]
            if m and text != "":
                cells[int(m[2]), column_number(m[1])] = text
        merges = [m.get("ref", "") for m in root.iter(f"{S}mergeCell")] if root is not None else []
        used = root.find(f"{S}dimension") if root is not None else None
        out.append({"name": s.get("name", ""), "part": part, "cells": cells, "bordered": bordered, "merges": merges, "formulas": formulas, "used": used.get("ref", "") if used is not None else ""})
    return out


def defined_names(package: Package) -> dict[str, str]:
    """Names of a workbook and what they stand for."""
    book = package.xml("xl/workbook.xml")
    return {d.get("name", ""): d.text or "" for d in book.iter(f"{S}definedName")} if book is not None else {}


def region_rows(cells: dict[tuple[int, int], str], merges: list[tuple[int, int, int, int]], box: list[int]) -> list[list[Cell]]:
    """The rows of a rectangle of a sheet, with the spans of merged ranges that begin in it."""
    r0, r1, c0, c1 = box[:4]
    inside = [m for m in merges if r0 <= m[0] <= r1 and c0 <= m[2] <= c1]
    spans = {(a, c): (b - a + 1, d - c + 1) for a, b, c, d in inside}
    # within the rectangle alone, however far a merged range reaches
    covered = {(r, k) for a, b, c, d in inside for r in range(a, min(b, r1) + 1) for k in range(c, min(d, c1) + 1)} - spans.keys()
    return [[Cell(cells.get((r, c), ""), *spans.get((r, c), (1, 1)), header=r == r0) for c in range(c0, c1 + 1) if (r, c) not in covered] for r in range(r0, r1 + 1)]


def workbook_text(package: Package) -> tuple[str, list[list[list[Cell]]]]:
    """Each sheet's tag and its tables as Markdown, as HTML where cells are merged; then its charts, images and text boxes.

    Tables are regions of cells that touch, those with borders first; what lies far apart takes no room.
    """
    parts, tables = [], []
    for s in sheets(package):
        parts.append(f"[Sheet: {s['name']}]")
        merges = []
        for ref in s["merges"]:
            if m := re.fullmatch(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", ref):
                merges.append((int(m[2]), int(m[4]), column_number(m[1]), column_number(m[3])))
        # a merged range is one cell however large it is: its first corner stands for it
        regions = rectangles({**dict.fromkeys(s["bordered"], True), **{k: k in s["bordered"] for k in s["cells"]}})
        for no, box in enumerate(regions, 1):
            if not any(box[0] <= r <= box[1] and box[2] <= c <= box[3] for r, c in s["cells"]):
                continue
            rows = region_rows(s["cells"], merges, box)
            tables.append(rows)
            text = as_html(rows) if any(c.rows > 1 or c.cols > 1 for row in rows for c in row) else as_markdown(rows)
            parts.append(f"[Table {no}]\n{text}" if len(regions) > 1 else text)
        for kind, target in package.relations(s["part"]).values():
            if kind == "drawing" and (root := package.xml(target)) is not None:
                parts += drawings(package, target, root, package.relations(target))
                for body in root.iter():
                    if body.tag.endswith("}txBody"):
                        text = "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in body.iter(f"{A}p")).strip()
                        if text:
                            parts.append(f"[textbox]\n{text}\n[/textbox]")
    return "\n\n".join(parts), tables


def _place(xfrm: ET.Element | None, name: str, keys: tuple[str, str]) -> tuple[float, float]:
    e = xfrm.find(f"{A}{name}") if xfrm is not None else None
    return (float(e.get(keys[0], "0")), float(e.get(keys[1], "0"))) if e is not None else (0.0, 0.0)


def _shapes(package: Package, part: str, tree: ET.Element, related: dict, to_slide: tuple[float, float, float, float], out: list, tables: list) -> None:
    """Text, tables, charts and images of the shapes below a tree with their place on the slide; groups have their own scale."""
    sx, ox, sy, oy = to_slide
    for e in tree:
        xfrm = next((x for x in (e.find(f"{P}spPr/{A}xfrm"), e.find(f"{P}grpSpPr/{A}xfrm"), e.find(f"{P}xfrm")) if x is not None), None)
        x, y = _place(xfrm, "off", ("x", "y"))
        at = (y * sy + oy, x * sx + ox)
        if e.tag == f"{P}grpSp":
            (w, h), (cx, cy), (cw, ch) = _place(xfrm, "ext", ("cx", "cy")), _place(xfrm, "chOff", ("x", "y")), _place(xfrm, "chExt", ("cx", "cy"))
            kx, ky = (w / cw if cw else 1.0), (h / ch if ch else 1.0)
            inner = (sx * kx, ox + (x - cx * kx) * sx, sy * ky, oy + (y - cy * ky) * sy)
            _shapes(package, part, e, related, inner, out, tables)
        elif e.tag == f"{P}pic":
            out += [(at, t) for t in drawings(package, part, e, related)]
        elif e.tag == f"{P}graphicFrame" and (table := e.find(f".//{A}tbl")) is not None:
            rows = [[Cell("".join(t.text or "" for t in tc.iter(f"{A}t")), int(tc.get("rowSpan", "1")), int(tc.get("gridSpan", "1")), i == 0) for tc in tr.findall(f"{A}tc") if tc.get("hMerge") != "1" and tc.get("vMerge") != "1"] for i, tr in enumerate(table.findall(f"{A}tr"))]
            # one row or one column is text, no table
            if len(rows) == 1 or all(len(r) == 1 for r in rows):
                out.append((at, "\n".join(c.text for r in rows for c in r if c.text)))
            else:
                tables.append(rows)
                out.append((at, as_html(rows)))
        elif e.tag == f"{P}graphicFrame":
            out += [(at, t) for t in drawings(package, part, e, related)]
        elif e.tag == f"{P}sp":
            text = "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in e.iter(f"{A}p")).strip()
            if text:
                out.append((at, text))


def slides_text(package: Package) -> tuple[str, list[list[list[Cell]]]]:
    """Each slide's tag, its shapes from top to bottom and left to right, tables, notes."""
    deck, related = package.xml("ppt/presentation.xml"), package.relations("ppt/presentation.xml")
    parts, tables = [], []
    ids = deck.iter(f"{P}sldId") if deck is not None else ()
    for no, s in enumerate(ids, 1):
        name = related.get(s.get(f"{R}id", ""), ("", ""))[1]
        root = package.xml(name)
        shapes: list[tuple[tuple[float, float], str]] = []
        tree = root.find(f"{P}cSld/{P}spTree") if root is not None else None
        if tree is not None:
            _shapes(package, name, tree, package.relations(name), (1.0, 0.0, 1.0, 0.0), shapes, tables)
        parts.append(f"[Slide Number: {no}]")
        parts += [t for _, t in sorted(shapes, key=lambda x: x[0])] or ["[Empty Slide]"]
        for kind, target in package.relations(name).values():
            if kind == "notesSlide" and (notes := package.xml(target)) is not None:
                text = "\n".join(x for x in ("".join(t.text or "" for t in p.iter(f"{A}t")) for p in notes.iter(f"{A}p")) if x.strip())
                if text:
                    parts.append("[Notes]\n" + text)
    return "\n\n".join(parts), tables


def set_cells(data: bytes, sheet: str, edits: dict[str, str | float | bool | None]) -> bytes:
    """A workbook with cells set: text inline, formulas dropped, styles kept; all other parts keep their bytes."""
    package = Package(data)
    book, related = package.xml("xl/workbook.xml"), package.relations("xl/workbook.xml")
    target = next((related[s.get(f"{R}id")][1] for s in book.iter(f"{S}sheet") if s.get("name") == sheet), None)
    if target is None:
        raise KeyError(f"no sheet {sheet!r}")
    ET.register_namespace("", S[1:-1])
    root = package.xml(target)
    body = root.find(f"{S}sheetData")
    for ref, value in edits.items():
        m = re.fullmatch(r"([A-Z]+)(\d+)", ref)
        if not m:
            raise ValueError(f"no cell {ref!r}")
        row = next((r for r in body if r.get("r") == m[2]), None)
        if row is None:
            row = ET.Element(f"{S}row", {"r": m[2]})
            body.insert(sum(int(r.get("r", "0")) < int(m[2]) for r in body), row)
        cell = next((c for c in row if c.get("r") == ref), None)
        if cell is None:
            cell = ET.Element(f"{S}c", {"r": ref})
            row.insert(sum(column_number(re.sub(r"\d", "", c.get("r", "A"))) < column_number(m[1]) for c in row), cell)
        for e in list(cell):
            cell.remove(e)
        cell.attrib.pop("t", None)
        if isinstance(value, bool):
            cell.set("t", "b")
            ET.SubElement(cell, f"{S}v").text = "1" if value else "0"
        elif isinstance(value, (int, float)):
            ET.SubElement(cell, f"{S}v").text = repr(value)
        elif value is not None:
            cell.set("t", "inlineStr")
            ET.SubElement(ET.SubElement(cell, f"{S}is"), f"{S}t").text = value
    _grow(root)
    package.put(target, ET.tostring(root, xml_declaration=True, encoding="UTF-8"))
    _recalculated(package)
    return package.save()


def new_workbook(sheet: str, rows: list[list]) -> bytes:
    """A workbook of one sheet with the rows given."""
    ns, pack = S[1:-1], "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = "".join(f'<Override PartName="/xl/{n}" ContentType="{office}.{t}+xml"/>' for n, t in (("workbook.xml", "sheet.main"), ("worksheets/sheet1.xml", "worksheet")))
    body = "".join(f'<row r="{r}">' + "".join(_cell_xml(f"{column_letters(c)}{r}", v) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{R[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{ns}" xmlns:r="{R[1:-1]}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{R[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'{head}<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _cell_xml(ref: str, value) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'


def append_rows(data: bytes, sheet: str, rows: list[list]) -> bytes:
    """A workbook with rows added below the last one of a sheet; the used range grows with them."""
    found = next((s for s in sheets(Package(data)) if s["name"] == sheet), None)
    if found is None:
        raise KeyError(f"no sheet {sheet!r}")
    package = Package(data)
    root = package.xml(found["part"])
    last = max((int(r.get("r", "0")) for r in root.iter(f"{S}row")), default=0)
    edits = {f"{column_letters(c)}{last + r}": v for r, row in enumerate(rows, 1) for c, v in enumerate(row, 1) if v is not None}
    return set_cells(data, sheet, edits)


def _grow(root: ET.Element) -> None:
    """The used range of a sheet as its cells have it."""
    used = root.find(f"{S}dimension")
    at = [(int(m[2]), column_number(m[1])) for c in root.iter(f"{S}c") if (m := re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", "")))]
    if used is not None and at:
        r, c = [x for x, _ in at], [x for _, x in at]
        used.set("ref", f"{column_letters(min(c))}{min(r)}:{column_letters(max(c))}{max(r)}")


def _recalculated(package: Package) -> None:
    """Let a workbook with formulas be calculated anew when it is opened, as values that they used may have changed."""
    if not any(re.search(rb"<(?:\w+:)?f[\s>]", package.part(n) or b"") for n in package.names if n.startswith("xl/worksheets/")):
        return
    book = package.xml("xl/workbook.xml")
    calc = book.find(f"{S}calcPr")
    if calc is None:
        after = ("calcPr", "oleSize", "customWorkbookViews", "pivotCaches", "smartTagPr", "smartTagTypes", "webPublishing", "fileRecoveryPr", "webPublishObjects", "extLst")
        place = next((k for k, e in enumerate(book) if e.tag.rsplit("}", 1)[-1] in after), len(book))
        calc = ET.Element(f"{S}calcPr")
        book.insert(place, calc)
    calc.set("fullCalcOnLoad", "1")
    ET.register_namespace("", S[1:-1])
    ET.register_namespace("r", R[1:-1])
    package.put("xl/workbook.xml", ET.tostring(book, xml_declaration=True, encoding="UTF-8"))


_TEXTS = r"word/(?:document|header\d*|footer\d*|footnotes|endnotes)\.xml|ppt/(?:slides/slide|notesSlides/notesSlide)\d+\.xml"


def _register_prefixes(data: bytes) -> None:
    """The prefixes that a part declares stay what they are when it is written."""
    for prefix, uri in re.findall(rb'xmlns:([A-Za-z0-9]+)="([^"]+)"', data[:4096]):
        if not re.fullmatch(rb"ns\d+", prefix):
            ET.register_namespace(prefix.decode(), uri.decode())


def _put_xml(package: Package, name: str, root: ET.Element) -> None:
    _register_prefixes(package.part(name) or b"")
    package.put(name, ET.tostring(root, xml_declaration=True, encoding="UTF-8"))


def replaced_in_runs(texts: list[str], old: str, new: str) -> list[str]:
    """The texts of the runs of a paragraph with a text replaced wherever it stands, also over several runs: the run it begins in holds the new one."""
    whole, out = "".join(texts), [""] * len(texts)
    ends, at = [], 0
    for t in texts:
        at += len(t)
        ends.append(at)
    k, i = 0, 0
    while i < len(whole):
        while i >= ends[k]:
            k += 1
        if old and whole.startswith(old, i):
            out[k] += new
            i += len(old)
        else:
            out[k] += whole[i]
            i += 1
    return out


def replace_text(data: bytes, old: str, new: str) -> bytes:
    """A document or presentation with a text replaced wherever a paragraph holds it, over however many runs; deleted text stays."""
    package = Package(data)
    for name in package.names:
        if not re.fullmatch(_TEXTS, name):
            continue
        root, hit = package.xml(name), False
        for p in [e for e in root.iter() if e.tag in (f"{W}p", f"{A}p")]:
            nested = {t for q in p.iter() if q is not p and q.tag in (f"{W}p", f"{A}p") for t in q.iter()}
            runs = [e for e in p.iter() if e.tag in (f"{W}t", f"{A}t") and e not in nested]
            texts = [e.text or "" for e in runs]
            if old and old in "".join(texts):
                for e, text in zip(runs, replaced_in_runs(texts, old, new)):
                    e.text, hit = text, True
                    if text != text.strip():
                        e.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        if hit:
            _put_xml(package, name, root)
    return package.save()


# documents


def _body(package: Package) -> tuple[ET.Element, ET.Element]:
    root = package.xml("word/document.xml")
    body = root.find(f"{W}body") if root is not None else None
    if body is None:
        raise ValueError("the document has no body")
    return root, body


def paragraphs(data: bytes) -> list[str]:
    """The texts of the paragraphs of a document's body, in order."""
    return [_runs(p) for p in _body(Package(data))[1].findall(f"{W}p")]


def _set_paragraph(p: ET.Element, text: str) -> None:
    """The text of a paragraph in its first run of text; other text goes, drawings stay."""
    runs = [r for r in p.iter(f"{W}r") if r.find(f"{W}t") is not None]
    run = runs[0] if runs else ET.SubElement(p, f"{W}r")
    for r in runs:
        for t in [e for e in r if e.tag in (f"{W}t", f"{W}tab", f"{W}br")]:
            r.remove(t)
    t = ET.SubElement(run, f"{W}t")
    t.text = text
    t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")


def edit_paragraphs(data: bytes, edits: list[tuple[str, int, str | None]]) -> bytes:
    """A document with paragraphs of its body changed, one edit after the other: ``set``, ``insert`` before, or ``delete`` the one of a number.

    An inserted paragraph looks like the one it stands before; the number of paragraphs inserts at the end.
    """
    package = Package(data)
    root, body = _body(package)
    for what, number, text in edits:
        all_of = body.findall(f"{W}p")
        if not 0 <= number < len(all_of) + (what == "insert"):
            raise IndexError(f"no paragraph {number}")
        if what == "delete":
            body.remove(all_of[number])
            continue
        if what == "insert":
            p = ET.Element(f"{W}p")
            like = all_of[min(number, len(all_of) - 1)] if all_of else None
            if like is not None and like.find(f"{W}pPr") is not None:
                p.append(copy.deepcopy(like.find(f"{W}pPr")))
            tail = body.find(f"{W}sectPr")
            body.insert(list(body).index(all_of[number]) if number < len(all_of) else list(body).index(tail) if tail is not None else len(body), p)
        elif what == "set":
            p = all_of[number]
        else:
            raise ValueError(f"no edit {what!r}")
        _set_paragraph(p, text or "")
    _put_xml(package, "word/document.xml", root)
    return package.save()


def table_grid(table: ET.Element) -> list[list[ET.Element]]:
    """The cells of a table by place: a cell that spans places stands in each, one that goes on from above is the cell above."""
    grid: list[list[ET.Element]] = []
    for tr in table.findall(f"{W}tr"):
        row: list[ET.Element] = []
        before = tr.find(f"{W}trPr/{W}gridBefore")
        skip = int(before.get(f"{W}val", "0")) if before is not None else 0
        for tc in tr.findall(f"{W}tc"):
            span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
            at = skip + len(row)
            goes_on = merge is not None and merge.get(f"{W}val", "continue") == "continue"
            owner = grid[-1][at] if goes_on and grid and at < len(grid[-1]) else tc
            row += [owner] * (int(span.get(f"{W}val", "1")) if span is not None else 1)
        grid.append([row[0]] * skip + row if row else [])
    return grid


def edit_table(data: bytes, number: int, cells: dict[tuple[int, int], str] | None = None, insert: int | None = None, delete: int | None = None) -> bytes:
    """A document with a table of its body changed: a row deleted, an empty one inserted that looks like the one above, cells set."""
    package = Package(data)
    root, body = _body(package)
    table = body.findall(f"{W}tbl")[number]
    rows = table.findall(f"{W}tr")
    if delete is not None:
        table.remove(rows[delete])
        rows = table.findall(f"{W}tr")
    if insert is not None:
        new = copy.deepcopy(rows[max(0, insert - 1)])
        for tc in new.iter(f"{W}tc"):
            for p in tc.findall(f"{W}p"):
                _set_paragraph(p, "")
            merge = tc.find(f"{W}tcPr/{W}vMerge")
            if merge is not None:
                tc.find(f"{W}tcPr").remove(merge)
        table.insert(list(table).index(rows[insert]) if insert < len(rows) else len(table), new)
    grid = table_grid(table)
    for (r, c), text in (cells or {}).items():
        first, *others = grid[r][c].findall(f"{W}p")
        _set_paragraph(first, text)
        for p in others:
            _set_paragraph(p, "")
    _put_xml(package, "word/document.xml", root)
    return package.save()


# presentations


def slide_parts(package: Package) -> list[str]:
    """The parts of the slides, in order."""
    deck, related = package.xml("ppt/presentation.xml"), package.relations("ppt/presentation.xml")
    return [related.get(s.get(f"{R}id", ""), ("", ""))[1] for s in (deck.iter(f"{P}sldId") if deck is not None else ())]


def shape_texts(data: bytes, slide: int) -> dict[str, str]:
    """The texts of the shapes of a slide, counted from 0, by the shape's name."""
    package = Package(data)
    root = package.xml(slide_parts(package)[slide])
    out = {}
    for sp in root.iter(f"{P}sp"):
        name = sp.find(f"{P}nvSpPr/{P}cNvPr")
        out[name.get("name", "") if name is not None else ""] = "\n".join("".join(t.text or "" for t in p.iter(f"{A}t")) for p in sp.iter(f"{A}p"))
    return out


def set_shape_text(data: bytes, slide: int, shape: str, text: str) -> bytes:
    """A presentation in which a shape has another text, a paragraph for each line, in the style of its first."""
    package = Package(data)
    part = slide_parts(package)[slide]
    root = package.xml(part)
    sp = next((s for s in root.iter(f"{P}sp") if (n := s.find(f"{P}nvSpPr/{P}cNvPr")) is not None and n.get("name") == shape), None)
    body = sp.find(f"{P}txBody") if sp is not None else None
    if body is None:
        raise KeyError(f"no shape with text {shape!r}")
    old = body.findall(f"{A}p")
    style, run = (old[0].find(f"{A}pPr"), old[0].find(f"{A}r/{A}rPr")) if old else (None, None)
    for p in old:
        body.remove(p)
    for line in text.split("\n"):
        p = ET.SubElement(body, f"{A}p")
        if style is not None:
            p.append(copy.deepcopy(style))
        r = ET.SubElement(p, f"{A}r")
        if run is not None:
            r.append(copy.deepcopy(run))
        ET.SubElement(r, f"{A}t").text = line
    _put_xml(package, part, root)
    return package.save()


def remove_slide(data: bytes, slide: int) -> bytes:
    """A presentation without a slide, its notes, and what no other part refers to."""
    package = Package(data)
    deck_part = "ppt/presentation.xml"
    part, deck = slide_parts(package)[slide], package.xml(deck_part)
    ids = next(deck.iter(f"{P}sldIdLst"))
    entry = [s for s in ids if s.tag == f"{P}sldId"][slide]
    ids.remove(entry)
    _put_xml(package, deck_part, deck)
    rels = "ppt/_rels/presentation.xml.rels"
    root = package.xml(rels)
    for r in [r for r in root if r.get("Id") == entry.get(f"{R}id")]:
        root.remove(r)
    package.put(rels, ET.tostring(root, xml_declaration=True, encoding="UTF-8"))
    # what the slide alone leads to goes with it
    reached, todo = {deck_part}, ["", deck_part]
    while todo:
        for _, target in package.relations(todo.pop()).values():
            if target in package.names and target not in reached:
                reached.add(target)
                todo.append(target)
    of_slide, todo = set(), [part]
    while todo:
        name = todo.pop()
        if name in of_slide or name in reached or name not in package.names:
            continue
        of_slide.add(name)
        todo += [t for _, t in package.relations(name).values()]
    for name in of_slide:
        package.remove(name)
        folder, base = posixpath.split(name)
        package.remove(posixpath.join(folder, "_rels", f"{base}.rels"))
    types = package.xml("[Content_Types].xml")
    if types is not None:
        for e in [e for e in types if e.get("PartName", "").lstrip("/") in of_slide]:
            types.remove(e)
        ET.register_namespace("", "http://schemas.openxmlformats.org/package/2006/content-types")
        package.put("[Content_Types].xml", ET.tostring(types, xml_declaration=True, encoding="UTF-8"))
    return package.save()
