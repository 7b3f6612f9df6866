"""Charts of packages: read from their XML, written as text blocks, changed in place."""

from __future__ import annotations

import copy
import posixpath
import re
from dataclasses import dataclass, field
from xml.etree import ElementTree as ET

from docloom.functions.render import CHARTS as KINDS
from docloom.functions.render import NO_CHART as NOTHING
from docloom.sources import ooxml

C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
CX = "{http://schemas.microsoft.com/office/drawing/2014/chartex}"
A = ooxml.A
#: Kinds whose points have an x instead of a category.
POINTS = ("scatterChart", "bubbleChart")


@dataclass
class Chart:
    kind: str = ""
    title: str = ""
    categories: list[str] = field(default_factory=list)
    series: list[tuple[str | None, list[float | str | None]]] = field(default_factory=list)
    raw: str = ""


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _cache(holder: ET.Element | None) -> ET.Element | None:
    """Where the points of a reference or a literal are."""
    if holder is None:
        return None
    for path in ("strRef/strCache", "numRef/numCache", "strLit", "numLit", "multiLvlStrRef/multiLvlStrCache/lvl"):
        found = holder.find("/".join(C + p for p in path.split("/")))
        if found is not None:
            return found
    return None


def _points(holder: ET.Element | None) -> tuple[dict[int, str], int]:
    """Points by number and how many there should be."""
    cache = _cache(holder)
    if cache is None:
        return {}, 0
    number = lambda e, k: int(e.get(k, "")) if e is not None and e.get(k, "").isdigit() else None
    found: dict[int, str] = {}
    for pt in cache.findall(f"{C}pt"):
        v, at = pt.find(f"{C}v"), number(pt, "idx")
        if v is not None:
            found[len(found) if at is None else at] = v.text or ""
    count = number(cache.find(f"{C}ptCount"), "val")
    return found, count if count is not None else max(found, default=-1) + 1


def _float(text: str | None) -> float | str | None:
    try:
        return float(text) if text else None
    except ValueError:
        return text


def _title(root: ET.Element) -> str:
    chart = root.find(f"{C}chart")
    gone = chart.find(f"{C}autoTitleDeleted") if chart is not None else None
    title = chart.find(f"{C}title") if chart is not None else root.find(f".//{CX}title")
    if title is None or (gone is not None and gone.get("val", "1") in ("1", "true")):
        return ""
    runs = [t.text for t in title.iter(f"{A}t") if t.text]
    return " ".join(runs).strip() or next((v.text.strip() for v in title.iter(f"{C}v") if v.text), "")


def plots(root: ET.Element) -> list[ET.Element]:
    """The plots of a chart, each of one kind."""
    area = root.find(f"{C}chart/{C}plotArea")
    return [] if area is None else [e for e in area if _local(e).endswith("Chart")]


def read(data: bytes) -> Chart:
    """Kind, title, categories and series of a chart; of one of several plots the first plot's kind and all series."""
    root = ET.fromstring(data.removeprefix(b"\xef\xbb\xbf"))
    if root.tag == f"{CX}chartSpace":
        return _extended(root)
    out = Chart(title=_title(root))
    for plot in plots(root):
        kind = _local(plot)
        out.kind = out.kind or kind
        for ser in plot.findall(f"{C}ser"):
            name, _ = _points(ser.find(f"{C}tx"))
            lone = ser.find(f"{C}tx/{C}v")
            labels, _ = _points(ser.find(f"{C}xVal" if kind in POINTS else f"{C}cat"))
            values, n = _points(ser.find(f"{C}yVal" if kind in POINTS else f"{C}val"))
            out.categories = out.categories or [labels[k] for k in sorted(labels)]
            out.series.append((name.get(0) or (lone.text if lone is not None else None), [_float(values.get(k)) for k in range(n)]))
    return out


def _extended(root: ET.Element) -> Chart:
    """A chart of the newer kind: its data lie apart from its series."""
    data = {d.get("id"): d for d in root.iter(f"{CX}data")}
    levels = lambda d, kind: [pt.text or "" for dim in d.findall(f"{CX}{kind}") for lvl in dim.findall(f"{CX}lvl")[:1] for pt in lvl.findall(f"{CX}pt")]
    out = Chart(title=_title(root))
    for s in root.iter(f"{CX}series"):
        out.kind = out.kind or s.get("layoutId", "unknown")
        name, of = s.find(f"{CX}tx/{CX}txData/{CX}v"), s.find(f"{CX}dataId")
        d = data.get(of.get("val")) if of is not None else None
        if d is not None:
            out.categories = out.categories or levels(d, "strDim")
            out.series.append((name.text if name is not None else None, [_float(v) for v in levels(d, "numDim")]))
    return out


def _shown(value: float | str | None) -> str:
    return "" if value is None else str(value)


def block(chart: Chart, as_html: bool = True) -> str:
    """A chart as a tagged block of kind, title and data; an empty string for one that has nothing."""
    parts = [f"Chart Type: {KINDS.get(chart.kind, chart.kind)}"] if chart.kind else []
    parts += [f"Title: {chart.title}"] if chart.title else []
    rows = len(chart.categories) or max((len(v) for _, v in chart.series), default=0)
    at = lambda values, k: values[k] if k < len(values) else None
    if chart.series and as_html:
        head = "".join(f"<th>{n}</th>" for n in ("Category", *(name or "Series" for name, _ in chart.series)))
        body = ["".join(f"<td>{_shown(c)}</td>" for c in (at(chart.categories, k), *(at(v, k) for _, v in chart.series))) for k in range(rows)]
        parts.append("\n".join(["<table>", f"<tr>{head}</tr>", *(f"<tr>{b}</tr>" for b in body), "</table>"]))
    elif chart.series:
        parts.append("\n".join(f"{c}: {', '.join(_shown(at(v, k)) for _, v in chart.series)}" for k, c in enumerate(chart.categories)))
    elif not chart.categories and chart.raw:
        parts.append(chart.raw)
    return "\n".join(["[chart]", *parts, "[/chart]"]) if parts else ""


def fallback(kind: str | None = None, title: str | None = None, message: str | None = None) -> str:
    """The block of a chart that couldn't be read."""
    parts = [f"Chart Type: {KINDS.get(kind, kind)}"] if kind else []
    parts += [f"Title: {title}"] if title else []
    parts += [message] if message else [] if parts else [NOTHING]
    return "\n".join(["[chart]", *parts, "[/chart]"])


def from_dict(d: dict, as_html: bool = True) -> str:
    """The block of a chart given as a dictionary of kind (or chart_type), title, categories and series; the fallback for what is none."""
    try:
        series = [(s.get("name"), list(s.get("values") or [])) if isinstance(s, dict) else (s[0], list(s[1])) for s in d.get("series") or []]
        made = Chart(d.get("kind") or d.get("chart_type") or "", d.get("title") or "", [str(c) for c in d.get("categories") or []], series, d.get("raw") or "")
    except (AttributeError, TypeError, IndexError, KeyError):
        return fallback()
    return block(made, as_html) or fallback()


def of_part(package: ooxml.Package, name: str) -> str:
    """The block of a chart's part; the fallback where it can't be read."""
    data = package.part(name)
    try:
        return block(read(data)) if data else fallback()
    except (ET.ParseError, ValueError):
        return fallback()


# writing


def _commit(package: ooxml.Package, part: str, root: ET.Element) -> None:
    ET.register_namespace("c", C[1:-1])
    ET.register_namespace("a", A[1:-1])
    ET.register_namespace("r", ooxml.R[1:-1])
    package.put(part, ET.tostring(root, xml_declaration=True, encoding="UTF-8"))


def set_title(data: bytes, part: str, title: str) -> bytes:
    """A package in which a chart has another title, in the style of the one it had."""
    package = ooxml.Package(data)
    root = package.xml(part)
    chart = root.find(f"{C}chart") if root is not None else None
    if chart is None:
        raise KeyError(f"no chart {part!r}")
    gone = chart.find(f"{C}autoTitleDeleted")
    if gone is not None:
        gone.set("val", "0")
    old = chart.find(f"{C}title")
    if old is None:
        old = ET.Element(f"{C}title")
        chart.insert(0, old)
    tx = old.find(f"{C}tx")
    if tx is None:
        tx = ET.Element(f"{C}tx")
        old.insert(0, tx)
    rich = tx.find(f"{C}rich")
    if rich is None:
        for e in list(tx):
            tx.remove(e)
        rich = ET.SubElement(tx, f"{C}rich")
        ET.SubElement(rich, f"{A}bodyPr")
        ET.SubElement(rich, f"{A}p")
    first, *others = rich.findall(f"{A}p")
    for p in others:
        rich.remove(p)
    runs = [e for e in first if e.tag in (f"{A}r", f"{A}fld", f"{A}br")]
    run = next((e for e in runs if e.tag == f"{A}r"), None)
    for e in runs:
        if e is not run:
            first.remove(e)
    if run is None:
        run = ET.Element(f"{A}r")
        first.insert(sum(e.tag == f"{A}pPr" for e in first), run)
    text = run.find(f"{A}t")
    (ET.SubElement(run, f"{A}t") if text is None else text).text = title
    _commit(package, part, root)
    return package.save()


def set_data(data: bytes, part: str, categories: list[str], series: list[tuple[str | None, list[float | None]]]) -> bytes:
    """A package in which a chart has other categories and series, in its cache and in the workbook that lies behind it.

    Series beyond those there were look like the last of them; fewer leave the first. Every series has as many values as
    there are categories. Charts of the newer kind can't be changed.
    """
    package = ooxml.Package(data)
    root = package.xml(part)
    if root is None or root.tag == f"{CX}chartSpace":
        raise ValueError(f"no chart that can be changed: {part!r}")
    if not series or any(len(v) != len(categories) for _, v in series):
        raise ValueError("every series needs a value for each category")
    held = [(plot, ser) for plot in plots(root) for ser in plot.findall(f"{C}ser")]
    if not held:
        raise ValueError("the chart has no series to start from")
    for plot, ser in held[len(series) :]:
        plot.remove(ser)
    plot, last = held[min(len(held), len(series)) - 1]
    numbers = [int(e.get("val", "0")) for _, s in held for e in s if _local(e) in ("idx", "order") and e.get("val", "").isdigit()]
    held = held[: len(series)]
    while len(held) < len(series):
        more = copy.deepcopy(last)
        for e in more:
            if _local(e) in ("idx", "order"):
                e.set("val", str(max(numbers, default=-1) + 1))
        numbers.append(max(numbers, default=-1) + 1)
        plot.insert(list(plot).index(held[-1][1]) + 1, more)
        held.append((plot, more))
    f = next((e.text for e in root.iter(f"{C}f") if e.text and "!" in e.text), "Sheet1!")
    sheet, n = f.split("!")[0], len(categories)
    for k, ((plot, ser), (name, values)) in enumerate(zip(held, series)):
        col = ooxml.column_letters(k + 2)
        x, y = ("xVal", "yVal") if _local(plot) in POINTS else ("cat", "val")
        _refer(ser, "tx", f"{sheet}!${col}$1", [name or ""], False)
        _refer(ser, x, f"{sheet}!$A$2:$A${n + 1}", categories, False)
        _refer(ser, y, f"{sheet}!${col}$2:${col}${n + 1}", values, True)
    for kind, target in package.relations(part).values():
        if kind == "package" and target.endswith(".xlsx"):
            package.put(target, ooxml.new_workbook(sheet.strip("'").replace("''", "'"), [["", *(name or "" for name, _ in series)], *([c, *(v[i] for _, v in series)] for i, c in enumerate(categories))]))
    _commit(package, part, root)
    return package.save()


#: The order of the parts of a series.
_ORDER = ("idx", "order", "tx", "spPr", "invertIfNegative", "marker", "pictureOptions", "explosion", "dPt", "dLbls", "trendline", "errBars", "cat", "xVal", "val", "yVal", "smooth", "bubbleSize", "shape", "extLst")


def _refer(ser: ET.Element, name: str, ref: str, values: list, numbers: bool) -> None:
    holder = ser.find(C + name)
    if holder is None:
        holder = ET.Element(C + name)
        ser.insert(sum(_ORDER.index(_local(e)) < _ORDER.index(name) for e in ser if _local(e) in _ORDER), holder)
    code = next((e.text for e in holder.iter(f"{C}formatCode")), None)
    for e in list(holder):
        holder.remove(e)
    of = ET.SubElement(holder, C + ("numRef" if numbers else "strRef"))
    ET.SubElement(of, f"{C}f").text = ref
    cache = ET.SubElement(of, C + ("numCache" if numbers else "strCache"))
    if numbers:
        ET.SubElement(cache, f"{C}formatCode").text = code or "General"
    ET.SubElement(cache, f"{C}ptCount", {"val": str(len(values))})
    for k, v in enumerate(values):
        if v is not None:
            ET.SubElement(ET.SubElement(cache, f"{C}pt", {"idx": str(k)}), f"{C}v").text = repr(v) if numbers else str(v)


def parts(package: ooxml.Package) -> list[str]:
    """The parts of a package that are charts, by their number."""
    found = [n for n in package.names if re.fullmatch(r"(?:word|ppt|xl)/charts/chart(?:Ex)?\d+\.xml", n)]
    return sorted(found, key=lambda n: (posixpath.dirname(n), int(re.sub(r"\D", "", posixpath.basename(n)) or 0), n))
