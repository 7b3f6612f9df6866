"""Tables, charts and metadata as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import cell_text, escaped

#: Labels of the metadata fields, in order.
LABELS = {
    "ko": {
        "title": "제목", "subject": "주제", "author": "작성자", "keywords": "키워드", "comments": "설명", "last_saved_by": "최종 수정자", "create_time": "작성일", "last_saved_time": "최종 수정일",
        "page_count": "페이지 수", "word_count": "단어 수", "category": "범주", "revision": "버전",
    },
    "en": {
        "title": "Title", "subject": "Subject", "author": "Author", "keywords": "Keywords", "comments": "Comments", "last_saved_by": "Last Saved By", "create_time": "Created", "last_saved_time": "Last Modified",
        "page_count": "Page Count", "word_count": "Word Count", "category": "Category", "revision": "Revision",
    },
}


def metadata_block(language: str = "ko", indent: str = "  ", prefix: str = "[Document-Metadata]", suffix: str = "[/Document-Metadata]") -> Column:
    """The metadata columns of a row as a tagged block, blank ones left out; an empty string where all are null."""
    fields = list(LABELS[language])
    value = lambda f: F.trim(F.col(f).cast("string"))
    lines = F.filter(F.array(*(F.when(value(f) != "", F.concat(F.lit(f"{indent}{LABELS[language][f]}: "), value(f))) for f in fields)), lambda x: x.isNotNull())
    block = F.array_join(F.concat(F.array(F.lit(prefix)), lines, F.array(F.lit(suffix))), "\n")
    return F.when(F.coalesce(*(F.col(f).cast("string") for f in fields)).isNull(), F.lit("")).otherwise(block)


def html_table(rows: Column) -> Column:
    """Rows of cells as simple HTML; the first row is the header. Nothing for no rows."""
    cell = lambda name: lambda c: F.concat(F.lit(f"    <{name}>"), escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{name}>"))
    row = lambda r, i: F.concat(F.lit("  <tr>\n"), F.array_join(F.when(i == 0, F.transform(r, cell("th"))).otherwise(F.transform(r, cell("td"))), "\n"), F.lit("\n  </tr>"))
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table border='1'>\n"), F.array_join(F.transform(rows, row), "\n"), F.lit("\n</table>"))).otherwise(F.lit(""))


def markdown_table(rows: Column) -> Column:
    """Rows of cells as Markdown, padded to the widest row, bars escaped, a separator after the first row."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cells = lambda r: F.transform(r, lambda c: F.replace(cell_text(c), F.lit("|"), F.lit("\\|")))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(cells(r), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.transform(rows, lambda r, i: F.when(i == 0, F.concat(line(r), F.lit("\n"), rule)).otherwise(line(r))), "\n")).otherwise(F.lit(""))


def text_table(rows: Column) -> Column:
    """Rows of cells joined by tabs."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, cell_text), "\t")), "\n")


#: Names of kinds of charts.
CHARTS = {
    "barChart": "Bar Chart", "bar3DChart": "3D Bar Chart", "lineChart": "Line Chart", "line3DChart": "3D Line Chart", "pieChart": "Pie Chart", "pie3DChart": "3D Pie Chart", "doughnutChart": "Doughnut Chart",
    "areaChart": "Area Chart", "area3DChart": "3D Area Chart", "scatterChart": "Scatter Chart", "radarChart": "Radar Chart", "surfaceChart": "Surface Chart", "surface3DChart": "3D Surface Chart", "bubbleChart": "Bubble Chart", "stockChart": "Stock Chart",
}
NO_CHART = "(Chart data could not be extracted)"


def chart_name(kind: Column) -> Column:
    """The name of a kind of chart; an unknown kind is its own."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in CHARTS.items() for x in pair))[kind], kind)


def _chart(*parts: Column) -> Column:
    kept = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.concat(F.lit("[chart]\n"), F.array_join(kept, "\n"), F.lit("\n[/chart]"))).otherwise(F.lit(""))


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))


def chart_block(kind: Column, title: Column, categories: Column, names: Column, series: Column, as_html: bool = True, raw: Column | None = None) -> Column:
    """A chart as a tagged block of kind, title and its data, as an HTML table or as lines; an empty string for one that has nothing.

    ``names`` and ``series`` (arrays of text) run side by side; a series that is too short leaves blanks. Where there are
    neither categories nor series, ``raw`` stands for them.
    """
    cell = lambda name: lambda c: F.concat(F.lit(f"<{name}>"), F.coalesce(c, F.lit("")), F.lit(f"</{name}>"))
    row = lambda c: F.concat(F.lit("<tr>"), F.array_join(c, ""), F.lit("</tr>"))
    values = lambda i: F.transform(series, lambda s: F.coalesce(F.get(s, i), F.lit("")))
    none = F.array().cast("array<string>")
    labels, count = F.coalesce(categories, none), F.coalesce(F.array_max(F.transform(series, lambda s: F.size(s))), F.lit(0))
    lines = F.when(F.size(labels) > 0, labels).otherwise(F.array_repeat(F.lit(""), count))
    head = row(F.transform(F.concat(F.array(F.lit("Category")), F.transform(names, lambda n: F.when(F.coalesce(n, F.lit("")) == "", "Series").otherwise(n))), cell("th")))
    body = F.transform(lines, lambda c, i: row(F.transform(F.concat(F.array(c), values(i)), cell("td"))))
    html = F.array_join(F.concat(F.array(F.lit("<table>"), head), body, F.array(F.lit("</table>"))), "\n")
    plain = F.array_join(F.transform(labels, lambda c, i: F.concat(c, F.lit(": "), F.array_join(values(i), ", "))), "\n")
    has = F.size(F.coalesce(series, F.array().cast("array<array<string>>"))) > 0
    data = F.when(has, F.when(F.lit(as_html), html).otherwise(F.when(plain != "", plain)))
    if raw is not None:
        data = F.when(~has & (F.size(labels) == 0) & (F.coalesce(raw, F.lit("")) != ""), raw).otherwise(data)
    return _chart(_labelled("Chart Type", chart_name(kind)), _labelled("Title", title), data)


def chart_fallback(kind: Column, title: Column, message: Column) -> Column:
    """The block of a chart that couldn't be read."""
    named, titled = _labelled("Chart Type", chart_name(kind)), _labelled("Title", title)
    said = F.when(F.coalesce(message, F.lit("")) != "", message).when(named.isNull() & titled.isNull(), F.lit(NO_CHART))
    return _chart(named, titled, said)
