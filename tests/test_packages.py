"""Charts, sheets, documents and presentations read and changed in their packages."""

import io
import zipfile

import pytest

from docloom import engine
from docloom.sources import charts, ooxml

W, S, P, A, R = (x[1:-1] for x in (ooxml.W, ooxml.S, ooxml.P, ooxml.A, ooxml.R))
PACK = "http://schemas.openxmlformats.org/package/2006"
C = charts.C[1:-1]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def rels(*pairs):
    return f'<Relationships xmlns="{PACK}/relationships">' + "".join(f'<Relationship Id="{i}" Type="x/{t}" Target="{to}"/>' for i, t, to in pairs) + "</Relationships>"


def points(values, kind, ref):
    tag = "num" if kind == "num" else "str"
    return f"<c:{tag}Ref><c:f>{ref}</c:f><c:{tag}Cache><c:ptCount val='{len(values)}'/>" + "".join(f"<c:pt idx='{k}'><c:v>{v}</c:v></c:pt>" for k, v in enumerate(values) if v is not None) + f"</c:{tag}Cache></c:{tag}Ref>"


CHART = (
    f"<c:chartSpace xmlns:c='{C}' xmlns:a='{A}'><c:chart><c:title><c:tx><c:rich><a:p><a:r><a:t>Sales</a:t></a:r><a:r><a:t>2024</a:t></a:r></a:p></c:rich></c:tx></c:title><c:plotArea><c:barChart>"
    f"<c:ser><c:idx val='0'/><c:order val='0'/><c:tx>{points(['North'], 'str', 'Sheet1!$B$1')}</c:tx><c:cat>{points(['Q1', 'Q2'], 'str', 'Sheet1!$A$2:$A$3')}</c:cat><c:val>{points([1.5, None], 'num', 'Sheet1!$B$2:$B$3')}</c:val></c:ser>"
    "</c:barChart></c:plotArea></c:chart></c:chartSpace>"
)
BLOCK = "[chart]\nChart Type: Bar Chart\nTitle: Sales 2024\n<table>\n<tr><th>Category</th><th>North</th></tr>\n<tr><td>Q1</td><td>1.5</td></tr>\n<tr><td>Q2</td><td></td></tr>\n</table>\n[/chart]"


def test_charts_as_text():
    chart = charts.read(CHART.encode())
    assert (chart.kind, chart.title, chart.categories, chart.series) == ("barChart", "Sales 2024", ["Q1", "Q2"], [("North", [1.5, None])])
    assert charts.block(chart) == BLOCK and charts.block(chart, as_html=False) == "[chart]\nChart Type: Bar Chart\nTitle: Sales 2024\nQ1: 1.5\nQ2: \n[/chart]"
    assert charts.block(charts.Chart()) == "" and charts.block(charts.Chart(raw="x")) == "[chart]\nx\n[/chart]"
    assert charts.fallback() == f"[chart]\n{charts.NOTHING}\n[/chart]" and charts.fallback("pieChart", "T", "m") == "[chart]\nChart Type: Pie Chart\nTitle: T\nm\n[/chart]"
    assert charts.from_dict({"chart_type": "barChart", "title": "Sales 2024", "categories": ["Q1", "Q2"], "series": [{"name": "North", "values": [1.5, None]}]}) == BLOCK and charts.from_dict({"series": 5}) == charts.fallback()
    more = f"<cx:chartSpace xmlns:cx='{charts.CX[1:-1]}'><cx:chartData><cx:data id='0'><cx:strDim><cx:lvl><cx:pt>a</cx:pt></cx:lvl></cx:strDim><cx:numDim><cx:lvl><cx:pt>2</cx:pt></cx:lvl></cx:numDim></cx:data></cx:chartData><cx:chart><cx:plotArea><cx:plotAreaRegion><cx:series layoutId='waterfall'><cx:dataId val='0'/></cx:series></cx:plotAreaRegion></cx:plotArea></cx:chart></cx:chartSpace>"
    assert charts.read(more.encode()) == charts.Chart("waterfall", "", ["a"], [(None, [2.0])])


def deck():
    shape = lambda name, y, text: f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="0" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p><a:pPr lvl="1"/><a:r><a:rPr b="1"/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="100"/><a:ext cx="10" cy="10"/><a:chOff x="0" y="1000"/><a:chExt cx="10" cy="100"/></a:xfrm></p:grpSpPr>{shape("In", 1050, "middle")}</p:grpSp>'
    frame = f'<p:graphicFrame><p:xfrm><a:off x="0" y="500"/></p:xfrm><a:graphic><a:graphicData><c:chart xmlns:c="{C}" r:id="r9"/></a:graphicData></a:graphic></p:graphicFrame>'
    slide = lambda body: f'<p:sld xmlns:p="{P}" xmlns:a="{A}" xmlns:r="{R}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>'
    return package({
        "[Content_Types].xml": f'<Types xmlns="{PACK}/content-types"><Override PartName="/ppt/slides/slide2.xml" ContentType="y"/></Types>', "_rels/.rels": rels(("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="1" r:id="r1"/><p:sldId id="2" r:id="r2"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("r1", "slide", "slides/slide1.xml"), ("r2", "slide", "slides/slide2.xml")),
        "ppt/slides/slide1.xml": slide(shape("Low", 400, "last") + shape("Top", 10, "first") + group + frame), "ppt/slides/_rels/slide1.xml.rels": rels(("r9", "chart", "../charts/chart1.xml"), ("r8", "image", "../media/shared.png")),
        "ppt/slides/slide2.xml": slide(""), "ppt/slides/_rels/slide2.xml.rels": rels(("r7", "notesSlide", "../notesSlides/notesSlide2.xml"), ("r8", "image", "../media/shared.png")), "ppt/notesSlides/notesSlide2.xml": f'<p:notes xmlns:p="{P}" xmlns:a="{A}"/>',
        "ppt/charts/chart1.xml": CHART, "ppt/charts/_rels/chart1.xml.rels": rels(("r1", "package", "../embeddings/book1.xlsx")), "ppt/embeddings/book1.xlsx": b"old", "ppt/media/shared.png": b"\x89PNG\r\n\x1a\n",
    })


def test_slides_with_groups_and_charts():
    got, error = engine.read_one(deck(), "pptx")
    assert error is None and got.text == f"[Slide Number: 1]\n\nfirst\n\nmiddle\n\nlast\n\n{BLOCK}\n\n[Slide Number: 2]\n\n[Empty Slide]"
    new = ooxml.set_shape_text(deck(), 0, "Top", "one\ntwo")
    assert ooxml.shape_texts(new, 0) == {"Low": "last", "Top": "one\ntwo", "In": "middle"} and ooxml.Package(new).part("ppt/slides/slide1.xml").count(b'b="1"') == 4
    with pytest.raises(KeyError):
        ooxml.set_shape_text(deck(), 0, "None", "x")


def test_removed_slides_leave_what_others_use():
    left = ooxml.Package(ooxml.remove_slide(deck(), 1))
    assert ooxml.slide_parts(left) == ["ppt/slides/slide1.xml"] and not any("slide2" in n.lower() for n in left.names) and "ppt/media/shared.png" in left.names and b"slide2" not in left.part("[Content_Types].xml")
    first = ooxml.Package(ooxml.remove_slide(deck(), 0))
    assert ooxml.slide_parts(first) == ["ppt/slides/slide2.xml"] and not any("chart" in n or "book1" in n for n in first.names) and "ppt/media/shared.png" in first.names


def test_charts_are_changed():
    new = charts.set_title(deck(), "ppt/charts/chart1.xml", "Turnover")
    assert charts.read(ooxml.Package(new).part("ppt/charts/chart1.xml")).title == "Turnover"
    new = ooxml.Package(charts.set_data(deck(), "ppt/charts/chart1.xml", ["a", "b", "c"], [("N", [1, 2.5, None]), ("S", [4, 5, 6]), (None, [7, 8, 9])]))
    got = charts.read(new.part("ppt/charts/chart1.xml"))
    assert got.categories == ["a", "b", "c"] and got.series == [("N", [1.0, 2.5, None]), ("S", [4.0, 5.0, 6.0]), (None, [7.0, 8.0, 9.0])] and b"Sheet1!$D$2:$D$4" in new.part("ppt/charts/chart1.xml")
    book = ooxml.sheets(ooxml.Package(new.part("ppt/embeddings/book1.xlsx")))[0]
    assert book["name"] == "Sheet1" and book["cells"][2, 2] == "1" and book["cells"][4, 4] == "9" and (4, 2) not in book["cells"]
    fewer = charts.read(ooxml.Package(charts.set_data(new.save(), "ppt/charts/chart1.xml", ["z"], [("only", [3.0])])).part("ppt/charts/chart1.xml"))
    assert (fewer.categories, fewer.series) == (["z"], [("only", [3.0])])
    with pytest.raises(ValueError):
        charts.set_data(deck(), "ppt/charts/chart1.xml", ["a"], [("N", [1, 2])])


def document():
    p = lambda *runs: "<w:p><w:pPr><w:jc w:val='left'/></w:pPr>" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in runs) + "</w:p>"
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('h', '<w:gridSpan w:val=' + chr(34) + '2' + chr(34) + '/>')}</w:tr><w:tr>{cell('a', '<w:vMerge w:val=' + chr(34) + 'restart' + chr(34) + '/>')}{cell('b')}</w:tr><w:tr>{cell('', '<w:vMerge/>')}{cell('c')}</w:tr></w:tbl>"
    drawing = f'<w:p><w:r><w:drawing><c:chart xmlns:c="{C}" r:id="r1"/></w:drawing></w:r></w:p>'
    return package({
        "word/document.xml": f'<w:document xmlns:w="{W}" xmlns:r="{R}" xmlns:a="{A}"><w:body>{p("Hello wo", "rld, wor", "ld")}{drawing}{table}<w:sectPr/></w:body></w:document>', "word/_rels/document.xml.rels": rels(("r1", "chart", "charts/chart1.xml")), "word/charts/chart1.xml": CHART,
        "docProps/app.xml": "<x/>",
    })


def test_documents_are_read_and_changed():
    got, error = engine.read_one(document(), "docx")
    assert error is None and got.text.startswith("Hello world, world\n\n" + BLOCK) and [[(c.text, c.rows, c.cols) for c in r] for r in got.tables[0]] == [[("h", 1, 2)], [("a", 2, 1), ("b", 1, 1)], [("c", 1, 1)]]
    assert ooxml.paragraphs(ooxml.replace_text(document(), "world", "earth"))[0] == "Hello earth, earth"
    assert ooxml.replaced_in_runs(["aab", "baa", "b"], "ab", "X") == ["aX", "baX", ""]
    new = ooxml.edit_paragraphs(document(), [("insert", 0, "Before"), ("set", 1, "Set"), ("delete", 2, None), ("insert", 2, "After")])
    assert ooxml.paragraphs(new) == ["Before", "Set", "After"] and ooxml.Package(new).part("docProps/app.xml") == b"<x/>" and b"w:document" in ooxml.Package(new).part("word/document.xml")
    new = ooxml.edit_table(document(), 0, {(0, 1): "head", (2, 0): "merged", (3, 1): "d"}, insert=3)
    assert [[c.text for c in r] for r in engine.read_one(new, "docx")[0].tables[0]] == [["head"], ["merged", "b"], ["c"], ["", "d"]]
    assert [[c.text for c in r] for r in engine.read_one(ooxml.edit_table(document(), 0, delete=0), "docx")[0].tables[0]] == [["a", "b"], ["c"]]


def workbook(cells, more=""):
    styles = f'<styleSheet xmlns="{S}"><borders><border/><border><left style="thin"/></border></borders><cellXfs><xf borderId="0"/><xf borderId="1"/></cellXfs></styleSheet>'
    return package({
        "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets><definedNames><definedName name="N">One!$A$1</definedName></definedNames></workbook>', "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml")),
        "xl/styles.xml": styles, "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{S}" xmlns:r="{R}"><dimension ref="A1:B2"/><sheetData>{cells}</sheetData>{more}</worksheet>', "xl/worksheets/_rels/sheet1.xml.rels": rels(("r1", "drawing", "../drawings/drawing1.xml")),
        "xl/drawings/drawing1.xml": f'<d xmlns:r="{R}" xmlns:a="{A}" xmlns:x="x"><c:chart xmlns:c="{C}" r:id="r1"/><x:txBody><a:p><a:r><a:t>note</a:t></a:r></a:p></x:txBody></d>', "xl/drawings/_rels/drawing1.xml.rels": rels(("r1", "chart", "../charts/chart1.xml")), "xl/charts/chart1.xml": CHART,
    })


def test_sheets_in_regions_however_far_apart():
    cells = '<row r="1"><c r="A1" t="inlineStr"><is><t>a</t></is></c><c r="B1"><f>A1*2</f><v>2</v></c></row><row r="5"><c r="A5" s="1"><v>5</v></c></row><row r="1048576"><c r="XFD1048576"><v>9</v></c></row>'
    data = workbook(cells, '<mergeCells><mergeCell ref="A1:A1000000"/></mergeCells>')
    got, error = engine.read_one(data, "xlsx")
    assert error is None and got.text.count("[Table ") == 3 and "| 9 |" in got.text and got.text.endswith(f"{BLOCK}\n\n[textbox]\nnote\n[/textbox]") and [len(t) for t in got.tables] == [1, 1, 1]
    sheet = ooxml.sheets(ooxml.Package(data))[0]
    assert sheet["bordered"] == {(5, 1)} and sheet["formulas"] == {"B1": "A1*2"} and sheet["used"] == "A1:B2" and ooxml.defined_names(ooxml.Package(data)) == {"N": "One!$A$1"}


def test_rows_are_added_and_formulas_calculated_anew():
    data = workbook('<row r="1"><c r="A1"><v>1</v></c><c r="B1"><f>A1</f><v>1</v></c></row>')
    new = ooxml.Package(ooxml.append_rows(data, "One", [["x", 2, None], [None, True, 1.5]]))
    sheet = ooxml.sheets(new)[0]
    assert sheet["cells"] == {(1, 1): "1", (1, 2): "1", (2, 1): "x", (2, 2): "2", (3, 2): "TRUE", (3, 3): "1.5"} and sheet["used"] == "A1:C3" and b"fullCalcOnLoad" in new.part("xl/workbook.xml")
    assert new.part("xl/styles.xml") == ooxml.Package(data).part("xl/styles.xml")
    with pytest.raises(KeyError):
        ooxml.append_rows(data, "None", [])
