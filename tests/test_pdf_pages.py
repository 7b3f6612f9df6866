"""Positioned elements of PDF pages, from operators to the analysis of pages."""

import base64
import zlib

import pytest

from docloom import engine
from docloom.operators import pages
from docloom.sources import package, pdf, pdfpage


def document(contents: list[bytes], more: str = "", resources: str = "") -> bytes:
    """A file with a page for each stream; ``more`` are further objects from 100 up."""
    n = len(contents)
    out = [b"%PDF-1.4", b"1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj", f"2 0 obj <</Type/Pages/MediaBox[0 0 600 800]/Resources<<{resources}>>/Kids[{' '.join(f'{10 + k} 0 R' for k in range(n))}]/Count {n}>> endobj".encode()]
    for k, c in enumerate(contents):
        out.append(f"{10 + k} 0 obj <</Type/Page/Parent 2 0 R/Contents {50 + k} 0 R>> endobj".encode())
        out.append(f"{50 + k} 0 obj <</Length {len(c)}>>\nstream\n".encode() + c + b"\nendstream endobj")
    return b"\n".join([*out, more.encode("latin-1")])


FONTS = "/Font<</F1 100 0 R>>/XObject<</Fm 101 0 R/Im 102 0 R>>"
OBJECTS = """100 0 obj <</Type/Font/Subtype/Type1/FirstChar 65/Widths[1000 500]>> endobj
101 0 obj <</Subtype/Form/Matrix[1 0 0 1 100 0]/Length 35>>
stream
BT /F1 10 Tf 0 100 Td (inner) Tj ET
endstream endobj
102 0 obj <</Subtype/Image/Width 5>> endobj"""
CELLS = [("Name", 60, 690), ("Amount", 160, 690), ("ink", 60, 660), ("12", 160, 660), ("pen", 60, 630), ("7", 160, 630)]
TABLE = b"".join(f"BT /F1 10 Tf {x} {y} Td ({t}) Tj ET\n".encode() for t, x, y in CELLS) + b"".join(f"50 {y} m 250 {y} l S\n".encode() for y in (705, 675, 645, 615)) + b"".join(f"{x} 615 m {x} 705 l S\n".encode() for x in (50, 150, 250))


def test_places_of_what_is_shown():
    data = document([b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 50 350 Td [(AB) -300 (A)] TJ ET Q 0 0 1 rg 10 20 30 40 re f 1 w 0 0 m 10 0 20 10 30 0 c S q 100 0 0 50 200 300 cm /Im Do Q /Fm Do BI /W 1 ID \x01( EI"], OBJECTS, FONTS)
    page = pdfpage.read(pdf.Document(data), pdf.Document(data).pages()[0])
    assert (page.width, page.height) == (600, 800) and [s.text for s in page.spans] == ["AB A", "inner"]
    a = page.spans[0]
    assert a.size == 20 and a.box == pytest.approx((100, 800 - 716, 100 + 2 * (10 + 5 + 3 + 10), 800 - 696)) and page.spans[1].box[0] == 100
    assert [(d.box, d.rects, d.curves, d.filled) for d in page.drawings] == [((10, 740, 40, 780), 1, 0, True), ((0, 790, 30, 800), 0, 1, False)] and page.images == [(200, 450, 300, 500)]


def test_tables_by_their_lines_and_text_around_them():
    got, error = engine.read_one(document([b"BT /F1 12 Tf 50 750 Td (Report) Tj ET\n" + TABLE + b"BT /F1 12 Tf 50 590 Td (below) Tj 0 -14 Td (the table) Tj ET"], OBJECTS, FONTS), "pdf")
    assert error is None and [[c.text for c in r] for r in got.tables[0]] == [["Name", "Amount"], ["ink", "12"], ["pen", "7"]]
    assert got.text.startswith("[Page Number: 1]\nReport\n<table") and got.text.endswith("</table>\nbelow\nthe table") and got.text.count("ink") == 1


def test_filters():
    plain = b"BT (x) Tj ET " * 20
    assert pdf.FILTERS["LZWDecode"](bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    assert pdf.FILTERS["RunLengthDecode"](b"\x02abc\xfex\x80zz") == b"abcxxx" and pdf.FILTERS["ASCIIHexDecode"](b"61 62 6>") == b"ab`"
    chain = base64.a85encode(zlib.compress(plain)) + b"~>"
    assert pdf.Document(b"%PDF-1.4").stream(b"<</Filter[/ASCII85Decode/FlateDecode]>>\nstream\n" + chain + b"\nendstream") == plain
    rows = b"".join(bytes([2]) + bytes([1] * 4) for _ in range(3))
    assert pdf._unpredicted(rows, b"/Predictor 12/Columns 4") == bytes([1] * 4 + [2] * 4 + [3] * 4) and pdf._unpredicted(b"abc", b"") == b"abc"
    assert pdf.Document(b"%PDF-1.4").stream(b"<</Filter/DCTDecode>>\nstream\nx\nendstream") == b""


def test_scans_are_told():
    scan = document([b"q 600 0 0 800 0 0 cm /Im Do Q"] * 2, OBJECTS, FONTS)
    got, _ = engine.read_one(scan, "pdf")
    assert got.metadata["scanned"] == "Yes" and got.warnings == ["a scan; it needs recognition"] and got.text == "[Page Number: 1]\n\n[Page Number: 2]"
    assert engine.read_one(document([TABLE], OBJECTS, FONTS), "pdf")[0].warnings == []


def test_files_to_the_analysis_of_their_pages(spark):
    data = document([TABLE, b"BT /F1 12 Tf 50 700 Td (text alone on a page) Tj ET"], OBJECTS, FONTS)
    df = spark.createDataFrame([(1, data), (2, b"no pdf"), (3, None), (4, document([b""], OBJECTS, FONTS))], "id long, content binary").selectExpr("*", "1 AS page")
    found = package.elements(df, "id")
    made, drawings, texts, images = package.page_tables(found, "id")
    keys = ["id", "page"]
    assert sorted((r.id, r.page, r.width, r.height) for r in made.collect()) == [(1, 1, 600.0, 800.0), (1, 2, 600.0, 800.0), (4, 1, 600.0, 800.0)] and images.count() == 0
    grid = pages.grids(pages.merged_lines(pages.classified_lines(drawings), keys), keys).first()
    assert (grid.id, grid.page, len(grid.rows_at), len(grid.cols_at), grid.closed) == (1, 1, 4, 3, True)
    scored = pages.complexity(made, drawings, texts, images, keys)
    assert {(r.id, r.page): r.strategy for r in pages.strategies(scored, pages.regions(made, drawings, texts, keys), keys).collect()} == {(1, 1): "text", (1, 2): "text", (4, 1): "text"}
