import io
import os
import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom import engine
from docloom.config import Settings
from docloom.functions import tags, text
from docloom.operators import chunkers, layout, structure, tables
from docloom.sources import decode, delimited, jsonpaths, ooxml

SMALL = "/root/testdata/sf0.001"


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_scalars(spark):
    assert one(spark, text.clean_plain(F.col("t")), t="  a\n \n\n\nb \n") == "a\n\nb"
    assert one(spark, text.clean_code(F.col("t")), t="\ta  \n\n") == "    a"
    for value, numeric in (("1,234.5", True), ("₩1,000", True), ("-5%", True), ("$3.50", True), ("1,23", False), ("", False), ("a", False), (" 7 ", True)):
        assert one(spark, text.is_numeric(F.col("v")), v=value) is numeric
    for n, letters in ((1, "A"), (26, "Z"), (27, "AA"), (702, "ZZ"), (703, "AAA"), (18278, "ZZZ")):
        assert one(spark, text.column_letters(F.col("n")), n=n) == letters and one(spark, text.column_number(F.col("l")), l=letters) == n
    assert one(spark, text.roman(F.col("n")), n=1994) == "MCMXCIV"
    assert one(spark, text.escaped(F.col("t"), True), t="<a & 'b'>\n") == "&lt;a &amp; &#x27;b&#x27;&gt;<br>"
    assert one(spark, text.private_share(F.col("t")), t="a") == 0.5


def test_tag_offsets(spark):
    texts = ["a[Page Number: 1]bb[Page Number: 22 (OCR)]", "x[Sheet: é]" * 3000, None, "", "[Page Number: 1]", "[Page Number: 1]"]
    df = spark.createDataFrame([(1, texts[0]), (2, texts[1]), (3, texts[2]), (4, texts[3]), (5, texts[4]), (5, texts[5]), (None, texts[0])], "id long, text string")
    patterns = {k: tags.pattern(k) for k in ("page", "sheet")}
    got = sorted((r.id or 0, r.kind, r.no, r.s, r.e) for r in tags.located(df, "id", "text", patterns).collect())
    want = [(i, k, n, m.start(), m.end()) for i, t in ((1, texts[0]), (2, texts[1]), (5, texts[4]), (5, texts[5]), (0, texts[0])) for k, p in patterns.items() for n, m in enumerate(re.finditer(p, t))]
    assert got == sorted(want) and len(got) > 3000 and tags.located(df.limit(0), "id", "text", patterns).count() == 0
    assert one(spark, tags.values(F.col("t"), "image"), t="[Image: a.png ][Image:b]") == ["a.png", "b"]


def test_chunk_strategies():
    size = 120
    words = " ".join(f"word{i}" for i in range(200))
    got = chunkers.recursive(words, size, 20)
    assert all(len(c) <= size for c in got) and " ".join(got).split()[-1] == "word199"
    assert all(a.split()[-1] in b.split() for a, b in zip(got, got[1:]))
    assert chunkers.recursive("x" * 300, 100, 10) == ["x" * 100, "x" * 100, "x" * 100, "x" * 30]
    with pytest.raises(ValueError):
        chunkers.recursive("a", 10, 10)
    table = "<table>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(40)) + "</table>"
    body = f"{words}\n\n{table}\n\n{words}"
    kept = chunkers.protected(body, size, 20)
    assert table in kept and not any("<table>" in c and c != table for c in kept)
    cut = chunkers.protected(body, 300, 20, preserve_tables=False)
    assert sum(c.startswith("[Table Chunk") for c in cut) > 1 and sum(c.count("<tr>") for c in cut) == 40
    paged = "".join(f"[Page Number: {i}]\n{'text ' * 10}\n" for i in range(1, 9))
    assert all("[Page Number:" in c for c in chunkers.paged(paged, 150, 10))
    assert chunkers.chunk("  ", "txt") == (None, []) == chunkers.chunk(None)
    assert chunkers.chunk("def a():\n  pass\n" * 50, "py", 100, 0)[0] == "plain"
    sheet = f"[Document-Metadata]\n  a: b\n[/Document-Metadata]\n[Sheet: S]\n{table}"
    assert all(c.startswith("[Document-Metadata]") for c in chunkers.chunk(sheet, "xlsx", 400, 0)[1])


def test_chunked_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 500, 1), (1, "a b " * 500, 1), (2, None, 2), (None, " ", 3)], "id long, text string, no int")
    got = chunkers.chunked(df, ["id"], "text", None, 100, 10)
    assert got.count() > 20 and got.where("length(chunk) > 100").count() == 0
    assert chunkers.chunked(df.limit(0), ["id"], "text").count() == 0


def test_structure(spark):
    df = spark.createDataFrame([(1, 0, "# A"), (1, 1, "## B"), (1, 2, "x"), (1, 3, "## C"), (1, 4, "# D"), (1, 5, "### E")], "id int, no int, line string")
    got = [r.path for r in structure.heading_paths(df, "id", "no", "line").orderBy("no").collect()]
    assert got == ["A", "A > B", "A > B", "A > C", "D", "D > E"]
    r = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 5, 8), (1, "c", 6, 9), (1, "d", 20, 22)], "id int, kind string, s int, e int")
    assert sorted((x.s, x.e, x.kinds) for x in structure.merged_regions(r, "id").collect()) == [(0, 5, "a"), (5, 9, "b+c"), (20, 22, "d")]


def test_sources():
    assert decode.decode("é".encode("utf-16"))[0] == "é" and decode.decode(b"\xef\xbb\xbfa\r\nb") == ("a\nb", "utf-8")
    assert decode.decode("가나".encode("cp949"))[0] == "가나" and decode.decode_html(b'<meta charset="euc-kr">' + "가".encode("euc-kr"))[0].endswith("가")
    assert delimited.sniff("a;b\n1;2\n3;4") == (";", 1.0) and delimited.parse("a,b\n\n1,2", ",", 2) == ([["a", "b"]], True)
    assert delimited.has_header([["Name", "Age"], ["x", "1"]]) and not delimited.has_header([["1", "2"], ["3", "4"]])
    assert jsonpaths.flatten('{"a": [], "b": {"c": 1}}') == "a: []\nb.c: 1" and jsonpaths.flatten("{") is None


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
BOOK = {
    "xl/workbook.xml": f'<workbook xmlns="{ooxml.S[1:-1]}" xmlns:r="{R}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Hid" state="hidden" sheetId="2" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f'<sst xmlns="{ooxml.S[1:-1]}"><si><t>Name</t></si></sst>',
    "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ooxml.S[1:-1]}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Q|1</t></is></c></row><row r="2"><c r="A2"><v>3.0</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>',
    "docProps/core.xml": '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:title>T</dc:title><dc:creator>A</dc:creator></cp:coreProperties>',
}


def test_workbook_read_and_write():
    data = package(BOOK)
    got, error = engine.read_one(data, "xlsx")
    assert error is None and got.text == "[Sheet: One]\n\n| Name | Q\\|1 |\n| --- | --- |\n| 3 | TRUE |" and got.metadata == {"title": "T", "author": "A"}
    new = ooxml.set_cells(data, "One", {"C2": "x", "A2": 5})
    cells = ooxml.sheets(ooxml.Package(new))[0]["cells"]
    assert cells[2, 3] == "x" and cells[2, 1] == "5"
    assert ooxml.Package(new).part("xl/workbook.xml") == ooxml.Package(data).part("xl/workbook.xml")


def test_word_and_slides():
    w = ooxml.W[1:-1]
    doc = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    got, error = engine.read_one(package({"word/document.xml": doc}), "docx")
    assert error is None and got.text.startswith("# Head\n\none\ttwo") and "rowspan='2'" in got.text and len(got.tables) == 1
    assert b"ONE" in ooxml.Package(ooxml.replace_text(package({"word/document.xml": doc}), "one", "ONE")).part("word/document.xml")
    assert engine.effective_extension(package(BOOK), "xls") == "xlsx"


def test_engine_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, data in (("a.csv", b"x,y\n1,2\n"), ("b.html", b"<h1>T</h1><p>p"), ("c.xlsx", package(BOOK)), ("d.zzz", b"?"), ("e.json", b'{"a": 1}'), ("f.docx", b"no zip"), ("g.txt", b" ")):
        (tmp_path / "in" / name).write_bytes(data)
    files = engine.files(spark, str(tmp_path / "in"))
    got = {Path(r.path).name: r for r in engine.extracted(files, ["path"]).collect()}
    assert got["b.html"].text == "# T\n\np" and got["e.json"].text == "a: 1" and got["g.txt"].text == ""
    assert got["d.zzz"].error.startswith("E_UNSUPPORTED_FORMAT") and got["f.docx"].error.startswith("E_BAD_ZIP_FILE")
    assert got["a.csv"].tables[0][1][0].content == "1" and got["c.xlsx"].text.startswith("[Document-Metadata]\n  제목: T")
    kept = str(tmp_path / "kept")
    first = engine.extracted_once(files, ["path"], kept).count()
    assert first == 7 == engine.extracted_once(files, ["path"], kept).count() and spark.read.parquet(kept).count() == 7
    chunks = engine.chunks(files.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)), ["name"], settings=Settings().with_chunking(chunk_size=50, chunk_overlap=5))
    engine.write_chunks(chunks, "name", str(tmp_path / "out"))
    assert (tmp_path / "out" / "name=b.html" / "chunk_0001.md").read_text().startswith("# T")
    assert Settings.from_dict(Settings().with_metadata(language="en").to_dict()).metadata.language == "en"


def test_stream_extracts_once(spark, tmp_path):
    from docloom.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    (tmp_path / "in" / "b.txt").write_text("hello")
    where = [str(tmp_path / x) for x in ("in", "out", "ck")]
    ingest(spark, *where).awaitTermination(120)
    (tmp_path / "in" / "c.txt").write_text("more")
    ingest(spark, *where).awaitTermination(120)
    assert sorted(r.text for r in spark.read.parquet(where[1]).collect()) == ["hello", "more"]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_queries_against_sql(spark):
    import __spark_entry__ as entry

    from tests.against_sql import compare

    core = [n for n in entry.oracle_sql() if not re.match(r"p(1|4|5|6|7|8|9)_", n)]
    wrong = {n: w for n in core if (w := compare(spark, n, SMALL))}
    assert not wrong and len(core) > 50


def test_sql_names_are_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert tables.DELIMITERS == delimited.DELIMITERS
