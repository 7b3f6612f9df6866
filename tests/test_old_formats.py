import io
import struct
import zipfile
import zlib

from docloom import engine
from docloom.sources import ole, pdf


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file whose streams all lie in whole sectors."""
    sector, free, end = 512, 0xFFFFFFFF, 0xFFFFFFFE
    padded = {k: v.ljust(4096, b"\0") for k, v in streams.items()}
    folders = sorted({k.rsplit("/", 1)[0] for k in padded if "/" in k})
    names = [None, *folders, *padded]
    n_dir = -(-len(names) * 128 // sector)
    fat, body, starts = [0xFFFFFFFD], b"", {}
    fat += [*range(2, 1 + n_dir), end]
    for k, v in padded.items():
        n = -(-len(v) // sector)
        starts[k] = len(fat)
        fat += [*range(len(fat) + 1, len(fat) + n), end]
        body += v.ljust(n * sector, b"\0")
    assert len(fat) <= 128
    fat += [free] * (128 - len(fat))

    def entry(name, kind, left, right, child, start, size):
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)

    tops = folders + [k for k in padded if "/" not in k]
    number = {k: i for i, k in enumerate(names) if k}
    out = entry("Root Entry", 5, free, free, number[tops[0]], end, 0)
    for k in names[1:]:
        parent = k.rsplit("/", 1)[0] if "/" in k else None
        mates = tops if parent is None else [x for x in padded if x.startswith(parent + "/")]
        i = mates.index(k)
        right = number[mates[i + 1]] if i + 1 < len(mates) else free
        if k in folders:
            out += entry(k, 1, free, right, number[next(x for x in padded if x.startswith(k + "/"))], 0, 0)
        else:
            out += entry(k.rsplit("/", 1)[-1], 2, free, right, free, starts[k], len(padded[k]))
    header = ole.MAGIC + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, 1, 1, 0, 4096, end, 0, end, 0, 0) + struct.pack("<108I", *[free] * 108)
    return header + struct.pack("<128I", *fat) + out.ljust(n_dir * sector, b"\0") + body


def test_word():
    text = "Hello\rcell\x07two\x07\x07é end"
    piece = text.encode("utf-16-le")
    main = bytearray(2048)
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<II", main, 418, 0, 5 + 4 * 2 + 8)
    main[1024 : 1024 + len(piece)] = piece
    table = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + b"\0\0" + struct.pack("<I", 1024) + b"\0\0"
    got, error = engine.read_one(compound({"WordDocument": bytes(main), "0Table": table}), "doc")
    assert error is None and got.text == "Hello\ncell\ttwo\né end"


def test_slides_enter_containers():
    atom = lambda kind, body: struct.pack("<HHI", 0, kind, len(body)) + body
    inner = atom(4000, "Titel é".encode("utf-16-le")) + atom(4008, b"plain")
    data = struct.pack("<HHI", 0xF, 1006, len(inner)) + inner
    got, error = engine.read_one(compound({"PowerPoint Document": data}), "ppt")
    assert error is None and got.text == "[Slide Number: 1]\n\nTitel é\n\nplain"


def test_workbook():
    rec = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    strings = struct.pack("<II", 1, 1) + struct.pack("<HB", 4, 0) + b"Name"
    sheet = rec(0x809, b"\0" * 16) + rec(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + rec(0x203, struct.pack("<HHHd", 0, 1, 0, 2.5)) + rec(0x27E, struct.pack("<HHHI", 1, 0, 0, (7 << 2) | 2)) + rec(0x205, struct.pack("<HHHBB", 1, 1, 0, 1, 0)) + rec(0x0A, b"")
    globals_ = lambda at: rec(0x809, b"\0" * 16) + rec(0x85, struct.pack("<IBBBB", at, 0, 0, 3, 0) + b"One") + rec(0xFC, strings) + rec(0x0A, b"")
    at = len(globals_(0))
    got, error = engine.read_one(compound({"Workbook": globals_(at) + sheet}), "xls")
    assert error is None and got.text == "[Sheet: One]\n\n| Name | 2.5 |\n| --- | --- |\n| 7 | TRUE |"


def test_hangul():
    text = "가나 다".encode("utf-16-le") + struct.pack("<H", 13)
    record = struct.pack("<I", 67 | len(text) << 20) + text
    pack = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = pack.compress(record) + pack.flush()
    head = b"HWP Document File".ljust(36, b"\0") + struct.pack("<I", 1)
    c = ole.Compound(compound({"FileHeader": head, "BodyText/Section0": packed}))
    c.streams["BodyText/Section0"] = (c.streams["BodyText/Section0"][0], 4096)
    assert ole.hangul_text(c) == ("가나 다", [])


def test_pdf():
    content = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello \\(PDF\\)) Tj 0 -14 Td [(Wor) -20 (ld)] TJ ET")
    data = b"%%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj\n3 0 obj <</Type/Page/Contents 4 0 R>> endobj\n4 0 obj <</Length %d/Filter/FlateDecode>>\nstream\n%s\nendstream endobj\n5 0 obj <</Title(A title)/Producer(x)>> endobj\ntrailer<</Root 1 0 R>>" % (len(content), content)
    got, error = engine.read_one(data, "pdf")
    assert error is None and got.text == "[Page Number: 1]\n\nHello (PDF)\nWorld".replace("\n\n", "\n") and got.metadata == {"title": "A title", "page_count": "1"}
    assert engine.read_one(b"%PDF-1.4 /Encrypt", "pdf")[1].startswith("E_VALUE")
    assert pdf.read(b"%PDF-1.4")[1]["page_count"] == "0"


def test_broken_heads_are_errors_not_crashes():
    for ext in engine.supported_extensions():
        for data in (b"", b"\0", ole.MAGIC, ole.MAGIC + b"\0" * 600, b"PK\x03\x04" + b"x" * 50, b"%PDF-", b"{\\rtf1", b"\xff\xfe\x00", b"<html"):
            got, error = engine.read_one(data, ext)
            assert (got is None) == (error is not None)


def test_tables_of_old_documents():
    text, tables = ole.word_blocks("Head\ra\x07b\x07\x07\rc\x07\x07d\x07\x07\rTail\rlone\x07row\x07\x07\rEnd")
    assert text.startswith("Head\n\n<table") and text.endswith("Tail\nlone\trow\nEnd") and [[c.text for c in r] for r in tables[0]][0] == ["a", "b"] and len(tables) == 1


def record(tag, level, body):
    return struct.pack("<I", tag | level << 10 | len(body) << 20) + body


def test_tables_of_hangul_documents():
    para = lambda t, level: record(66, level, b"") + record(67, level + 1, t.encode("utf-16-le"))
    cell = lambda c, r, t: record(72, 1, struct.pack("<HHIHHHH", 1, 0, 0, c, r, 1, 1)) + para(t, 1)
    table = lambda rows, cols, cells: record(71, 0, b" lbt" + b"\0" * 4) + record(77, 1, struct.pack("<IHH", 0, rows, cols)) + cells
    data = para("앞", 0) + table(2, 2, cell(0, 0, "가") + cell(1, 0, "나") + cell(0, 1, "다") + cell(1, 1, "라")) + table(1, 1, cell(0, 0, "하나")) + table(2, 1, cell(0, 0, "위") + cell(0, 1, "밑")) + para("뒤", 0)
    c = ole.Compound(compound({"FileHeader": b"\0" * 40, "BodyText/Section0": data}))
    text, tables = ole.hangul_text(c)
    assert text.startswith("앞\n<table") and text.endswith("하나\n위\n\n밑\n뒤") and [[x.text for x in r] for r in tables[0]] == [["가", "나"], ["다", "라"]] and len(tables) == 1


    packed = zlib.compress("살아남은 글자들".encode("utf-16-le"))
    assert "살아남은 글자들" in ole.recovered(b"\xff\xfe\xfd" + packed[:-4])


def test_tables_of_packed_hangul_documents():
    h = "http://www.hancom.co.kr/hwpml/2011/paragraph"
    cell = lambda r, c, t, wide=1: f"<p:tc><p:subList><p:p><p:run><p:t>{t}</p:t></p:run></p:p></p:subList><p:cellAddr colAddr='{c}' rowAddr='{r}'/><p:cellSpan colSpan='{wide}' rowSpan='1'/></p:tc>"
    table = f"<p:tbl rowCnt='2' colCnt='2'><p:tr>{cell(0, 0, 'head', 2)}</p:tr><p:tr>{cell(1, 0, 'a')}{cell(1, 1, 'b')}</p:tr></p:tbl>"
    section = f"<s xmlns:p='{h}'><p:p><p:run><p:t>before</p:t>{table}<p:t>after</p:t></p:run></p:p><p:p><p:run><p:tbl rowCnt='1' colCnt='1'><p:tr>{cell(0, 0, 'box')}</p:tr></p:tbl></p:run></p:p></s>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("Contents/section10.xml", section.replace("before", "tenth"))
        z.writestr("Contents/section2.xml", section)
    got, error = engine.read_one(out.getvalue(), "hwpx")
    assert error is None and got.text.startswith("before\n<table") and got.text.index("before") < got.text.index("tenth") and "after\nbox" in got.text
    assert [[(c.text, c.cols) for c in r] for r in got.tables[0]] == [[("head", 2)], [("a", 1), ("b", 1)]]
