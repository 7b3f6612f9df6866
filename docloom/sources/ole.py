"""Compound files of streams: the container, and text of the old formats that live in it."""

from __future__ import annotations

import re
import struct
import zlib

from docloom.sources.grid import Cell, as_html

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
_FREE, _END = 0xFFFFFFFF, 0xFFFFFFFE
#: Property numbers of the summary stream and the fields they fill.
SUMMARY = {2: "title", 3: "subject", 4: "author", 5: "keywords", 6: "comments", 8: "last_saved_by", 9: "revision", 12: "create_time", 13: "last_saved_time", 14: "page_count", 15: "word_count"}


class Compound:
    """Streams of a compound file by path."""

    def __init__(self, data: bytes):
        if not data.startswith(MAGIC) or len(data) < 512:
            raise ValueError("no compound file")
        self.data = data
        self.sector, self.mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
        n_fat, first_dir = struct.unpack_from("<I", data, 44)[0], struct.unpack_from("<I", data, 48)[0]
        self.cutoff, first_mini, _, at, n_more = struct.unpack_from("<IIIII", data, 56)
        table = list(struct.unpack_from("<109I", data, 76))
        for _ in range(n_more):
            if at >= _END:
                break
            more = struct.unpack(f"<{self.sector // 4}I", self._sector(at))
            table += more[:-1]
            at = more[-1]
        self.fat: list[int] = []
        for s in table[:n_fat]:
            if s < _END:
                self.fat += struct.unpack(f"<{self.sector // 4}I", self._sector(s))
        raw = self._chain(first_dir)
        self.entries = []
        for i in range(0, len(raw) - 127, 128):
            size = struct.unpack_from("<H", raw, i + 64)[0]
            name = raw[i : i + max(0, size - 2)].decode("utf-16-le", "replace")
            kind, left, right, child = raw[i + 66], *struct.unpack_from("<III", raw, i + 68)
            start, length = struct.unpack_from("<IQ", raw, i + 116)
            self.entries.append((name, kind, left, right, child, start, length & 0xFFFFFFFF))
        self.small = self._chain(self.entries[0][5]) if self.entries else b""
        mini = self._chain(first_mini) if first_mini < _END else b""
        self.mini_fat = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])
        self.streams: dict[str, tuple[int, int]] = {}
        if self.entries:
            self._walk(self.entries[0][4], "", set())

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.sector
        return self.data[at : at + self.sector].ljust(self.sector, b"\0")

    def _chain(self, start: int) -> bytes:
        out, seen = [], set()
        while start < _END and start not in seen:
            seen.add(start)
            out.append(self._sector(start))
            start = self.fat[start] if start < len(self.fat) else _END
        return b"".join(out)

    def _walk(self, n: int, prefix: str, seen: set[int]) -> None:
        todo = [(n, prefix)]
        while todo:
            n, prefix = todo.pop()
            if n >= len(self.entries) or n in seen:
                continue
            seen.add(n)
            name, kind, left, right, child, start, length = self.entries[n]
            todo += [(left, prefix), (right, prefix)]
            if kind == 1:
                todo.append((child, f"{prefix}{name}/"))
            elif kind == 2:
                self.streams[prefix + name] = (start, length)

    def read(self, name: str) -> bytes | None:
        if name not in self.streams:
            return None
        start, length = self.streams[name]
        if length >= self.cutoff:
            return self._chain(start)[:length]
        out, seen = [], set()
        while start < _END and start not in seen:
            seen.add(start)
            out.append(self.small[start * self.mini : (start + 1) * self.mini])
            start = self.mini_fat[start] if start < len(self.mini_fat) else _END
        return b"".join(out)[:length]


def properties(c: Compound) -> dict[str, str]:
    """Fields of the summary stream."""
    data = c.read("\x05SummaryInformation") or b""
    out: dict[str, str] = {}
    try:
        base = struct.unpack_from("<I", data, 44)[0]
        for i in range(struct.unpack_from("<I", data, base + 4)[0]):
            number, at = struct.unpack_from("<II", data, base + 8 + 8 * i)
            field, kind = SUMMARY.get(number), struct.unpack_from("<I", data, base + at)[0]
            if not field:
                continue
            if kind == 30:
                n = struct.unpack_from("<I", data, base + at + 4)[0]
                value = data[base + at + 8 : base + at + 8 + n].split(b"\0")[0].decode("cp1252", "replace")
            elif kind == 31:
                n = struct.unpack_from("<I", data, base + at + 4)[0]
                value = data[base + at + 8 : base + at + 8 + 2 * n].decode("utf-16-le", "replace").split("\0")[0]
            elif kind == 3:
                value = str(struct.unpack_from("<i", data, base + at + 4)[0])
            elif kind == 64:
                ticks = struct.unpack_from("<Q", data, base + at + 4)[0]
                if not ticks:
                    continue
                from datetime import datetime, timedelta

                value = (datetime(1601, 1, 1) + timedelta(microseconds=ticks // 10)).strftime("%Y-%m-%d %H:%M:%S")
            else:
                continue
            if value.strip():
                out[field] = value.strip()
    except struct.error:
        pass
    return out


def clean(text: str) -> str:
    """Paragraph marks as line feeds, page breaks as blank lines, other control signs gone; cells parted by tabs."""
    text = re.sub("\x13[^\x14\x15]*\x14?", "", text).replace("\x15", "")
    text = text.replace("\r", "\n").replace("\x0b", "\n").replace("\x0c", "\n\n").replace("\x07\x07", "\n").replace("\x07", "\t")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[\x00-\x08\x0e-\x1f]", "", text)).strip()


def word_blocks(text: str) -> tuple[str, list[list[list[Cell]]]]:
    """Text with its tables as HTML: a cell ends with a bell, a row with two; rows that follow each other are a table, one alone is a line."""
    parts, tables, rows, lines = [], [], [], []

    def flush() -> None:
        """The rows so far as a table behind the lines before them."""
        if len(rows) > 1:
            tables.append([[Cell(c, header=k == 0) for c in r] for k, r in enumerate(rows)])
            parts.extend([clean("\n".join(lines)), as_html(tables[-1])])
            lines.clear()
        else:
            lines.extend("\t".join(r) for r in rows)
        rows.clear()

    for line in re.sub("\x07\x07\r?", "\x07\n", text).replace("\r", "\n").split("\n"):
        if "\x07" in line:
            cells = [clean(x) for x in line.split("\x07")]
            rows.append(cells[:-1] if cells[-1] == "" else cells)
        else:
            flush()
            lines.append(line)
    flush()
    return "\n\n".join(p for p in (*parts, clean("\n".join(lines))) if p), tables


def word_text(c: Compound) -> tuple[str, list[list[list[Cell]]]]:
    """Text and tables by the piece table; text by runs of two-byte letters where there is none."""
    main = c.read("WordDocument") or b""
    if len(main) >= 426 and struct.unpack_from("<H", main, 0)[0] in (0xA5EC, 0xA5DC):
        table = c.read("1Table" if struct.unpack_from("<H", main, 10)[0] & 0x0200 else "0Table") or b""
        at, size = struct.unpack_from("<II", main, 418)
        clx, i, out = table[at : at + size], 0, []
        while i < len(clx):
            if clx[i] == 1:
                i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
                continue
            if clx[i] != 2:
                break
            n = struct.unpack_from("<I", clx, i + 1)[0]
            plc = clx[i + 5 : i + 5 + n]
            k = (n - 4) // 12
            cps = struct.unpack_from(f"<{k + 1}I", plc, 0)
            for j in range(k):
                fc = struct.unpack_from("<I", plc, 4 * (k + 1) + 8 * j + 2)[0]
                length = cps[j + 1] - cps[j]
                if fc & 0x40000000:
                    start = (fc & 0x3FFFFFFF) // 2
                    out.append(main[start : start + length].decode("cp1252", "replace"))
                else:
                    out.append(main[fc : fc + 2 * length].decode("utf-16-le", "replace"))
            break
        if out:
            return word_blocks("".join(out))
    return "\n".join(clean(m[0].decode("utf-16-le", "replace")) for m in re.finditer(rb"(?:[\x09\x0d\x20-\x7e]\x00|[\x00-\xff][\xac-\xd7]){8,}", main)), []


def slides_text(c: Compound) -> str:
    """Texts of a presentation in order of its records, with containers entered; a slide's tag before each slide."""
    data, out, number = c.read("PowerPoint Document") or b"", [], 0

    def scan(a: int, b: int, depth: int) -> None:
        nonlocal number
        while a + 8 <= b:
            head, kind, size = struct.unpack_from("<HHI", data, a)
            body, end = a + 8, min(a + 8 + size, b)
            if kind == 1006:
                number += 1
                out.append(f"[Slide Number: {number}]")
            if head & 0xF == 0xF and depth < 40:
                scan(body, end, depth + 1)
            elif kind in (4000, 4026):
                out.append(clean(data[body:end].decode("utf-16-le", "replace")))
            elif kind == 4008:
                out.append(clean(data[body:end].decode("cp1252", "replace")))
            a = end if end > a else b

    scan(0, len(data), 0)
    return "\n\n".join(t for t in out if t)


def workbook_cells(c: Compound) -> list[tuple[str, dict[tuple[int, int], str]]]:
    """Visible sheets of an old workbook: name, cells by row and column from 0."""
    data = c.read("Workbook") or c.read("Book") or b""
    records, i = [], 0
    while i + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, i)
        records.append((i, kind, data[i + 4 : i + 4 + size]))
        i += 4 + size
    strings: list[str] = []
    sheets: dict[int, str] = {}
    k = 0
    while k < len(records):
        _, kind, body = records[k]
        if kind == 0x85 and len(body) > 8 and body[4] & 3 == 0:
            n, wide = body[6], body[7] & 1
            sheets[struct.unpack_from("<I", body, 0)[0]] = body[8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")
        elif kind == 0xFC:
            parts = [body]
            while k + 1 < len(records) and records[k + 1][1] == 0x3C:
                k += 1
                parts.append(records[k][2])
            strings = _shared(parts)
        k += 1
    number = lambda v: str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)
    out: list[tuple[str, dict[tuple[int, int], str]]] = []
    cells: dict[tuple[int, int], str] | None = None
    for at, kind, body in records:
        if at in sheets:
            cells = {}
            out.append((sheets[at], cells))
        elif kind == 0x0A:
            cells = None
        elif cells is None or len(body) < 6:
            continue
        else:
            r, col = struct.unpack_from("<HH", body, 0)
            if kind == 0xFD and struct.unpack_from("<I", body, 6)[0] < len(strings):
                cells[r, col] = strings[struct.unpack_from("<I", body, 6)[0]]
            elif kind in (0x203, 0x06) and len(body) >= 14:
                if kind == 0x06 and body[12:14] == b"\xff\xff":
                    continue
                cells[r, col] = number(struct.unpack_from("<d", body, 6)[0])
            elif kind == 0x27E:
                cells[r, col] = number(_rk(struct.unpack_from("<I", body, 6)[0]))
            elif kind == 0xBD:
                for j in range((len(body) - 6) // 6):
                    cells[r, col + j] = number(_rk(struct.unpack_from("<I", body, 6 + 6 * j)[0]))
            elif kind == 0x204:
                n, wide = struct.unpack_from("<H", body, 6)[0], body[8] & 1
                cells[r, col] = body[9 : 9 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")
            elif kind == 0x205 and len(body) >= 8 and body[7] == 0:
                cells[r, col] = "TRUE" if body[6] else "FALSE"
    return out


def _rk(v: int) -> float:
    value = float((v >> 2) - (1 << 30 if v & 0x80000000 else 0)) if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return value / 100 if v & 1 else value


def _shared(parts: list[bytes]) -> list[str]:
    """The table of shared strings; a string may go on in the next record, which names its width anew."""
    out, part, at = [], 0, 8
    total = struct.unpack_from("<I", parts[0], 4)[0] if len(parts[0]) >= 8 else 0

    def take(n: int) -> bytes:
        nonlocal part, at
        got = b""
        while n:
            if at >= len(parts[part]):
                if part + 1 >= len(parts):
                    return got
                part, at = part + 1, 0
            piece = parts[part][at : at + n]
            got, at, n = got + piece, at + len(piece), n - len(piece)
        return got

    for _ in range(total):
        head = take(3)
        if len(head) < 3:
            break
        n, flags = struct.unpack("<HB", head)
        runs = struct.unpack("<H", take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", take(4))[0] if flags & 4 else 0
        text, wide = "", flags & 1
        while n:
            if at >= len(parts[part]):
                if part + 1 >= len(parts):
                    break
                part, at, wide = part + 1, 1, parts[part + 1][0] & 1
            size = min(n, (len(parts[part]) - at) // (1 + wide))
            if not size:
                break
            text += parts[part][at : at + size * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")
            at, n = at + size * (1 + wide), n - size
        take(4 * runs + extra)
        out.append(text)
    return out


#: Tags of records of a Hangul document.
PARAGRAPH, CONTROL, LIST, TABLE = 67, 71, 72, 77
Record = tuple[int, int, bytes]


def _records(data: bytes) -> list[Record]:
    """Tag, level and payload of the records of a section."""
    out, i = [], 0
    while i + 4 <= len(data):
        word = struct.unpack_from("<I", data, i)[0]
        tag, level, size = word & 0x3FF, word >> 10 & 0x3FF, word >> 20
        i += 4
        if size == 0xFFF and i + 4 <= len(data):
            size = struct.unpack_from("<I", data, i)[0]
            i += 4
        out.append((tag, level, data[i : i + size]))
        i += size
    return out


def _hangul_table(records: list[Record], tables: list) -> str:
    """A table out of the records below its control: one cell as its text, one column as paragraphs, else HTML."""
    shape = next((r[2] for r in records if r[0] == TABLE and len(r[2]) >= 8), None)
    if shape is None:
        return ""
    n_rows, n_cols = struct.unpack_from("<HH", shape, 4)
    level, cells, at = records[0][1], [], None
    for k, (tag, depth, body) in enumerate(records):
        if tag == LIST and depth == level and len(body) >= 16:
            cells.append((*struct.unpack_from("<4H", body, 8), k + 1))
    ends = [c[4] - 1 for c in cells[1:]] + [len(records)]
    texts = {(row, col): (_hangul_body(records[at:end], tables).strip(), high, wide) for (col, row, wide, high, at), end in zip(cells, ends)}
    if (n_rows, n_cols) == (1, 1):
        return texts.get((0, 0), ("",))[0]
    if n_cols == 1:
        return "\n\n".join(t for _, (t, _, _) in sorted(texts.items()) if t)
    rows = [[Cell(texts[r, c][0], max(1, texts[r, c][1]), max(1, texts[r, c][2]), r == 0) for c in range(n_cols) if (r, c) in texts] for r in range(n_rows)]
    tables.append(rows)
    return as_html(rows)


def _hangul_body(records: list[Record], tables: list) -> str:
    """Paragraphs and tables in order; what a table holds belongs to its cells."""
    out, k = [], 0
    while k < len(records):
        tag, level, body = records[k]
        k += 1
        if tag == PARAGRAPH:
            out.append(_hangul_paragraph(body))
        elif tag == CONTROL and body[:4][::-1] == b"tbl ":
            end = next((j for j in range(k, len(records)) if records[j][1] <= level), len(records))
            try:
                out.append(_hangul_table(records[k:end], tables) if k < end else "")
            except struct.error:
                out.append("[Table Extraction Failed]")
            k = end
    return "\n".join(out)


def hangul_text(c: Compound) -> tuple[str, list[list[list[Cell]]]]:
    """Paragraphs and tables of the sections of a Hangul document; where no section can be read, what looks like text in them."""
    head = c.read("FileHeader") or b""
    packed = len(head) > 36 and struct.unpack_from("<I", head, 36)[0] & 1
    names = sorted((n for n in c.streams if re.fullmatch(r"BodyText/Section\d+", n)), key=lambda n: int(re.sub(r"\D", "", n)))
    out, tables, broken = [], [], []
    for name in names:
        data = c.read(name) or b""
        if packed:
            try:
                data = zlib.decompress(data, -15)
            except zlib.error:
                broken.append(data)
                continue
        out.append(_hangul_body(_records(data), tables))
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()
    return text or "\n".join(filter(None, map(recovered, broken))), tables


def recovered(data: bytes) -> str:
    """What looks like text in a broken section: in what of it unpacks, from wherever that can start, else in the bytes as they are."""
    found = []
    for start in (0, *(m.start() for m in re.finditer(rb"\x78[\x01\x9c\xda]", data))):
        for window in (-15, 15):
            unpack, got = zlib.decompressobj(window), b""
            try:
                for k in range(start, len(data), 64):
                    got += unpack.decompress(data[k : k + 64])
            except zlib.error:
                pass
            found.append(got)
    raw = max(found, key=len, default=b"") or data
    runs = re.findall(rb"(?:[\x20-\x7e]\x00|[\x00-\xff][\xac-\xd7\x31]){4,}", raw)
    return "\n".join(t for t in (r.decode("utf-16-le", "ignore").strip() for r in runs) if t)


def _hangul_paragraph(raw: bytes) -> str:
    out, i = [], 0
    while i + 1 < len(raw):
        code = struct.unpack_from("<H", raw, i)[0]
        if code in (10, 13, 24, 25, 26, 27, 28, 29, 30, 31, 0):
            out.append("\n" if code == 10 else "")
            i += 2
        elif code < 32:
            out.append("\t" if code == 9 else "")
            i += 16
        else:
            out.append(raw[i : i + 2].decode("utf-16-le", "replace") if not 0xD800 <= code < 0xDC00 else raw[i : i + 4].decode("utf-16-le", "replace"))
            i += 4 if 0xD800 <= code < 0xDC00 else 2
    return "".join(out)
