"""Rich text: text in order with tables, and the fields of its info group."""

from __future__ import annotations

import re

from docloom.sources.grid import Cell, as_html

#: Groups that hold no text of the body.
DESTINATIONS = frozenset("fonttbl colortbl stylesheet info pict object header footer headerl headerr footerl footerr footnote listtable listoverridetable rsidtbl generator themedata datastore latentstyles xmlnstbl mmathPr operator shppict nonshppict fldinst bkmkstart bkmkend filetbl revtbl".split())
SIGNS = {"par": "\n", "line": "\n", "tab": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "page": "\n", "sect": "\n"}
_TOKEN = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def _clean(source: str) -> str:
    return re.sub(r"\\bin(\d+) ", "", source)


def read(data: bytes) -> tuple[str, list[list[list[Cell]]], dict[str, str]]:
    """Text with tables in place, the tables, and metadata."""
    source = _clean(data.decode("latin-1"))
    if not source.lstrip().startswith("{\\rtf"):
        raise ValueError("no rich text")
    m = re.search(r"\\ansicpg(\d+)", source)
    page = f"cp{m[1]}" if m else "cp1252"
    out: list[str] = []
    tables: list[list[list[Cell]]] = []
    rows: list[list[Cell]] = []
    row: list[str] = []
    cell: list[str] = []
    stack: list[tuple[bool, int]] = []
    hidden, skip, uc, in_table, pending, raw = False, 0, 1, False, False, bytearray()

    def say(text: str) -> None:
        (cell if in_table else out).append(text)

    def flush_raw() -> None:
        nonlocal raw
        if raw:
            say(raw.decode(page, "replace"))
            raw = bytearray()

    def end_table() -> None:
        nonlocal rows
        if rows:
            if max(len(r) for r in rows) >= 2:
                tables.append(rows)
                out.append("\n\n" + as_html(rows) + "\n\n")
            else:
                out.append("\n".join(c.text for r in rows for c in r) + "\n")
            rows = []

    for m in _TOKEN.finditer(source):
        word, number, code, sign, brace, text = m.groups()
        if code is None:
            flush_raw()
        if brace == "{":
            stack.append((hidden, uc))
            pending = True
            continue
        if brace == "}":
            hidden, uc = stack.pop() if stack else (False, 1)
            continue
        if word:
            if pending and word in DESTINATIONS:
                hidden = True
            pending = False
            if hidden:
                continue
            if word == "u" and number:
                say(chr(int(number) & 0xFFFF))
                skip = uc
            elif word == "uc" and number:
                uc = int(number)
            elif word == "trowd":
                in_table = True
                row, cell = [], []
            elif word == "cell":
                row.append("".join(cell).strip())
                cell = []
            elif word == "row":
                rows.append([Cell(t, header=not rows) for t in row])
                row, cell, in_table = [], [], False
            elif word == "pard" and not in_table:
                end_table()
            elif word in SIGNS:
                say(SIGNS[word])
        elif code:
            pending = False
            if not hidden:
                if skip:
                    skip -= 1
                else:
                    raw.append(int(code, 16))
        elif sign:
            if sign == "*":
                hidden = True
            elif not hidden and sign in "\\{}~-_":
                say({"~": "\xa0", "-": "", "_": "-"}.get(sign, sign))
            pending = False
        elif text and not hidden:
            pending = False
            if skip:
                n = min(skip, len(text))
                text, skip = text[n:], skip - n
            if not in_table and text.strip():
                end_table()
            say(text)
    flush_raw()
    end_table()
    info = {f: v.strip() for f, v in ((f, re.search(rf"\{{\\{k} ([^{{}}]*)\}}", source)) for k, f in (("title", "title"), ("subject", "subject"), ("author", "author"), ("keywords", "keywords"), ("doccomm", "comments"), ("operator", "last_saved_by"))) if v for v in (v[1],) if v.strip()}
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip(), tables, info
