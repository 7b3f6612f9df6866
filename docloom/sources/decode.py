"""Bytes to text: marks of order first, then declared encodings, then candidates, at last with replacement."""

from __future__ import annotations

import codecs
import re

#: Encodings tried in turn where nothing else tells.
CANDIDATES = ("utf-8", "cp949", "euc-kr", "latin-1", "ascii", "utf-16")
#: The longer marks first, as one of them begins like a shorter one.
BOMS = ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))
_CHARSET = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)


def decode(data: bytes, declared: str | None = None, candidates: tuple[str, ...] = CANDIDATES) -> tuple[str, str]:
    """The text and the encoding that it was read in; line ends become line feeds."""
    for mark, encoding in BOMS:
        if data.startswith(mark):
            return _lines(data[len(mark) :].decode(encoding, "replace")), encoding
    for encoding in ((declared,) if declared else ()) + candidates:
        try:
            return _lines(data.decode(encoding)), encoding
        except (UnicodeDecodeError, LookupError):
            continue
    return _lines(data.decode("utf-8", "replace")), "utf-8"


def decode_html(data: bytes) -> tuple[str, str]:
    """As ``decode``, with the character set that the page's head declares."""
    m = _CHARSET.search(data[:2048])
    return decode(data, m[1].decode("ascii") if m else None)


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")
