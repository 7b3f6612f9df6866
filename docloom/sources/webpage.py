"""HTML pages: text in order with headings, lists, links, code and tables; title and metadata."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from docloom.sources.grid import Cell, as_html

SKIPPED = frozenset("script style noscript template svg math head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Names of metadata and the fields they fill.
FIELDS = {"author": "author", "creator": "author", "dc.creator": "author", "dc.title": "title", "description": "subject", "dc.description": "subject", "keywords": "keywords", "generator": "last_saved_by", "og:title": "title"}


class Page(HTMLParser):
    """A page read once: parts of text, tables and metadata."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.tables: list[list[list[Cell]]] = []
        self.meta: dict[str, str] = {}
        self.stack: list[tuple[str, list, dict]] = []
        self.lists: list[list] = []
        self.open_tables: list[list[list[Cell]]] = []
        self.title = ""

    def _skipping(self) -> bool:
        return any(t in SKIPPED for t, _, _ in self.stack)

    def handle_starttag(self, tag, attrs):
        at = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (at.get("name") or at.get("property") or "").lower()
            if name in FIELDS and at.get("content"):
                self.meta.setdefault(FIELDS[name], at["content"].strip())
        if tag in VOID:
            if not self._skipping():
                if tag == "br":
                    self._inline("\n")
                elif tag == "hr":
                    self._flush("---")
                elif tag == "img" and at.get("alt"):
                    self._inline(f"[Image: {at['alt']}]")
            return
        if tag in ("li", "p", "tr", "td", "th", "dt", "dd", "option"):
            self._implied(tag)
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
        elif tag == "table":
            self.open_tables.append([])
        elif tag == "tr" and self.open_tables:
            self.open_tables[-1].append([])
        self.stack.append((tag, [], at))

    def _implied(self, tag: str) -> None:
        closes = {"li": {"li", "p"}, "p": {"p"}, "tr": {"td", "th", "tr", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}.get(tag, {tag})
        while self.stack and self.stack[-1][0] in closes:
            self._close()

    def handle_endtag(self, tag):
        if any(t == tag for t, _, _ in self.stack):
            while self._close() != tag:
                pass

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "title":
            self.title += data
        elif not self._skipping() and (data.strip() or any(t == "pre" for t, _, _ in self.stack)):
            keep = any(t in ("pre", "code") for t, _, _ in self.stack)
            self._inline(data if keep else " ".join(data.split()))

    def _holder(self) -> list | None:
        for tag, held, _ in reversed(self.stack):
            if re.fullmatch(r"h[1-6]|li|a|pre|code|blockquote|td|th|caption", tag):
                return held
        return None

    def _inline(self, text: str) -> None:
        held = self._holder()
        if held is not None:
            held.append(text)
        elif text.strip():
            self.parts.append(text.strip())

    def _flush(self, text: str) -> None:
        held = self._holder()
        (self.parts if held is None else held).append(text)

    def _close(self) -> str:
        tag, held, at = self.stack.pop()
        if self._skipping() or tag in SKIPPED:
            return tag
        text = " ".join(x for x in (h.strip(" ") for h in held) if x).strip()
        if re.fullmatch(r"h[1-6]", tag) and text:
            self._flush("#" * int(tag[1]) + " " + text)
        elif tag == "li" and self.lists:
            kind, n = self.lists[-1]
            if text:
                self._flush(f"{n}. {text}" if kind == "ol" else f"- {text}")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "a" and text:
            href = at.get("href", "")
            self._flush(text if not href or href.startswith("#") or href.lower().startswith("javascript:") else f"[{text}]({href})")
        elif tag == "pre" and "".join(held).strip():
            self._flush("```\n" + "".join(held).strip("\n") + "\n```")
        elif tag == "code" and text:
            self._flush(text if any(t == "pre" for t, _, _ in self.stack) else f"`{text}`")
        elif tag == "blockquote" and text:
            self._flush("\n".join("> " + x for x in text.split("\n")))
        elif tag in ("td", "th") and self.open_tables:
            if not self.open_tables[-1]:
                self.open_tables[-1].append([])
            span = lambda k: int(at[k]) if at.get(k, "").isdigit() and int(at[k]) > 0 else 1
            self.open_tables[-1][-1].append(Cell(text, span("rowspan"), span("colspan"), tag == "th"))
        elif tag == "table" and self.open_tables:
            rows = [r for r in self.open_tables.pop() if r]
            if rows:
                self.tables.append(rows)
                self._flush(as_html(rows))
        elif text and tag == "caption":
            self._flush(text)
        return tag


def read(source: str) -> Page:
    page = Page()
    page.feed(source)
    page.close()
    while page.stack:
        page._close()
    if page.title.strip():
        page.meta["title"] = " ".join(page.title.split())
    return page


def text_of(source: str) -> str:
    """The text of a page, its parts parted by blank lines."""
    return "\n\n".join(p for p in read(source).parts if p.strip())
