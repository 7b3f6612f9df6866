"""Markup residue to clean text with its structure, by consensus paths of each host.

Each page is parsed once, into pieces of text that stand in containers, and kept in that form. A page votes for
or against the generalised path of tags and classes of each of its containers, by the text they hold in and
outside of links; the votes are counted over all pages of a host in Spark. The pieces of a page are then put
together again along the paths that won on its host, so that menus and the like go whatever a single page looks
like. Markdown, wiki and LaTeX in them become the same plain forms as HTML: headings as ``# ``, list items as
``- `` or ``1. ``, code between fences, formulas between ``$``; which kinds there were is told on the way.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.tables import bounded_batches, stored

HTML, MARKDOWN, WIKI, LATEX = "html", "markdown", "wiki", "latex"
#: The elements of HTML and MathML; what else stands between angle brackets is no tag.
TAGS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt "
    "em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark marquee menu meta meter nav nobr noframes "
    "noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea "
    "tfoot th thead time title tr track tt u ul var video wbr math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover mtable mtr mtd semantics annotation ref references nowiki syntaxhighlight gallery".split()
)
CONTAINERS = frozenset("html body div main article section nav header footer aside form td center table".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote tr th caption title figure figcaption hr address fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head".split())

#: What a tag's name is followed by: attributes, with signs of tags only within quotes, or whatever else there is up to its end.
_REST = r"""(?:\s(?:[^<>"']|"[^"<]*"|'[^'<]*')*|\s[^<>]*|/)?"""
_TAG = re.compile(rf"</?([A-Za-z][A-Za-z0-9]*){_REST}>")
_TOKEN = re.compile(rf"<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9]*)(?P<rest>{_REST})>|<!DOCTYPE\b[^>]*>|<\?xml\b[^>]*>", re.IGNORECASE)
_ESCAPED = re.compile(r"&lt;/?([A-Za-z][A-Za-z0-9]*)(?:\s(?:(?!&lt;)[^<>])*?)?/?&gt;")
_REFERENCE = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|alt)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
#: What holds no signs of markup: scripts, styles, comments and samples of code.
_OPAQUE = re.compile(
    r"<(?P<tag>script|style|pre|code|syntaxhighlight|source|nowiki|samp|kbd|tt|textarea)\b[^>]*>(?P<inner>.*?)(?:</(?P=tag)\s*>|\Z)"
    r"|(?P<comment><!--.*?(?:-->|\Z))"
    r"|(?:^|(?<=>))(?P<fence>[ ]{0,3}(?P<ticks>`{3,}|~{3,})[^\n`<]*)\r?\n(?P<fenced>.*?)(?:^[ ]{0,3}(?P=ticks)[`~]*(?=[ \t]*\r?$|[ \t]*<)|\Z)"
    r"|\\begin\{(?P<env>verbatim|lstlisting|minted)\*?\}(?P<verbatim>.*?)(?:\\end\{(?P=env)\*?\}|\Z)"
    r"|(?P<tick>``?)(?!`)(?P<inline>[^`\n]+)(?P=tick)",
    re.IGNORECASE | re.DOTALL | re.MULTILINE,
)
_MARKDOWN = re.compile(
    r"^[ ]{0,3}#{1,6}[ \t]+\S|^[ ]{0,3}(?!\s)(?=[^\n]*[^\s|=-])[^\n]+\n[ ]{0,3}(?:={3,}|-{3,})[ \t]*\r?$|\*\*[^\s*][^*\n]*\*\*|!?\[[^\[\]\n]*\]\((?!\s)[^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)"
    r"|^[ ]{0,3}>[ \t]+\S|^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[ \t:|-]*\r?$|^[ ]{0,3}\[[^\]\n]+\]:[ \t]+\S+",
    re.MULTILINE,
)
_WIKI = re.compile(
    r"^={2,6}[ \t]*[^=\s][^=\n]*={2,6}[ \t]*\r?$|\[\[(?=[^\[\]\n]*[^\W\d_])[^\[\]\n]+\]\]|'''?[^'\n]+'''?(?!')|\{\{(?!\{)[#A-Za-z][^{}\n]*\}\}|^\{\|.*$|\[(?:https?|ftp)://[^\s\]]+[ \t]+[^\]\n]+\]|<ref\b|__(?:TOC|NOTOC)__",
    re.MULTILINE,
)
_LATEX = re.compile(
    r"\\(?:[a-zA-Z]{2,})\*?(?:\[[^\]\n]*\])?\{|\\item\b|\\\((?:(?!\\\()[^\n])*?\\\)|\\\[(?:(?!\\\[).)*?\\\]|\$\$[^$]+\$\$|(?<![\w$])\$(?![\s\d$])(?=[^$\n]*[\\^_{])[^$\n]+(?<!\s)\$(?!\d)|\\[\"'`^~]\{?[a-zA-Z]\}?(?=\w)",
    re.DOTALL,
)
#: Stands for a sample of code while the text around it is worked on.
_MARK = "\ue000"
_SAMPLE = re.compile(f"{_MARK}(\\d+){_MARK}")
#: Kinds of pieces: text of the page, such in a link, signs that stand for tags, samples of code within a line or apart.
OWN, LINKED, SIGN, INLINE, APART = range(5)
#: Signs from which on a path is told by its digest, so that deep pages have no long paths.
LONGEST_PATH = 256
#: A page in pieces: the paths of its containers, and of each piece the path's number, kind and text.
Pieces = tuple[list[str], list[int], list[int], list[str]]


def _shielded(text: str, kinds: set[str]) -> tuple[str, list[tuple[int, str]]]:
    """The text with its samples of code out of the way, without scripts, styles and comments; and the samples."""
    kept: list[tuple[int, str]] = []
    text = text.replace(_MARK, "")
    if not ("<" in text or "`" in text or "~~~" in text or "\\begin{" in text):
        return text, kept

    def shield(m: re.Match) -> str:
        tag = (m["tag"] or "").lower()
        kinds.add(HTML if tag or m["comment"] else LATEX if m["env"] else MARKDOWN)
        if m["comment"]:
            return " "
        if tag in ("script", "style"):
            return "\n\n"
        if m["inline"]:
            kept.append((INLINE, f"`{m['inline']}`"))
            return f"{_MARK}{len(kept) - 1}{_MARK}"
        inner = m["inner"] if tag else m["fenced"] if m["fence"] else m["verbatim"]
        language = m["fence"].strip().strip("`~").strip() if m["fence"] else ""
        if tag:
            inner = html.unescape(_TAG.sub(lambda t: "" if t[1].lower() in TAGS else t[0], inner))
            if tag in ("code", "nowiki", "samp", "kbd", "tt") and "\n" not in inner:
                kept.append((INLINE, f"`{inner}`"))
                return f"{_MARK}{len(kept) - 1}{_MARK}"
        kept.append((APART, f"```{language}\n" + inner.strip("\r\n") + "\n```"))
        return f"{_MARK}{len(kept) - 1}{_MARK}"

    return _OPAQUE.sub(shield, text), kept


class _Page:
    """The pieces of a page while its tags are gone through."""

    def __init__(self, samples: list[tuple[int, str]]):
        self.samples = samples
        self.stack: list[str] = []
        #: Numbers of the paths of the open containers.
        self.within: list[int] = []
        self.paths: dict[str, int] = {"text": 0}
        self.names = ["text"]
        self.at: list[int] = []
        self.kinds: list[int] = []
        self.texts: list[str] = []
        self.links = self.hidden = self.cells = 0
        self.lists: list[int | None] = []
        #: Of each open superscript or subscript its sign, its depth and the parts so far.
        self.raised: list[list] = []

    def piece(self, kind: int, text: str) -> None:
        if self.hidden or not text:
            return
        at = self.within[-1] if self.within else 0
        if self.at and self.at[-1] == at and self.kinds[-1] == kind and kind < INLINE:
            self.texts[-1] += text
        else:
            self.at.append(at)
            self.kinds.append(kind)
            self.texts.append(text)

    def sign(self, text: str) -> None:
        self.piece(SIGN, text)

    def data(self, text: str) -> None:
        if self.hidden or not text:
            return
        kind = LINKED if self.links else OWN
        if _MARK not in text:
            self.piece(kind, text)
            return
        parts = text.split(_MARK)
        for k, part in enumerate(parts):
            if k % 2 and part.isdigit() and int(part) < len(self.samples):
                self.piece(*self.samples[int(part)])
            else:
                self.piece(kind, part)

    def open(self, tag: str, rest: str) -> None:
        if tag in BLOCKS:
            self._close_implied(tag)
        if tag in VOID:
            if tag == "br":
                self.sign("\n")
            elif tag == "hr":
                self.sign("\n\n---\n\n")
            elif tag == "img" and (alt := _attribute(rest, "alt")):
                self.sign(f"[Image: {html.unescape(alt)}]")
            return
        self.stack.append(tag)
        if tag in CONTAINERS:
            name = re.sub(r"[0-9]+", "", _attribute(rest, "class")).lower()
            step = tag + "".join("." + c for c in sorted(name.split()))
            path = f"{self.names[self.within[-1]]}>{step}" if self.within else step
            if len(path) > LONGEST_PATH:
                path = hashlib.sha256(path.encode("utf-8", "surrogatepass")).hexdigest()
            number = self.paths.setdefault(path, len(self.names))
            if number == len(self.names):
                self.names.append(path)
            self.within.append(number)
        if self.raised and len(self.stack) == self.raised[-1][1] + 1 and tag in ("mi", "mn", "mo", "mrow", "mtext"):
            self.raised[-1][2] += 1
            if self.raised[-1][2] == 2:
                self.sign(self.raised[-1][0])
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "a":
            self.links += 1
        elif tag in ("ul", "ol", "menu", "dir"):
            self.lists.append(0 if tag == "ol" else None)
            self.sign("\n")
        elif tag == "li":
            indent = "  " * max(0, len(self.lists) - 1)
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.sign(f"\n{indent}{self.lists[-1]}. ")
            else:
                self.sign(f"\n{indent}- ")
        elif tag in ("td", "th"):
            self.sign(" | " if self.cells else "")
            self.cells += 1
        elif tag in ("msup", "msub"):
            self.raised.append(["^" if tag == "msup" else "_", len(self.stack), 0])
        elif tag == "tr":
            self.cells = 0
            self.sign("\n")
        elif tag in _OPENING:
            self.sign(_OPENING[tag])
        elif tag in BLOCKS:
            self.sign("\n\n")

    def _close_implied(self, tag: str) -> None:
        stack = self.stack
        while stack and (stack[-1] == "p" or (tag == "li" and stack[-1] == "li") or (tag == "tr" and stack[-1] in ("td", "th", "tr")) or (tag in ("td", "th") and stack[-1] in ("td", "th"))):
            self._pop()

    def _pop(self) -> str:
        tag = self.stack.pop()
        if tag in HIDDEN:
            self.hidden -= 1
        elif tag == "a":
            self.links -= 1
        elif tag in ("ul", "ol", "menu", "dir"):
            if self.lists:
                self.lists.pop()
            self.sign("\n")
        elif tag == "math":
            self.sign("$")
        elif tag in ("msup", "msub"):
            self.raised.pop()
        elif tag == "tr":
            self.sign("\n")
        elif tag in BLOCKS and tag not in ("li", "td", "th"):
            self.sign("\n\n")
        if tag in CONTAINERS:
            self.within.pop()
        return tag

    def close(self, tag: str) -> None:
        if tag in self.stack:
            while self._pop() != tag:
                pass


#: Signs that stand for the opening of an element.
_OPENING = {**{f"h{k}": "\n\n" + "#" * k + " " for k in range(1, 7)}, "math": "$", "blockquote": "\n\n> "}


def _attribute(rest: str, name: str) -> str:
    """The value of an attribute out of what follows a tag's name; an empty string for none."""
    if name in rest.lower():
        for m in _ATTRIBUTE.finditer(rest):
            if m[1].lower() == name:
                return m[2].strip("\"'")
    return ""


def parsed(text: str) -> tuple[Pieces, set[str]]:
    """A page in pieces, and the kinds of markup of its tags, references and samples of code."""
    kinds: set[str] = set()
    source, samples = _shielded(text, kinds)
    if "&lt;" in source and any(m[1].lower() in TAGS for m in _ESCAPED.finditer(source)):
        kinds.add(HTML)
        if not any(m["tag"] and m["tag"].lower() in TAGS for m in _TOKEN.finditer(source)):
            # the text of a page that was escaped as a whole
            source, samples = _shielded(html.unescape(text), kinds)
    source = source.replace("\r\n", "\n")
    page, at = _Page(samples), 0
    references = "&" in source and any(m[1] is None or m[1] + ";" in html5 for m in _REFERENCE.finditer(source))
    if references:
        kinds.add(HTML)
    read: Callable[[str], str] = html.unescape if references else str
    if "<" in source:
        for m in _TOKEN.finditer(source):
            tag = m["tag"]
            if tag is not None:
                tag = tag.lower()
                if tag not in TAGS:
                    continue
            page.data(read(source[at : m.start()]))
            at = m.end()
            kinds.add(HTML)
            if tag is None:
                page.data(" ")
            elif m["end"]:
                page.close(tag)
            else:
                page.open(tag, m["rest"])
    page.data(read(source[at:]))
    while page.stack:
        page._pop()
    return (page.names, page.at, page.kinds, page.texts), kinds


def scores(pieces: Pieces) -> list[int]:
    """Of each path of a page its score: signs outside of links less twice those within."""
    names, at, kinds, texts = pieces
    out = [0] * len(names)
    for k, kind, text in zip(at, kinds, texts):
        if kind != SIGN:
            out[k] += len(text.strip()) * (-2 if kind == LINKED else 1)
    return out


def kinds_within(pieces: Pieces, chosen: list[bool]) -> set[str]:
    """Markdown, wiki and LaTeX in the page's own text along some of its paths; samples of code don't count."""
    _, at, kinds, texts = pieces
    view = []
    for k, kind, text in zip(at, kinds, texts):
        if not chosen[k]:
            if not view or view[-1] != "\n":
                view.append("\n")
        elif kind in (OWN, LINKED):
            view.append(text)
        elif kind == SIGN:
            if "\n" in text:
                view.append("\n")
        else:
            view.append(" " if kind == INLINE else "\n\n")
    return signs_in("".join(view))


def signs_in(text: str) -> set[str]:
    """Markdown, wiki and LaTeX in text without tags and samples."""
    found: set[str] = set()
    for kind, signs, pattern in ((MARKDOWN, "#=-*[>|", _MARKDOWN), (WIKI, "=[\'{_<", _WIKI), (LATEX, "\\$", _LATEX)):
        if any(s in text for s in signs) and pattern.search(text):
            found.add(kind)
    return found


def kinds_of(text: str) -> set[str]:
    """The kinds of markup in a text, apart from what scripts, styles, comments and samples of code hold."""
    pieces, kinds = parsed(text)
    return kinds | kinds_within(pieces, [True] * len(pieces[0]))


def extracted(pieces: Pieces, kinds: set[str], winning: set[int] | None) -> tuple[str, set[str]]:
    """The clean text of a page and all kinds of markup in it: the pieces whose path won on its host, all where none did.

    What stands along the other paths goes; its kinds still count.
    """
    names, at, what, texts = pieces
    chosen = [winning is not None and k in winning for k in range(len(names))]
    if not any(chosen[k] for k in at):
        chosen = [True] * len(names)
    kinds = kinds | kinds_within(pieces, chosen)
    if not all(chosen[k] for k in at):
        kinds = kinds | kinds_within(pieces, [not c for c in chosen])
    out, kept, tagged = [], [], HTML in kinds
    for k, kind, text in zip(at, what, texts):
        if not chosen[k]:
            continue
        if kind >= INLINE:
            kept.append(text)
            mark = f"{_MARK}{len(kept) - 1}{_MARK}"
            out.append(mark if kind == INLINE else f"\n\n{mark}\n\n")
        else:
            if tagged and kind != SIGN:
                # blanks beside line ends mean nothing between tags
                text = _unindented(text) if "\n" in text else text
                text = text.lstrip(" \t") if out and out[-1].endswith("\n") else text
            if text:
                out.append(text)
    clean = plain("".join(out))
    if kept:
        clean = _SAMPLE.sub(lambda m: kept[int(m[1])], clean)
    return clean.strip(), kinds


def _unindented(text: str) -> str:
    """The text without blanks beside its line feeds."""
    first, *rest = text.split("\n")
    return "\n".join([first.rstrip(" \t"), *(x.strip(" \t") for x in rest[:-1]), *(x.lstrip(" \t") for x in rest[-1:])])


def extract(text: str, winning: set[str] | None) -> str:
    """The clean text of one page along paths by their names."""
    pieces, kinds = parsed(text)
    return extracted(pieces, kinds, None if winning is None else {k for k, n in enumerate(pieces[0]) if n in winning})[0]


#: Commands that go with their argument, and those of which the argument stays.
_GONE = re.compile(r"~?\\(?:cite[tp]?|ref|eqref|label|pageref)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
_WRAPPED = re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|text|mathrm|footnote|title|author|caption)\*?\{|[{}]")


def _unwrapped(text: str) -> str:
    """Text without the commands around it that say how it looks, however deep they stand in each other."""
    out, at, opened = [], 0, []
    for m in _WRAPPED.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "}" and opened:
            start = opened.pop()
            out.append("" if start is not None else "}")
        else:
            if m[0] != "}":
                opened.append(len(out) if len(m[0]) > 1 else None)
            out.append(m[0])
            if m[0] != "}" and len(m[0]) > 1:
                opened[-1] = len(out) - 1
            continue
        if start is not None:
            out[start] = ""
    return "".join([*out, text[at:]])


def plain(text: str) -> str:
    """Markdown, wiki and LaTeX in plain forms; headings, lists, code and formulas stay recognisable."""
    t = text.replace("\r\n", "\n").replace("\xa0", " ")
    # wiki
    if "==" in t:
        t = re.sub(r"^(={2,6})[ \t]*([^=\s][^=\n]*?)[ \t]*={2,6}[ \t]*$", lambda m: "#" * len(m[1]) + " " + m[2], t, flags=re.M)
    if "[[" in t:
        t = re.sub(r"\[\[(?:File|Image|Category)?:?(?:[^\[\]\n|]*\|)*([^\[\]\n|]+)\]\]", r"\1", t)
    if "''" in t:
        t = re.sub(r"'''?([^'\n]+)'''?", r"\1", t)
    if "{{" in t:
        t = re.sub(r"\{\{(?!\{)[#A-Za-z][^{}\n]*\}\}", "", t)
    if "|-" in t or "|}" in t or "{|" in t:
        t = re.sub(r"^\{\|.*$|^\|[-}].*$", "", t, flags=re.M)
    if "||" in t or "!!" in t:
        t = re.sub(r"^[|!]([^\n]*?(?:\|\||!!)[^\n]*)$", lambda m: " | ".join(x.strip() for x in re.split(r"\|\||!!", m[1])), t, flags=re.M)
    if "://" in t:
        t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+[ \t]+([^\]\n]+)\]", r"\1", t)
    if "\\" in t:
        t = _typeset(t)
    pieces = re.split(r"(\$\$.+?\$\$|\$[^$\n]+\$)", t, flags=re.S) if "$" in t else [t]
    for k in range(0, len(pieces), 2):
        p = pieces[k]
        if "\\" in p:
            p = _GONE.sub("", p)
            p = _unwrapped(p)
            p = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?", "", p)
        # Markdown
        if "](" in p:
            p = re.sub(r"!\[([^\[\]\n]*)\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)", r"[Image: \1]", p)
            p = re.sub(r"\[([^\[\]\n]*)\]\((?!\s)[^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)", r"\1", p)
        if "**" in p:
            p = re.sub(r"\*\*([^\s*][^*\n]*)\*\*", r"\1", p)
        if "\n===" in p or "\n---" in p or "\n " in p:
            p = re.sub(r"^([ ]{0,3}\S[^\n]*)\n[ ]{0,3}(={3,}|-{3,})[ \t]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1].strip(), p, flags=re.M)
        if "|" in p:
            p = re.sub(r"^[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*\|[ \t:|-]*$\n?", "", p, flags=re.M)
            p = re.sub(r"^[ \t]*\|([^\n]*)\|[ \t]*$", lambda m: " | ".join(x.strip() for x in m[1].split("|")), p, flags=re.M)
        if "* " in p or "+ " in p or "*\t" in p or "+\t" in p:
            p = re.sub(r"^([ \t]*)[*+][ \t]+", r"\1- ", p, flags=re.M)
        if ">" in p:
            p = re.sub(r"^[ ]{0,3}>[ \t]+", "", p, flags=re.M)
        pieces[k] = p
    t = "".join(pieces)
    if " \n" in t or "\t\n" in t:
        t = "\n".join(line.rstrip(" \t") for line in t.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def _typeset(t: str) -> str:
    """LaTeX headings, lists and formulas in plain forms."""
    t = re.sub(r"\\(?:sub)*section\*?\{([^{}\n]*)\}", lambda m: "\n" + "#" * (1 + m[0].count("sub")) + f" {m[1]}\n", t)
    t = re.sub(r"\\(?:chapter|part)\*?\{([^{}\n]*)\}", r"\n# \1\n", t)
    t = re.sub(r"\\begin\{(?:equation|align|gather|displaymath|eqnarray)\*?\}((?:(?!\\begin\{(?:equation|align|gather|displaymath|eqnarray)\*?\}).)*?)\\end\{(?:equation|align|gather|displaymath|eqnarray)\*?\}", lambda m: f"\n$${m[1].strip()}$$\n", t, flags=re.S)
    t = re.sub(r"\\\[((?:(?!\\\[).)*?)\\\]", lambda m: f"$${m[1].strip()}$$", t, flags=re.S)
    t = re.sub(r"\\\(((?:(?!\\\()[^\n])*?)\\\)", lambda m: f"${m[1].strip()}$", t)
    number = 0

    def item(m: re.Match) -> str:
        nonlocal number
        if m["open"]:
            number = 1 if m["open"] == "enumerate" else 0
            return ""
        if m["item"]:
            if number:
                number += 1
                return f"{number - 1}. "
            return "- "
        number = 0
        return ""

    return re.sub(r"\\begin\{(?P<open>itemize|enumerate|description)\}(?:\[[^\]\n]*\])?|(?P<close>\\end\{(?:itemize|enumerate|description)\})|(?P<item>\\item\b[ \t]*)", item, t)


def _hosts(files: DataFrame) -> DataFrame:
    """``file_id, host``: the share and site that a file lies in; one row for each file."""
    host = F.regexp_extract("file_path", r"^(/[^/]+/[^/]+/[^/]+)/", 1)
    named = files.where(F.col("file_path").isNotNull() & F.col("file_id").isNotNull())
    return named.groupBy("file_id").agg(F.min("file_path").alias("file_path")).select("file_id", host.alias("host"))


_PIECES = "page bigint, html_id bigint, file_id bigint, digest binary, paths array<string>, scores array<bigint>, kinds array<string>, at array<int>, what array<tinyint>, texts array<string>"


def in_pieces(pages: DataFrame) -> DataFrame:
    """Each page parsed once, kept in the shared folder: its key, paths with scores, kinds of its tags, and pieces.

    A page has a number of its own here, so that ids that are null or come again part nothing and join nothing.
    """
    source = pages.select(F.monotonically_increasing_id().alias("page"), F.col("html_id").cast("bigint").alias("html_id"), F.col("file_id").cast("bigint").alias("file_id"), F.unhex(F.sha2("html_text", 256)).alias("digest"), "html_text")
    names = [x.split()[0] for x in _PIECES.split(", ")]
    lists = [pa.list_(k) for k in (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int8(), pa.string())]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns: list[list] = [[] for _ in lists]
            for text in part.column(4).to_pylist():
                if text is None:
                    got = [None] * 6
                else:
                    pieces, kinds = parsed(text)
                    got = [pieces[0], scores(pieces), sorted(kinds), *pieces[1:]]
                for c, v in zip(columns, got):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *(pa.array(c, k) for c, k in zip(columns, lists))], names)

    return stored(bounded_batches(source).mapInArrow(run, _PIECES))


def votes(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """``page, no, host, path, score`` of each container that a page has text in; a page without a file has the empty host."""
    each = pieces.select("page", "file_id", F.posexplode(F.arrays_zip("paths", "scores")).alias("no", "x")).select("page", "file_id", "no", F.col("x.paths").alias("path"), F.col("x.scores").alias("score")).where("score <> 0")
    # a page without a file needs no join, so such pages are no hot key
    without = each.where("file_id IS NULL").withColumn("host", F.lit(""))
    hosted = each.where("file_id IS NOT NULL").join(_hosts(files), "file_id", "left").withColumn("host", F.coalesce("host", F.lit("")))
    return hosted.unionByName(without).drop("file_id")


def winners(voted: DataFrame) -> DataFrame:
    """``host, path``: the paths that more pages of a host vote for than against; where as many do, those with more text than links."""
    summed = voted.groupBy("host", "path").agg(F.sum(F.signum("score")).alias("pages"), F.sum("score").alias("score"))
    return summed.where("pages > 0 OR (pages = 0 AND score > 0)").select("host", "path")


def converted(pages: DataFrame, files: DataFrame) -> DataFrame:
    """``html_id, clean, markup``: the clean text of each page and the kinds of markup found in it.

    A page delivered twice counts once; two texts under one id give two rows. Null texts give null, empty
    and blank ones the empty text; a page without a file has the empty host. Votes are counted by host and
    path, and a page gets the winners among its own paths, so no host is gathered.
    """
    pieces = in_pieces(pages)
    # of equal deliveries the one with the least number, before any vote
    first = pieces.groupBy("html_id", "file_id", "digest").agg(F.min("page").alias("page")).select("page")
    voted = votes(pieces.select("page", "file_id", "paths", "scores").join(first, "page", "left_semi"), files)
    won = voted.join(winners(voted), ["host", "path"]).groupBy("page").agg(F.collect_list("no").alias("winning"))
    source = pieces.select("page", "html_id", "paths", "kinds", "at", "what", "texts").join(first.join(won, "page", "left"), "page")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            clean, kinds = [], []
            for paths, found, at, what, texts, winning in zip(*(part.column(k).to_pylist() for k in range(1, 7))):
                text, every = (None, set()) if texts is None else extracted((paths, at, what, texts), set(found), None if winning is None else set(winning))
                clean.append(text)
                kinds.append(sorted(every))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(clean, pa.string()), pa.array(kinds, pa.list_(pa.string()))], ["html_id", "clean", "markup"])

    picked = source.select("html_id", "paths", "kinds", "at", "what", "texts", "winning")
    return bounded_batches(picked).mapInArrow(run, "html_id bigint, clean string, markup array<string>")


def found(pages: DataFrame, files: DataFrame) -> DataFrame:
    """``html_id, markup``: each kind of markup in a page, once, as the extraction along the winning paths met it."""
    return converted(pages, files).select("html_id", F.explode("markup").alias("markup")).distinct()
