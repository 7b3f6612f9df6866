"""Chunk strategies for one text: recursive, by language, by page, around protected regions, by rows of tables.

Each is a function of a text; ``chunked`` applies the one that fits to every row of a DataFrame.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.operators.structure import TABLE_EXTENSIONS
from docloom.tables import bounded_batches

PLAIN = ("\n\n", "\n", " ", "")
#: Separators before which code is cut, by language; shared by extensions.
_C_LIKE = ("\nclass ", "\npublic ", "\nprivate ", "\nprotected ", "\nstatic ", "\nfunc ", "\nfunction ", "\nfn ", "\nfun ", "\nconst ", "\nlet ", "\nvar ", "\ninterface ", "\nstruct ", "\nenum ", "\nif ", "\nfor ", "\nwhile ", "\nswitch ")
LANGUAGES = {
    "py": ("\nclass ", "\ndef ", "\n\tdef ", "\n    def "), "rb": ("\nclass ", "\nmodule ", "\ndef ", "\nif ", "\nunless ", "\nwhile "),
    "html": ("<body", "<div", "<p", "<br", "<li", "<h1", "<h2", "<h3", "<h4", "<h5", "<h6", "<table", "<tr", "<ul", "<ol"),
    **dict.fromkeys("js ts java cpp c cs go rs php swift kt scala jsx tsx".split(), _C_LIKE),
}
PAGES = re.compile(r"\[(?:Page|Slide) Number: (\d+)(?:\s*\(OCR(?:\+Ref)?\))?\]")
SHEET = re.compile(r"\[Sheet: (.+?)\]")
FENCED_HTML = re.compile(r"```html.*?```", re.DOTALL)
_MARKDOWN_TABLE = r"(?:(?<=\n)|^)\|[^\n]+\|\n\|[-:|\s]+\|\n(?:\|[^\n]+\|(?:\n|$))+"
WHOLE = re.compile(
    r"\[chart\].*?\[/chart\]|\[textbox\].*?\[/textbox\]|<table[^>]*>.*?</table>|\[Document-Metadata\].*?\[/Document-Metadata\]|\[Image:[^\n]+?\]|" + PAGES.pattern.replace("(\\d+)", "\\d+") + r"|\[Sheet: [^\n]+?\]|" + _MARKDOWN_TABLE,
    re.DOTALL | re.IGNORECASE,
)
_MARK_ONLY = re.compile(r"\s*(?:\[(?:Page|Slide) Number: \d+[^\]]*\]|\[Sheet: [^\]]*\])\s*")


def recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = PLAIN) -> list[str]:
    """Pieces of at most ``size``: cut by the first separator found, small pieces put together again with up to
    ``overlap`` signs of the end of one at the start of the next, large ones cut by the next separator."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the chunk size")
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :] if sep in separators else ()
    if sep == "":
        return [text[i : i + size] for i in range(0, max(1, len(text) - overlap), size - overlap)] if text.strip() else []
    keep = sep.strip() != ""
    parts = [p for p in re.split(f"(?={re.escape(sep)})" if keep else re.escape(sep), text) if p]
    joint, out = "" if keep else sep, []
    # the pieces held for the next chunk, and how long they are together
    held: deque[str] = deque()
    gap, count = len(joint), 0

    def flush() -> None:
        chunk = joint.join(held).strip()
        if chunk:
            out.append(chunk)

    for p in parts:
        n = len(p)
        if n > size:
            flush()
            held.clear()
            count = 0
            out += recursive(p, size, overlap, rest or ("",))
            continue
        if held and count + gap + n > size:
            flush()
            while held and (count > overlap or count + gap + n > size):
                count -= len(held.popleft()) + (gap if held else 0)
        count += n + (gap if held else 0)
        held.append(p)
    flush()
    return out


def plain(text: str, size: int, overlap: int, extension: str = "") -> list[str]:
    """Chunks of a text without structure; HTML between fences stays whole, chunks of nothing but a mark go."""
    out, at = [], 0
    separators = LANGUAGES.get(extension.lower(), ()) + PLAIN
    for m in FENCED_HTML.finditer(text):
        out += recursive(text[at : m.start()], size, overlap, separators) + [m[0]]
        at = m.end()
    out += recursive(text[at:], size, overlap, separators)
    return [c for c in out if c.strip() and not _MARK_ONLY.fullmatch(c)] or ([text] if text.strip() else [])


def packed_table(table: str, size: int) -> list[str]:
    """The parts of an HTML table cut between rows, each with the header; the table itself if it fits or can't be cut."""
    rows = re.findall(r"<tr[^>]*>.*?</tr>", table, re.DOTALL | re.IGNORECASE)
    head = [r for r in rows[:1] if re.search("<th[^>]*>", r, re.IGNORECASE)]
    room = size - 60 - sum(map(len, head))
    body = rows[len(head) :]
    if len(table) <= size or room <= 0 or len(body) < 2:
        return [table]
    groups, used = [[]], 0
    for r in body:
        if groups[-1] and used + len(r) > room:
            groups.append([])
            used = 0
        groups[-1].append(r)
        used += len(r)
    if len(groups) == 1:
        return [table]
    open_tag = re.match(r"<table[^>]*>", table, re.IGNORECASE)[0]
    out = []
    for i, g in enumerate(groups, 1):
        fixed = []
        for k, r in enumerate(g):
            left = len(g) - k

            def clamp(m: re.Match, left: int = left) -> str:
                n = min(int(m[1]), left)
                return f" rowspan='{n}'" if n > 1 else ""

            fixed.append(re.sub(r"\s+rowspan=['\"]?(\d+)['\"]?", clamp, r, flags=re.IGNORECASE))
        out.append(f"[Table Chunk {i}/{len(groups)}]\n" + open_tag + "\n" + "\n".join([*head, *fixed]) + "\n</table>")
    return out


_RULE = re.compile(r"\|[\s\-:]+(?:\|[\s\-:]+)*\|")


def markdown_table(text: str) -> tuple[str, list[str]] | None:
    """The header of a Markdown table, with its rule, and its rows; None for what is none."""
    lines = [x.strip() for x in text.strip().split("\n")]
    if len(lines) < 3 or not lines[0].startswith("|") or not _RULE.fullmatch(lines[1]):
        return None
    return f"{lines[0]}\n{lines[1]}", [x for x in lines[2:] if x.startswith("|")]


def packed_markdown(table: str, size: int, prefix: str = "") -> list[str]:
    """The parts of a Markdown table cut between rows, each with the header; the table itself if it fits or can't be cut."""
    whole, found = [(prefix + table).strip()] if table else [], markdown_table(table)
    if found is None or not found[1] or len(table) + len(prefix) <= size:
        return whole
    head, rows = found
    room = size - len(prefix) - 30 - len(head) - 2
    if room <= 0:
        return whole
    groups, used = [[]], 0
    for r in rows:
        if groups[-1] and used + len(r) + 1 > room:
            groups.append([])
            used = 0
        groups[-1].append(r)
        used += len(r) + 1
    if len(groups) == 1:
        return whole
    return [f"{prefix}[Table Chunk {i}/{len(groups)}]\n{head}\n" + "\n".join(g) for i, g in enumerate(groups, 1)]


#: What a sheet's text is made of, by kind.
SEGMENTS = (
    ("table", re.compile(r"(?:\[Table\s*\d+\]\s*)?<table[^>]*>.*?</table>", re.DOTALL | re.IGNORECASE)), ("table", re.compile(_MARKDOWN_TABLE)), ("textbox", re.compile(r"\[textbox\].*?\[/textbox\]", re.DOTALL | re.IGNORECASE)),
    ("chart", re.compile(r"\[chart\].*?\[/chart\]", re.DOTALL | re.IGNORECASE)), ("image", re.compile(r"\[Image:.+?\]")),
)


def segments(text: str) -> list[tuple[str, str]]:
    """Tables, text boxes, charts, images and the text between them, in order; of what overlaps the first counts."""
    found = sorted(((m.start(), m.end(), kind) for kind, pattern in SEGMENTS for m in pattern.finditer(text)), key=lambda x: x[0])
    out, at = [], 0
    for start, end, kind in found:
        if start < at:
            continue
        out += [("text", between)] if (between := text[at:start].strip()) else []
        out.append((kind, text[start:end].strip()))
        at = end
    return out + ([("text", tail)] if (tail := text[at:].strip()) else [])


def protected(text: str, size: int, overlap: int, preserve_tables: bool = True) -> list[str]:
    """Chunks that cut no region; a region larger than a chunk stands alone, a table by rows if it may be cut."""
    regions: list[list] = []
    for m in WHOLE.finditer(text):
        regions.append([m.start(), m.end(), m[0].lower().startswith("<table")])
    out, at, n = [], 0, len(text)
    # regions in reach: from the first that isn't passed yet to the last that begins before the end of a piece
    starts, k = [r[0] for r in regions], 0
    while at < n:
        while k < len(regions) and regions[k][1] <= at:
            k += 1
        end = min(at + size, n)
        inside = regions[k : max(k, bisect_left(starts, end))]
        crossing = next((r for r in inside if r[0] < end < r[1]), None)
        soft = False
        if crossing:
            if crossing[0] > at and text[at : crossing[0]].strip():
                end = crossing[0]
            else:
                end = crossing[1]
                body = text[at:end].strip()
                out += packed_table(body, size) if crossing[2] and not preserve_tables else [body]
                at = end
                continue
        elif end < n:
            low = max([at, *(r[1] for r in inside if r[1] <= end)])
            window = text[low:end]
            cut = window.rfind("\n\n", max(0, len(window) - 200))
            if cut < 0:
                cut = window.rfind("\n", len(window) // 2)
            if cut < 0:
                cut = window.rfind(" ", len(window) // 2)
            if cut > 0:
                end = low + cut + 1
            soft = True
        piece = text[at:end].strip()
        if piece:
            out.append(piece)
        back = end - overlap if soft and overlap else end
        if soft and any(r[0] < back < r[1] or back < r[1] <= end for r in inside):
            back = end
        at = max(back, at + 1) if end < n else n
    return out


def paged(text: str, size: int, overlap: int, preserve_tables: bool = True) -> list[str]:
    """Pages with their marks put together up to ``size``, up to half more to close one; larger ones are cut again."""
    marks = list(PAGES.finditer(text))
    pages = [text[: marks[0].start()].strip()] if marks else [text.strip()]
    for m, nxt in zip(marks, [*marks[1:], None]):
        body = text[m.end() : nxt.start() if nxt else len(text)].strip()
        pages.append(f"{m[0]}\n{body}" if body else "")
    chunks, held, count, carry = [], [], 0, ""
    for p in pages:
        if not p:
            continue
        if not held:
            held = [f"{carry}\n\n{p}" if carry else p]
            count, carry = len(held[0]), ""
        elif count + 4 + len(p) <= size:
            held.append(p)
            count += 4 + len(p)
        elif count + 4 + len(p) <= size * 1.5:
            chunks.append("\n\n".join([*held, p]))
            held, count, carry = [], 0, p[-overlap:] if overlap else ""
        else:
            chunks.append("\n\n".join(held))
            held, count = [p], len(p)
    if held:
        chunks.append("\n\n".join(held))
    out = []
    for c in chunks:
        out += [c] if len(c) <= int(1.5 * int(1.5 * size)) else protected(c, size, overlap, preserve_tables) if WHOLE.search(c) else recursive(c, size, overlap)
    return out


def tabled(text: str, size: int, overlap: int, preserve_tables: bool = True, keep_text: bool = True) -> list[str]:
    """Tables by rows, sheet by sheet, each chunk opened by the metadata block and the sheet's tag."""
    m = re.search(r"\[Document-Metadata\].*?\[/Document-Metadata\]", text, re.DOTALL)
    prefix = m[0] + "\n" if m else ""
    body = text.replace(m[0], "", 1) if m else text
    parts = [x for x in re.split(r"(?=\[Sheet: .+?\])", body) if x.strip()]
    out = []
    for part in parts:
        s = SHEET.match(part)
        head = prefix + (s[0] + "\n" if s else "")
        room = max(size - len(head), overlap + 1)
        for kind, piece in segments(part[s.end() :] if s else part):
            if kind == "table":
                html = "<table" in piece[:40].lower()
                out += [head + c for c in packed_table(piece, size - len(head))] if html else packed_markdown(piece, size, head)
            elif kind == "text":
                out += [head + c for c in recursive(piece, room, overlap)] if keep_text else []
            else:
                out.append(head + piece)
    return out


#: Strategies by name with their priority, the least first; each tells whether it takes a text and cuts it.
Takes = Callable[[str, str], bool]
Cuts = Callable[[str, int, int, bool, str], list[str]]
STRATEGIES: dict[str, tuple[int, Takes, Cuts]] = {}


def add_strategy(name: str, priority: int, takes: Takes, cuts: Cuts) -> None:
    """Let a strategy cut the texts it takes; of several that take one the least priority counts, of equal ones the first added."""
    STRATEGIES[name] = (priority, takes, cuts)


def remove_strategy(name: str) -> None:
    STRATEGIES.pop(name, None)


add_strategy("table", 5, lambda t, e: e.lower() in TABLE_EXTENSIONS, lambda t, size, overlap, keep, e: tabled(t, size, overlap, keep))
add_strategy("page", 10, lambda t, e: "[Page Number: " in t or "[Slide Number: " in t, lambda t, size, overlap, keep, e: paged(t, size, overlap, keep))
add_strategy("protected", 20, lambda t, e: any(x in t for x in ("<table", "[chart]", "[textbox]", "[Image:", "[Document-Metadata]")), lambda t, size, overlap, keep, e: protected(t, size, overlap, keep))
add_strategy("plain", 100, lambda t, e: True, lambda t, size, overlap, keep, e: plain(t, size, overlap, e))


def _taking(text: str, extension: str) -> list[str]:
    """The strategies that take a text, the first one first; one whose test fails takes none."""
    out = []
    for name in sorted(STRATEGIES, key=lambda n: STRATEGIES[n][0]):
        try:
            if STRATEGIES[name][1](text, extension):
                out.append(name)
        except Exception:  # a strategy of a user must not keep others from the text
            continue
    return out


def strategy_of(text: str, extension: str) -> str | None:
    if not text or not text.strip():
        return None
    return next(iter(_taking(text, extension)), None)


def chunk(text: str | None, extension: str = "", size: int = 1000, overlap: int = 200, preserve_tables: bool = True) -> tuple[str | None, list[str]]:
    """The strategy that fits a text and its chunks; none for a null or blank one.

    A strategy that isn't made yet (``NotImplementedError``) leaves the text to the others that take it, the last one first;
    if there is none, it is one chunk.
    """
    overlap = min(overlap, size - 1)
    names = _taking(text, extension) if text and text.strip() else []
    if not names:
        return (None, []) if not text or not text.strip() else ("whole", [text])
    for name in (names[0], *reversed(names[1:])):
        try:
            return name, STRATEGIES[name][2](text, size, overlap, preserve_tables, extension)
        except NotImplementedError:
            continue
    return "whole", [text]


def chunked(df: DataFrame, keys: list[str], text: str, extension: str | None = None, size: str | int = 1000, overlap: str | int = 200, preserve_tables: str | bool = True) -> DataFrame:
    """``keys, strategy, no, chunk``: the chunks of every text in order; sizes may be columns or values.

    Null and blank texts have no rows. Keys may be null and repeat; each row is chunked for itself.
    """
    col = lambda v: F.col(v) if isinstance(v, str) else F.lit(v)
    picked = df.select(*keys, F.col(text).alias("_text"), F.coalesce(F.col(extension) if extension else F.lit(""), F.lit("")).alias("_ext"), F.coalesce(col(size), F.lit(1000)).cast("int").alias("_size"), F.coalesce(col(overlap), F.lit(0)).cast("int").alias("_overlap"), F.coalesce(col(preserve_tables), F.lit(True)).alias("_keep"))
    n, known = len(keys), dict(STRATEGIES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        STRATEGIES.update(known)
        for part in parts:
            at, kinds, nos, out = [], [], [], []
            for i, row in enumerate(zip(*(part.column(n + k).to_pylist() for k in range(5)))):
                kind, chunks = chunk(*row)
                at += [i] * len(chunks)
                kinds += [kind] * len(chunks)
                nos += range(len(chunks))
                out += chunks
            held = [part.column(k).take(pa.array(at, pa.int64())) for k in range(n)]
            yield pa.RecordBatch.from_arrays([*held, pa.array(kinds, pa.string()), pa.array(nos, pa.int32()), pa.array(out, pa.string())], [*keys, "strategy", "no", "chunk"])

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "strategy string, no int, chunk string"])
    return bounded_batches(picked).mapInArrow(run, schema)
