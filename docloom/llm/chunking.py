"""Splitting of oversized texts at natural boundaries, without loading a whole text into one step.

A text is read in ranges with halos. Each range finds its boundaries and lays out the pieces from every place
in its first chunk where a piece may start, as the ranges before it may end anywhere; what it hands on is a
small table: for each such place where the first piece of the next range then starts and how many pieces lie
between, its length, and what of a stretch without white space begins, ends or lies in it. The tables of a
text are gone through in order, one range at a time with the state so far, which sums up lengths and settles
where each range's first piece starts; a range then cuts its own pieces out of its segment. No text, no list
of boundaries and no list of pieces of a text is ever gathered.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.tables import bounded_batches, stored

#: Signs of a range; one of a larger chunk size is as long as that, so that a piece ends in the halo of its range.
RANGE = 1 << 18
#: Kinds of boundaries, the best first.
PAGE, PARAGRAPH, LINE, WORD = range(4)
#: How marks of pages, slides and sheets open.
MARK = re.compile(r"\[(?:Page Number|Slide Number|Sheet): ")
#: Signs beyond those that pieces can reach that are needed to tell a boundary.
BEFORE, AFTER = 3, 16


def boundaries(segment: str, before: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Places of each kind of boundary within a range, and where white space stands.

    ``segment`` has ``before`` signs ahead of the range and some behind it; ``size`` is the range's own.
    A place p means a cut between the signs p-1 and p, from 1 to ``size``, counted in the range.
    """
    codes = np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)
    feed, carriage = codes == 10, codes == 13
    ends = feed | (carriage & ~np.append(feed[1:], False))
    white = feed | carriage | (codes == 32) | (codes == 9)
    # where a line that ends here began: the sign before it, or before its carriage return
    at = np.flatnonzero(ends)
    previous = at - 1 - (feed[at] & (at > 0) & carriage[np.maximum(at - 1, 0)])
    blank = at[(previous >= 0) & ends[np.maximum(previous, 0)]]
    marks = np.array([m.start() for m in MARK.finditer(segment)], np.int64)
    found = [marks - before, blank + 1 - before, at + 1 - before, np.flatnonzero(white) + 1 - before]
    return [p[(p >= 1) & (p <= size)] for p in found], white[before : before + size]


#: How a range without any further piece hands on.
DONE = -1
NAMES = ("page", "paragraph", "line", "word")


class Range:
    """The boundaries of one range and the pieces that start in it; all places count from its first sign.

    ``rest`` is how many signs the text has from there on, where the segment reaches its end, else None.
    """

    def __init__(self, segment: str, before: int, own: int, rest: int | None, size: int, overlap: int):
        self.own, self.rest, self.size = own, rest, size
        self.overlap = overlap = min(max(overlap, 0), size - 1)
        found, white = boundaries(segment, before, len(segment) - before)
        # those ahead of the range are needed to tell where pieces of the range before may be cut
        ahead, _ = boundaries(segment, 0, before) if before else ([np.empty(0, np.int64)] * 4, white)
        self.by_kind = [np.concatenate([a - before, b]) for a, b in zip(ahead, found)]
        self.at = [k.tolist() for k in self.by_kind]
        self.middle = max(overlap, size // 2)
        gaps = np.flatnonzero(white[:own])
        self.head = int(gaps[0]) if len(gaps) else own
        self.tail = own - 1 - int(gaps[-1]) if len(gaps) else own
        self.inner = int(np.diff(gaps).max() - 1) if len(gaps) > 1 else 0
        self.solid = not len(gaps)

    def cut(self, start: int) -> tuple[int, str]:
        """Where the piece that starts at a place ends, and by what kind of boundary.

        It ends at the best and then last boundary in the second half of what it may hold, else in the first half
        behind the overlap, else by force at its full size. A page mark starts a piece wherever one can.
        """
        if self.rest is not None and self.rest - start <= self.size:
            return self.rest, "end"
        for low, high in ((start + self.middle, start + self.size), (start + self.overlap, start + self.middle)):
            for kind, at in enumerate(self.at):
                k = bisect_right(at, high) - 1
                if k >= 0 and at[k] > low:
                    return at[k], NAMES[kind]
        return start + self.size, "forced"

    def pieces(self, entry: int) -> Iterator[tuple[int, int, str]]:
        """Start, end and kind of cut of each piece that starts in the range, the first at ``entry``."""
        start = entry
        while 0 <= start < self.own:
            end, how = self.cut(start)
            yield start, end, how
            start = DONE if how == "end" else end - self.overlap

    def entries(self) -> np.ndarray:
        """The places at which the first piece of the range may start: behind a boundary less the overlap, or behind a forced cut."""
        reach = min(self.size, self.own)
        every = np.unique(np.concatenate(self.by_kind))
        natural = every - self.overlap
        # a cut is forced where no boundary lies between its piece's overlap and the cut
        places = np.arange(reach)
        last = np.searchsorted(every, places + self.overlap, "right") - 1
        nearest = np.where(last >= 0, every[np.maximum(last, 0)], -(1 << 40)) if len(every) else np.full(reach, -(1 << 40))
        forced = places[nearest <= places + 2 * self.overlap - self.size]
        return np.union1d(natural[(natural >= 0) & (natural < reach)], forced)

    def table(self, first: bool) -> tuple[list[int], list[int], list[int]]:
        """Entries, where the first piece of the next range starts for each (DONE: nowhere), and pieces in between."""
        known: dict[int, tuple[int, int]] = {}
        entries = [0] if first else self.entries().tolist()
        for entry in entries:
            chain, at = [], entry
            while 0 <= at < self.own and at not in known:
                chain.append(at)
                end, how = self.cut(at)
                at = DONE if how == "end" else end - self.overlap
            there, count = known[at] if at in known else (at - self.own if at >= 0 else DONE, 0)
            for at in reversed(chain):
                count += 1
                known[at] = (there, count)
        return entries, [known[e][0] for e in entries], [known[e][1] for e in entries]


def latest(texts: DataFrame) -> DataFrame:
    """The texts with one row for each id: where an id comes again, the last extraction, of equal ones the greatest text.

    Only ids are shuffled to see which come again; the texts of these alone are moved.
    """
    known = texts.where(F.col("text_id").isNotNull())
    again = stored(known.groupBy("text_id").agg(F.count("*").alias("rows")).where("rows > 1").select("text_id"))
    if again.isEmpty():
        return known
    order = [F.col("extracted_at").desc_nulls_last()] if "extracted_at" in texts.columns else []
    no = F.row_number().over(Window.partitionBy("text_id").orderBy(*order, F.col("text").desc_nulls_last(), "config_id"))
    last = known.join(again, "text_id", "left_semi").withColumn("_no", no).where("_no = 1").drop("_no")
    return known.join(again, "text_id", "left_anti").unionByName(last)


def sized(texts: DataFrame, configs: DataFrame) -> DataFrame:
    """``text_id, text, chunk_size, chunk_overlap`` of each text that has something to cut.

    A text without a configuration, or with a chunk size below 1, is left out, as is a null or empty one.
    """
    sizes = configs.where(F.col("chunk_size") >= 1).groupBy("config_id").agg(F.min("chunk_size").alias("chunk_size"), F.min_by(F.coalesce("chunk_overlap", F.lit(0)), "chunk_size").alias("chunk_overlap"))
    wanted = latest(texts).where(F.length("text") > 0)
    return wanted.join(sizes, "config_id").select(F.col("text_id").cast("bigint").alias("text_id"), "text", F.col("chunk_size").cast("int").alias("chunk_size"), F.col("chunk_overlap").cast("int").alias("chunk_overlap"))


_RANGE = {
    "text_id": ("bigint", pa.int64()), "chunk_size": ("int", pa.int32()), "chunk_overlap": ("int", pa.int32()), "range_no": ("int", pa.int32()), "own": ("bigint", pa.int64()), "before": ("int", pa.int32()),
    "rest": ("bigint", pa.int64()), "segment": ("string", pa.string()),
}
_TABLE = {
    **dict(list(_RANGE.items())[:5]), "head": ("bigint", pa.int64()), "tail": ("bigint", pa.int64()), "inner": ("bigint", pa.int64()), "solid": ("boolean", pa.bool_()),
    "entries": ("array<int>", pa.list_(pa.int32())), "exits": ("array<bigint>", pa.list_(pa.int64())), "counts": ("array<bigint>", pa.list_(pa.int64())),
}
_SPAN = {"text_id": ("bigint", pa.int64()), "range_no": ("int", pa.int32()), "offset": ("bigint", pa.int64()), "entry": ("bigint", pa.int64()), "first_no": ("bigint", pa.int64())}
_OUTLINE = {"text_id": ("bigint", pa.int64()), "chunk_size": ("int", pa.int32()), "length": ("bigint", pa.int64()), "longest": ("bigint", pa.int64()), "pieces": ("bigint", pa.int64())}
_CHUNK = {"text_id": ("bigint", pa.int64()), "chunk_no": ("bigint", pa.int64()), "start": ("bigint", pa.int64()), "end": ("bigint", pa.int64()), "cut": ("string", pa.string()), "text": ("string", pa.string())}
#: Signs, or entries of tables, after which what a task has made is handed on.
_ENOUGH = 1 << 21


def _mapped(df: DataFrame, each: Callable[[Iterator[tuple]], Iterator[tuple[int, tuple]]], fields: dict) -> DataFrame:
    """Rows to rows in one pass over a partition; with each row made comes how much it weighs, so that batches stay bounded."""
    names, kinds = list(fields), [k for _, k in fields.values()]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns)))
        held, weight = [], 0
        for w, row in each(rows):
            held.append(row)
            weight += w + 16
            if weight >= _ENOUGH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return bounded_batches(df).mapInArrow(run, ", ".join(f"{n} {k}" for n, (k, _) in fields.items()))


def ranges(texts: DataFrame, range_size: int = RANGE, first: int = 0) -> DataFrame:
    """``text_id, chunk_size, chunk_overlap, range_no, own, before, rest, segment``: texts in ranges with halos, from the ``first`` on."""

    def each(rows):
        for text_id, text, size, overlap in rows:
            step = max(range_size, size)
            for no in range(first, (len(text) + step - 1) // step):
                start = no * step
                own, before, after = min(step, len(text) - start), min(size + BEFORE, start), size + AFTER
                rest = len(text) - start
                segment = text[start - before : start + own + after]
                yield len(segment), (text_id, size, overlap, no, own, before, rest if rest <= own + after else None, segment)

    return _mapped(texts.select("text_id", "text", "chunk_size", "chunk_overlap"), each, _RANGE)


def file_ranges(spark: SparkSession, folder: str, chunk_size: int, chunk_overlap: int, range_size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """``ranges`` of the UTF-8 files below a folder, each read by its bytes at an offset, and ``text_id, path`` of the files.

    No file is loaded whole, by any task; ``range_size`` counts bytes here. A sign belongs to the range that its
    first byte lies in; bytes that are no UTF-8 become U+FFFD.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").cast("bigint").alias("bytes")).where("bytes > 0")
    named = stored(listed.withColumn("text_id", F.xxhash64("path")))
    step = max(range_size, 4 * chunk_size)
    cut = named.select("text_id", "path", "bytes", F.explode(F.sequence(F.lit(0), ((F.col("bytes") - 1) / step).cast("int"))).alias("no"))

    def each(rows):
        from pyarrow import fs

        for text_id, path, size, no in rows:
            system, at = fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))
            start, end = no * step, min((no + 1) * step, size)
            low, high = max(0, start - 4 * (chunk_size + BEFORE) - 3), min(size, end + 4 * (chunk_size + AFTER) + 3)
            with system.open_input_file(at) as f:
                raw = f.read_at(high - low, low)
            part = lambda a, b: raw[_sign_at(raw, a - low) : _sign_at(raw, b - low)].decode("utf-8", "replace")  # noqa: B023, E731
            ahead, own, behind = part(low, start)[-(chunk_size + BEFORE) :], part(start, end), part(end, high)
            if low:
                ahead = ahead.lstrip("\ufffd")
            rest = len(own) + len(behind) if high == size else None
            behind = behind[: chunk_size + AFTER]
            if rest is not None and rest > len(own) + len(behind):
                rest = None
            if own:
                yield len(own), (text_id, chunk_size, chunk_overlap, no, len(own), len(ahead), rest, ahead + own + behind)

    return _mapped(cut.repartition("text_id", "no"), each, _RANGE), named.select("text_id", "path")


def _sign_at(raw: bytes, at: int) -> int:
    """The first place from ``at`` on where a sign starts."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def boundary_tables(cut: DataFrame) -> DataFrame:
    """What each range hands on; no text is left in it."""

    def each(rows):
        for text_id, size, overlap, no, own, before, rest, segment in rows:
            r = Range(segment, before, own, rest, size, overlap)
            entries, exits, counts = r.table(no == 0)
            yield 3 * len(entries), (text_id, size, overlap, no, own, r.head, r.tail, r.inner, r.solid, entries, exits, counts)

    return _mapped(cut, each, _TABLE)


def _in_order(tables: DataFrame) -> DataFrame:
    """The tables of each text behind one another, in one partition."""
    return tables.repartition("text_id").sortWithinPartitions("text_id", "range_no")


def spans(tables: DataFrame) -> DataFrame:
    """``text_id, range_no, offset, entry, first_no``: where each range lies in its text, where its first piece starts
    and the number of that; only ranges that a piece starts in. One row at a time is held."""

    def each(rows):
        text = None
        for text_id, _, _, no, own, _, _, _, _, entries, exits, counts in rows:
            if text_id != text:
                text, offset, entry, number = text_id, 0, 0, 0
            if 0 <= entry < own:
                yield 1, (text_id, no, offset, entry, number)
                k = entries.index(entry)
                number, entry = number + counts[k], exits[k]
            elif entry >= 0:
                entry -= own
            offset += own

    return _mapped(_in_order(tables), each, _SPAN)


def outlined(tables: DataFrame) -> DataFrame:
    """``text_id, chunk_size, length, longest, pieces``: length, longest stretch without white space and number of pieces of
    each text. One row at a time is held."""

    def each(rows):
        text, held = None, None
        for text_id, size, _, _, own, head, tail, inner, solid, entries, exits, counts in rows:
            if text_id != text:
                if held:
                    yield 1, held
                text, length, run, longest, entry, number = text_id, 0, 0, 0, 0, 0
            longest = max(longest, run + head, inner)
            run = run + own if solid else tail
            if 0 <= entry < own:
                k = entries.index(entry)
                number, entry = number + counts[k], exits[k]
            elif entry >= 0:
                entry -= own
            length += own
            held = (text_id, size, length, max(longest, run), number)
        if held:
            yield 1, held

    return _mapped(_in_order(tables), each, _OUTLINE)


def oversized(texts: DataFrame, configs: DataFrame, range_size: int = RANGE) -> DataFrame:
    """``text_id, kind`` of each text that is cut: ``forced`` where a stretch without white space is longer
    than the chunk size, else ``natural``. A row of a few numbers for each range is shuffled."""
    laid = outlined(boundary_tables(ranges(sized(texts, configs), range_size))).where("pieces > 1")
    return laid.select("text_id", F.when(F.col("longest") > F.col("chunk_size"), "forced").otherwise("natural").alias("kind"))


def _cut(rows) -> Iterator[tuple[int, tuple]]:
    for text_id, size, overlap, before, own, rest, segment, offset, entry, number in rows:
        r = Range(segment, before, own, rest, size, overlap)
        for k, (start, end, how) in enumerate(r.pieces(entry)):
            yield end - start, (text_id, number + k, offset + start, offset + end, how, segment[start + before : end + before])


_NEEDED = ("text_id", "chunk_size", "chunk_overlap", "before", "own", "rest", "segment", "offset", "entry", "first_no")


def chunks_of(cut: DataFrame) -> DataFrame:
    """``text_id, chunk_no, start, end, cut, text`` of texts given in ranges."""
    entered = cut.join(spans(boundary_tables(cut)), ["text_id", "range_no"])
    return _mapped(entered.select(*_NEEDED), _cut, _CHUNK)


def chunks(texts: DataFrame, configs: DataFrame, range_size: int = RANGE) -> DataFrame:
    """``text_id, chunk_no, start, end, cut, text``: the pieces of every text in order, none longer than its
    chunk size, consecutive ones sharing its overlap.

    A text that fits is one piece; null and empty texts have none, blank ones are cut like any other. An
    overlap of the chunk size or more counts as one sign less than it. Texts are counted in code points. Of an
    id that comes again the last extraction counts.
    """
    wanted = sized(texts, configs)
    # the first range of a text is entered at its first sign, so its pieces need no table and no shuffle
    step = F.greatest(F.lit(range_size), F.col("chunk_size"))
    firsts = _mapped(wanted.select("text_id", F.substring("text", F.lit(1), step + F.col("chunk_size") + AFTER).alias("text"), F.length("text").cast("bigint").alias("length"), "chunk_size", "chunk_overlap"), _first(range_size), _CHUNK)
    several = wanted.where(F.length("text") > step)
    entered = ranges(several, range_size, 1).join(spans(boundary_tables(ranges(several, range_size))), ["text_id", "range_no"])
    return firsts.unionByName(_mapped(entered.select(*_NEEDED), _cut, _CHUNK))


def _first(range_size: int) -> Callable[[Iterator[tuple]], Iterator[tuple[int, tuple]]]:
    def each(rows):
        for text_id, text, length, size, overlap in rows:
            own = min(max(range_size, size), length)
            rest = length if length <= own + size + AFTER else None
            yield from _cut([(text_id, size, overlap, 0, own, rest, text, 0, 0, 0)])

    return each


def chunks_of_files(spark: SparkSession, folder: str, chunk_size: int, chunk_overlap: int, range_size: int = RANGE) -> DataFrame:
    """``path, chunk_no, start, end, cut, text`` of the UTF-8 files below a folder; places count code points."""
    cut, named = file_ranges(spark, folder, chunk_size, chunk_overlap, range_size)
    return chunks_of(cut).join(named, "text_id").select("path", "chunk_no", "start", "end", "cut", "text")
