"""Pages, slides, sheets, regions and headings of extracted text, and what of them a chunk belongs to."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import tags
from docloom.tables import bounded_batches, by_group

#: Extensions that are tables by nature.
TABLE_EXTENSIONS = ("csv", "tsv", "xlsx", "xls")
#: Regions that are kept whole, by kind.
REGIONS = {
    "chart": r"(?is)\[chart\].*?\[/chart\]", "textbox": r"(?is)\[textbox\].*?\[/textbox\]", "table": r"(?is)<table[^>]*>.*?</table>", "metadata": r"(?s)\[Document-Metadata\].*?\[/Document-Metadata\]",
    "image": r"\[Image:.+?\]", "page": tags.pattern("page"), "slide": tags.pattern("slide"), "sheet": r"\[Sheet: .+?\]",
}


def strategy(text: Column, extension: Column) -> Column:
    """How a text is chunked: by table, page, protected region or plainly; null for blank texts."""
    marked = lambda *marks: F.greatest(*(text.contains(m) for m in marks))
    return (
        F.when(text.isNull() | ~text.rlike(r"(?U)\S"), F.lit(None).cast("string"))
        .when(F.coalesce(F.lower(extension).isin(*TABLE_EXTENSIONS), F.lit(False)), "table")
        .when(marked("[Page Number: ", "[Slide Number: "), "page")
        .when(marked("<table", "[chart]", "[textbox]", "[Image:", "[Document-Metadata]"), "protected")
        .otherwise("plain")
    )


def sections(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """``key, no, label, body``: a text cut before each tag of a kind; what stands ahead of the first is section 0.

    The label is the tag's value; the tag itself is not in the body. Sections of blanks alone are dropped.
    """
    regex = tags.pattern(kind)
    t = F.col(text)
    bodies = F.split(t, regex, -1)
    labels = F.concat(F.array(F.lit(None).cast("string")), tags.values(t, kind))
    each = df.where(t.isNotNull()).select(key, F.posexplode(F.arrays_zip(bodies.alias("body"), labels.alias("label"))).alias("no", "x"))
    return each.select(key, "no", F.col("x.label").alias("label"), F.regexp_replace("x.body", r"^\s+|\s+$", "").alias("body")).where(F.col("body") != "")


def merged_pages(pages: DataFrame, key: str, size: int, overlap: int) -> DataFrame:
    """``key, chunks``: pages put together greedily, ``pages`` holding ``key, no, body``.

    A page joins while the sum stays within ``size``, four counted for each join; one that stays within one
    and a half times of it joins too and closes the chunk, whose last ``overlap`` signs open the next.
    """

    def each(rows: list[tuple]) -> Iterator[tuple]:
        out, held, count, carry = [], [], 0, ""
        for _, body in rows:
            if not held:
                held = [f"{carry}\n\n{body}" if carry else body]
                count, carry = len(held[0]), ""
            elif count + 4 + len(body) <= size:
                held.append(body)
                count += 4 + len(body)
            elif count + 4 + len(body) <= size * 3 / 2:
                out.append("\n\n".join([*held, body]))
                held, carry = [], body[-overlap:] if overlap else ""
            else:
                out.append("\n\n".join(held))
                held, count = [body], len(body)
        yield (out + (["\n\n".join(held)] if held else []),)

    return by_group(pages.select(key, "no", "body"), [key], each, {"chunks": "array<string>"})


def regions(df: DataFrame, key: str, text: str, kinds: tuple[str, ...] = tuple(REGIONS)) -> DataFrame:
    """``key, kind, s, e``: every region of a text that is kept whole, with its offsets."""
    return tags.located(df, key, text, {k: REGIONS[k] for k in kinds}).drop("no")


def merged_regions(found: DataFrame, key: str) -> DataFrame:
    """``key, s, e, kinds``: overlapping regions as one with their kinds joined; touching ones stay apart."""
    order = Window.partitionBy(key).orderBy("s", "e", "kind")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    numbered = found.withColumn("_new", F.when(F.col("s") < reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(order))
    return numbered.groupBy(key, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_join(F.array_sort(F.collect_set("kind")), "+").alias("kinds")).drop("_island")


def in_force(chunks: DataFrame, key: str, order: str, text: str, kind: str) -> DataFrame:
    """The chunks with ``label``: the tag in force at each, its own if it opens with one, else the last before it."""
    regex, value = tags.pattern(kind), tags.values(F.col(text), kind)
    own = F.when(F.col(text).rlike(r"^\s*" + regex), F.get(value, F.lit(0)))
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.size(value) > 0, F.element_at(value, -1)), ignorenulls=True).over(window)
    return chunks.withColumn("label", F.coalesce(own, before))


def heading_paths(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """The lines with ``path``: the headings in force, outermost first, joined by `` > ``."""
    level = F.length(F.regexp_extract(F.col(line), r"^(#{1,6})\s+\S", 1))
    title = F.regexp_extract(F.col(line), r"^#{1,6}\s+(.*?)\s*#*\s*$", 1)
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = lines.withColumns({"_level": level, "_title": title})
    for k in range(1, 7):
        out = out.withColumn(f"_h{k}", F.max(F.when(F.col("_level") == k, F.struct(F.col(order), F.col("_title")))).over(window))
    parts, limit = [], F.lit(-1).cast("long")
    for k in range(1, 7):
        at = F.col(f"_h{k}.{order}").cast("long")
        parts.append(F.when(at > limit, F.col(f"_h{k}._title")))
        limit = F.greatest(limit, F.coalesce(at, F.lit(-1).cast("long")))
    return out.withColumn("path", F.concat_ws(" > ", *parts)).drop("_level", "_title", *(f"_h{k}" for k in range(1, 7)))


def offsets_of(chunks: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The chunks with ``starts`` and ``ends``, the running sum of their lengths."""
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("ends", F.sum(F.length(text)).over(window).cast("long")).withColumn("starts", F.col("ends") - F.length(text))


def packed_lines(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key, no, chunk``: lines put together greedily up to ``size``; a longer line is a chunk of its own."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, nos, out = [], [], []
            for i, whole in enumerate(part.column(1).to_pylist()):
                held, count, first = [], 0, len(out)
                for line in whole.split("\n"):
                    if not _VISIBLE.search(line):
                        continue
                    if held and count + 1 + len(line) > size:
                        out.append("\n".join(held))
                        held, count = [], 0
                    count += len(line) + bool(held)
                    held.append(line)
                out += ["\n".join(held)] if held else []
                at += [i] * (len(out) - first)
                nos += range(len(out) - first)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(nos, pa.int32()), pa.array(out, pa.string())], [key, "no", "chunk"])

    rows = df.where(F.col(text).isNotNull()).select(key, text)
    return bounded_batches(rows).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, no int, chunk string")


#: A sign that isn't white space as SQL patterns have it.
_VISIBLE = re.compile(r"[^ \t\n\x0b\f\r]")
