"""Structural tags in extracted text: written, found, removed."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How tags open and close.
TAGS = {
    "page": ("[Page Number: ", "]"), "slide": ("[Slide Number: ", "]"), "sheet": ("[Sheet: ", "]"), "image": ("[Image:", "]"),
    "chart": ("[chart]", "[/chart]"), "metadata": ("[Document-Metadata]", "[/Document-Metadata]"),
}
OCR = r"(?:\s*\(OCR(?:\+Ref)?\))?"


def tag(kind: str, value: Column) -> Column:
    """A tag around a value."""
    a, b = TAGS[kind]
    return F.concat(F.lit(a), value.cast("string"), F.lit(b))


def pattern(kind: str, group: bool = False) -> str:
    """The regular expression of a kind of tag; with a group for its value on demand."""
    a, b = (re.escape(x).replace("\\ ", " ") for x in TAGS[kind])
    inner = r"\d+" if kind in ("page", "slide") else r"\s*.+?\s*" if kind == "image" else ".+?"
    if kind in ("chart", "metadata"):
        return f"(?s){a}{'(' if group else ''}.*?{')' if group else ''}{b}"
    if group:
        inner = r"(\d+)" if kind in ("page", "slide") else r"\s*(.+?)\s*" if kind == "image" else "(.+?)"
    return f"{a}{inner}{OCR if kind in ('page', 'slide') else ''}{b}"


def has(text: Column, kind: str) -> Column:
    return F.coalesce(text.rlike(pattern(kind)), F.lit(False))


def values(text: Column, kind: str) -> Column:
    """The values of all tags of a kind, in order."""
    return F.regexp_extract_all(text, F.lit(pattern(kind, True)), F.lit(1))


def removed(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, pattern(kind), "")


def located(df: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """``key, kind, no, s, e``: start and end of every match of each pattern in a text, from 0, by running sums of lengths.

    What is shuffled are the lengths of matches and of what lies between; rows with one key stay apart. Null texts have none.
    """
    t = F.col(text)

    def of(kind: str, regex: str) -> Column:
        pairs = F.arrays_zip(F.split(t, regex, -1).alias("p"), F.regexp_extract_all(t, F.lit(regex), F.lit(0)).alias("m"))
        sizes = F.transform(pairs, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("no"), F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m")))
        return F.filter(sizes, lambda x: x["m"].isNotNull())

    numbered = df.where(t.isNotNull()).select(key, text, F.monotonically_increasing_id().alias("_row"))
    rows = numbered.select(key, "_row", F.explode(F.concat(*(of(k, r) for k, r in patterns.items()))).alias("x"))
    ends = F.sum(F.col("x.p") + F.col("x.m")).over(Window.partitionBy("_row", "x.kind").orderBy("x.no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("e", ends.cast("int")).select(key, "x.kind", "x.no", (F.col("e") - F.col("x.m")).alias("s"), "e")
