"""Text scalars as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.tables import stripped

#: What counts as numeric text.
NUMERIC = r"^(?:-?[0-9]+|-?[0-9]+\.[0-9]+|-?[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?|-?[0-9]+(?:\.[0-9]+)?%|\$-?[0-9]+(?:\.[0-9]+)?|₩-?[0-9]+(?:,[0-9]{3})*)$"


def clean_plain(text: Column) -> Column:
    """Runs of blank lines become one; white space at both ends goes."""
    return stripped(F.regexp_replace(text, r"\n\s*\n\s*\n+", "\n\n"))


def clean_code(text: Column) -> Column:
    """White space at the end goes, tabs become four blanks; indentation stays."""
    return F.replace(F.regexp_replace(text, r"(?U)\s+$", ""), F.lit("\t"), F.lit("    "))


def normalised(text: Column) -> Column:
    """At most one blank line in a row, no blanks before a line feed, white space at both ends goes. A line ends at a
    line feed alone; a carriage return is a sign like others, as in Python's and the SQL engine's ``(?m)$``."""
    return stripped(F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"[ \t]+(?=\n|\z)", ""))


def is_numeric(value: Column) -> Column:
    """Integer, float, with thousands commas, percent, dollars or won."""
    return F.coalesce(stripped(value).rlike(NUMERIC), F.lit(False))


def escaped(text: Column, quotes: bool = False) -> Column:
    """``& < >`` as character references, on demand quotes too, line breaks as ``<br>``."""
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return F.replace(out, F.lit("\n"), F.lit("<br>"))


def cell_text(value: Column) -> Column:
    """A cell's content with white space runs as one blank, an empty string for none."""
    return F.coalesce(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), F.lit(""))


def column_number(letters: Column) -> Column:
    """Number of a spreadsheet column from its letters, from 1; null for anything else."""
    digits = F.transform(F.split(F.upper(letters), ""), lambda c: F.ascii(c) - 64)
    return F.when(letters.rlike("^[A-Za-z]{1,3}$"), F.aggregate(digits, F.lit(0), lambda a, d: a * 26 + d))


def column_letters(number: Column) -> Column:
    """Letters of a spreadsheet column from its number, from 1 to 18278."""
    one = lambda k: F.chr((65 + k).cast("int"))
    n = number - 1
    return F.when(number.between(1, 26), one(n)).when(number.between(27, 702), F.concat(one(F.floor(n / 26) - 1), one(n % 26))).when(
        number.between(703, 18278), F.concat(one(F.floor((n - 26) / 676) - 1), one(F.floor((n - 26) / 26) % 26), one((n - 26) % 26))
    )


#: Roman numerals, greatest first.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def roman(number: Column) -> Column:
    """A number from 1 to 3999 in Roman numerals."""
    rest, parts = number, []
    for value, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = rest % value
    return F.when(number.between(1, 3999), F.concat(*parts))


def private_count(text: Column) -> Column:
    """The number of private-use signs."""
    return F.length(F.regexp_replace(text, r"[^\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}]", "")).cast("long")


def private_share(text: Column) -> Column:
    """Share of private-use signs; text with many needs recognition anew."""
    kept = F.regexp_replace(text, r"[^\x{E000}-\x{F8FF}]", "")
    return F.when(F.length(text) > 0, F.length(kept) / F.length(text)).otherwise(F.lit(0.0))
