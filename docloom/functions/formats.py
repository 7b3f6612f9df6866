"""Extensions, categories and signatures of file formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of extensions.
CATEGORIES = {
    "document": "pdf docx doc rtf hwp hwpx",
    "presentation": "ppt pptx",
    "spreadsheet": "xlsx xls",
    "text": "txt md markdown",
    "code": "py js ts java cpp c h cs go rs php rb swift kt scala dart r sql css jsx tsx vue svelte",
    "config": "json yaml yml xml toml ini cfg conf properties env",
    "data": "csv tsv",
    "script": "sh bat ps1 zsh fish",
    "log": "log",
    "web": "html htm xhtml",
    "image": "jpg jpeg png gif bmp webp",
}
#: First bytes, in hexadecimal, and the format they tell.
SIGNATURES = (
    ("89504E470D0A1A0A", "png"), ("474946383961", "gif"), ("474946383761", "gif"), ("FFD8FF", "jpeg"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"),
    ("25504446", "pdf"), ("504B0304", "zip"), ("D0CF11E0A1B11AE1", "ole2"), ("7B5C727466", "rtf"), ("EFBBBF", "utf-8-bom"),
)


def extension(name: Column) -> Column:
    """The extension of a file name in lower case, without its dot; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, r"^.*[/\\]", ""), r"[^.].*?\.([^.]+)$", 1))


def category(ext: Column) -> Column:
    """The category of an extension, ``unknown`` for others."""
    bare = F.regexp_replace(F.lower(ext), r"^\.+", "")
    pairs = [F.lit(x) for kind, exts in CATEGORIES.items() for e in exts.split() for x in (e, kind)]
    return F.coalesce(F.create_map(*pairs)[bare], F.lit("unknown"))


def signature(head: Column) -> Column:
    """The format that the first bytes tell, ``unknown`` for others."""
    code = F.hex(F.substring(head, 1, 12))
    out = F.when(code.rlike("^52494646.{8}57454250"), "webp")
    for sign, kind in SIGNATURES:
        out = out.when(code.startswith(sign), kind)
    return out.otherwise("unknown")
