"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from docloom.llm import chunking, garbled, markup, mixing, names, quality, tokens
from docloom.tables import read, read_wide


def p1_found(spark, folder):
    """Texts that must be cut, and whether by force."""
    return chunking.oversized(read_wide(spark, folder, "extracted_texts"), read(spark, folder, "chunking_configs"))


def p1_chunks(spark, folder):
    """The pieces of every text."""
    return chunking.chunks(read_wide(spark, folder, "extracted_texts"), read(spark, folder, "chunking_configs"))


def p4_found(spark, folder):
    """Contributors named under a spelling other than the registered one."""
    return names.variants(read(spark, folder, "doc_metadata"), read(spark, folder, "contributors"))


def p4_links(spark, folder):
    """Every name that is linked to the register."""
    return names.linked(read(spark, folder, "doc_metadata"), read(spark, folder, "contributors"))


def p5_found(spark, folder):
    """The kinds of markup in each text."""
    return markup.found(read_wide(spark, folder, "html_converted"), read(spark, folder, "file_contexts"))


def p5_texts(spark, folder):
    """The clean text of each page."""
    return markup.converted(read_wide(spark, folder, "html_converted"), read(spark, folder, "file_contexts"))


def p6_found(spark, folder):
    """Texts that hold a garbled sequence."""
    return garbled.found(read_wide(spark, folder, "html_converted"))


def p6_texts(spark, folder):
    """Texts with garbled sequences restored."""
    return garbled.restore(read_wide(spark, folder, "html_converted"))


def p7_ids(spark, folder):
    """Token ids of every document."""
    return tokens.encode(read_wide(spark, folder, "documents"))


def p8_mixture(spark, folder):
    """The mixture of all sources, document by document."""
    return mixing.mixture(read_wide(spark, folder, "documents"), read(spark, folder, "mix_targets"))


def p8_shares(spark, folder):
    """The share that each source got."""
    return mixing.shares(read_wide(spark, folder, "documents"), read(spark, folder, "mix_targets"))


def p9_found(spark, folder):
    """Documents whose body is a list, a table or junk."""
    return quality.not_prose(read_wide(spark, folder, "documents"))


def p9_quality(spark, folder):
    """Quality statistics and kind of every document."""
    return quality.classified(read_wide(spark, folder, "documents"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_chunks": p1_chunks, "p4_found": p4_found, "p4_links": p4_links, "p5_found": p5_found, "p5_texts": p5_texts, "p6_found": p6_found, "p6_texts": p6_texts, "p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_quality": p9_quality}


P1_FOUND = r"""
WITH sized AS (
  SELECT text_id, text, chunk_size FROM extracted_texts JOIN chunking_configs USING (config_id)
  WHERE length(text) > chunk_size
)
SELECT text_id, CASE WHEN list_max(list_transform(string_split_regex(text, '[ \t\r\n]'), lambda x: length(x))) > chunk_size THEN 'forced' ELSE 'natural' END AS kind
FROM sized
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND}
