"""Encoding and sizing of a whole corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.bpe import TOKENIZERS, batches, encoder
from docloom.tables import bounded_batches

#: Characters encoded at a time; bounds a worker's memory, not the result.
AT_ONCE = 2_000_000


def _vocabulary(name: str, folder: str) -> str:
    return f"{folder}/{name}.tiktoken"


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids``, the token ids of ``text`` without special tokens; one row for each row.

    An empty text has the empty list, a null text null ids. White space only is text like any other.
    Keys may be null or repeat; other columns are not looked at. Texts of any length are encoded whole.
    One narrow pass: no shuffle, each worker loads the vocabulary once.
    """
    file = _vocabulary(tokenizer, folder)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file)
        for part in parts:
            keys, texts, at = part.column(0), part.column(1).to_pylist(), 0
            for group in batches([t or "" for t in texts], AT_ONCE):
                flat, sizes = bpe.encode_flat(group)
                n = len(group)
                null = pa.array([t is None for t in texts[at : at + n]], pa.bool_())
                ends = sizes.cumsum()
                offsets = pa.array([0, *ends.tolist()], pa.int32())
                if null.true_count:
                    offsets = pa.array([None if x else o for x, o in zip([*null.to_pylist(), False], offsets.to_pylist())], pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys.slice(at, n), ids], [key, "ids"])
                at += n

    kind = df.schema[key].dataType.simpleString()
    return bounded_batches(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count(df: DataFrame, text: str = "text", out: str = "n_tokens", keep: list[str] | None = None, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``out``, the number of tokens of ``text``; 0 for an empty, null for a null text."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    file = _vocabulary(tokenizer, folder)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(file)
        for part in parts:
            texts, counts = part.column(part.num_columns - 1).to_pylist(), []
            for group in batches([t or "" for t in texts], AT_ONCE):
                counts += bpe.count_batch(group).tolist()
            counts = pa.array([None if t is None else c for t, c in zip(texts, counts)], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], counts], [*keep, out])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return bounded_batches(df.select(*keep, text)).mapInArrow(run, ", ".join([*fields, f"`{out}` bigint"]))
