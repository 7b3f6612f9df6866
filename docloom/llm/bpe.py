"""Encoding with a public byte-level BPE vocabulary by dynamic programming over prefixes.

A byte string has exactly one encoding that greedy merging yields, and its last token follows from
its length alone: token ``t`` ends the encoding of ``s[:j]`` exactly if the last token of
``s[:j-len(t)]`` may stand before ``t``. So one pass over the prefixes stores one token each:

* an automaton of suffix matches lists the tokens that end at ``j``, longest first;
* a pair test says whether greedy merging leaves ``a`` and ``b`` apart when they stand together;
* the back-pointers (token lengths) from the end give the ids.

Texts are cut into pre-tokens first, as the vocabulary demands; the piece's ids are kept by piece in
a bounded table, so the dynamic programme runs once for each distinct piece a worker meets.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pandas as pd
import regex

#: Where the public vocabularies lie; every operator takes another folder as a parameter.
TOKENIZERS = "/opt/tokenizers"
#: Pieces whose ids a worker remembers before it starts afresh: a bound of memory, not of results.
REMEMBERED = 1_000_000
#: Fixed value: the pre-token pattern of the vocabulary.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Classes of characters that PIECE tells apart.
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
#: What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def ranks_of(file: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the id."""
    lines = Path(file).read_bytes().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    found = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            found[a : b + 1] = kind
    return found


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, for hashes of all stretches of a text."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def cuts(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts start that stand one after the other; ``begins``: each text's start.

    The same cuts as PIECE makes, found for all places at once: a run of letters, of numbers or of
    other signs is a piece and takes one blank before it along; of white space before such a run the
    last sign is cut off; a contraction is a piece where a piece starts at its apostrophe.
    """
    n = len(codes)
    kind = classes()[codes]
    blank = kind == BLANK
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = (kind[1:] != kind[:-1]) & ~((codes[:-1] == 32) & ~blank[1:])
    last = blank.copy()
    last[:-1] &= ~blank[1:]
    last &= ~first[1:]
    start |= last
    start |= first[:-1]
    marks = np.flatnonzero((codes == 39) & start)
    if len(marks):
        end = np.append(begins, n)[np.searchsorted(begins, marks, "right")]
        padded = np.append(codes, [0, 0, 0])
        taken = np.zeros(len(marks), bool)
        for tail in CONTRACTIONS:
            hit = ~taken & (marks + len(tail) < end)
            for k, c in enumerate(tail):
                hit &= padded[marks + 1 + k] == ord(c)
            taken |= hit
            at = marks[hit]
            for k in range(len(tail)):
                start[at + 1 + k] = False
            after = at + 1 + len(tail)
            start[after[after < n]] = True
    return np.flatnonzero(start)


class PrefixBpe:
    """Exact encoder of one vocabulary of byte-level merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.parts = _Parts(self._last_merge, self.token)
        self.apart: dict[tuple[int, int], bool] = {}
        self.suffixes = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.suffixes.add_word(t.decode("latin-1"), (len(t), i))
        self.suffixes.make_automaton()
        self.pieces = Pieces(self)

    def _last_merge(self, t: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``t``, None for a single byte."""
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if rank >= self.ranks[t]:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging by rank keeps ``a`` and ``b`` as they are when ``b`` follows ``a``.

        Undo the later of both merges step by step along the seam; a merge across the seam that comes
        before the one undone would have happened first.
        """
        known = self.apart.get((a, b))
        if known is not None:
            return known
        left, right, limit, kept = a, b, 1 << 40, True
        while True:
            across = self.ranks.get(self.token[left] + self.token[right])
            if across is not None and across < limit:
                kept = False
                break
            split_left, split_right = self.parts[left], self.parts[right]
            if left > right or (left == right and split_left is None):
                if split_left is None:
                    if split_right is None:
                        break
                    limit, right = right, split_right[0]
                    continue
                limit, left = left, split_left[1]
                if left == limit:
                    limit += 1
            else:
                if split_right is None:
                    if split_left is None:
                        break
                    limit, left = left, split_left[1]
                    continue
                limit, right = right + 1, split_right[0]
        if len(self.apart) > 4 * REMEMBERED:
            self.apart.clear()
        self.apart[a, b] = kept
        return kept

    def piece_ids(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, apart, done = len(piece), self.apart, -1
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, token) in self.suffixes.iter(piece.decode("latin-1")):  # of one end the longest first
            if end == done:
                continue
            before = end + 1 - length
            if before:
                left = last[before]
                if left < 0:
                    continue
                kept = apart.get((left, token))
                if not (self.compatible(left, token) if kept is None else kept):
                    continue
            last[end + 1], size[end + 1], done = token, length, end
        ids, j = [], n
        while j:
            ids.append(last[j])
            j -= size[j]
        return ids[::-1]

    def encode(self, text: str) -> list[int]:
        """The ids of a text; an empty text has none."""
        return self.encode_flat([text])[0].tolist()

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of ids of each text."""
        slots, pieces = self._slots(texts)
        sizes = self.pieces.size[slots]
        return self.pieces.gather(slots), _sums(sizes, pieces)

    def count_batch(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        slots, pieces = self._slots(texts)
        return _sums(self.pieces.size[slots], pieces)

    def _slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every pre-token of all texts, and each text's number of pre-tokens."""
        self.pieces.limit()
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        begins = np.unique(np.append(0, ends[:-1]))
        begins = begins[begins < len(codes)]
        starts = cuts(codes, begins)
        stops = np.append(starts[1:], len(codes))
        sizes = stops - starts
        up, down = powers(1 << (max(len(codes), 1 << 21) + 1).bit_length())
        with np.errstate(over="ignore"):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes + np.uint32(1)) * up[: len(codes)], out=sums[1:])
            hashes = (sums[stops] - sums[starts]) * down[starts] + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        group, distinct = pd.factorize(hashes)
        sample = np.empty(len(distinct), np.int64)
        sample[group[::-1]] = np.arange(len(group))[::-1]
        # equal hashes are looked at sign by sign, so the ids don't rest on them
        other = np.arange(len(codes)) + np.repeat(starts[sample][group] - starts, sizes)
        if (sizes != sizes[sample][group]).any() or (codes[np.minimum(other, len(codes) - 1)] != codes).any():
            slots = np.array([self.pieces[joined[a:b]] for a, b in zip(starts.tolist(), stops.tolist())], np.int64)
        else:
            known = self.pieces
            slots = np.array([known[joined[a:b]] for a, b in zip(starts[sample].tolist(), stops[sample].tolist())], np.int64)[group]
        return slots, np.diff(np.searchsorted(starts, np.append(0, ends)))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum over each of the stretches of ``sizes`` values that follow one another."""
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(sizes)
    return (total[ends] - total[ends - sizes]).astype(np.int64)


class _Parts(dict):
    """Token to the two tokens it was merged from, found when first asked for."""

    def __init__(self, split, token: dict[int, bytes]):
        super().__init__()
        self.split, self.token = split, token

    def __missing__(self, i: int) -> tuple[int, int] | None:
        self[i] = found = self.split(self.token[i])
        return found


class Pieces(dict):
    """Pre-token to slot; the slot's ids lie in one flat array."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.start, self.size, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32)
        self.used = 0

    def limit(self) -> None:
        """Start afresh before a batch; slots hold within one."""
        if len(self) > REMEMBERED or self.used > 8 * REMEMBERED:
            self._reset()

    def __missing__(self, piece: str) -> int:
        ids, slot = self.bpe.piece_ids(piece.encode("utf-8", "surrogatepass")), len(self)
        if slot >= len(self.start):
            self.start, self.size = np.resize(self.start, 2 * slot), np.resize(self.size, 2 * slot)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.start[slot], self.size[slot] = self.used, len(ids)
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self[piece] = slot
        return slot

    def gather(self, slots: np.ndarray) -> np.ndarray:
        size = self.size[slots]
        total = int(size.sum())
        shift = np.repeat(self.start[slots] - np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size, size)
        return self.flat[shift + np.arange(total)]


@lru_cache(maxsize=4)
def encoder(file: str) -> PrefixBpe:
    """The encoder of a vocabulary file, once for each Python worker."""
    return PrefixBpe(ranks_of(file))


def batches(texts: list[str], most: int) -> Iterator[list[str]]:
    """Groups of texts of about ``most`` characters."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group
