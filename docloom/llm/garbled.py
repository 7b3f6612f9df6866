"""Text garbled by a wrong decoding: found, and restored where the bytes are still there.

Noisy channel: a word as it stands came from a true word through a channel, that is a true encoding
read in a wrong one. Undoing a channel gives bytes, with a wildcard for each that was lost, and the
true encoding makes a lattice of them; the best path under the frequencies of words and of pairs of
signs in the corpus is the candidate. A Viterbi search over the words of a text then picks the channel
of each, with a price for every change. The frequencies are counted over the whole corpus; what of them
goes to the workers is bounded whatever the corpus holds.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from codecs import charmap_encode
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import nlargest
from math import log
from operator import itemgetter
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.tables import bounded_batches, stored

#: The most words and pairs of signs whose frequencies are kept; the bound of what is broadcast (twelve bytes each).
#: Where a corpus has more, the rarest go together, up to a count at which the rest fits.
MOST_WORDS, MOST_PAIRS = 1 << 20, 1 << 20
#: A word holds a sign beyond ASCII; blanks, digits and most punctuation part words, as no encoding here makes them second bytes.
WORD = re.compile(r"(?<![\x40-\x7f])[\x40-\x7f]*+[^\x00-\x7f][^\x00-\x3f]*+")
#: What of a word the frequencies are of: letters and signs beyond ASCII without the punctuation between them.
PART = re.compile(r"(?<![A-Za-z])[A-Za-z]*+[\x80-\U0010ffff][A-Za-z\x80-\U0010ffff]*+")
PART_SQL = r"(?<![A-Za-z])[A-Za-z]*+[\x{80}-\x{10ffff}][A-Za-z\x{80}-\x{10ffff}]*+"
START, END = "\x02", "\x03"
LOST = "�"
#: Price in nats of a change to a channel between words, by its true encoding: chance seldom makes the bytes
#: of clean text valid UTF-8, more often those of an encoding of two bytes, always those of one of single bytes.
PRICES, TWO_BYTES, ONE_BYTE, BACK = {"utf-8": 0.5}, ("cp949", "shift_jis", "gbk"), 6.0, 0.3
PRICES |= dict.fromkeys(TWO_BYTES, 3.0)
#: Paths kept through a lattice for each sign that they can end in. One makes the search exact under the pairs of
#: signs; the others are there because words have frequencies of their own, by which the ends are chosen.
BEST = 8
#: What lost signs cost a word in nats, for each dozen of them; a word with fewer pays for a dozen.
LOST_PRICE, DOZEN = 40, 12
#: From this many signs on a word is a stretch without a blank; its frequency as a whole says nothing, pairs of signs do.
LONG = 400
#: Weight of the word table against the pairs of signs.
WORD_SHARE = 0.7


@lru_cache(maxsize=64)
def _reverse(wrong: str) -> dict[int, int]:
    """Sign to byte of a single-byte encoding; bytes without a sign stay as control signs."""
    table = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(wrong))] = b
        except UnicodeDecodeError:
            table[b] = b
    if wrong == "cp1252":
        table |= {b: b for b in range(0x80, 0xA0) if b not in table}
    return table


#: Channels as steps (wrong, true), the outermost first.
_SINGLE = ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp1250", "koi8-r", "cp850", "iso8859-2")
CHANNELS: tuple[tuple[tuple[str, str], ...], ...] = (
    *(((w, "utf-8"),) for w in _SINGLE),
    (("cp949", "utf-8"),), (("shift_jis", "utf-8"),), (("gbk", "utf-8"),),
    (("cp1252", "utf-8"), ("cp1252", "utf-8")), (("latin-1", "utf-8"), ("latin-1", "utf-8")), (("cp1252", "utf-8"), ("latin-1", "utf-8")), (("cp1252", "utf-8"), ("cp1252", "utf-8"), ("cp1252", "utf-8")),
    *(((w, t),) for w in ("cp1252", "latin-1") for t in ("cp1251", "koi8-r", "cp949", "shift_jis", "cp1250")),
    (("cp1251", "cp1252"),), (("cp1251", "koi8-r"),), (("koi8-r", "cp1251"),), (("cp1250", "cp1252"),), (("cp1251", "cp949"),), (("cp437", "cp1252"),), (("mac_roman", "cp1252"),), (("cp437", "cp1251"),),
)
#: The price of each state: no channel, each channel, and signs lost one by one.
PRICE = np.array([BACK, *(PRICES.get(steps[-1][1], ONE_BYTE) if all(w not in TWO_BYTES for w, _ in steps) else 1.5 for steps in CHANNELS), 2.0])


class Frequencies:
    """Frequencies of words, of pairs of signs and of signs in the corpus.

    Words are told by a checksum of 32 bits, so that a word that was never seen counts as known with a chance of one
    in four thousand where the table is full; pairs and signs are told exactly.
    """

    def __init__(self, words: tuple[np.ndarray, np.ndarray], pairs: tuple[np.ndarray, np.ndarray], signs: tuple[np.ndarray, np.ndarray], n_words: float):
        self.words, self.pairs = (_sorted(*x) for x in (words, pairs))
        self.pair_keys, self.pair_often = np.frombuffer(self.pairs[0], np.int64), np.frombuffer(self.pairs[1], np.float32)
        self.signs = {chr(c): float(n) for c, n in zip(signs[0].tolist(), signs[1].tolist()) if chr(c) not in (START, END)}
        self.n_words, self.n_signs = max(1.0, n_words), max(1.0, float(signs[1].sum()))
        self.starts = float(signs[1][signs[0] == ord(START)].sum())
        self.kept: dict[str, float] = {}
        self.steps: dict[str, float] = {}
        self.options: dict[tuple, tuple[str, ...]] = {}
        self.steps_between: dict[tuple, np.ndarray] = {}
        self.held = 0
        self.encoded: dict[str, dict[int, list[tuple[bytes, str]]]] = {}

    @classmethod
    def of(cls, parts: dict[str, int]) -> Frequencies:
        """Out of the parts of words of a corpus and how often each is there."""
        words: dict[int, int] = {}
        for part, n in parts.items():
            key = crc32(part.encode("utf-8", "surrogatepass"))
            words[key] = words.get(key, 0) + n
        pairs = _pairs(parts.items())
        signs: dict[int, int] = {}
        for key, n in pairs.items():
            signs[key >> 21] = signs.get(key >> 21, 0) + n
        arrays = [(np.fromiter(x.keys(), np.int64, len(x)), np.fromiter(x.values(), np.float64, len(x))) for x in (words, pairs, signs)]
        return cls(*arrays, float(sum(parts.values())))

    def lone(self, sign: str) -> float:
        """The probability of a sign whatever stands before it."""
        return ((self.n_words if sign == END else self.signs.get(sign, 0.0)) + 0.01) / (self.n_signs + 0.01 * 65536)

    def seen(self, sign: str) -> float:
        """How often a sign has another after it."""
        return self.starts if sign == START else self.signs.get(sign, 0.0)

    def step(self, pair: str) -> float:
        """Log probability of a sign after another."""
        found = self.steps.get(pair)
        if found is None:
            a, b = pair
            share = (_often(self.pairs, (ord(a) << 21) | ord(b)) + 2 * self.lone(b)) / (self.seen(a) + 2)
            if len(self.steps) > 500_000:
                self.steps.clear()
            self.steps[pair] = found = log(min(1.0, share))
        return found

    def matrix(self, before: tuple[str, ...], after: tuple[str, ...]) -> np.ndarray:
        """Log probabilities of each of some signs after each of others."""
        found = self.steps_between.get((before, after))
        if found is None:
            if len(before) * len(after) < 16:
                found = np.array([[self.step(a + b) for b in after] for a in before], np.float32)
            else:
                a, b = (np.fromiter(map(ord, x), np.int64, len(x)) for x in (before, after))
                lone, seen = np.array([self.lone(x) for x in after]), np.array([self.seen(x) for x in before])
                keys = (a[:, None] << 21) | b
                at = np.minimum(np.searchsorted(self.pair_keys, keys), max(0, len(self.pair_keys) - 1))
                often = np.where(self.pair_keys[at] == keys, self.pair_often[at], 0.0) if len(self.pair_keys) else np.zeros(keys.shape)
                found = np.log(np.minimum(1.0, (often + 2 * lone) / (seen[:, None] + 2))).astype(np.float32)
            self.held += found.size
            if self.held > 4_000_000:
                self.steps_between.clear()
                self.held = found.size
            self.steps_between[before, after] = found
        return found

    def known(self, part: str) -> float:
        """How often a part of a word is in the corpus."""
        return _often(self.words, crc32(part.encode("utf-8", "surrogatepass")))

    def spelled(self, part: str) -> float:
        """Log probability of a part from its pairs of signs."""
        marked, step = f"{START}{part}{END}", self.step
        return sum(step(marked[i : i + 2]) for i in range(len(marked) - 1)) + _UNKNOWN

    def part(self, part: str) -> float:
        """Log probability of a part of a word, from its own frequency and its pairs of signs."""
        found = self.kept.get(part)
        if found is None:
            found, known = self.spelled(part), self.known(part)
            if known:
                found = float(np.logaddexp(found, log(WORD_SHARE * known / self.n_words)))
            if len(self.kept) > 500_000:
                self.kept.clear()
            self.kept[part] = found
        return found

    def word(self, word: str) -> float:
        """Log probability of a word; what is pure ASCII costs nothing, as no channel changes it."""
        return sum(map(self.part, PART.findall(word)))

    def stretch(self, text: str) -> float:
        """Log probability of a long stretch, from its pairs of signs alone."""
        return sum(map(self.spelled, PART.findall(text)))

    def signs_of(self, part: tuple[int | None, ...], true: str) -> tuple[str, ...]:
        """The signs of the corpus whose bytes in an encoding agree with some of which not all are known; a lost byte is none of ASCII."""
        found = self.options.get((part, true))
        if found is None:
            by_size = self.encoded.get(true)
            if by_size is None:
                by_size = self.encoded[true] = {}
                for sign in self.signs:
                    try:
                        raw = sign.encode(true)
                    except UnicodeEncodeError:
                        continue
                    by_size.setdefault(len(raw), []).append((raw, sign))
            found = tuple(sign for raw, sign in by_size.get(len(part), ()) if all(r >= 0x80 if b is None else b == r for b, r in zip(part, raw)))
            if len(self.options) > 20_000:
                self.options.clear()
            self.options[part, true] = found
        return found

    def alphabet(self) -> tuple[str, ...]:
        """The signs beyond ASCII of the corpus that single bytes can be."""
        if (None,) not in self.options:
            self.options[(None,)] = tuple(sorted({s for e in ("cp1252", "cp1250", "cp1251", "koi8-r") for s in self.signs_of((None,), e) if s > "\x7f"}))
        return self.options[(None,)]


_UNKNOWN = log(1 - WORD_SHARE)


def _sorted(keys: np.ndarray, often: np.ndarray) -> tuple[array, array]:
    order = np.argsort(keys, kind="stable")
    return array("q", keys[order].astype(np.int64).tobytes()), array("f", often[order].astype(np.float32).tobytes())


def _often(table: tuple[array, array], key: int) -> float:
    at = bisect_left(table[0], key)
    return table[1][at] if at < len(table[0]) and table[0][at] == key else 0.0


def _pairs(parts: Iterable[tuple[str, int]]) -> dict[int, int]:
    """Pairs of signs of parts of words, each as one number, and how often each is there."""
    out: dict[int, int] = {}
    for part, n in parts:
        codes = [2, *map(ord, part), 3]
        for a, b in zip(codes, codes[1:]):
            key = (a << 21) | b
            out[key] = out.get(key, 0) + n
    return out


#: Bytes of a word before it was misread; None for a lost one.
Raw = list[int | None]


def unread(word: str, wrong: str) -> bytes | Raw | None:
    """The bytes that, read in the wrong encoding, give the word, with None in a list for lost ones; None: it can't be."""
    pieces: list[bytes] = []
    try:
        for piece in word.split(LOST):
            pieces.append(charmap_encode(piece, "strict", _reverse(wrong))[0] if wrong in _SINGLE else piece.encode(wrong))
    except UnicodeEncodeError:
        return None
    if len(pieces) == 1:
        return pieces[0]
    out: Raw = [*pieces[0]]
    for piece in pieces[1:]:
        out += [None, *piece]
    return out


class _Column:
    """What ends at a place of a lattice: signs, the scores of the best paths that end in each, and where these come from:
    ``back`` counts through the paths of all columns ``before``, the best of each sign of each."""

    def __init__(self, signs: tuple[str, ...], scores: np.ndarray, back: np.ndarray, before: list[_Column]):
        self.signs, self.scores, self.back, self.before = signs, scores, back, before

    def text(self, sign: int, rank: int) -> str:
        out, column = [], self
        while column.before:
            out.append(column.signs[sign])
            at, which = int(column.back[sign, rank]), 0
            while at >= column.before[which].scores.size:
                at -= column.before[which].scores.size
                which += 1
            column = column.before[which]
            sign, rank = divmod(at, column.scores.shape[1])
        return "".join(reversed(out))


def _joined(ways: list[tuple[_Column, tuple[str, ...]]], lm: Frequencies) -> _Column:
    """The best paths over some columns and the signs that may follow each, by Viterbi over the last sign of a path."""
    if len(ways) == 1:
        before, signs = ways[0]
        if len(before.signs) == 1 and len(signs) == 1:
            return _Column(signs, before.scores + np.float32(lm.step(before.signs[0] + signs[0])), np.arange(before.scores.shape[1])[None], [before])
        total = (before.scores[None] + lm.matrix(before.signs, signs).T[:, :, None]).reshape(len(signs), -1)
    else:
        signs = tuple(dict.fromkeys(s for _, some in ways for s in some))
        place = {s: i for i, s in enumerate(signs)}
        total = np.full((len(signs), sum(c.scores.size for c, _ in ways)), -np.inf, np.float32)
        at = 0
        for c, some in ways:
            block = (c.scores[None] + lm.matrix(c.signs, some).T[:, :, None]).reshape(len(some), -1)
            total[[place[s] for s in some], at : at + block.shape[1]] = block
            at += block.shape[1]
    if total.shape[1] > BEST:
        top = np.argpartition(total, -BEST, axis=1)[:, -BEST:]
        return _Column(signs, np.take_along_axis(total, top, axis=1), top, [c for c, _ in ways])
    return _Column(signs, total, np.broadcast_to(np.arange(total.shape[1]), total.shape), [c for c, _ in ways])


def _through(columns: Iterator[list[tuple[int, tuple[str, ...]]]], size: int, lm: Frequencies) -> list[str]:
    """The likeliest texts through a lattice.

    ``columns`` gives for each place the signs that may start there, by how far each leads.
    """
    here: _Column | None = _Column((START,), np.zeros((1, 1), np.float32), np.zeros((1, 1), np.int64), [])
    coming: dict[int, list[tuple[_Column, tuple[str, ...]]]] = {}
    for at, column in enumerate(columns):
        if at:
            ways = coming.pop(at, None)
            here = _joined(ways, lm) if ways else None
        if here is None:
            if not coming:
                return []
            continue
        for step, signs in column:
            if signs:
                coming.setdefault(at + step, []).append((here, signs))
    if size not in coming:
        return []
    end = _joined(coming[size], lm)
    last = end.scores + lm.matrix(end.signs, (END,))
    best = np.argsort(-last, axis=None, kind="stable")[: 2 * BEST]
    return [end.text(*divmod(int(k), last.shape[1])) for k in best if last.flat[k] > -np.inf]


def reread(raw: bytes | Raw, true: str, lm: Frequencies, score: Callable[[str], float]) -> str | None:
    """The likeliest text of bytes in the true encoding, however many are lost if they are less than half; None: there is none."""
    if isinstance(raw, bytes):
        try:
            return raw.decode(true)
        except UnicodeDecodeError:
            return None
    if sum(b is None for b in raw) * 2 >= len(raw):
        return None
    texts = _through((_signs(raw, at, true, lm) for at in range(len(raw))), len(raw), lm)
    return max(((score(text), text) for text in texts), default=(0, None))[1]


def _signs(raw: Raw, at: int, true: str, lm: Frequencies) -> list[tuple[int, tuple[str, ...]]]:
    """The signs that may start at a byte, by how many bytes they take."""
    out = []
    for size in (1, 2, 3, 4) if true == "utf-8" else (1, 2) if true in TWO_BYTES else (1,):
        part = tuple(raw[at : at + size])
        if len(part) < size:
            break
        if None not in part:
            try:
                sign = bytes(part).decode(true)  # type: ignore[arg-type]
            except UnicodeDecodeError:
                continue
            if len(sign) == 1:
                out.append((size, (sign,)))
        elif true != "utf-8" or _may_be(part):
            found = lm.signs_of(part, true)
            if found:
                out.append((size, found))
    return out


def _may_be(part: tuple[int | None, ...]) -> bool:
    """Whether bytes of which some are lost can be one sign in UTF-8."""
    low, high = ((0xC2, 0xE0), (0xE0, 0xF0), (0xF0, 0xF5))[len(part) - 2] if len(part) > 1 else (1, 0)
    return (part[0] is None or low <= part[0] < high) and len(part) > 1 and all(b is None or 0x80 <= b < 0xC0 for b in part[1:])


_NOT_TEXT = re.compile(r"[\x00-\x1f\x7f-\x9f]")


def candidates(word: str, lm: Frequencies) -> list[tuple[float, str] | None]:
    """Score and text of a word under no channel and each channel; None: impossible."""
    score = lm.word if len(word) <= LONG else lm.stretch
    out: list[tuple[float, str] | None] = [(score(word), word)]
    # several channels begin alike, and several encodings give the same bytes
    undone: dict[tuple[str, str], bytes | Raw | None] = {}
    read: dict[tuple[bytes | tuple, str], str | None] = {}
    scored: dict[str, float] = {}
    for steps in CHANNELS:
        text: str | None = word
        for wrong, true in steps:
            if (text, wrong) not in undone:
                undone[text, wrong] = unread(text, wrong)
            raw = undone[text, wrong]
            if raw is None:
                text = None
                break
            key = (raw if isinstance(raw, bytes) else tuple(raw), true)
            if key not in read:
                read[key] = reread(raw, true, lm, score)
            text = read[key]
            if text is None:
                break
        if text is None or text == word or _NOT_TEXT.search(text):
            out.append(None)
            continue
        if text not in scored:
            scored[text] = score(text)
        out.append((scored[text], text))
    if LOST in word:
        # bytes of one sign each were lost when other bytes were read as UTF-8
        text = _filled(word, lm, score)
        out.append(None if text is None else (score(text), text))
        out[0] = (out[0][0] - LOST_PRICE * max(1, word.count(LOST) / DOZEN), word)
    else:
        out.append(None)
    return out


def _filled(word: str, lm: Frequencies, score: Callable[[str], float]) -> str | None:
    """The word with the likeliest signs for lost ones, if they aren't most of it."""
    if word.count(LOST) * 2 >= len(word):
        return None
    texts = _through(([(1, lm.alphabet() if c == LOST else (c,))] for c in word), len(word), lm)
    best = max(((score(t), t) for t in texts), default=None)
    return best[1] if best and all(lm.known(p) for p in PART.findall(best[1])) else None


class Restorer:
    """Finds and restores garbled words of texts."""

    def __init__(self, lm: Frequencies):
        self.lm, self.known = lm, {}

    def _of(self, word: str):
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = candidates(word, self.lm)
            scores = np.array([-1e9 if x is None else x[0] for x in found])
            found = (scores, [None if x is None else x[1] for x in found], bool((scores[1:] > scores[0]).any()))
            if len(word) <= LONG:  # a long stretch hardly comes again
                self.known[word] = found
        return found

    def __call__(self, text: str) -> tuple[str, int, int]:
        """The restored text, the number of garbled words, and of those among them that stay; it is gone over until
        nothing changes, as it may have been garbled more than once."""
        most, left, seen = 0, 0, set()
        while True:
            seen.add(hash(text))
            text, garbled, left = self.once(text)
            most = max(most, garbled)
            if garbled == left or hash(text) in seen:
                return text, most, left

    def once(self, text: str) -> tuple[str, int, int]:
        if text.isascii():
            return text, 0, 0
        words = list(WORD.finditer(text))
        of = [self._of(m[0]) for m in words]
        if not any(x[2] for x in of) and LOST not in text and not _CONTROL.search(text):
            return text, 0, 0
        best, back = None, []
        for scores, _, _ in of:
            if best is None:
                best = scores - PRICE * (PRICE != BACK)
                continue
            jump = int(np.argmax(best))
            stay, move = best, best[jump] - PRICE
            back.append(np.where(stay >= move, np.arange(len(best)), jump))
            best = np.maximum(stay, move) + scores
        path = [int(np.argmax(best))] if best is not None else []
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        path.reverse()
        out, at, garbled, left = [], 0, 0, 0
        for m, state, (_, texts, _) in zip(words, path, of):
            new = texts[state] if state and texts[state] is not None else m[0]
            if new != m[0]:
                garbled += 1
                out += [text[at : m.start()], new]
                at = m.end()
            elif LOST in new or _CONTROL.search(new):
                garbled, left = garbled + 1, left + 1
        return "".join([*out, text[at:]]), garbled, left


_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")


def _common(counted: DataFrame, most: int) -> DataFrame:
    """The rows of ``key, n`` with the largest ``n``, at most so many: those from the least count on at which the rest fits."""
    # counts to three digits, so that there are few of them whatever they are
    size = F.greatest(F.floor(F.log10("n")) - 2, F.lit(0))
    level = (F.floor(F.col("n") / F.pow(F.lit(10.0), size)) * F.pow(F.lit(10.0), size)).cast("bigint")
    levels = counted.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()
    held, least = 0, 1 << 62
    for r in sorted(levels, key=lambda r: -r["level"]):
        if held + r["rows"] > most:
            break
        held, least = held + r["rows"], r["level"]
    return counted.where(F.col("n") >= least)


def _arrays(counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = counted.select("key", "n").toArrow()
    return table.column(0).to_numpy(), table.column(1).to_numpy().astype(np.float32)


def frequencies(texts: DataFrame, text: str) -> tuple:
    """What ``Frequencies`` takes, over all texts: the shuffles move distinct parts of words, then sums by pair of signs."""
    found = texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PART_SQL), F.lit(0))).alias("part"))
    parts = stored(found.groupBy("part").agg(F.count("*").alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = _pairs(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["key", "n"])

    pairs = stored(bounded_batches(parts).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")))
    words = parts.select(F.crc32("part").alias("key"), "n")
    signs = pairs.groupBy(F.shiftright("key", 21).alias("key")).agg(F.sum("n").alias("n"))
    # there are no more signs than Unicode has; words with one checksum are added up by whoever reads the table
    common = _common(words, MOST_WORDS).groupBy("key").agg(F.sum("n").alias("n"))
    return _arrays(common), _arrays(_common(pairs, MOST_PAIRS)), _arrays(signs), float(parts.agg(F.sum("n")).first()[0] or 0)


#: The restorer of the last frequencies that a worker was given.
_RESTORERS: dict[str, Restorer] = {}


def restore(df: DataFrame, key: str = "html_id", text: str = "html_text") -> DataFrame:
    """``key, restored, garbled, left``: the text with garbled words restored, how many were garbled, and how many of
    them stay because too many bytes are lost; one row for each row.

    Null texts give null and 0, empty ones stay. What the row says of its encoding isn't asked. Words are
    looked at whole, and in texts of any length.
    """
    shared, token = df.sparkSession.sparkContext.broadcast(frequencies(df, text)), uuid4().hex

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker meets the same words in one task after another
        if token not in _RESTORERS:
            _RESTORERS.clear()
            _RESTORERS[token] = Restorer(Frequencies(*shared.value))
        fix = _RESTORERS[token]
        for part in parts:
            done = [(None, 0, 0) if t is None else fix(t) for t in part.column(1).to_pylist()]
            new, garbled, left = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.string()), pa.array(garbled, pa.int32()), pa.array(left, pa.int32())], [key, "restored", "garbled", "left"])

    kind = df.schema[key].dataType.simpleString()
    return bounded_batches(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, restored string, garbled int, left int")


def found(df: DataFrame, key: str = "html_id", text: str = "html_text") -> DataFrame:
    """``key`` of each row whose text holds a garbled word, recoverable or not, once."""
    return restore(df, key, text).where("garbled > 0").select(key).distinct()
