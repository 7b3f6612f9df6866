"""Timestamps in mixed formats and zones as moments in UTC.

Every value is reduced to a shape mask: a digit becomes ``9``, a letter ``a``, all else stays. A mask is
mapped once to the formats it can have and the places of their fields; the values of a mask are then cut
at these places and converted as arrays, and wall clocks go through the transition table of their zone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import zones
from docloom.tables import bounded_batches

RESOLVED, UNPARSED, INVALID, NO_TIME, NO_ZONE, GAP, AMBIGUOUS, NULL = STATUS = "resolved", "unparsed", "invalid", "no_time", "no_zone", "gap", "ambiguous", "null"
_NO = {s: i for i, s in enumerate(STATUS)}

MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
MONTHS |= {m: i for i, m in enumerate("january february march april may june july august september october november december".split(), 1)} | {"sept": 9}
DAYS = {d: i for i, d in enumerate("mon tue wed thu fri sat sun".split())}
DAYS |= {d: i for i, d in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())}
HALVES = {"am": 0, "pm": 12, "오전": 0, "오후": 12}
#: Zone abbreviations that name one offset, in minutes. IST is India's where the row's zone doesn't say otherwise.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "KST": 540, "JST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
_MINUTES = {k.lower(): v for k, v in ABBREVIATIONS.items()}
#: Locales that write the month before the day between slashes; all others write the day first.
MONTH_FIRST = {"en_US"}
#: Seconds from each fixed origin to 1970, and units a second, by the number's length and range.
ORIGIN_1601, ORIGIN_1 = 11_644_473_600, 62_135_596_800

#: Formats over masks: the signs of a shape stand for themselves, so each field lies at fixed places in every value of the shape.
_CLOCK = r"(?P<h>99?):(?P<mi>99)(?::(?P<s>99)(?:[.,]9+)?)?"
_ZONE = r"(?:\s*(?P<off>[+-]99:?99|[+-]99)|\s*(?P<abbr>a{1,5}))?"
_HALF = r"(?:\s*(?P<half>aa)(?!a))?"
FORMATS = [
    re.compile(p)
    for p in (
        rf"(?P<y>9999)[-/](?P<mo>99?)[-/](?P<d>99?)(?:(?:(?P<t>a)|\s+|,\s*){_CLOCK}{_ZONE})?",
        r"(?P<y>9999)(?P<mo>99)(?P<d>99)(?P<t>a)(?P<h>99)(?P<mi>99)(?P<s>99)?(?:[.,]9+)?" + _ZONE,
        r"(?:(?P<dated>a):)?(?P<y>9999)(?P<mo>99)(?P<d>99)(?:(?P<h>99)(?P<mi>99)(?P<s>99)?)?(?:(?P<z>a)(?:99'?99'?)?|(?P<off>[+-]99'?99)'?|(?P<hours>[+-]99)'?)?",
        rf"(?P<d>99?)\.(?P<mo>99?)\.(?P<y>9999)(?:,?\s+{_CLOCK}{_ZONE})?",
        rf"(?P<one>99?)/(?P<two>99?)/(?P<y>9999)(?:,?\s+{_CLOCK}{_HALF}{_ZONE})?",
        rf"(?P<wd>a{{3,9}}),?\s+(?P<mon>a{{3,9}})\s+(?P<d>99?)\s+{_CLOCK}(?:\s+(?P<abbr>a{{1,5}}))?\s+(?P<y>9999)",
        rf"(?:(?P<wd>a{{3,9}}),?\s+)?(?P<d>99?)[\s-](?P<mon>a{{3,9}})[\s-](?P<y>9999)(?:,?\s+{_CLOCK}{_ZONE})?",
        rf"(?P<mon>a{{3,9}})\.?\s+(?P<d>99?),?\s+(?P<y>9999)(?:,?\s+{_CLOCK}{_HALF}{_ZONE})?",
        rf"(?P<y>9999)(?:년|\.)\s*(?P<mo>99?)(?:월|\.)\s*(?P<d>99?)(?:일|\.)?(?:(?:\s*(?P<half>오전|오후))?\s*{_CLOCK}{_ZONE})?",
        r"(?P<number>9{10}|9{13}|9{16}|9{18,19})",
    )
]
#: Fields that must be one word for a value to have the format at all.
_WORDS = {"t": "t", "dated": "d", "z": "z"}
_SHAPE = str.maketrans({**dict.fromkeys("0123456789", "9"), **dict.fromkeys("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "a")})
#: Masks up to this length are kept with their formats; longer ones are looked at anew, so that long texts fill no memory.
_KEPT = 64

Fields = dict[str, tuple[int, int]]


def mask(value: str) -> str:
    """The shape of a value: its digits as 9, its Latin letters as a, the rest as it is."""
    return value.translate(_SHAPE)


def formats_of(shape: str) -> tuple[tuple[int, Fields], ...]:
    """The formats that values of a shape can have, with the place of each field; time linear in the shape's length."""
    return _kept(shape) if len(shape) <= _KEPT else _formats_of(shape)


def _formats_of(shape: str) -> tuple[tuple[int, Fields], ...]:
    found = ((i, f.fullmatch(shape)) for i, f in enumerate(FORMATS))
    return tuple((i, {k: m.span(k) for k, v in m.groupdict().items() if v is not None}) for i, m in found if m)


_kept = lru_cache(maxsize=4096)(_formats_of)


class _Cut:
    """The values of one shape as a matrix of signs, out of which fields are cut by their places."""

    def __init__(self, values: list[str], fields: Fields):
        width = len(values[0])
        self.text = np.array(values, f"<U{width}")
        self.signs = self.text.view(np.uint32).reshape(len(values), width)
        self.fields = fields

    def __contains__(self, name: str) -> bool:
        return name in self.fields

    def digits(self, a: int, b: int) -> np.ndarray:
        out = np.zeros(len(self.signs), np.int64)
        for k in range(a, b):
            out = out * 10 + (self.signs[:, k].astype(np.int64) - 48)
        return out

    def number(self, name: str, default: int) -> np.ndarray:
        return self.digits(*self.fields[name]) if name in self.fields else np.full(len(self.signs), default, np.int64)

    def word(self, name: str, table: dict[str, int], missing: int, unknown: int) -> np.ndarray:
        if name not in self.fields:
            return np.full(len(self.signs), missing, np.int64)
        a, b = self.fields[name]
        words, of = np.unique(np.ascontiguousarray(self.signs[:, a:b]).view(f"<U{b - a}").ravel(), return_inverse=True)
        return np.array([table.get(str(w).lower(), unknown) for w in words], np.int64)[of]

    def rows(self, keep: np.ndarray) -> _Cut:
        out = object.__new__(_Cut)
        out.text, out.signs, out.fields = self.text[keep], self.signs[keep], self.fields
        return out


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates, and which of them exist."""
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    longest = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)] + (leap & (m == 2))
    return zones.days(y, m, d), (m >= 1) & (m <= 12) & (d >= 1) & (d <= longest) & (y >= 1)


def resolved(values: list[str | None], locales: pa.Array, zone_names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds since 1970 of each text, and the number of its status in STATUS; seconds count only where it is 0."""
    n = len(values)
    wall, status = np.zeros(n, np.int64), np.full(n, _NO[NULL], np.int8)
    groups: dict[str, list[int]] = {}
    stripped = [None if v is None else v.strip() for v in values]
    for i, v in enumerate(stripped):
        if v is not None:
            groups.setdefault(v.translate(_SHAPE), []).append(i)
    orders = locales.dictionary_encode()
    months = np.array([x in MONTH_FIRST for x in orders.dictionary.to_pylist()] + [False])
    order_no = orders.indices.fill_null(len(months) - 1).to_numpy(zero_copy_only=False)
    known, month_first = order_no < len(months) - 1, months[order_no]
    local = np.zeros(n, bool)
    for shape, members in groups.items():
        left = np.array(members)
        status[left] = _NO[UNPARSED]
        for _, fields in formats_of(shape):
            cut = _Cut([stripped[i] for i in left], fields)
            fits = np.ones(len(left), bool)
            for name, word in _WORDS.items():
                fits &= cut.word(name, {word: 1}, 1, 0) == 1
            if fits.any():
                rows = left[fits]
                wall[rows], status[rows], local[rows] = _converted(cut.rows(fits), known[rows], month_first[rows])
                left = left[~fits]
            if not len(left):
                break
    in_zones = zone_names.dictionary_encode()
    zone_no = in_zones.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    local &= status == _NO[RESOLVED]
    status[local & (zone_no < 0)] = _NO[NO_ZONE]
    for k, zone in enumerate(in_zones.dictionary.to_pylist()):
        rows = np.flatnonzero(local & (zone_no == k))
        if not len(rows):
            continue
        if zones.table(zone) is None:
            status[rows] = _NO[NO_ZONE]
            continue
        wall[rows], kind = zones.to_utc(wall[rows], zone)
        status[rows] = np.array([_NO[RESOLVED], _NO[GAP], _NO[AMBIGUOUS]], np.int8)[kind]
    return wall, status


def resolve(values: list[str | None], locales: list[str | None], zone_names: list[str | None]) -> tuple[np.ndarray, list[str]]:
    """As ``resolved``, for lists, with the status by name."""
    seconds, status = resolved(values, pa.array(locales, pa.string()), pa.array(zone_names, pa.string()))
    return seconds, [STATUS[k] for k in status]


def _converted(cut: _Cut, known: np.ndarray, month_first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seconds of values of one shape and format, their status, and which of them are wall clocks of the row's zone."""
    n = len(cut.signs)
    if "number" in cut:
        return _origins(cut), np.zeros(n, np.int8), np.zeros(n, bool)
    y, h, mi, s = (cut.number(k, v) for k, v in (("y", 0), ("h", -1), ("mi", 0), ("s", 0)))
    several = np.zeros(n, bool)
    if "one" in cut:
        one, two = cut.number("one", 0), cut.number("two", 0)
        days_month, ok_month = _days(y, one, two)
        days_day, ok_day = _days(y, two, one)
        several = ~known & ok_month & ok_day & (days_month != days_day)
        use_month = np.where(known, month_first, ok_month)
        days, exists = np.where(use_month, days_month, days_day), np.where(use_month, ok_month, ok_day)
    else:
        month = cut.word("mon", MONTHS, 0, 0) if "mon" in cut else cut.number("mo", 0)
        days, exists = _days(y, month, cut.number("d", 0))
    half = cut.word("half", HALVES, -1, -2)
    twelve = half >= 0
    bad = ~exists | (twelve & ((h < 1) | (h > 12))) | (h > 23) | (mi > 59) | (s > 59)
    weekday = cut.word("wd", DAYS, -1, -2)
    bad |= (weekday == -2) | ((weekday >= 0) & (weekday != (days + 3) % 7))
    offset, fixed = np.zeros(n, np.int64), np.full(n, "z" in cut)
    if "off" in cut or "hours" in cut:
        a, b = cut.fields["off" if "off" in cut else "hours"]
        minutes = cut.digits(b - 2, b) if b - a > 3 else np.zeros(n, np.int64)
        amount = cut.digits(a + 1, a + 3) * 60 + minutes
        bad |= (minutes > 59) | (amount > 18 * 60)
        offset, fixed = np.where(cut.signs[:, a] == ord("-"), -amount, amount), np.ones(n, bool)
    unknown = half == -2
    if "abbr" in cut:
        named = cut.word("abbr", _MINUTES, 0, 1 << 20)
        unknown |= named == 1 << 20
        offset, fixed = named, np.ones(n, bool)
    seconds = days * 86400 + np.where(twelve, h % 12 + half, h) * 3600 + mi * 60 + s - offset * 60
    status = np.select([bad, several, h < 0, unknown], [_NO[INVALID], _NO[AMBIGUOUS], _NO[NO_TIME], _NO[UNPARSED]], _NO[RESOLVED]).astype(np.int8)
    return seconds, status, ~fixed


def _origins(cut: _Cut) -> np.ndarray:
    """Seconds of counts since a fixed origin: seconds, milli-, micro- and nanoseconds since 1970, tenths of microseconds since 1601 or the year 1."""
    width = cut.signs.shape[1]
    whole = cut.digits(0, 11 if width == 18 else 10)
    return whole - np.where(cut.signs[:, 0] < ord("4"), ORIGIN_1601, ORIGIN_1) if width == 18 else whole


def normalise(df: DataFrame, fields: tuple[str, ...] = ("create_time", "last_saved_time"), keys: tuple[str, ...] = ("meta_id", "file_id"), locale: str = "locale", zone: str = "zone_name") -> DataFrame:
    """``keys``, ``field``, ``value``, ``utc_seconds``, ``utc`` and ``status``, one row for each row and field.

    ``status`` is ``resolved`` where the text denotes exactly one moment, to which its fraction is cut;
    otherwise it says why not, and the moment is null: ``null``, ``unparsed`` (also the empty text and
    texts that are no time), ``invalid`` (no such day or hour, or a weekday that belies the date), ``no_time``, ``no_zone``, ``gap``
    (skipped by the clock) or ``ambiguous`` (a double hour, or two orders of day and month). Keys may be
    null and repeat. A narrow pass over four short columns; nothing is shuffled.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held = part.columns[: len(keys)]
            where, zone_names = (part.column(len(keys) + len(fields) + k) for k in (0, 1))
            for k, field in enumerate(fields):
                values = part.column(len(keys) + k)
                seconds, status = resolved(values.to_pylist(), where, zone_names)
                moments = pa.array(seconds, mask=status != 0)
                named = pa.DictionaryArray.from_arrays(pa.array(status), pa.array(STATUS)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*held, pa.array([field] * len(seconds), pa.string()), values, moments, named], names)

    names = [*keys, "field", "value", "utc_seconds", "status"]
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "field string, value string, utc_seconds bigint, status string"])
    picked = df.select(*keys, *fields, locale, zone)
    return bounded_batches(picked).mapInArrow(run, schema).withColumn("utc", F.timestamp_seconds("utc_seconds").cast("timestamp_ntz") if df.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC" else F.expr("timestamp_ntz '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, utc_seconds)"))


def same_moment(times: DataFrame) -> DataFrame:
    """``field, meta_id_a, meta_id_b``: each pair of records of one file with the same second in one field.

    Files and records without an id are in no pair; a record delivered twice counts once. Both sides of
    the join are partitioned by file and second, so no group is gathered; AQE splits a hot one.
    """
    known = times.where(F.col("utc_seconds").isNotNull() & F.col("file_id").isNotNull() & F.col("meta_id").isNotNull())
    known = known.select("field", "file_id", "utc_seconds", "meta_id").distinct()
    other = known.withColumnRenamed("meta_id", "meta_id_b")
    return known.withColumnRenamed("meta_id", "meta_id_a").join(other, ["field", "file_id", "utc_seconds"]).where("meta_id_a < meta_id_b").select("field", "meta_id_a", "meta_id_b").distinct()


def classes(times: DataFrame) -> DataFrame:
    """``field, meta_id, file_id, utc_seconds, class, links``: each record with a moment once, the least ``meta_id`` of its file that
    has the same second in the field, and how many others have it; as ``same_moment``, without a row for each pair."""
    known = times.where(F.col("utc_seconds").isNotNull() & F.col("file_id").isNotNull() & F.col("meta_id").isNotNull())
    known = known.select("field", "file_id", "utc_seconds", "meta_id").distinct()
    key = ["field", "file_id", "utc_seconds"]
    grouped = known.groupBy(*key).agg(F.min("meta_id").alias("class"), (F.count("*") - 1).alias("links"))
    return known.join(grouped, key).select("field", "meta_id", "file_id", "utc_seconds", "class", "links")
