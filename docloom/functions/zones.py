"""Zone transition tables: wall clock to UTC for whole arrays, with gaps and double hours told apart.

A table is read from the installed zone database: the transitions written out in a zone's file, then those of
the yearly rule at its end, for every year that a calendar date here can have.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from importlib import resources
from pathlib import Path
from zoneinfo import TZPATH

import numpy as np

RESOLVED, NONE, SEVERAL = 0, 1, 2
#: The last year of a calendar date here.
LAST_YEAR = 9999
#: A moment after all moments of such dates, in seconds.
_NEVER = 1 << 40
_NAME = re.compile(r"[A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)*")
_RULE = re.compile(r"(?:<[^>]+>|[A-Za-z]+)(?P<std>[+-]?[\d:]+)(?:(?:<[^>]+>|[A-Za-z]+)(?P<dst>[+-]?[\d:]+)?,(?P<on>[^,]+),(?P<off>[^,]+))?")


@lru_cache(maxsize=1)
def version() -> str:
    """The release of the zone database that the tables are made from."""
    for folder in TZPATH:
        for name, word in (("tzdata.zi", 2), ("+VERSION", 0)):
            try:
                return Path(folder, name).read_text().split("\n")[0].split()[word]
            except (OSError, IndexError):
                continue
    try:
        from importlib.metadata import version as installed

        return installed("tzdata")
    except Exception:
        return "unknown"


def _file(zone: str) -> bytes | None:
    if not _NAME.fullmatch(zone):
        return None
    for folder in TZPATH:
        try:
            return Path(folder, zone).read_bytes()
        except OSError:
            continue
    try:
        return resources.files("tzdata").joinpath("zoneinfo", *zone.split("/")).read_bytes()
    except (OSError, ModuleNotFoundError):
        return None


def _clock(text: str) -> int:
    """Seconds of ``[+-]hh[:mm[:ss]]``."""
    parts = [int(x) for x in text.lstrip("+-").split(":")] + [0, 0]
    seconds = parts[0] * 3600 + parts[1] * 60 + parts[2]
    return -seconds if text.startswith("-") else seconds


def days(y: np.ndarray, m: np.ndarray | int, d: np.ndarray | int) -> np.ndarray:
    """Days since 1970 of civil dates."""
    a, b = y - (np.asarray(m) <= 2), (np.asarray(m) + 9) % 12
    return 365 * a + a // 4 - a // 100 + a // 400 + (153 * b + 2) // 5 + d - 1 - 719468


def _moments(rule: str, years: np.ndarray, offset: int) -> np.ndarray:
    """UTC seconds at which a yearly rule strikes, its clock being at ``offset``."""
    day, _, clock = rule.partition("/")
    if day.startswith("M"):
        month, week, weekday = map(int, day[1:].split("."))
        first = days(years, month, 1)
        at = first + (weekday - (first + 4) % 7) % 7 + 7 * (week - 1)
        nxt = days(years + (month == 12), month % 12 + 1, 1)
        at = np.where(at >= nxt, at - 7, at)
    elif day.startswith("J"):
        n, leap = int(day[1:]), ((years % 4 == 0) & (years % 100 != 0)) | (years % 400 == 0)
        at = days(years, 1, 1) + n - 1 + (leap & (n >= 60))
    else:
        at = days(years, 1, 1) + int(day)
    return at * 86400 + _clock(clock or "2") - offset


@lru_cache(maxsize=1024)
def table(zone: str) -> tuple[np.ndarray, np.ndarray] | None:
    """UTC seconds of the transitions, and the offsets before, between and after them; None: no such zone."""
    data = _file(zone)
    if data is None or data[:4] != b"TZif":
        return None
    at, width, kind = 0, 4, "i"
    if data[4:5] >= b"2":  # a second part with eight bytes for a moment follows the first
        utc, std, leaps, moments, types, signs = struct.unpack(">6l", data[20:44])
        at, width, kind = 44 + moments * 5 + types * 6 + signs + leaps * 8 + std + utc, 8, "q"
    utc, std, leaps, moments, types, signs = struct.unpack(">6l", data[at + 20 : at + 44])
    at += 44
    transitions = np.array(struct.unpack(f">{moments}{kind}", data[at : at + moments * width]), np.int64)
    at += moments * width
    of = np.frombuffer(data, np.uint8, moments, at)
    at += moments
    found = [struct.unpack(">lbb", data[at + 6 * i : at + 6 * i + 6]) for i in range(types)]
    first = next((o for o, summer, _ in found if not summer), found[0][0])
    offsets = np.array([first, *(found[i][0] for i in of)], np.int64)
    m = _RULE.fullmatch(data[data.rstrip(b"\n").rfind(b"\n") + 1 :].strip().decode("ascii", "replace")) if width == 8 else None
    if m:
        last = int(transitions[-1]) if moments else -_NEVER
        if m["on"]:
            standard = -_clock(m["std"])
            summer = -_clock(m["dst"]) if m["dst"] else standard + 3600
            years = np.arange(1970 + max(last, -(1 << 36)) // 31_556_952 - 1, LAST_YEAR + 1)
            on, off = _moments(m["on"], years, standard), _moments(m["off"], years, summer)
            more = np.concatenate([on, off])
            kinds = np.concatenate([np.full(len(on), summer), np.full(len(off), standard)])
            order = np.argsort(more, kind="stable")
            more, kinds = more[order], kinds[order]
            transitions, offsets = np.concatenate([transitions, more[more > last]]), np.concatenate([offsets, kinds[more > last]])
        elif not moments:
            offsets = np.array([-_clock(m["std"])], np.int64)
    real = np.flatnonzero(offsets[1:] != offsets[:-1])
    return transitions[real], np.append(offsets[:1], offsets[1:][real])


def to_utc(wall: np.ndarray, zone: str) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of wall clock seconds, and for each whether one moment, none or several show that wall clock."""
    found = table(zone)
    if found is None:
        return np.zeros(len(wall), np.int64), np.full(len(wall), NONE, np.int8)
    transitions, offsets = found
    utc, hits = np.zeros(len(wall), np.int64), np.zeros(len(wall), np.int8)
    # no offset is larger than a day, so only those in force within a day of the wall clock can show it
    low, high = np.searchsorted(transitions, wall - 86400, "right"), np.searchsorted(transitions, wall + 86400, "right")
    for k in range(int((high - low).max(initial=0)) + 1):
        at = np.minimum(low + k, high)
        u = wall - offsets[at]
        hit = (low + k <= high) & (np.searchsorted(transitions, u, "right") == at)
        utc[hit], hits[hit] = u[hit], hits[hit] + 1
    return utc, np.where(hits == 1, RESOLVED, np.where(hits == 0, NONE, SEVERAL)).astype(np.int8)
