"""Caches of results for use outside of a job: in memory, in a folder, or whatever keeps text by key."""

from __future__ import annotations

import hashlib
import json
import os
from collections import OrderedDict
from dataclasses import asdict
from pathlib import Path
from threading import Lock
from typing import Protocol

from docloom.config import Settings
from docloom.engine import Read, read_one
from docloom.sources.grid import Cell


class Cache(Protocol):
    def get(self, key: str) -> str | None: ...

    def put(self, key: str, value: str) -> None: ...


class Memory:
    """The results used last, up to a number of them."""

    def __init__(self, most: int = 256):
        self.most, self.held, self.lock = most, OrderedDict(), Lock()

    def get(self, key: str) -> str | None:
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
            return self.held.get(key)

    def put(self, key: str, value: str) -> None:
        with self.lock:
            self.held[key] = value
            self.held.move_to_end(key)
            while len(self.held) > self.most:
                self.held.popitem(last=False)


class Folder:
    """A file for each result; one that can't be read counts as none, one is written whole or not at all."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def get(self, key: str) -> str | None:
        try:
            return (self.folder / f"{key}.json").read_text(encoding="utf-8")
        except (OSError, UnicodeDecodeError):
            return None

    def put(self, key: str, value: str) -> None:
        new = self.folder / f"{key}.{os.getpid()}.new"
        new.write_text(value, encoding="utf-8")
        new.replace(self.folder / f"{key}.json")


def key_of(data: bytes, extension: str, settings: Settings) -> str:
    """The key that a result is kept under: digest of the bytes, the extension and all settings."""
    said = json.dumps(settings.to_dict(), sort_keys=True, default=str)
    return hashlib.sha256(f"{hashlib.sha256(data).hexdigest()}|{extension.lower()}|{said}".encode()).hexdigest()


def to_json(got: Read) -> str:
    return json.dumps(asdict(got), ensure_ascii=False)


def from_json(text: str) -> Read:
    d = json.loads(text)
    return Read(d["text"], d["metadata"], [[[Cell(**c) for c in row] for row in table] for table in d["tables"]], d["warnings"], d["encoding"])


def read_cached(data: bytes, extension: str, cache: Cache, settings: Settings = Settings()) -> tuple[Read | None, str | None]:
    """As ``engine.read_one``, through a cache; errors aren't kept, a kept text that is no result is read anew."""
    key = key_of(data, extension, settings)
    kept = cache.get(key)
    if kept is not None:
        try:
            return from_json(kept), None
        except (ValueError, KeyError, TypeError):
            pass
    got, error = read_one(data, extension, settings)
    if got is not None:
        cache.put(key, to_json(got))
    return got, error
