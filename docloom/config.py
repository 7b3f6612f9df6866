"""Settings of extraction and chunking: immutable, copied on change."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from typing import Any


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 1000
    chunk_overlap: int = 200
    preserve_tables: bool = True

    def __post_init__(self):
        if self.chunk_size < 1 or not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_size must be positive and chunk_overlap less than it")


@dataclass(frozen=True)
class Metadata:
    language: str = "ko"
    indent: str = "  "


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    metadata: Metadata = field(default_factory=Metadata)
    #: What a file may hold; None: whatever it does. What is left out is told in the warnings.
    most_bytes: int | None = 500 << 20
    most_rows: int | None = 100_000
    most_columns: int | None = 1_000
    most_values: int | None = 20_000
    #: Seconds that a file may take; None: as long as it needs.
    seconds: float | None = None
    options: tuple[tuple[str, Any], ...] = ()

    def with_chunking(self, **changes) -> Settings:
        return replace(self, chunking=replace(self.chunking, **changes))

    def with_metadata(self, **changes) -> Settings:
        return replace(self, metadata=replace(self.metadata, **changes))

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, d: dict) -> Settings:
        known = {k: v for k, v in d.items() if k in ("most_bytes", "most_rows", "most_columns", "most_values", "seconds")}
        return cls(Chunking(**d.get("chunking", {})), Metadata(**d.get("metadata", {})), **known, options=tuple(map(tuple, d.get("options", ()))))
