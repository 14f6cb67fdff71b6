"""What a run knows of its input: the files, and each column as it was found."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

MOST_SAMPLES = 3


@dataclass
class ColumnMeta:
    original: str
    name: str
    dtype: str
    null_count: int = 0
    null_ratio: float = 0.0
    unique_count: int = 0
    samples: list[str] = field(default_factory=list)

    def __post_init__(self):
        if not 0 <= self.null_ratio <= 1:
            raise ValueError("a share of nulls is between 0 and 1")
        self.samples = list(self.samples)[:MOST_SAMPLES]


@dataclass
class SourceManifest:
    path: str
    kind: str
    files: int
    size: int
    encoding: str | None = None
    separator: str | None = None
    records: int = 0
    bad_lines: int = 0
    rows: int = 0
    digest: str = ""
    columns: list[ColumnMeta] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    version: str = "1.0"

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, data: dict) -> SourceManifest:
        return cls(**{**data, "columns": [ColumnMeta(**c) for c in data.get("columns", [])]})

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, indent=2)
