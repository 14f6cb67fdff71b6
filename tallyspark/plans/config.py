"""Configuration of a run: YAML read into dataclasses on the driver."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from ..errors import ConfigError
from ..operators.crossverify import CrossFile
from ..operators.integrity import OPERATORS, ColumnRules, CrossCheck, IntegrityConfig
from ..operators.rules import Settings


@dataclass
class InputConfig:
    sheet: str | int | None = None
    separator: str | None = None
    encoding: str | None = None
    skip_rows: int = 0
    max_rows: int | None = None
    approximate_profile: bool = True


@dataclass
class ReviewConfig:
    enabled: bool = False
    primary: str = "ollama"
    model: str = "llama3"
    batch_size: int = 50
    max_retries: int = 2
    hidden_columns: list[str] = field(default_factory=list)
    column_notes: dict[str, str] = field(default_factory=dict)
    write_summary: bool = False


@dataclass
class RunConfig:
    input: InputConfig = field(default_factory=InputConfig)
    integrity: IntegrityConfig = field(default_factory=IntegrityConfig)
    review: ReviewConfig = field(default_factory=ReviewConfig)
    approval_limit: float = 1e8
    frequent_count: int = 5
    fiscal_year_end: str = "12-31"
    flag_columns: dict[str, str] = field(default_factory=dict)
    journal_tolerance: float = 0.005
    cross_file: CrossFile = field(default_factory=CrossFile)
    approved_vendors: list[str] = field(default_factory=list)
    approved_vendors_file: str | None = None
    public_holidays: list[str] = field(default_factory=list)
    rules_file: str | None = None
    report_formats: list[str] = field(default_factory=lambda: ["json", "markdown"])

    def settings(self) -> Settings:
        from ..sources.readers import reference_values

        vendors = list(self.approved_vendors) + (reference_values(self.approved_vendors_file) if self.approved_vendors_file else [])
        month, day = (int(x) for x in self.fiscal_year_end.split("-"))
        return Settings(month, day, {"__CONFIG_APPROVED_VENDORS__": vendors, "__CONFIG_PUBLIC_HOLIDAYS__": [str(x) for x in self.public_holidays]})


def _fill(kind, data, where: str):
    if not isinstance(data, dict):
        raise ConfigError(f"{where}: a mapping is expected")
    names = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: v for k, v in data.items() if k in names and v is not None})


def parse(data: dict | None) -> RunConfig:
    """A configuration from loaded YAML; unknown keys are ignored."""
    data = dict(data or {})
    for name, kind in (("input", InputConfig), ("review", ReviewConfig), ("cross_file", CrossFile)):
        if name in data:
            data[name] = _fill(kind, data[name] or {}, name)
    if "integrity" in data:
        raw = dict(data["integrity"] or {})
        raw["columns"] = {c: _fill(ColumnRules, r or {}, f"integrity.columns.{c}") for c, r in (raw.get("columns") or {}).items()}
        raw["cross_checks"] = [_fill(CrossCheck, c, "integrity.cross_checks") for c in raw.get("cross_checks") or []]
        data["integrity"] = _fill(IntegrityConfig, raw, "integrity")
    config = _fill(RunConfig, data, "configuration")
    problems = []
    if not 1 <= config.review.batch_size <= 500:
        problems.append("review.batch_size must be from 1 to 500")
    if config.input.max_rows is not None and config.input.max_rows < 1:
        problems.append("input.max_rows must be positive")
    if config.cross_file.file and not config.cross_file.keys:
        problems.append("cross_file needs keys")
    if any(len(x) != 3 or x[1] not in OPERATORS for x in config.cross_file.contradicts):
        problems.append(f"cross_file.contradicts: each is column, operator, column; operators are {', '.join(OPERATORS)}")
    if unknown := set(config.report_formats) - {"json", "markdown", "pdf"}:
        problems.append(f"unknown report formats {sorted(unknown)}")
    try:
        config.settings()
    except (ValueError, OSError) as error:
        problems.append(f"fiscal_year_end or approved_vendors_file: {error}")
    if problems:
        raise ConfigError("; ".join(problems))
    return config


def load(path: str | Path) -> RunConfig:
    path = Path(path)
    try:
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as error:
        raise ConfigError(f"{path}: {error}") from error
    if data is not None and not isinstance(data, dict):
        raise ConfigError(f"{path}: a mapping is expected")
    for key in ("rules_file", "approved_vendors_file"):
        if data and data.get(key):
            data[key] = str((path.parent / data[key]).resolve())
    if data and (data.get("cross_file") or {}).get("file") and "://" not in data["cross_file"]["file"]:
        data["cross_file"]["file"] = str((path.parent / data["cross_file"]["file"]).resolve())
    return parse(data)
