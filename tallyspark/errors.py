"""What can go wrong in a run, by kind; exit_code is what the command line ends with."""

from __future__ import annotations


class AuditError(ValueError):
    exit_code = 1


class SourceError(AuditError):
    """An input that can't be read."""


class ConfigError(AuditError):
    """A configuration that can't be used."""


class RuleError(AuditError):
    """A rule, or a set of them, that can't be used."""


class LayerError(AuditError):
    """A layer of a run that failed; the run goes on without it."""

    exit_code = 2

    def __init__(self, layer: str, cause: Exception):
        super().__init__(f"{layer}: {cause}"[:500])
        self.layer, self.cause = layer, cause


class CheckpointError(AuditError):
    """A stage's output that can't be written or read back."""

    exit_code = 2


class ReportError(AuditError):
    """A report that can't be written."""

    exit_code = 2


class ReviewError(AuditError):
    """No language model that can be reached, or one that fails."""

    exit_code = 3


class StoreError(AuditError):
    """A session or table that the store does not have, or can't write."""

    exit_code = 4


class TrailError(AuditError):
    """A trail that can't be written or does not hold."""

    exit_code = 4
