"""What a file is: format, encoding and separator, from its first bytes."""

from __future__ import annotations

import csv
from pathlib import PurePosixPath

from .charset import HEAD, detect_encoding
from .files import Files, SourceError

SEPARATORS = (",", ";", "\t", "|")
NAMED = {"pipe": "|", "tab": "\t", "comma": ",", "semicolon": ";"}


def detect_separator(text: str) -> str:
    """The separator of the first five lines: as the csv module sniffs it, else the one with the most fields, equal on all lines."""
    lines = [x for x in text.splitlines() if x.strip()][:5]
    if not lines:
        return ","
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters="".join(SEPARATORS)).delimiter
    except csv.Error:
        pass
    best, most = ",", 1
    for sep in SEPARATORS:
        counts = {len(row) for row in csv.reader(lines, delimiter=sep)}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = sep, n
    return best


def detect_format(path: str, data: bytes) -> str:
    """xlsx, csv or parquet, of a file's path and head: by magic, then by name, then by whether the text has a separator."""
    if not data.strip():
        raise SourceError(f"{path} is empty")
    if data.startswith(b"PK\x03\x04"):
        return "xlsx"
    if data.startswith(b"PAR1"):
        return "parquet"
    suffix = PurePosixPath(str(path)).suffix.lower()
    if suffix in (".xlsx", ".xls"):
        return "xlsx"
    if suffix == ".csv" or any(s in data.decode(detect_encoding(data)[0], "replace") for s in SEPARATORS):
        return "csv"
    raise SourceError(f"{path}: unknown format")


__all__ = ["Files", "HEAD", "NAMED", "SourceError", "detect_encoding", "detect_format", "detect_separator"]
