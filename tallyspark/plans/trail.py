"""An append-only audit trail on the driver: JSON lines, each with the hash of the one before."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

from ..errors import TrailError

SUMMARY_CHARS = 500


@dataclass
class TrailEntry:
    session_id: str
    action: str
    layer: str = ""
    summary: str = ""
    confidence: float | None = None
    details: dict = field(default_factory=dict)

    def __post_init__(self):
        if len(self.summary) > SUMMARY_CHARS:
            raise ValueError(f"a summary has at most {SUMMARY_CHARS} characters")
        if self.confidence is not None and not 0 <= self.confidence <= 1:
            raise ValueError("a confidence is between 0 and 1")


class Trail:
    """Each line holds seq, at, prev_hash and hash, which covers the line's other content; so no line can be changed, dropped
    or moved without a break in the chain, and lines after a seal are chained as well."""

    def __init__(self, path: str | Path):
        self.path, self.seq, self.last = Path(path), 0, ""
        if self.path.exists():
            for line in self.path.read_text(encoding="utf-8").splitlines():
                try:
                    got = json.loads(line)
                    self.seq, self.last = got["seq"] + 1, got["hash"]
                except (ValueError, KeyError) as error:
                    raise TrailError(f"{self.path}: line {self.seq + 1} can't be read") from error
        else:
            os.close(os.open(self.path, os.O_CREAT | os.O_WRONLY, 0o600))

    @staticmethod
    def _hash(body: dict) -> str:
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def append(self, entry: TrailEntry, at: str | None = None) -> str:
        body = asdict(entry) | {"seq": self.seq, "at": at or dt.datetime.now(dt.timezone.utc).isoformat(), "prev_hash": self.last}
        self.last = self._hash(body)
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(body | {"hash": self.last}, ensure_ascii=False) + "\n")
        self.seq += 1
        return self.last

    def extend(self, session_id: str, rows, layer: str = "") -> int:
        """Chain entries that tasks have made, in the order of rows (action, summary, details as JSON, at), which come to the
        driver one partition at a time; how many."""
        n = 0
        for r in rows.toLocalIterator():
            self.append(TrailEntry(session_id, r["action"], layer, r["summary"][:SUMMARY_CHARS], details=json.loads(r["details"])), r["at"])
            n += 1
        return n

    def seal(self, session_id: str) -> str:
        return self.append(TrailEntry(session_id, "SEAL", summary=f"{self.seq} entries"))


def verify(path: str | Path) -> tuple[bool, str]:
    """(whether the chain holds and ends in a seal, what is wrong)."""
    last, seq, action = "", 0, ""
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        try:
            body = json.loads(line)
            stated = body.pop("hash")
        except (ValueError, KeyError):
            return False, f"line {seq + 1} can't be read"
        if body.get("seq") != seq or body.get("prev_hash") != last or Trail._hash(body) != stated:
            return False, f"the chain breaks at line {seq + 1}"
        last, seq, action = stated, seq + 1, body["action"]
    return (True, "") if action == "SEAL" else (False, "the trail is not sealed")
