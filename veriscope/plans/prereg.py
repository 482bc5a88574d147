"""Thresholds declared before the data was seen: a plain record under a stamp.

A declaration is a dict of FIELDS. ``stamped`` adds the SHA-256 of its canonical JSON; ``standing``
says of a stamped record whether its stamp still fits and whether it came before an upload."""

from __future__ import annotations

import hashlib
import json
import re
from datetime import UTC, datetime
from typing import Any, NamedTuple

from .verdict import canonical

Record = dict[str, Any]
#: What the stamp covers, with what a record that lacks it is read as.
FIELDS: Record = {"title": "", "thresholds": {}, "notes": "", "declared_at": "", "checks_planned": []}
LEAST_TITLE = 8
_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ")


class Standing(NamedTuple):
    intact: bool
    in_time: bool

    @property
    def counts(self) -> bool:
        return self.intact and self.in_time


def utc_now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds").replace("+00:00", "Z")


def stamp(record: Record) -> str:
    covered = {k: record.get(k, default) for k, default in FIELDS.items()}
    covered["checks_planned"] = sorted(covered["checks_planned"])
    return hashlib.sha256(canonical(covered).encode()).hexdigest()


def stamped(title: str, thresholds: dict[str, dict] | None = None, **rest: Any) -> Record:
    """A declaration of now (or of ``declared_at``) with its fingerprint; keywords are the other FIELDS."""
    unknown = rest.keys() - FIELDS.keys()
    if unknown:
        raise ValueError(f"not part of a declaration: {', '.join(sorted(unknown))}")
    if len(title.strip()) < LEAST_TITLE:
        raise ValueError(f"a title needs {LEAST_TITLE} characters")
    record = {**FIELDS, "declared_at": utc_now(), **rest, "title": title, "thresholds": dict(thresholds or {})}
    return {**record, "checks_planned": list(record["checks_planned"]), "fingerprint": stamp(record)}


def standing(record: Record, uploaded_at: str | None = None) -> Standing:
    """Times are of one fixed format, in which text order is time order; a time of any other form proves nothing."""
    times = [record.get("declared_at") or "", *([] if uploaded_at is None else [uploaded_at])]
    return Standing(record.get("fingerprint") == stamp(record), all(_TIME.fullmatch(t) for t in times) and times == sorted(times))


def declared_for(record: Record | None, check_id: str) -> tuple[dict, bool]:
    """A check's declared thresholds, and whether the record names the check at all (thresholds or plan)."""
    known = (record or {}).get("thresholds", {})
    return dict(known.get(check_id, {})), check_id in known


def dumps(record: Record) -> str:
    return json.dumps(record, sort_keys=True, indent=1)


def loads(text: str) -> Record:
    """A record as it was written; a changed one loads too and is then not intact."""
    record = json.loads(text)
    if not isinstance(record, dict) or "fingerprint" not in record:
        raise ValueError("not a stamped declaration")
    return record
