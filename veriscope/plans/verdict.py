"""Results of checks."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal

PASS, FAIL, INSUFFICIENT = "PASS", "FAIL", "INSUFFICIENT_DATA"
SEVERITY = {FAIL: 0, INSUFFICIENT: 1, PASS: 2}


@dataclass
class CheckResult:
    check_id: str
    title: str
    verdict: str
    headline: str
    measured: dict = field(default_factory=dict)
    threshold: dict = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)
    details: dict = field(default_factory=dict)
    preregistered: bool = False
    seconds: float = 0.0

    def to_dict(self) -> dict:
        return plain(asdict(self))


def plain(x):
    """Values as JSON has them: non-finite numbers null, sets and tuples lists, what is unknown as text."""
    if x is None or isinstance(x, (bool, str)):
        return x
    if hasattr(x, "item") and not hasattr(x, "__len__"):
        x = x.item()
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, (float, Decimal)):
        return float(x) if math.isfinite(x) else None
    if isinstance(x, (bool, int)):
        return x
    if isinstance(x, timedelta):
        return x.total_seconds()
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted((plain(v) for v in x), key=str)
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return str(x)


def canonical(x) -> str:
    """Sorted keys, no spaces: the text that fingerprints are taken of."""
    return json.dumps(plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
