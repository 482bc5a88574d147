"""Run checks over a submission, and render what they found."""

from __future__ import annotations

import hashlib
import time
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .checks import CHECKS
from .contract import AuditFrame
from .prereg import Record, declared_for, standing
from .verdict import FAIL, INSUFFICIENT, PASS, SEVERITY, CheckResult, canonical, plain


@dataclass
class AuditReport:
    results: list[CheckResult]
    summary: dict
    preregistration: dict | None = None
    warnings: list[str] = field(default_factory=list)

    @property
    def counts(self) -> dict[str, int]:
        return {v: sum(r.verdict == v for r in self.results) for v in (PASS, FAIL, INSUFFICIENT)} | {"preregistered": sum(r.preregistered for r in self.results)}

    def to_dict(self) -> dict:
        return plain({"results": [r.to_dict() for r in self.results], "counts": self.counts, "summary": self.summary, "preregistration": self.preregistration, "warnings": self.warnings})

    def fingerprint(self) -> str:
        """SHA-256 of the report without what depends on the clock."""
        body = self.to_dict()
        for r in body["results"]:
            r.pop("seconds")
        return hashlib.sha256(canonical(body).encode()).hexdigest()

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """One row a check, measured values and details as JSON."""
        rows = [(r.check_id, r.title, r.verdict, r.headline, canonical(r.measured), canonical(r.threshold), r.missing, canonical(r.details), r.preregistered) for r in self.results]
        return spark.createDataFrame(rows, "check_id string, title string, verdict string, headline string, measured string, threshold string, missing array<string>, details string, preregistered boolean")


def catalogue() -> list[dict]:
    return [{"check_id": c.check_id, "title": c.title, "needs": list(c.needs), "defaults": c.defaults} for c in CHECKS.values()]


def availability(frame: AuditFrame) -> dict[str, bool]:
    """Which checks have what they need."""
    return {
        "duplicates": frame.content is not None,
        "split_integrity": frame.has("split"),
        "demographic_baseline": bool(frame.demographics),
        "proxy_probe": bool(frame.demographics),
        "permutation": True,
        "seed_stability": len(frame.seeds) >= 3,
        "subgroup_robustness": True,
        "ceiling": bool(frame.features),
    }


def run_audit(
    frame: AuditFrame,
    checks: list[str] | None = None,
    thresholds: dict[str, dict] | None = None,
    preregistration: Record | None = None,
    uploaded_at: str | None = None,
    unsupported: dict[str, str] | None = None,
    progress: Callable[[float, str], None] | None = None,
) -> AuditReport:
    """Run the named checks (all by default), worst verdict first.

    A check that raises gives INSUFFICIENT_DATA with its traceback, and one named in ``unsupported`` gives it with the reason
    there: no check is lost. Declared thresholds count as pre-registered only if the declaration is intact and not later than the upload."""
    ids = list(CHECKS) if checks is None else checks
    unknown = [c for c in ids if c not in CHECKS]
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(unknown)}")
    stands = None if preregistration is None else standing(preregistration, uploaded_at)
    results = []
    for i, check_id in enumerate(ids):
        check, began = CHECKS[check_id], time.monotonic()
        wanted, named = declared_for(preregistration, check_id)
        if unsupported and check_id in unsupported:
            result = CheckResult(check_id, check.title, INSUFFICIENT, "the source cannot support this check", threshold=check.defaults, missing=[unsupported[check_id]])
        else:
            try:
                result = check.run(frame, {**wanted, **(thresholds or {}).get(check_id, {})})
            except Exception as e:  # reported as its result
                result = CheckResult(check_id, check.title, INSUFFICIENT, f"the check failed: {type(e).__name__}", threshold=check.defaults, missing=["a run without errors"], details={"traceback": traceback.format_exc()[-4000:]})
        result.preregistered = named and stands.counts and not (thresholds or {}).get(check_id)
        result.seconds = time.monotonic() - began
        results.append(result)
        if progress:
            progress((i + 1) / len(ids), check_id)
    results.sort(key=lambda r: SEVERITY[r.verdict])
    told = None if stands is None else {**preregistration, "intact": stands.intact, "before_upload": stands.counts}
    return AuditReport(results, frame.summary, told, frame.warnings)


#: What to do about a verdict, by check: fixable in the submission, to be reported, or a reason to stop.
ADVICE = {
    "duplicates": ("FIXABLE", "Split again by leak-proof groups, so that copies stay on one side."),
    "split_integrity": ("FIXABLE", "Split again by whole subjects and by shared content."),
    "demographic_baseline": ("STOP", "A single attribute does as well; the model adds nothing that was shown."),
    "proxy_probe": ("STOP", "The advantage is what an attribute already tells."),
    "permutation": ("STOP", "The score is within what chance and selection give."),
    "seed_stability": ("REPORT IT", "Give the mean and spread over seeds in place of one run."),
    "subgroup_robustness": ("REPORT IT", "Say how much of the advantage rests on few subjects."),
    "ceiling": ("REPORT IT", "The inputs show no measurable information on the target."),
}


def markdown(report: AuditReport, title: str = "Audit report") -> str:
    counts = report.counts
    lines = [f"# {title}", "", f"{counts[PASS]} pass, {counts[FAIL]} fail, {counts[INSUFFICIENT]} without enough data.", f"Fingerprint: `{report.fingerprint()}`", ""]
    if report.preregistration:
        lines += [f"Thresholds declared {report.preregistration['declared_at']}, intact: {report.preregistration['intact']}, before upload: {report.preregistration['before_upload']}.", ""]
    lines += [f"- {k}: {v}" for k, v in plain(report.summary).items() if k != "columns"] + [f"- note: {w}" for w in report.warnings]
    lines += ["", "| check | verdict | finding |", "| --- | --- | --- |"] + [f"| {r.title} | {r.verdict} | {r.headline} |" for r in report.results]
    for r in report.results:
        lines += ["", f"## {r.title}: {r.verdict}", "", r.headline, ""]
        lines += [f"- {k}: {v}" for k, v in plain(r.measured).items()] + [f"- threshold {k}: {v}" + (" (declared in advance)" if r.preregistered else "") for k, v in r.threshold.items()]
        lines += [f"- missing: {m}" for m in r.missing]
        if r.verdict == FAIL:
            kind, todo = ADVICE[r.check_id]
            lines += ["", f"**{kind}** {todo}"]
    return "\n".join(lines) + "\n"


def external_markdown(report: AuditReport, record: dict, title: str = "External audit") -> str:
    """Two parts: how the table was read, then the audit."""
    parts = [f"# {title}", "", "## How the table was read", ""]
    for k, v in plain(record).items():
        parts += [f"- {k}: {', '.join(map(str, v)) if isinstance(v, list) else v}"]
    return "\n".join(parts) + "\n\n" + markdown(report, "Findings").replace("# Findings", "## Findings", 1)
