"""What a front end needs, as plain functions over a folder: submissions, declarations, runs, reports."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import preview
from .audit import availability, catalogue, markdown, run_audit
from .contract import AuditFrame, ContractError, load
from .prereg import Record, dumps, loads, stamped, utc_now

RECENT = 50


class AuditService:
    """Submissions are Parquet tables below ``root``; declarations and runs are JSON documents beside them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        for kind in ("submissions", "preregistrations", "runs"):
            (self.root / kind).mkdir(parents=True, exist_ok=True)

    def _read(self, kind: str, key: str) -> dict:
        return json.loads((self.root / kind / f"{key}.json").read_text())

    def _write(self, kind: str, key: str, body: dict) -> dict:
        (self.root / kind / f"{key}.json").write_text(json.dumps(body, sort_keys=True))
        return body

    def checks(self) -> list[dict]:
        return catalogue()

    def declare(self, title: str, thresholds: dict, **rest) -> dict:
        """Store a declaration; its id is the head of its fingerprint. ``rest``: notes, checks_planned."""
        record = stamped(title, thresholds, **rest)
        key = record["fingerprint"][:16]
        (self.root / "preregistrations" / f"{key}.json").write_text(dumps(record))
        return {**record, "id": key}

    def declaration(self, key: str) -> Record:
        return loads((self.root / "preregistrations" / f"{key}.json").read_text())

    def submit(self, source: DataFrame | str) -> dict:
        """Validate and store a submission; raises ContractError and stores nothing if it is not one."""
        frame = load(source, self.spark)
        key = uuid.uuid4().hex[:16]
        frame.df.write.parquet(str(self.root / "submissions" / key))
        return self._write("submissions", key, {"id": key, "uploaded_at": utc_now(), "summary": frame.summary, "warnings": frame.warnings, "dropped": frame.dropped, "available": availability(frame)})

    def submission(self, key: str) -> dict:
        return self._read("submissions", key)

    def frame(self, key: str) -> AuditFrame:
        info = self.submission(key)
        return AuditFrame(self.spark.read.parquet(str(self.root / "submissions" / key)), info["dropped"], info["warnings"])

    def preview(self, key: str, n: int = 20) -> dict:
        rows, types = preview(self.frame(key).df.drop("_row"), n)
        return {"columns": types, "rows": [r.asDict() for r in rows.collect()]}

    def run(self, submission: str, checks: list[str] | None = None, thresholds: dict | None = None, preregistration: str | None = None) -> dict:
        """Run checks under a Spark job group of the run's id; an error is stored with the run."""
        key, began = uuid.uuid4().hex[:16], utc_now()
        self.spark.sparkContext.setJobGroup(key, f"audit of {submission}")
        body = {"id": key, "submission": submission, "started_at": began, "status": "done", "error": None}
        try:
            plan = self.declaration(preregistration) if preregistration else None
            report = run_audit(self.frame(submission), checks, thresholds, plan, self.submission(submission)["uploaded_at"])
            body |= {"report": report.to_dict(), "markdown": markdown(report)}
        except (ContractError, ValueError, OSError) as e:
            body |= {"status": "failed", "error": str(e)}
        return self._write("runs", key, body)

    def runs(self) -> list[dict]:
        """The latest runs, newest first, without their reports."""
        found = [json.loads(p.read_text()) for p in (self.root / "runs").glob("*.json")]
        found.sort(key=lambda r: (r["started_at"], r["id"]), reverse=True)
        return [{k: r[k] for k in ("id", "submission", "started_at", "status", "error")} for r in found[:RECENT]]

    def report(self, run: str) -> str:
        return self._read("runs", run)["markdown"]


#: Order of results in a listing.
SORTS = {"severity": lambda r: ({"FAIL": 0, "INSUFFICIENT_DATA": 1, "PASS": 2}[r["verdict"]], r["title"]), "title": lambda r: r["title"], "duration": lambda r: -r["seconds"]}


def listed(results: list[dict], verdicts: set[str] | None = None, by: str = "severity") -> list[dict]:
    """Results with one of the verdicts, sorted."""
    return sorted((r for r in results if not verdicts or r["verdict"] in verdicts), key=SORTS[by])
