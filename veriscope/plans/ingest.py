"""External tables: declared renames, unit changes and derived subjects, each recorded."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import medians
from .contract import CANDIDATE, SEED, AuditFrame, load, number

#: Checks that a table without real subjects cannot support.
NEED_SUBJECTS = ("split_integrity", "subgroup_robustness")
#: A median above this in g/dL means that the values are in another unit.
IMPLAUSIBLE_MEDIAN = 30.0
SEXES = {"m": "M", "male": "M", "man": "M", "f": "F", "female": "F", "woman": "F"}
SPLITS = {"training": "train", "validation": "val", "valid": "val", "testing": "test"}
EXAMPLES = 25


class NotAuditable(ValueError):
    """The table cannot be audited at all; ``missing`` says what it lacks."""

    def __init__(self, missing: list[str], note: str):
        super().__init__(note)
        self.missing = missing


@dataclass
class IngestSpec:
    """How an external table maps to the contract."""

    columns: dict[str, str]
    unit: str = "g/dL"
    subject_pattern: str | None = None
    split_values: dict[str, str] = field(default_factory=dict)
    one_row_per_subject: bool = False
    aggregate: bool = False


@dataclass
class IngestRecord:
    assumptions: list[str] = field(default_factory=list)
    derived: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    unsupported: dict[str, str] = field(default_factory=dict)

    def to_dict(self) -> dict:
        return asdict(self)


def _mapped(column, table: dict[str, str]):
    if not table:
        return column
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[column], column)


def ingest(df: DataFrame, spec: IngestSpec) -> tuple[AuditFrame, IngestRecord]:
    record = IngestRecord()
    df = df.toDF(*[c.strip() for c in df.columns]).withColumnsRenamed(spec.columns)
    lacking = [c for c in ("y_true", "y_pred") if c not in df.columns]
    if lacking:
        raise NotAuditable(lacking, "the table has no column for: " + ", ".join(lacking))
    if spec.columns:
        record.assumptions.append("renamed " + ", ".join(f"{a} to {b}" for a, b in sorted(spec.columns.items())))
    if "_row" not in df.columns:
        from ..session import cut

        df = cut(df.withColumn("_row", F.monotonically_increasing_id()), "ingest")
    df = df.withColumns({c: number(c) for c in df.columns if c in ("y_true", "y_pred", "age") or CANDIDATE.match(c) or SEED.match(c)})
    facts = df.agg(F.bool_and(F.col("y_true").isin(0.0, 1.0)).alias("binary"), F.count("y_true").alias("n")).first()
    if not facts["n"]:
        raise NotAuditable(["y_true"], "no value of the truth is a number")
    if facts["binary"]:
        raise NotAuditable(["a continuous y_true"], "the truth is a class, and these checks audit regressions")
    if spec.unit == "g/L":
        df = df.withColumns({c: F.col(c) / 10 for c in df.columns if c in ("y_true", "y_pred") or CANDIDATE.match(c) or SEED.match(c)})
        record.assumptions.append("divided by ten, from the declared g/L to g/dL")
    elif (middle := medians(df, ["y_true"])["y_true"]) is not None and middle > IMPLAUSIBLE_MEDIAN:
        raise NotAuditable(["a declared unit"], f"a median of {middle:.4g} is implausible in {spec.unit}; declare g/L if that is the unit")
    if "sex" in df.columns:
        df = df.withColumn("sex", F.coalesce(F.create_map(*[F.lit(x) for kv in SEXES.items() for x in kv])[F.lower(F.trim("sex"))], F.col("sex")))
        odd = [r[0] for r in df.where(F.col("sex").isNotNull() & ~F.col("sex").isin("M", "F")).select("sex").distinct().orderBy("sex").limit(EXAMPLES).collect()]
        if odd:
            record.warnings.append("sex left as it is: " + ", ".join(map(str, odd)))
    if "split" in df.columns:
        table = {**SPLITS, **spec.split_values}
        df = df.withColumn("split", _mapped(F.col("split").cast("string"), table))
        unknown = df.where(F.col("split").isNull() | ~F.col("split").isin("train", "val", "test")).select(F.coalesce("split", F.lit("None")).alias("v")).distinct()
        shown = [r["v"] for r in unknown.orderBy("v").limit(EXAMPLES + 1).collect()]
        if shown:
            more = f" and {unknown.count() - EXAMPLES} more" if len(shown) > EXAMPLES else ""
            record.warnings.append("split values kept: " + ", ".join(shown[:EXAMPLES]) + more)
    if spec.subject_pattern:
        name = "image_path" if "image_path" in df.columns else "subject_id"
        base = F.regexp_extract(F.col(name), r"([^/\\]*)$", 1)
        found = F.regexp_extract(base, spec.subject_pattern, 1)
        bad = df.where(F.coalesce(found, F.lit("")) == "").count()
        if bad:
            raise NotAuditable(["subject_id"], f"{bad} names do not match the subject pattern")
        df = df.withColumn("subject_id", found)
        record.derived.append("subject_id from the image name")
    elif "subject_id" not in df.columns:
        df = df.withColumn("subject_id", F.concat(F.lit("row"), F.col("_row").cast("string")))
        if not spec.one_row_per_subject:
            record.unsupported = dict.fromkeys(NEED_SUBJECTS, "subjects are not known, one for each row was made up")
        record.derived.append("subject_id from the row")
    if spec.aggregate:
        df = per_subject(df, record)
    return load(df), record


def per_subject(df: DataFrame, record: IngestRecord) -> DataFrame:
    """One row a subject: medians of truths and predictions, the first known attribute in row order, joined image paths."""
    middle = [c for c in df.columns if c in ("y_true", "y_pred") or CANDIDATE.match(c) or SEED.match(c)]
    rest = [c for c in df.columns if c not in (*middle, "subject_id", "image_path", "_row")]
    parts = [F.median(c).alias(c) for c in middle] + [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_row"))).alias(c) for c in rest] + [F.min("_row").alias("_row")]
    if "image_path" in df.columns:
        pairs = F.sort_array(F.collect_list(F.when(F.col("image_path").isNotNull(), F.struct("_row", "image_path"))))
        parts.append(F.array_join(F.transform(pairs, lambda p: p["image_path"]), "|").alias("image_path"))
    if "split" in df.columns:
        mixed = df.groupBy("subject_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count()
        if mixed:
            record.warnings.append(f"{mixed} subjects have rows in several splits; the first one counts")
    record.derived.append("one row a subject: medians, first known attributes")
    return df.where("subject_id is not null").groupBy("subject_id").agg(*parts)
