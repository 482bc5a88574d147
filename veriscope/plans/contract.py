"""The submission contract: what a table of predictions must hold, and what is made of it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import splits
from ..session import cut
from ..sources import tables

REQUIRED = ("subject_id", "y_true", "y_pred")
OPTIONAL = ("split", "age", "sex", "device", "site", "group", "image_path")
DEMOGRAPHICS = ("age", "sex", "device", "site")
CANDIDATE = re.compile(r"^y_pred__(?P<name>.+)$")
SEED = re.compile(r"^y_pred_seed__(?P<k>.+)$")
N_FOLDS = 10
FEW_SUBJECTS = 20


class ContractError(ValueError):
    """The table cannot be audited; ``errors`` says why."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


def number(name: str):
    """A double; text that is no number, NaN and infinities become null."""
    value = F.col(f"`{name}`").cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


@dataclass
class AuditFrame:
    """A validated submission: ``df`` with a ``_row`` ordinal and a fold for each effective group."""

    df: DataFrame
    dropped: int = 0
    warnings: list[str] = field(default_factory=list)
    #: ``(_row, md5, phash)`` of the content that rows came from, where there is any.
    content: DataFrame | None = None
    n_folds: int = N_FOLDS

    @cached_property
    def filled(self) -> set[str]:
        """Columns with any value, from one aggregate."""
        names = self.df.columns
        row = self.df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]).first()
        return {c for c, n in zip(names, row) if n}

    def has(self, name: str) -> bool:
        return name in self.filled

    @property
    def candidates(self) -> dict[str, str]:
        """Name to column; the submitted prediction always among them."""
        named = {m["name"]: c for c in self.df.columns if (m := CANDIDATE.match(c))}
        return {"submitted": "y_pred", **named}

    @property
    def seeds(self) -> dict[str, str]:
        return {m["k"]: c for c in self.df.columns if (m := SEED.match(c))}

    @property
    def features(self) -> list[str]:
        taken = {*REQUIRED, *OPTIONAL, "_row", "_fold"}
        numeric = {f.name for f in self.df.schema if isinstance(f.dataType, T.NumericType)}
        return [c for c in self.df.columns if c in numeric and c not in taken and not CANDIDATE.match(c) and not SEED.match(c)]

    @property
    def demographics(self) -> list[str]:
        return [c for c in DEMOGRAPHICS if self.has(c)]

    @property
    def grouping(self) -> str:
        return "group" if self.has("group") else "subject_id"

    @cached_property
    def folded(self) -> DataFrame:
        """``df`` with ``_fold``: whole groups dealt round-robin in hash order."""
        folds = splits.group_kfold(self.df, self.grouping, self.n_folds, seed=0).withColumnRenamed("fold", "_fold")
        return cut(self.df.join(folds, self.grouping), "folded")

    @cached_property
    def summary(self) -> dict:
        y = F.col("y_true")
        row = self.df.agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("s"), F.avg(y).alias("m"), F.stddev_pop(y).alias("sd"), F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        return {
            "n_rows": row["n"], "n_subjects": row["s"], "y_mean": row["m"], "y_sd": row["sd"], "y_min": row["lo"], "y_max": row["hi"],
            "columns": sorted(self.filled - {"_row"}), "n_candidates": len(self.candidates), "n_seeds": len(self.seeds),
            "n_features": len(self.features), "dropped_rows": self.dropped, "grouping": self.grouping,
        }

    @cached_property
    def mean_error(self) -> float:
        """Cross-validated error of the training folds' mean; computed once and used by several checks."""
        means = splits.training_means(self.folded, "_fold", "y_true")
        rows = self.folded.join(F.broadcast(means), "_fold")  # one row a fold
        return rows.agg(F.avg(F.abs(F.coalesce("train_mean", F.lit(0.0)) - F.col("y_true")))).first()[0]


def validate(df: DataFrame) -> tuple[list[str], list[str], int]:
    """(errors, warnings, incomplete rows), from one aggregate."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        return [f"missing required column: {c}" for c in missing], [], 0
    t, p, s = number("y_true"), number("y_pred"), F.col("subject_id")
    row = df.agg(
        F.count("*").alias("n"), F.count(t).alias("t"), F.count(p).alias("p"), F.count(s).alias("s"), F.count_distinct(s).alias("subjects"),
        F.count_if(t.isNotNull() & p.isNotNull() & s.isNotNull()).alias("whole"),
    ).first()
    errors = [f"{c} has no numeric value" for c, k in (("y_true", "t"), ("y_pred", "p")) if not row[k]]
    if not errors and not row["whole"]:
        errors.append("no complete row")
    notes = [f"{row['n'] - row[k]} rows without a numeric {c} are dropped" for c, k in (("y_true", "t"), ("y_pred", "p")) if row["n"] > row[k]]
    if row["n"] > row["s"]:
        notes.append(f"{row['n'] - row['s']} rows without a subject are dropped")
    if row["subjects"] == row["n"]:
        notes.append("every row is its own subject, so grouping has no effect")
    if row["subjects"] < FEW_SUBJECTS:
        notes.append(f"only {row['subjects']} subjects")
    return errors, notes, row["n"] - row["whole"]


def load(source: DataFrame | str, spark: SparkSession | None = None, content: DataFrame | None = None) -> AuditFrame:
    """A validated AuditFrame from a DataFrame, a CSV path or a workbook (.xlsx, its first sheet); raises ContractError."""
    if isinstance(source, str):
        source = tables.spreadsheet(spark, source) if source.lower().endswith(".xlsx") else spark.read.csv(source, header=True, inferSchema=False)
    df = source.toDF(*[c.strip() for c in source.columns])
    errors, warnings, dropped = validate(df)
    if errors:
        raise ContractError(errors)
    numeric = {"y_true", "y_pred", "age", *[c for c in df.columns if CANDIDATE.match(c) or SEED.match(c)]}
    text = {"subject_id", "split", "sex", "device", "site", "group", "image_path"}
    others = [c for c in df.columns if c not in numeric | text | {"_row"}]
    as_text = [c for c in others if isinstance(df.schema[c].dataType, T.StringType)]
    if as_text:  # a text column all of whose values are numbers is a feature
        row = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & (F.trim(f"`{c}`") != "") & number(c).isNull()).alias(f"c{i}") for i, c in enumerate(as_text)]).first()
        numeric |= {c for c, bad in zip(as_text, row) if not bad}
    columns = [
        (number(c) if c in numeric else F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) if c in text else F.col(f"`{c}`")).alias(c) for c in df.columns
    ]
    if "_row" not in df.columns:
        columns.append(F.monotonically_increasing_id().alias("_row"))
    rows = df.select(*columns).where("subject_id is not null and y_true is not null and y_pred is not null")
    return AuditFrame(cut(rows, "submission"), dropped, warnings, content)  # written once: _row must not be dealt again


def encoded(frame: AuditFrame, columns: list[str], df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Design columns of demographics: numbers as they are; text one-hot over the whole table's sorted
    levels without the last (a single level is kept). Missing text is the level ``nan``."""
    names = []
    for c in columns:
        if isinstance(df.schema[c].dataType, T.NumericType):
            names.append(c)
            continue
        value = F.coalesce(F.col(c), F.lit("nan"))
        levels = sorted(r[0] for r in frame.df.select(F.coalesce(F.col(c), F.lit("nan"))).distinct().limit(10_001).collect())
        if len(levels) > 10_000:
            raise ContractError([f"{c} has more than 10,000 levels"])
        for i, level in enumerate(levels[: max(1, len(levels) - 1)]):
            names.append(f"_{c}_{i}")
            df = df.withColumn(names[-1], F.when(value == level, 1.0).otherwise(0.0))
    return df, names
