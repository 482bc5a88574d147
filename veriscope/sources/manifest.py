"""One generic manifest adapter: files, a name grammar and a dimension table to one row a measurement."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns and types that every manifest has, then those on provenance.
SCHEMA = {
    "image_id": "string", "subject_id": "string", "dataset": "string", "site": "string", "modality": "string", "file_path": "string", "hb_g_dl": "double",
    "anemia_label": "long", "age": "double", "sex": "string", "device_model": "string", "width": "long", "height": "long", "notes": "string",
    "subject_id_source": "string", "anemia_label_source": "string", "severity": "string", "hospital": "string", "region": "string", "age_units": "string",
    "mask_paths": "string", "hb_label_trusted": "boolean", "hb_label_untrusted_reason": "string",
}
HB_RANGE = (1.0, 25.0)


def parsed_names(df: DataFrame, path: str, fields: Iterable[tuple[str, str]], default: str | None = None) -> DataFrame:
    """Adds a column for each (name, pattern): the pattern's first group in the file's stem, ``default`` where it does not match."""
    from ..functions.parse import stem

    found = {name: F.coalesce(F.nullif(F.regexp_extract(stem(path), pattern, 1), F.lit("")), F.lit(default)) for name, pattern in fields}
    return df.withColumns(found)


def image_ids(dataset: str, *parts: str, number: str | None = None):
    """``dataset:part:..:NNN``; the number is padded to three digits."""
    from ..functions.parse import padded

    pieces = [F.lit(dataset), *[F.col(p) for p in parts]] + ([padded(number, 3)] if number else [])
    return F.concat_ws(":", *pieces)


def with_dimension(rows: DataFrame, sheet: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """Left lookup of a sheet by key, with defaults where it has no row. Keys must be unique in the sheet."""
    repeated = sheet.groupBy(key).count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"the sheet repeats a {key}")
    out = rows.join(sheet, key, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def finalise(df: DataFrame, untrusted: dict[str, str] | None = None) -> DataFrame:
    """SCHEMA's columns in order and type, missing ones null, more after them; labels are trusted where there is one and
    its dataset is not in ``untrusted`` (dataset to reason)."""
    untrusted = untrusted or {}
    cells = [(F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in SCHEMA.items()]
    out = df.select(*cells, *[c for c in df.columns if c not in SCHEMA])
    reason = F.lit(None).cast("string")
    for name, why in untrusted.items():
        reason = F.when(F.col("dataset") == name, why).otherwise(reason)
    has = F.col("hb_g_dl").isNotNull()
    trusted = has & ~F.coalesce(F.col("dataset").isin(*untrusted), F.lit(False)) if untrusted else has
    return out.withColumns({"hb_label_trusted": trusted, "hb_label_untrusted_reason": F.when(has & ~trusted, reason)})


def trusted(df: DataFrame) -> DataFrame:
    if "hb_label_trusted" not in df.columns:
        raise ValueError("the manifest was not finalised: it does not say which labels are trusted")
    return df.where("hb_label_trusted")


def derived_label(hb: str = "hb_g_dl", sex: str = "sex"):
    """1 below the sex's threshold, 0 from it on; null without either."""
    from ..operators.screening import THRESHOLDS

    limit = F.when(F.col(sex) == "M", THRESHOLDS["M"]).when(F.col(sex) == "F", THRESHOLDS["F"])
    return (F.col(hb) < limit).cast("long")


def integrity(df: DataFrame, key: str = "image_id", marker: str = "unparsed") -> DataFrame:
    """One row: repeated keys, labels out of range, rows whose notes carry the marker."""
    repeated = df.groupBy(key).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count") - 1)), F.lit(0)).alias("n_repeated"))
    odd = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~((F.col("hb_g_dl") > HB_RANGE[0]) & (F.col("hb_g_dl") < HB_RANGE[1]))).alias("n_out_of_range"),
        F.count_if(F.contains(F.col("notes"), F.lit(marker))).alias("n_unparsed"),
    )
    return odd.crossJoin(repeated)  # one row each


def notes(column: str = "notes"):
    """``k=v; k=v`` text as a map."""
    return F.str_to_map(F.col(column), F.lit("; "), F.lit("="))
