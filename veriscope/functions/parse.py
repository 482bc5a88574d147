"""Text grammars, tolerant number parsing and vector angles as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that stand for a missing number.
MISSING = ("_", "-", "/", "n/a", "NA", "")

#: Fields of a page address: (name, pattern, type).
PAGE_GRAMMAR = (
    ("scheme", r"^([a-z]+)://", "string"),
    ("host", r"^[a-z]+://([^/?#]+)", "string"),
    ("lang", r"/([a-z]{2})/[0-9]+", "string"),
    ("number", r"/([0-9]+)", "long"),
    ("suffix", r"\.([a-z]+)(?:[?#]|$)", "string"),
)


def grammar(column: str, fields) -> list[Column]:
    """One column for each (name, pattern, type): the pattern's first group, cast where a type other than string is asked for."""
    return [F.regexp_extract(column, pattern, 1).try_cast(kind).alias(name) for name, pattern, kind in fields]


def decimal_comma(column: str) -> Column:
    """A double from text with a decimal comma or point; null for marks of a missing number and for anything else."""
    text = F.trim(column)
    return F.when(~text.isin(*MISSING), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def angle_degrees(a, b) -> Column:
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def stem(column: str) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(column, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def extension(column: str) -> Column:
    return F.lower(F.regexp_extract(column, r"\.([^./\\]+)$", 1))


def padded(column, width: int) -> Column:
    """Zero-padded to at least ``width``; longer numbers keep all their digits."""
    text = F.col(column).cast("string") if isinstance(column, str) else column.cast("string")
    return F.when(F.char_length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
