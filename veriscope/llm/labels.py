"""Labelled rows for the trained scorers: a bounded, deterministic sample."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Training rows of each class at most, and the length from which a text trains only where shorter ones are too few.
PER_CLASS = 1500
MAX_TRAIN_CHARS = 12_000


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """True on rows that never train: crc32 of the id as text leaves 1 modulo 3. A null id is not held out."""
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def chosen(candidates: list[tuple[int, int]], per_class: int, max_chars: int) -> list[int]:
    """Ids from (id, length) rows in order of choice: all that fit into ``per_class * max_chars`` characters, and the first in any case."""
    out, room = [], per_class * max_chars
    for doc_id, n in candidates:
        if not out or n <= room:
            out.append(doc_id)
            room -= n
    return out


def training_frame(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame | None:
    """``(doc_id, wanted, text)``, or None where there are none, of at most ``per_class`` rows a class that are not held out, drawn among labelled documents by the hash of
    their ids: those of at most ``max_chars`` characters first, then longer ones by length, within a total of
    ``per_class * max_chars`` characters a class (one text at least, whatever its length). Where a doc_id has several labels the largest
    counts; where it has several rows, its longest text trains."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 1))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("wanted"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    sizes = texts.groupBy("doc_id").agg(F.max(F.char_length("text")).alias("n"))
    sizes = cut(sizes.join(known, "doc_id").withColumns({"long": F.greatest(F.lit(0), F.col("n") - max_chars), "turn": F.xxhash64("doc_id")}), "train-sizes")
    wanted = []
    for k in (0, 1):
        first = sizes.where(F.col("wanted") == k).orderBy("long", "turn", "doc_id").limit(per_class).select("doc_id", "n").collect()
        wanted += [(i, k) for i in chosen([(r["doc_id"], r["n"]) for r in first], per_class, max_chars)]
    if not wanted:
        return None
    sample = F.broadcast(docs.sparkSession.createDataFrame(wanted, f"doc_id {known.schema['doc_id'].dataType.simpleString()}, wanted int"))  # 2 * per_class rows at most
    return texts.join(sample, "doc_id").groupBy("doc_id", "wanted").agg(F.max(F.struct(F.char_length("text"), "text"))["text"].alias("text"))


def in_order(rows: Iterable[tuple]) -> list[tuple[str, int]]:
    """(text, label) of (doc_id, label, text) rows, in the order in which they train."""
    return [(text, y) for _, y, text in sorted(rows, key=lambda r: (r[1], r[0]))]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, max_chars: int = MAX_TRAIN_CHARS) -> list[tuple[str, int]]:
    """The rows of ``training_frame`` on the driver."""
    rows = training_frame(docs, labels, label, per_class, max_chars)
    return [] if rows is None else in_order(map(tuple, rows.collect()))


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` with marks before them until no column has them, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out
