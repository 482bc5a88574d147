"""Joins and concatenation by position, for tables whose rows belong together by their order alone.

A table has no order of its own in Spark, so one is declared: columns to sort on. Rows are numbered in two passes: ranges of the order are sorted in parallel and
written, and the sizes of the ranges before (one number a range) are added. Both sides are then joined on the number.

Before that, both sides' columns that ought to agree are digested together with the row's number; digests that differ mean that the sides are not in the same
order (or not the same rows), and the join raises. A digest is a sum and a bit-wise sum of 64-bit hashes, so swapping two rows changes it.

Defined cases: rows that tie on the order are put in order of a hash of all their columns, and rows that are equal in all of them are interchangeable; nulls sort
first, and agree with nulls; empty tables join to an empty one; names that both sides have raise, since either could be meant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

_BITS = 33


class OrderMismatch(ValueError):
    """Two sides that were to be joined by position are not in the same order."""


def with_position(df: DataFrame, order: list[str], out: str = "position") -> DataFrame:
    """``df`` with its row number from 0 in the declared order."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = "_tie"
    rows = df.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    ranged = rows.repartitionByRange(parts, *order, tie).sortWithinPartitions(*order, tie).drop(tie)
    written = cut(ranged.withColumn(out, F.monotonically_increasing_id()), "positions")  # the range's number, and the row's place in it
    part = F.shiftright(out, _BITS)
    before, upto = {}, 0
    for r in written.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a range
        before[r["part"]] = upto
        upto += r["count"]
    if not before:
        return written
    offset = F.element_at(F.create_map(*[F.lit(v) for pair in before.items() for v in pair]), part)
    return written.withColumn(out, offset + F.col(out).bitwiseAND((1 << _BITS) - 1))


def order_digest(numbered: DataFrame, keys: list[str], position: str = "position") -> tuple:
    """(rows, sum, bit-wise sum) of the hashes of each row's number and keys."""
    h = F.xxhash64(F.col(position), *[F.col(k) for k in keys])
    row = numbered.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return row["n"], row["s"], row["x"]


def positional_join(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str], agree: dict[str, str] | None = None, position: str = "position") -> DataFrame:
    """Row n of ``left`` beside row n of ``right``. ``agree`` maps columns of the left to those of the right that have to hold the same
    values in the same order (compared as strings); without it only the numbers of rows have to agree."""
    agree = agree or {}
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}
    if both or position in (*left.columns, *right.columns):
        raise ValueError(f"names on both sides, or that of the position: {sorted(both) or [position]}")
    sides = [with_position(df, order, position) for df, order in ((left, left_order), (right, right_order))]
    keys = (list(agree), list(agree.values()))
    as_text = [side.withColumns({k: F.col(k).cast("string") for k in ks}) for side, ks in zip(sides, keys)]
    digests = [order_digest(side, ks, position) for side, ks in zip(as_text, keys)]
    if digests[0][0] != digests[1][0]:
        raise OrderMismatch(f"{digests[0][0]} rows beside {digests[1][0]}")
    if digests[0] != digests[1]:
        l, r = (side.select(position, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(ks)]).alias(name)) for side, ks, name in zip(as_text, keys, ("l", "r")))
        first = l.join(r, position).where(~F.col("l").eqNullSafe(F.col("r"))).agg(F.min(F.struct(position, "l", "r")).alias("m")).first()["m"]
        raise OrderMismatch(f"row {first[position]}: {list(first['l'])} beside {list(first['r'])}")
    return sides[0].join(sides[1], position).select(position, *left.columns, *right.columns)


def positional_concat(parts: list[tuple[DataFrame, list[str]]], position: str = "position") -> DataFrame:
    """The columns of several tables of the same length side by side, each in its declared order."""
    whole, order = parts[0]
    for df, by in parts[1:]:
        whole = positional_join(whole, df, order, by, position=position).drop(position)
    return whole
