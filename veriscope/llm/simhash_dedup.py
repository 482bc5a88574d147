"""Near-duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant that differs from
either in at most r bits. Every distinct fingerprint therefore emits all variants
within r = 2 bits (2,081 of them); variants meet in the task that owns their
leading bits, and fingerprints that share a variant are linked.

What travels is not the variants but one row for each leading-bit pattern that a
fingerprint's variants have (37 rows at 8 leading bits in place of 2,081): the
task expands the rest of the bits itself. A pattern under which more than VOLUME variants would
be expanded (a group of close copies may hold a third of all rows) is split by further
bits in the same way, until it is below that or all but 4 bits are leading ones, where a group can't hold more. So no task's
memory depends on the size of the input; in the limit the variants themselves travel. All fingerprints that share a variant
are within 2r bits of each other, so a chain to the smallest document of the run
keeps every component whole, and a group of G close fingerprints gives at most
G - 1 rows in a task, never G squared.

Defined cases: a null or empty text (or one of white space only) has fingerprint
zero and links like any other; a text of fewer words than the shingle is one
shingle, and a text of any length is read whole. Repeated rows share a fingerprint; ties go to the smallest doc_id. Rows with a null doc_id get their
fingerprint, a null component_id, and link nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut

SEED = 42
BITS = 64
RADIUS = 2
#: A task expands at most this many variants at once; groups start at about half of it.
VOLUME = 2_000_000
#: Further bits that split a group beyond that, up to this many bits in all.
SPLIT_BITS = 8
MAX_BITS = 60


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 values of all word shingles, in order; one for a text of fewer words, none without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits that more than half of ``hashes`` have; zero for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of the XXH64 values of all word shingles."""
    return simhash(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _masks(width: int, most: int) -> list[np.ndarray]:
    """XOR masks over ``width`` bits, by number of bits set."""
    return [
        np.array([sum(1 << b for b in bits) for bits in combinations(range(width), k)], np.uint64) for k in range(most + 1)
    ]


def _within(width: int, most: int) -> int:
    """Masks over ``width`` bits with at most ``most`` bits set."""
    return sum(comb(width, k) for k in range(most + 1))


def leading_bits(n_fingerprints: int, volume: int = VOLUME) -> int:
    """Leading bits under which evenly spread fingerprints expand about half of ``volume`` variants."""
    for bits in range(6, 29, 2):
        if n_fingerprints * _within(BITS, RADIUS) <= (volume // 2) << bits:
            return bits
    return 28


def _collisions(fp: np.ndarray, rep: np.ndarray, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (document, smaller document) among fingerprints whose variants meet under ``prefix``."""
    rest = BITS - bits
    low_masks = _masks(rest, RADIUS)
    order = np.argsort(rep, kind="stable")
    fp, rep = fp[order], rep[order]
    used = np.bitwise_count((fp >> np.uint64(rest)) ^ np.uint64(prefix)).astype(np.int64)
    low = fp & np.uint64((1 << rest) - 1)
    values, owners = [], []
    for spent in range(RADIUS + 1):
        mine = np.nonzero(used == spent)[0]
        for mask in low_masks[: RADIUS - spent + 1]:
            values.append((low[mine][:, None] ^ mask[None, :]).ravel())
            owners.append(np.repeat(mine.astype(np.int32), len(mask)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    ranked = np.sort(value)
    met = ranked[1:][ranked[1:] == ranked[:-1]]
    met = met[np.concatenate(([True], met[1:] != met[:-1]))] if len(met) else met
    if not len(met):
        return rep[:0], rep[:0]
    at = np.minimum(np.searchsorted(met, value), len(met) - 1)
    keep = met[at] == value
    at, owner = at[keep], owner[keep]
    order = np.lexsort((owner, at))
    at, owner = at[order], owner[order]
    head = np.concatenate(([True], at[1:] != at[:-1]))
    first = owner[np.nonzero(head)[0]][np.cumsum(head) - 1]
    other = ~head & (first != owner)
    a, b = owner[other], first[other]
    close = np.bitwise_count(fp[a] ^ fp[b]) <= 2 * RADIUS
    a, b = a[close], b[close]
    label = np.arange(len(fp))
    while len(a):  # contract this task's links to one for each member
        before = label.copy()
        low_label = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low_label)
        np.minimum.at(label, b, low_label)
        np.minimum.at(label, before[a], low_label)
        np.minimum.at(label, before[b], low_label)
        label = label[label]
        if (label == before).all():
            break
    linked = np.nonzero(label != np.arange(len(fp)))[0]
    return rep[linked], rep[label[linked]]


def _flips(width: int) -> list[int]:
    return [int(m) for masks in _masks(width, RADIUS) for m in masks]


def _patterns(rows: DataFrame, bits: int, more: int) -> DataFrame:
    """Rows dealt by ``bits`` leading bits, dealt by ``more`` further ones; ``bits`` may be 0."""
    flip = F.explode(F.lit(_flips(more)).cast("array<bigint>"))
    at = F.shiftrightunsigned("fp", BITS - bits - more)
    rows = rows.withColumn("flip", flip).withColumn("next", F.shiftleft("prefix", more).bitwiseOR(at.bitwiseAND(F.lit((1 << more) - 1)).bitwiseXOR(F.col("flip"))))
    return rows.where(F.bit_count(at.bitwiseXOR(F.col("next"))) <= RADIUS).select("fp", "rep", F.col("next").alias("prefix"))


def near_links(distinct: DataFrame, volume: int = VOLUME) -> DataFrame:
    """``(src, dst)`` of representatives ``(fp, rep)`` whose fingerprints are linked, up to transitivity."""
    import pandas as pd

    def meeting(rows: DataFrame, bits: int) -> DataFrame:
        def meet(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = _collisions(pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy(), int(pdf["prefix"].iloc[0]), bits)
            return pd.DataFrame({"src": a, "dst": b})

        return rows.groupBy("prefix").applyInPandas(meet, "src long, dst long")

    def expanded(bits: int) -> Column:
        """Variants that a row expands: those within what its flips among the leading bits leave of the radius."""
        spent = F.bit_count(F.shiftrightunsigned("fp", BITS - bits).bitwiseXOR(F.col("prefix")))
        return F.element_at(F.array(*[F.lit(_within(BITS - bits, RADIUS - k)) for k in range(RADIUS + 1)]), spent + 1)

    bits, found = leading_bits(distinct.count(), volume), None
    rows = _patterns(distinct.withColumn("prefix", F.lit(0).cast("long")), 0, bits)
    while True:
        large = 0
        if bits + SPLIT_BITS <= MAX_BITS:
            sizes = rows.groupBy("prefix").agg(F.sum(expanded(bits)).alias("n")).where(F.col("n") > volume)
            sizes = cut(sizes.select("prefix"), "simhash-large")
            large = sizes.count()
        here = meeting(rows.join(sizes, "prefix", "left_anti") if large else rows, bits)
        found = here if found is None else found.unionByName(here)
        if not large:
            return found.distinct()
        rows, bits = _patterns(rows.join(sizes, "prefix", "left_semi"), bits, SPLIT_BITS), bits + SPLIT_BITS


def near_duplicates(docs: DataFrame, shingle: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``."""
    found = cut(fingerprints(docs, shingle, id_column, text_column), "simhash")
    distinct = cut(found.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-fp")
    parts = connected_components(near_links(distinct))
    classes = distinct.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    classes = cut(classes.select(F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")), "simhash-classes")
    rows = found.join(classes, (F.col("fp") == F.col("class_fp")) & F.col("doc_id").isNotNull(), "left")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``docs`` without all but the smallest doc_id of each group of ``shingle_links.components``
    (similarity 0.8 or more); rows that repeat the kept doc_id are one document and stay, as do
    rows with a null doc_id."""
    from . import shingle_links

    found = shingle_links.components(docs, shingle)
    gone = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
