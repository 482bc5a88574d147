"""Embedding near-duplicates: iterative quantisation and multi-index Hamming tables.

A rotation that balances binary codes is learned on a bounded sample (SAMPLE vectors
by the hash of their ids): principal directions, then alternating sign codes
and orthogonal fits. Every vector is coded with it. Codes are cut into ``tables``
substrings; vectors within ``radius`` bits agree to within radius // tables bits in some
substring, and two substrings that close share a variant within half of that, so each
side enters a table under every variant of its ball. Candidates are then reranked by the cosine of the
original vectors in double precision.

A pair meets in many buckets but is looked at for good in one only: the first table
that brings it together, under one fixed variant; so counts need no distinct over
pairs. First pass: codes alone find which entries have a partner. Second pass: only those fetch
their vectors, and a task returns each vector's count and one link into its local
component, never the pairs. Equal vectors are one entry with a
weight. A bucket of more than BLOCK entries is cut into blocks (of BLOCK entries, larger ones from
BLOCK * SPREAD entries on, so that an entry takes part in about SPREAD pairs of blocks) and its pairs of blocks
are dealt to tasks, so no group is held whole and none is capped.

Vectors link with vectors of their own length only; the length is part of the bucket, so all lengths are in one index. A
length of which the sample has enough vectors (and that is among its FITTED most frequent ones) has its own learned rotation;
codes of vectors shorter than 64 are filled up, and those of rare lengths made, with random directions.

Defined cases: vectors that are null, empty, zero, or with null or non-finite parts link with nothing and are their own
component. Rows that repeat a vec_id are one vector (the smallest embedding by array
order). A null vec_id gives a row of its own with no links, a null component and kept
false. Ties do not arise: a component's id is its smallest vec_id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut

THRESHOLD = 0.95
SAMPLE = 20_000
ROUNDS = 40
TABLES = 4
RADIUS = 11
BITS = 64
BLOCK = 128
SPREAD = 64
LARGEST_BLOCK = 4096
FITTED = 16


class Quantiser:
    """``mean`` and ``directions`` (columns): a bit is the sign of a centred vector along one."""

    def __init__(self, mean: np.ndarray, directions: np.ndarray):
        self.mean, self.directions = mean, directions

    def codes(self, unit: np.ndarray) -> np.ndarray:
        bits = (unit - self.mean) @ self.directions >= 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def unfitted(dim: int) -> Quantiser:
    """Random directions for vectors of ``dim`` parts, the same ones everywhere."""
    rng = np.random.Generator(np.random.PCG64(dim))
    return Quantiser(np.zeros(dim), rng.normal(size=(dim, BITS)))


def fit(sample: np.ndarray, seed: int = 11) -> Quantiser:
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    mean = unit.mean(axis=0)
    centred = unit - mean
    width = min(BITS, unit.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :width]
    projected = centred @ axes
    rng = np.random.Generator(np.random.PCG64(seed))
    rotation = np.linalg.qr(rng.normal(size=(width, width)))[0]
    for _ in range(ROUNDS):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ projected)
        rotation = (left @ right).T
    learned = axes @ rotation
    return Quantiser(mean, np.concatenate([learned, unfitted(unit.shape[1]).directions[:, width:]], axis=1))


class Quantisers:
    """A quantiser for every length of vectors."""

    def __init__(self, fitted: dict[int, Quantiser]):
        self.of = dict(fitted)

    def codes(self, column: pa.Array) -> np.ndarray:
        sizes = column.value_lengths().to_numpy()
        out = np.zeros(len(column), np.uint64)
        for dim in np.unique(sizes).tolist():
            at = np.nonzero(sizes == dim)[0]
            x = _matrix(column.take(pa.array(at)))
            if dim not in self.of:
                self.of[dim] = unfitted(dim)
            out[at] = self.of[dim].codes(x / np.linalg.norm(x, axis=1, keepdims=True))
        return out


def fit_all(sample: pa.Array) -> dict[int, Quantiser]:
    """Learned quantisers for the FITTED most frequent lengths of which ``sample`` has four vectors a bit."""
    if not len(sample):
        return {}
    sizes = sample.value_lengths().to_numpy()
    dims, counts = np.unique(sizes, return_counts=True)
    often = sorted(zip(-counts, dims))[:FITTED]
    return {int(d): fit(_matrix(sample.take(pa.array(np.nonzero(sizes == d)[0])))) for n, d in often if -n >= 4 * min(BITS, d)}


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def substrings(tables: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of each table's substring."""
    edges = [bits * t // tables for t in range(tables + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


class Meeting:
    """Whether a pair's one place to be looked at is a given table and variant."""

    def __init__(self, tables: int, radius: int):
        self.parts = substrings(tables)
        self.radius, self.ball = radius, -(-(radius // tables) // 2)

    def here(self, a: np.ndarray, b: np.ndarray, table: np.ndarray, variant: np.ndarray) -> np.ndarray:
        differ = a ^ b
        ok = np.bitwise_count(differ) <= self.radius
        out = np.zeros(len(a), bool)
        at = np.nonzero(ok)[0]
        a, b, differ, table, variant = a[at], b[at], differ[at], table[at], variant[at]
        undecided = np.ones(len(at), bool)
        for t, (shift, width) in enumerate(self.parts):
            mask = np.uint64((1 << width) - 1)
            x = (differ >> np.uint64(shift)) & mask
            n = np.bitwise_count(x)
            first = undecided & (n <= 2 * self.ball)
            undecided &= ~first
            meet = np.minimum((a >> np.uint64(shift)) & mask, (b >> np.uint64(shift)) & mask)
            rest = x.copy()
            for k in range(self.ball):
                low = rest & (~rest + np.uint64(1))
                use = n // 2 > k
                meet = np.where(use, meet ^ low, meet)
                rest ^= low
            out[at] |= first & (table == t) & (variant == meet)
        return out


#: A bucket is the vectors' length, then TABLE_BITS for the table, then WIDTH for the variant.
WIDTH, TABLE_BITS = 32, 6


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (bucket, lo, hi) from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(3)]
        new = np.nonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))[0]
        last = int(new[-1]) + 1 if len(new) else 0
        if held and any(k[0] != held[-1].column(j)[-1].as_py() for j, k in enumerate(keys)):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(group: pa.Table, meeting: Meeting) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs that are to be looked at, by their distance in the table."""
    bucket, lo, hi, block, code = (group.column(c).to_numpy() for c in ("bucket", "lo", "hi", "block", "code"))
    code = code.view(np.uint64)
    turn = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    end = np.append(np.nonzero(turn)[0][1:], len(bucket))[np.cumsum(turn) - 1]
    table, variant = (bucket >> WIDTH) & ((1 << TABLE_BITS) - 1), (bucket & ((1 << WIDTH) - 1)).astype(np.uint64)
    i, d = np.arange(len(bucket)), 0
    while len(i):
        d += 1
        i = i[i + d < end[i]]
        a = i[(lo[i] == hi[i]) | (block[i] != block[i + d])]
        a = a[meeting.here(code[a], code[a + d], table[a], variant[a])] if len(a) else a
        if len(a):
            yield a, a + d


def _dealt(entries: DataFrame, block: int) -> DataFrame:
    """Entries with (lo, hi) for each pair of blocks of their bucket that they take part in."""
    sizes = cut(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "itq-buckets")
    size = F.least(F.lit(max(block, LARGEST_BLOCK)), F.greatest(F.lit(block), F.floor(F.col("n") / SPREAD)))
    spread = entries.join(sizes.select("bucket", F.ceil(F.col("n") / size).cast("int").alias("blocks")), "bucket")
    spread = spread.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = spread.withColumn("other", other)
    return spread.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "code")


def _together(df: DataFrame) -> DataFrame:
    return df.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def _is_vector() -> Column:
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(e, lambda x: x != 0), F.lit(False))


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for each vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("kept"))
    rows = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    plain = F.transform("embedding", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    rows = rows.withColumn("fine", _is_vector()).withColumn("embedding", F.when(F.col("fine"), plain))
    rows = cut(rows.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")}), "itq-vectors")
    same = rows.where("fine").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.min("embedding").alias("embedding"))
    entries = cut(same, "itq-entries")
    sample = entries.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("embedding").toArrow()
    linked = _links(entries, fit_all(sample.column(0).combine_chunks()), threshold, tables, radius, block)
    linked = cut(linked, "itq-links")
    parts = connected_components(linked.where("dst is not null").select("rep", "dst"), "rep", "dst")
    counts = linked.groupBy("rep").agg(F.sum("weight").alias("others"))
    known_classes = entries.select("k1", "k2", "rep", "weight").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    classes = cut(
        known_classes.select("k1", "k2", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component")),
        "itq-classes",
    )
    found = rows.select("vec_id", "fine", "k1", "k2").join(classes.withColumn("fine", F.lit(True)), ["fine", "k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    found = found.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
    return found.unionByName(nameless)


def _links(entries: DataFrame, known: dict[int, Quantiser], threshold: float, tables: int, radius: int, block: int) -> DataFrame:
    """``(rep, weight, dst)``: parts of an entry's link count, and a smaller entry of its component."""
    shared = entries.sparkSession.sparkContext.broadcast({dim: (q.mean, q.directions) for dim, q in known.items()})
    meeting = Meeting(tables, radius)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers = Quantisers({dim: Quantiser(*parts) for dim, parts in shared.value.items()})
        for batch in batches:
            codes = quantisers.codes(batch.column(1)).view(np.int64)
            sizes = batch.column(1).value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(codes)], ["rep", "dim", "code"])

    coded = cut(entries.select("rep", "embedding").mapInArrow(code, "rep long, dim long, code long"), "itq-codes")

    def variants(t: int, shift: int, width: int) -> Column:
        part = F.shiftrightunsigned("code", shift).bitwiseAND(F.lit((1 << width) - 1))
        return F.transform(F.lit(ball(width, meeting.ball)).cast("array<bigint>"), lambda m: part.bitwiseXOR(m) + F.lit(t << WIDTH) + F.shiftleft("dim", WIDTH + TABLE_BITS))

    buckets = F.concat(*[variants(t, shift, width) for t, (shift, width) in enumerate(meeting.parts)])
    placed = coded.select(F.explode(buckets).alias("bucket"), "rep", "code")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            active = np.zeros(group.num_rows, bool)
            for a, b in _pairs(group, meeting):
                active[a] = active[b] = True
            yield from group.filter(pa.array(active)).to_batches()

    active = cut(_together(_dealt(placed, block)).mapInArrow(partners, "bucket long, lo int, hi int, block int, rep long, code long"), "itq-active")

    def reranked(group: pa.Table) -> pa.RecordBatch:
        """Counts and links among the rows of a group of whole buckets, whose vectors are of one length."""
        x = _matrix(group.column("embedding").combine_chunks())
        norm = np.linalg.norm(x, axis=1)
        rep, weight = group.column("rep").to_numpy(), group.column("weight").to_numpy()
        total = np.zeros(len(rep), np.int64)
        left, right = [], []
        for a, b in _pairs(group, meeting):
            close = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= threshold
            a, b = a[close], b[close]
            np.add.at(total, a, weight[b])
            np.add.at(total, b, weight[a])
            left.append(a)
            right.append(b)
        a, b = (np.concatenate(s) if s else np.zeros(0, np.int64) for s in (left, right))
        least = rep.copy()
        while len(a):
            before = least.copy()
            low = np.minimum(least[a], least[b])
            np.minimum.at(least, a, low)
            np.minimum.at(least, b, low)
            if (least == before).all():
                break
        at = np.nonzero(total)[0]
        dst = pa.array(least[at], mask=least[at] == rep[at])
        return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(total[at]), dst], ["rep", "weight", "dst"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            dim = group.column("bucket").to_numpy() >> (WIDTH + TABLE_BITS)
            edges = [0, *(np.nonzero(np.diff(dim))[0] + 1).tolist(), len(dim)]
            for start, end in zip(edges, edges[1:]):
                yield reranked(group.slice(start, end - start))

    whole = active.join(entries.select("rep", "weight", "embedding"), "rep").select("bucket", "lo", "hi", "block", "rep", "code", "weight", "embedding")
    return _together(whole).mapInArrow(rerank, "rep long, weight long, dst long")
