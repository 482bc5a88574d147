"""Packing: optimal length buckets by dynamic programming over the global histogram.

The histogram of lengths is one aggregate. Dynamic programming chooses at most
``n_buckets`` upper bounds so that the padding (each document padded to its bucket's
bound) is the least possible; the cost of a bucket satisfies the quadrangle inequality,
so each layer is solved by divide and conquer in n log n. Inside a bucket, documents in a fixed
pseudo-random order (MD5 of doc_id) form batches of floor(budget / bound) documents,
at least one.

Places inside a bucket come from two levels of counts (4,096 slices of the order, then the rows of a
slice), so one bucket with a third of all rows is dealt over all tasks. The histogram has a
row for each distinct length and is never rounded. What reaches the driver is bounded by
the corpus, not by the longest document: n distinct lengths need n^2 / 2 words, a million of them 5 * 10^11.

Defined cases: a null or empty text has length 0 and is packed like any other (a
bucket with bound 0 is one batch per ``budget`` documents); no document is cut, and one longer than the budget is a batch of its own.
Repeated rows each take a place; equal rows are exchangeable. Rows without an id order by their text. Extra
columns pass through ``packed``; its own columns are named pack_*, and columns of those names are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .labels import unused
from .mixing import WORDS, order_key

N_BUCKETS = 16
TOKEN_BUDGET = 32_768
SLICES = 4096


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds, ascending, of at most ``n_buckets`` buckets with the least total padding.

    ``lengths`` ascend and are distinct. Among equally good choices the one with the fewest
    buckets is returned."""
    n = len(lengths)
    if not n:
        return []
    size = lengths.astype(np.float64)
    number = np.concatenate(([0.0], np.cumsum(counts.astype(np.float64))))
    total = np.concatenate(([0.0], np.cumsum(counts * size)))

    def cost(i, j):
        """Padding of one bucket over lengths i..j-1."""
        return size[j - 1] * (number[j] - number[i]) - (total[j] - total[i])

    ends = np.arange(1, n + 1)
    best = np.concatenate(([0.0], cost(0, ends)))
    parents = []
    values = [best[n]]
    for _ in range(1, min(n_buckets, n)):
        fresh, parent = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        fresh[0] = 0.0
        spans = [(1, n, 0, n - 1)]
        while spans:
            lo, hi, left, right = spans.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            starts = np.arange(left, min(right, mid - 1) + 1)
            tried = best[starts] + cost(starts, mid)
            at = int(tried.argmin())
            fresh[mid], parent[mid] = tried[at], starts[at]
            spans += [(lo, mid - 1, left, int(starts[at])), (mid + 1, hi, int(starts[at]), right)]
        parents.append(parent)
        best = fresh
        values.append(best[n])
        if best[n] == 0:
            break
    used = int(np.argmin(values))  # the first of equal minima
    bounds, end = [], n
    for parent in reversed(parents[:used]):
        bounds.append(int(lengths[end - 1]))
        end = int(parent[end])
        if end == 0:
            break
    if end:
        bounds.append(int(lengths[end - 1]))
    return sorted(set(bounds))


def histogram(sizes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct lengths and their counts, exact."""
    rows = sizes.groupBy(F.col("pack_length").alias("length")).count().orderBy("length").toArrow()
    return rows.column("length").to_numpy(), rows.column("count").to_numpy()


def lengths(docs: DataFrame) -> DataFrame:
    """``(pack_key, pack_length)``: the order key and the number of words of every row, written once."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    return cut(docs.select("doc_id", order_key().alias("pack_key"), size.alias("pack_length")), "pack-lengths")


def batches(sizes: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``sizes`` with pack_bucket (from 0), pack_bound, pack_batch (from 0 in its bucket) and pack_padding."""
    bounds = optimal_bounds(*histogram(sizes), n_buckets)
    bound, bucket = F.lit(0).cast("long"), F.lit(0)
    for k in range(len(bounds) - 1, -1, -1):
        here = F.col("pack_length") <= bounds[k]
        bound, bucket = F.when(here, F.lit(bounds[k]).cast("long")).otherwise(bound), F.when(here, k).otherwise(bucket)
    rows = sizes.withColumns({"pack_bucket": bucket, "pack_bound": bound, "pack_slice": F.conv(F.substring("pack_key", 1, 3), 16, 10).cast("int")})
    counts = cut(rows.groupBy("pack_bucket", "pack_slice").agg(F.count("*").alias("n")), "pack-slices")
    earlier = Window.partitionBy("pack_bucket").orderBy("pack_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("pack_bucket", "pack_slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")), "pack-offsets")
    within = F.row_number().over(Window.partitionBy("pack_bucket", "pack_slice").orderBy("pack_key", "doc_id", "pack_length"))
    rows = rows.withColumn("within", within).join(offsets, ["pack_bucket", "pack_slice"])
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("pack_bound", F.lit(1))))
    batch = F.floor((F.col("offset") + F.col("within") - 1) / capacity).cast("long")
    return rows.select("doc_id", "pack_key", "pack_length", "pack_bucket", "pack_bound", batch.alias("pack_batch"), (F.col("pack_bound") - F.col("pack_length")).alias("pack_padding"))


def pack_report(docs: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``(doc_id, length, bucket, bound, batch, padding)`` for every row."""
    found = batches(lengths(docs), n_buckets, budget)
    return found.select("doc_id", *[F.col(f"pack_{c}").alias(c) for c in ("length", "bucket", "bound", "batch", "padding")])


def packed(docs: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """``docs`` with pack_length, pack_bucket, pack_bound, pack_batch and pack_padding, for every row."""
    turn = Window.partitionBy("pack_key").orderBy("pack_length", "pack_batch")
    found = batches(lengths(docs), n_buckets, budget).drop("doc_id").withColumn("pack_turn", F.row_number().over(turn))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")
    added = ("pack_length", "pack_bucket", "pack_bound", "pack_batch", "pack_padding")
    docs = docs.drop(*added)
    key, number = unused(docs.columns, "pack_key", "pack_turn")
    texts = docs.withColumn(key, order_key()).withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(size)))
    found = found.withColumnsRenamed({"pack_key": key, "pack_turn": number})
    return texts.join(found, [key, number]).select(*docs.columns, *added)
