"""Running sums along an order without one task per group.

Values are dealt into slices at approximate quantiles (at most SLICES boundaries on the driver, found by a
binary search in the JVM); slices are summed and those sums run over the slice table; rows are then ordered
inside their slice only. Equal values share a slice, so ties stay together."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def sliced(df: DataFrame, order: str, slices: int = SLICES) -> DataFrame:
    """``df`` without null ``order``, with an integer ``_slice`` that ascends with it."""
    known = df.where(F.col(order).isNotNull() & ~F.isnan(F.col(order).cast("double"))).withColumn("_order", F.col(order).cast("double"))
    at = F.array(*[F.lit(k / slices) for k in range(1, slices)])
    found = known.agg(F.percentile_approx("_order", at, F.lit(4 * slices))).first()[0] or []
    inner = sorted({float(v) for v in found if abs(v) != float("inf")})
    if not inner:
        return known.withColumn("_slice", F.lit(0)).drop("_order")
    splits = [-float("inf"), *inner, float("inf")]
    out = Bucketizer(splits=splits, inputCol="_order", outputCol="_slice", handleInvalid="keep").transform(known)
    return out.withColumn("_slice", F.col("_slice").cast("int")).drop("_order")


def running_sums(df: DataFrame, by: list[str], order: str, columns: list[str], slices: int = SLICES) -> DataFrame:
    """``df`` with, for each column, ``upto_<c>`` (sum of rows with order up to and including this one) and ``all_<c>`` (the
    group's sum), and ``next``: the next larger order value in the group. ``order`` is unique within a group."""
    rows = sliced(df, order, slices)
    sums = rows.groupBy(*by, "_slice").agg(*[F.sum(c).alias(c) for c in columns], F.min(order).alias("_first"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_off_{c}") for c in columns],
        *[F.sum(c).over(group).alias(f"all_{c}") for c in columns],
        F.lead("_first").over(group.orderBy("_slice")).alias("_after"),
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({**{f"_in_{c}": F.sum(c).over(upto) for c in columns}, "_lead": F.lead(order).over(inside)})
    keys = [*by, "_slice"]
    joined = rows.join(offsets.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return joined.select(
        *df.columns,
        *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(f"upto_{c}") for c in columns],
        *[F.col(f"all_{c}") for c in columns],
        F.coalesce("_lead", "_after").alias("next"),
    )


def least_from_here(df: DataFrame, by: list[str], order: str, value: str, out: str, slices: int = SLICES) -> DataFrame:
    """``(*by, order, out)``: the least ``value`` of the group's rows from this one on along ``order``, which is unique within a group."""
    rows = sliced(df, order, slices)
    later = Window.partitionBy(*by).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = rows.groupBy(*by, "_slice").agg(F.min(value).alias("_m")).select(*by, "_slice", F.min("_m").over(later).alias("_beyond"))
    inside = Window.partitionBy(*by, "_slice").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.min(value).over(inside))
    keys = [*by, "_slice"]
    joined = rows.join(beyond.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return joined.select(*by, order, F.least("_in", "_beyond").alias(out))


def rank_in_slices(df: DataFrame, by: list[str], order: list, out: str = "_i", total: str = "_k") -> DataFrame:
    """``df`` (with ``_slice`` ascending along ``order``) with its place from 1 in each group, and the group's number of rows."""
    counts = df.groupBy(*by, "_slice").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(group).alias(total))
    keys = [*by, "_slice"]
    rows = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = rows.join(offsets.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return joined.select(*[c for c in df.columns if c != "_slice"], (F.col("_off") + F.col("_at")).alias(out), total)
