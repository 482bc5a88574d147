"""Splits that keep groups whole, and the checks that they did.

Order comes from MD5 of seed and key, so that a split is the same on every engine,
partitioning and run. Only tables of groups are ranked, in 4,096 slices of the hash, so no task orders all groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .running import rank_in_slices


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def leaks(df: DataFrame, split: str, axes: dict[str, str]) -> DataFrame:
    """(axis, key, n_splits, n_rows) of keys found in more than one split."""

    def spanning(axis: str, key: str) -> DataFrame:
        counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key"))
        counts = counts.agg(F.count_distinct(split).alias("n_splits"), F.count("*").alias("n_rows"))
        return counts.where("n_splits > 1").select(F.lit(axis).alias("axis"), "key", "n_splits", "n_rows")

    found = [spanning(axis, key) for axis, key in axes.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def leakproof_groups(df: DataFrame, subject: str, content: str | None) -> DataFrame:
    """(subject, group_id): components of subjects linked by shared content.

    Rows without content fall back to their subject. Each content value links its subjects to the
    smallest of them, so a value that many share gives a star and no pairs."""
    subjects = df.where(F.col(subject).isNotNull()).select(F.col(subject).cast("string").alias("s")).distinct()
    if content is None:
        return subjects.select(F.col("s").alias(subject), F.col("s").alias("group_id"))
    held = df.where(F.col(subject).isNotNull() & F.col(content).isNotNull() & (F.col(content).cast("string") != ""))
    held = held.select(F.col(subject).cast("string").alias("s"), F.col(content).cast("string").alias("c")).distinct()
    least = held.groupBy("c").agg(F.min("s").alias("low"))
    parts = connected_components(held.join(least, "c").select("s", "low"), "s", "low")
    return subjects.join(parts.withColumnRenamed("node", "s"), "s", "left").select(F.col("s").alias(subject), F.coalesce("component", "s").alias("group_id"))


def _ranked(df: DataFrame, group: str, seed: int) -> DataFrame:
    groups = df.where(F.col(group).isNotNull()).select(group).distinct()
    return _in_hash_order(groups, [], group, seed)


def _in_hash_order(groups: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """``groups`` with ``_i``, the place in hash order, and ``_k``, the number of groups; both within ``by``."""
    rows = groups.withColumn("_h", hash_order(key, seed)).withColumn("_slice", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    return rank_in_slices(rows, by, ["_h", key]).drop("_h")


def group_kfold(df: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """(group, fold): whole groups dealt round-robin in hash order."""
    return _ranked(df, group, seed).select(group, ((F.col("_i") - 1) % k).cast("int").alias("fold"))


def grouped_split(df: DataFrame, group: str, fractions: dict[str, float], seed: int = 0, stratum: str | None = None) -> DataFrame:
    """(group, split): whole groups cut at cumulative fractions of their number (rounded half to even), the rest to the last.

    With ``stratum``, groups are cut inside each stratum by their most frequent value, the smallest among ties."""
    groups = df.where(F.col(group).isNotNull())
    if stratum is None:
        ranked = _ranked(df, group, seed)
    else:
        counts = groups.groupBy(group, F.coalesce(F.col(stratum).cast("string"), F.lit("nan")).alias("_v")).agg(F.count("*").alias("_n"))
        groups = counts.groupBy(group).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v")))["v"].alias("_s"))
        ranked = _in_hash_order(groups, ["_s"], group, seed)
    names, total, choice = list(fractions), 0.0, F.lit(list(fractions)[-1])
    for upto in range(len(names) - 1, 0, -1):
        total = sum(list(fractions.values())[:upto])
        choice = F.when(F.col("_i") <= F.bround(F.col("_k") * round(total, 12), 0), names[upto - 1]).otherwise(choice)
    return ranked.select(group, choice.alias("split"))


def stratified_sample(df: DataFrame, stratum: str, key: str, fraction: float, least: int = 4, seed: int = 0) -> DataFrame:
    """A fraction of each stratum in hash order, at least ``least`` rows where there are that many."""
    ranked = _in_hash_order(df, [stratum], key, seed)
    take = F.greatest(F.least(F.lit(least), F.col("_k")), F.bround(F.col("_k") * fraction, 0))
    return ranked.where(F.col("_i") <= take).drop("_i", "_k")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all) in hash order."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def training_means(df: DataFrame, fold: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(fold, *by, train_mean): for each fold, the mean over the other folds, from one pass of sums."""
    keys = by or []
    parts = df.where(F.col(value).isNotNull()).groupBy(fold, *keys).agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    rest = Window.partitionBy(*keys)
    mean = F.try_divide(F.sum("_s").over(rest) - F.col("_s"), F.sum("_n").over(rest) - F.col("_n"))
    return parts.select(fold, *keys, mean.alias("train_mean"))
