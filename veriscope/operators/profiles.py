"""Profiles of measurements: duplicates, label conflicts, rates and spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_groups(df: DataFrame, key: str, subject: str) -> DataFrame:
    """Keys that occur more than once: rows, redundant rows, subjects they span."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n"), F.count_distinct(subject).alias("n_subjects"))
        .where("n > 1")
        .withColumn("redundant", F.col("n") - 1)
    )


def duplicate_summary(df: DataFrame, key: str, subject: str, by: str) -> DataFrame:
    """Per ``by``: duplicate groups, redundant rows, groups spanning several subjects."""
    groups = df.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.count("*").alias("n"), F.count_distinct(subject).alias("s"))
    return groups.groupBy(by).agg(
        F.count_if(F.col("n") > 1).alias("n_groups"),
        F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("redundant"),
        F.count_if((F.col("n") > 1) & (F.col("s") > 1)).alias("n_spanning"),
    )


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys whose rows disagree on a label."""
    stats = df.groupBy(key).agg(
        F.count("*").alias("n"), F.count_distinct(label).alias("n_labels"), F.min(label).alias("lowest"), F.max(label).alias("highest")
    )
    return stats.where("n_labels > 1").withColumn("spread", F.col("highest") - F.col("lowest"))


def smallest_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest among equally frequent ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias("mode"))


def overlap(df: DataFrame, key: str, side: str) -> DataFrame:
    """For each pair of sides a < b: shared keys, and pairs of rows that share one.

    Both sides are counted per key before they meet, so a key with many rows is one row on either side."""
    counts = df.where(F.col(key).isNotNull() & F.col(side).isNotNull()).groupBy(side, key).agg(F.count("*").alias("n"))
    a = counts.select(F.col(side).alias("side_a"), key, F.col("n").alias("na"))
    b = counts.select(F.col(side).alias("side_b"), key, F.col("n").alias("nb"))
    met = a.join(b, key).where("side_a < side_b")
    return met.groupBy("side_a", "side_b").agg(F.count("*").alias("shared"), F.sum(F.col("na") * F.col("nb")).alias("row_pairs"))


def order_summary(df: DataFrame, value: str, by: list[str], tiebreak: str, fraction: float = 0.25) -> DataFrame:
    """Mean, median, trimean, mean of the best and worst ``fraction`` (half-even rounded count, at least one), maximum."""
    from .quantiles import quantiles
    from .running import rank_in_slices, sliced

    ranked = rank_in_slices(sliced(df, value), by, [value, tiebreak], "_rank", "_n")
    ranked = ranked.withColumn("_take", F.greatest(F.lit(1), F.bround(F.col("_n") * fraction, 0).cast("long")))
    best = F.when(F.col("_rank") <= F.col("_take"), F.col(value))
    worst = F.when(F.col("_rank") > F.col("_n") - F.col("_take"), F.col(value))
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.avg(best).alias("best"), F.avg(worst).alias("worst"), F.max(value).alias("max"))
    q = quantiles(df, by, value, [0.25, 0.5, 0.75], "_quarters").withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    quarter = lambda k: F.col("_quarters")[k]
    trimean = (quarter(0) + 2 * quarter(1) + quarter(2)) / 4
    return out.join(q, same).select(*by, "n", "mean", quarter(1).alias("median"), trimean.alias("trimean"), "best", "worst", "max")


def histogram(df: DataFrame, value: str, bins: int = 60) -> DataFrame:
    """Equal-width bins between the extremes; the last one is closed. Empty bins have no row."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width)))
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))  # one row of two numbers
    return rows.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.min("hi").alias("hi")).select(
        "bin", (F.col("lo") + F.col("bin") * width).alias("left"), "n"
    )


def binned_signal(df: DataFrame, axis: str, value: str, width: float = 1.0) -> DataFrame:
    """Mean of ``value`` in bins along ``axis`` with the step to the next occupied bin, weighted by the smaller count."""
    low = df.agg(F.min(axis).alias("lo"))
    bins = df.where(F.col(axis).isNotNull() & F.col(value).isNotNull()).crossJoin(F.broadcast(low))
    bins = bins.groupBy(F.floor((F.col(axis) - F.col("lo")) / width).alias("bin")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    ahead = Window.orderBy("bin")
    return bins.withColumns({"step": F.abs(F.lead("mean").over(ahead) - F.col("mean")), "weight": F.least("n", F.lead("n").over(ahead))})


def linear_split(df: DataFrame, value: str, axis: str, by: list[str], least: int = 20) -> DataFrame:
    """Per group: slope of value on axis, total and residual coefficient of variation, R2, and the residual spread in units of axis.

    Groups under ``least`` rows are left out."""
    stats = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope(value, axis).alias("slope"),
        F.regr_r2(value, axis).alias("r2"),
        F.stddev_pop(value).alias("sd"),
        F.avg(value).alias("mean"),
    )
    stats = stats.where(F.col("n") >= least)
    residual = F.col("sd") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("r2")))
    return stats.select(
        *by,
        "n",
        "slope",
        "r2",
        F.try_divide(F.col("sd"), F.abs("mean")).alias("total_cv"),
        F.try_divide(residual, F.abs("mean")).alias("residual_cv"),
        F.try_divide(residual, F.abs("slope")).alias("equivalent_noise"),
    )


def two_way_variance(df: DataFrame, value: str, unit: str, first: str, second: str, least: int = 4) -> DataFrame:
    """Within-unit sums of squares of two factors' means and the rest; between-unit sum of squares; units under ``least`` rows are left out."""
    cells = df.where(F.col(value).isNotNull()).groupBy(unit, first, second)
    cells = cells.agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    whole = cells.groupBy(unit).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).where(F.col("n") >= least)
    whole = whole.withColumn("mean", F.col("s") / F.col("n"))

    def between(factor: str, name: str) -> DataFrame:
        """Sum of squares of the factor's level means about their unit's mean."""
        levels = cells.groupBy(unit, factor).agg(F.sum("n").alias("ln"), F.sum("s").alias("ls")).join(whole.select(unit, "mean"), unit)
        gap = F.col("ls") / F.col("ln") - F.col("mean")
        return levels.groupBy(unit).agg(F.sum(F.col("ln") * gap * gap).alias(name))

    parts = whole.withColumn("ss_within", F.col("q") - F.col("n") * F.col("mean") * F.col("mean"))
    parts = parts.join(between(first, "ss_first"), unit).join(between(second, "ss_second"), unit)
    grand = (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("grand")
    totals = parts.agg(grand, F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("raw"), F.sum("n").alias("n"), F.count("*").alias("n_units"),
                       F.sum("ss_first").alias("ss_first"), F.sum("ss_second").alias("ss_second"), F.sum("ss_within").alias("ss_within"))
    return totals.select(
        "n_units",
        "n",
        "ss_first",
        "ss_second",
        (F.col("ss_within") - F.col("ss_first") - F.col("ss_second")).alias("ss_residual"),
        (F.col("raw") - F.col("n") * F.col("grand") * F.col("grand")).alias("ss_between"),
    )


def conditional_counts(by: str, df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Counts of rows that meet each named test; 0 where none does."""
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.count_if(test).alias(name) for name, test in tests.items()])


def top_per_cell(df: DataFrame, cell: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).where(F.col("rank") <= k)


def rates_by_dimension(df: DataFrame, dimensions: list[str], hit: str, size: str) -> DataFrame:
    """(dimension, level, n, rate_pct, median_area) for each level of each dimension, from one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("level")) for d in dimensions]))
    rows = df.select(cells.alias("cell"), F.col(hit).alias("_hit"), F.col(size).alias("_size")).groupBy("cell.dimension", "cell.level")
    return rows.agg(F.count("*").alias("n"), (100.0 * F.count_if("_hit") / F.count("*")).alias("rate_pct"), F.median("_size").alias("median_area"))


def category_counts(df: DataFrame, criteria: dict[str, str], by: str, classes: list[str]) -> DataFrame:
    """(criterion, category, one count for each of ``classes``): criteria are names of columns; a null category is left out."""
    cells = F.explode(F.array(*[F.struct(F.lit(name).alias("criterion"), F.col(c).cast("string").alias("category")) for name, c in criteria.items()]))
    rows = df.select(cells.alias("cell"), F.col(by).alias("_class")).where("cell.category is not null").groupBy("cell.criterion", "cell.category")
    return rows.agg(*[F.count_if(F.col("_class") == k).alias(k) for k in classes])


def row_mean(columns: list[str]) -> Column:
    """The mean over columns of a row; null if one is."""
    total = F.aggregate(F.array(*columns), F.lit(0.0), lambda acc, v: acc + v)
    return total / len(columns)


def weighted_channels(df: DataFrame, key: str, channel: str, value: str, weights: dict[str, tuple[float, float]], longest: float, out: str = "mixed") -> DataFrame:
    """(key, out): the sum of values by channel weight; ``weights`` gives (weight, wavelength), and beyond ``longest`` nothing counts."""
    used = {name: weight if length <= longest else 0.0 for name, (weight, length) in weights.items()}
    weight = F.create_map(*[F.lit(x) for kv in used.items() for x in kv])[F.col(channel)]
    return df.where(weight.isNotNull()).groupBy(key).agg(F.sum(weight * F.col(value)).alias(out))
