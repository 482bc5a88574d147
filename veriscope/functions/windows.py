"""Hopping windows over a sample index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hopping_windows(df: DataFrame, key: str, order: list[str], value: str, size: int, stride: int) -> DataFrame:
    """(key, window, i, value, z): full windows of ``size`` samples every ``stride``, standardised by their own
    mean and population SD; windows of hardly any spread are left out.

    The index comes from slices of the first order column (a number or a time), so a key with most of the rows is not
    ordered in one task; a sample is copied to its size / stride windows by arithmetic on its index."""
    from pyspark.sql import Window
    from pyspark.sql import types as T

    from ..operators.running import rank_in_slices, sliced

    rows = df.where(F.col(value).isNotNull())
    timed = isinstance(df.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
    at = F.unix_micros(F.col(order[0]).cast("timestamp")) if timed else F.col(order[0]).cast("double")
    rows = rank_in_slices(sliced(rows.withColumn("_t", at), "_t"), [key], order, "_i", "_n").withColumn("_i", F.col("_i") - 1)
    last = F.floor((F.col("_n") - size) / stride)
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / stride))
    high = F.least(last, F.floor(F.col("_i") / stride))
    rows = rows.where((F.col("_n") >= size) & (low <= high)).withColumn("window", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    own = Window.partitionBy(key, "window")
    rows = rows.withColumns({"_m": F.avg(value).over(own), "_s": F.stddev_pop(value).over(own)}).where("_s >= 1e-9")
    at = (F.col("_i") - F.col("window") * stride).alias("i")
    return rows.select(key, "window", at, F.col(value).alias("value"), ((F.col(value) - F.col("_m")) / F.col("_s")).alias("z"))
