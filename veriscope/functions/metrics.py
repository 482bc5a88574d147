"""Metrics as aggregate expressions, so that any grouping of them is one shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mae(truth, pred) -> Column:
    return F.avg(F.abs(_c(pred) - _c(truth)))


def rmse(truth, pred) -> Column:
    gap = _c(pred) - _c(truth)
    return F.sqrt(F.avg(gap * gap))


def bias(truth, pred) -> Column:
    return F.avg(_c(pred) - _c(truth))


def r2(truth, pred) -> Column:
    """1 - residual over total sum of squares; null where the truth is constant."""
    gap = _c(pred) - _c(truth)
    return 1 - F.sum(gap * gap) / F.nullif(F.var_pop(_c(truth)) * F.count(_c(truth)), F.lit(0.0))


def pearson(a, b) -> Column:
    return F.corr(_c(a), _c(b))


def duplicate_rate(key) -> Column:
    return 1 - F.count_distinct(_c(key)) / F.count(_c(key))


def metric_bundle(truth, pred, digits: int = 6) -> list[Column]:
    parts = {"mae": mae, "rmse": rmse, "bias": bias, "r2": r2, "r": pearson}
    return [F.count("*").alias("n"), *[F.round(f(truth, pred), digits).alias(name) for name, f in parts.items()]]


def average_ranks(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """(by, column, out): ranks from 1, ties sharing their mean rank, from running counts over the table of
    distinct values, which is written once. Rows are not sorted themselves."""
    from ..operators.running import running_sums
    from ..session import cut

    keys = by or []
    counts = cut(df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("_n")), "values")
    return running_sums(counts, keys, column, ["_n"]).select(*keys, column, (F.col("upto__n") - (F.col("_n") - 1) / 2).alias(out))


def with_average_ranks(df: DataFrame, columns: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``df`` with the average rank of each column under its name in ``columns``; rows without a value are left out.

    Ranks join by value, each from ``df`` itself, so no rank is computed on top of another's joins. ``df`` is read more than once and has to give
    the same values each time, to the bit: columns of a table, or means that were written by ``cut``."""
    out = df
    for column, name in columns.items():
        out = out.join(average_ranks(df, column, name, by), [*(by or []), column])
    return out


def with_average_rank(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    return with_average_ranks(df, {column: out}, by)


def benjamini_hochberg(df: DataFrame, p: str, out: str = "q", by: list[str] | None = None) -> DataFrame:
    """Adds the adjusted p: the smallest p * n / rank at this rank or beyond, at most 1. Null p stays null."""
    from ..operators.running import least_from_here, running_sums
    from ..session import cut

    keys = by or []
    names = {k: f"_by{i}" for i, k in enumerate(keys)}
    # equal p-values share one adjusted value, that of the last of them, so distinct ones are ranked, in slices
    values = df.where(F.col(p).isNotNull()).groupBy(*[F.col(k).alias(n) for k, n in names.items()], F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("_n"))
    ranked = cut(running_sums(values, list(names.values()), "_p", ["_n"]), "bh-ranks")
    scaled = ranked.select(*names.values(), "_p", (F.col("_p") * F.col("all__n") / F.col("upto__n")).alias("_scaled"))
    found = least_from_here(scaled, list(names.values()), "_p", "_scaled", "_least")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()] + [F.col(p).cast("double") == F.col("_p")]
    return df.join(found, same, "left").select(*df.columns, F.least("_least", F.lit(1.0)).alias(out))


def confusion(truth, called) -> list[Column]:
    t, c = _c(truth) == 1, _c(called)
    return [
        F.count_if(t & c).alias("tp"),
        F.count_if(~t & c).alias("fp"),
        F.count_if(~t & ~c).alias("tn"),
        F.count_if(t & ~c).alias("fn"),
    ]


def screening_rates(tp="tp", fp="fp", tn="tn", fn="fn") -> dict[str, Column]:
    """Rates from the four counts; null where a denominator is zero."""
    tp, fp, tn, fn = map(_c, (tp, fp, tn, fn))
    total = tp + fp + tn + fn
    return {
        "sensitivity": F.try_divide(tp, tp + fn),
        "specificity": F.try_divide(tn, tn + fp),
        "ppv": F.try_divide(tp, tp + fp),
        "npv": F.try_divide(tn, tn + fn),
        "referral_rate": F.try_divide(tp + fp, total),
        "false_referral_rate": F.try_divide(fp, total),
        "needed_to_screen": F.try_divide(total, tp),
    }

