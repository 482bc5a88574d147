"""Screening by a score: cuts, ranking metrics, calls made out of fold.

A row is called positive when its score lies strictly below the cut. Everything works on
the table of distinct scores (counts of positives and negatives), and its running sums are dealt into
slices of the score, so no task orders a whole fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import running_sums

ADULT_AGE = 15
#: Haemoglobin thresholds in g/dL by sex.
THRESHOLDS = {"M": 13.0, "F": 12.0}


def adult_threshold(sex: str = "sex", age: str = "age") -> Column:
    """The threshold of an adult; raises for a missing age or one under ADULT_AGE, null for an unknown sex."""
    known = F.col(age).isNotNull() & ~F.isnan(F.col(age).cast("double")) & (F.col(age) >= ADULT_AGE)
    value = F.when(F.col(sex) == "M", THRESHOLDS["M"]).when(F.col(sex) == "F", THRESHOLDS["F"])
    return F.when(known, value).otherwise(F.raise_error(F.lit(f"age is missing or under {ADULT_AGE}")).cast("double"))


def score_table(df: DataFrame, truth: str, score: str, by: list[str]) -> DataFrame:
    """(by, score, pos, neg) for each distinct score."""
    return (
        df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*by, F.col(score).cast("double").alias("score"))
        .agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    )


def cuts(scores: DataFrame, by: list[str]) -> DataFrame:
    """(by, cut, tp, fp, n_pos, n_neg): every useful cut. Cuts are midpoints of consecutive scores and
    one beyond either end; tp and fp are what lies below."""
    rows = running_sums(scores, by, "score", ["pos", "neg"]).select(
        *by,
        "score",
        F.coalesce((F.col("score") + F.col("next")) / 2, F.col("score") + 1).alias("cut"),
        F.col("upto_pos").alias("tp"),
        F.col("upto_neg").alias("fp"),
        F.col("all_pos").alias("n_pos"),
        F.col("all_neg").alias("n_neg"),
    )
    inner = rows.select(*by, "cut", "tp", "fp", "n_pos", "n_neg")
    zero = F.lit(0).cast("long")
    ends = scores.groupBy(*by).agg((F.min("score") - 1).alias("cut"), zero.alias("tp"), zero.alias("fp"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    ends = ends.where("cut is not null")
    return inner.unionByName(ends).withColumns({"sensitivity": F.try_divide("tp", "n_pos"), "specificity": 1 - F.try_divide("fp", "n_neg")})


def cut_for_sensitivity(options: DataFrame, target: float | str, by: list[str]) -> DataFrame:
    """The cut of highest specificity whose sensitivity reaches the target, the lowest cut among ties; else
    the most sensitive one with ``reached`` false. ``target`` is a number or a column."""
    want = F.lit(target) if isinstance(target, float) else F.col(target)
    reached = F.coalesce(F.col("sensitivity") >= want, F.lit(False))
    rank = F.struct(reached.alias("r"), F.when(reached, F.col("specificity")).otherwise(F.col("sensitivity")).alias("a"), (-F.col("cut")).alias("c"))
    best = options.groupBy(*by).agg(F.max_by(F.struct("cut", "sensitivity", "specificity", reached.alias("reached")), rank).alias("b"))
    return best.select(*by, "b.cut", "b.sensitivity", "b.specificity", "b.reached")


def cut_for_specificity(options: DataFrame, target: float | str, by: list[str]) -> DataFrame:
    """The most sensitive cut whose specificity reaches the target; else the one nearest to it."""
    want = F.lit(target) if isinstance(target, float) else F.col(target)
    reached = F.coalesce(F.col("specificity") >= want, F.lit(False))
    rank = F.struct(reached.alias("r"), F.when(reached, F.col("sensitivity")).otherwise(F.col("specificity")).alias("a"), (-F.col("cut")).alias("c"))
    best = options.groupBy(*by).agg(F.max_by(F.struct("cut", "sensitivity", "specificity", reached.alias("reached")), rank).alias("b"))
    return best.select(*by, "b.cut", "b.sensitivity", "b.specificity", "b.reached")


def training_score_tables(df: DataFrame, truth: str, score: str, fold: str) -> DataFrame:
    """(fold, score, pos, neg) over all other folds, from the folds' own tables."""
    own = score_table(df, truth, score, [fold])
    folds = own.select(F.col(fold).alias("held")).distinct()
    other = own.join(F.broadcast(folds), F.col(fold) != F.col("held"))  # one row a fold
    return other.groupBy(F.col("held").alias(fold), "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def nested_calls(df: DataFrame, truth: str, score: str, fold: str, target: float, kind: str = "sensitivity") -> DataFrame:
    """``df`` with the cut that the other folds choose and the call it makes."""
    choose = {"sensitivity": cut_for_sensitivity, "specificity": cut_for_specificity}[kind]
    chosen = choose(cuts(training_score_tables(df, truth, score, fold), [fold]), target, [fold]).select(fold, "cut")
    return df.join(F.broadcast(chosen), fold).withColumn("called", F.col(score) < F.col("cut"))  # one row a fold


def nested_calls_matched(df: DataFrame, truth: str, score: str, reference: str, fold: str, target: float, match: str) -> DataFrame:
    """Like ``nested_calls``, where a reference score's cut (sensitivity at ``target`` in the training folds) sets the level of
    ``match`` (sensitivity or specificity) that this score's cut must reach."""
    level = cut_for_sensitivity(cuts(training_score_tables(df, truth, reference, fold), [fold]), target, [fold]).select(fold, F.col(match).alias("level"))
    options = cuts(training_score_tables(df, truth, score, fold), [fold]).join(F.broadcast(level), fold)  # one row a fold
    choose = {"sensitivity": cut_for_sensitivity, "specificity": cut_for_specificity}[match]
    chosen = choose(options, "level", [fold]).select(fold, "cut")
    return df.join(F.broadcast(chosen), fold).withColumn("called", F.col(score) < F.col("cut"))


def ranking_metrics(df: DataFrame, truth: str, score: str, by: list[str]) -> DataFrame:
    """(by, n, prevalence, auroc, auprc), low scores meaning positive. AUROC is the Mann-Whitney statistic with ties
    counted half; AUPRC is the sum of precision times the step in recall. Null where a class is missing."""
    rows = running_sums(score_table(df, truth, score, by), by, "score", ["pos", "neg"]).withColumnsRenamed({"upto_pos": "tp", "upto_neg": "fp"})
    above = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    stats = rows.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        above.alias("above"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("steps"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return stats.select(
        *by,
        "n",
        F.try_divide("n_pos", "n").alias("prevalence"),
        F.when(both, F.col("above") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"),
        F.when(both, F.col("steps") / F.col("n_pos")).alias("auprc"),
    )


def roc_points(df: DataFrame, truth: str, score: str, by: list[str]) -> DataFrame:
    """(by, cut, tpr, fpr) at every distinct score, collinear points included."""
    return cuts(score_table(df, truth, score, by), by).select(*by, "cut", F.col("sensitivity").alias("tpr"), (1 - F.col("specificity")).alias("fpr"))


#: Floors and margins of the verdict on usefulness.
SENSITIVITY_FLOOR, SPECIFICITY_FLOOR, MARGIN = 0.90, 0.50, 0.10


def has_margin(gain: float, low: float) -> bool:
    return gain >= MARGIN and low > 0


def verdict(sensitivity: float, specificity: float, margins: list[tuple[float, float]]) -> str:
    """NOT USEFUL below either floor; above both, USEFUL with a margin in either direction and MARGINAL without.

    ``margins`` are (gain, lower end of its interval) pairs."""
    if not (sensitivity >= SENSITIVITY_FLOOR and specificity >= SPECIFICITY_FLOOR):
        return "NOT USEFUL"
    return "USEFUL" if any(has_margin(*m) for m in margins) else "MARGINAL"
