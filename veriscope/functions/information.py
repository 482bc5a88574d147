"""Information that columns hold on a target: correlations with p-values, mutual information, a class probe."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import medians
from . import metrics

NEIGHBOURS = 3
NULL_REPEATS = 5
#: Points of an estimate that one task walks from, and the most tasks that an estimate is dealt to.
SLICE_POINTS = 1 << 14
SLICES = 64


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    total = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_front) * total / a


def correlation_p(r: float | None, n: int) -> float:
    """Two-sided p of a correlation from Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3 or math.isnan(r):
        return 1.0
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


def bh(p: list[float]) -> list[float]:
    """Adjusted p-values of a short list."""
    order = np.argsort(p, kind="stable")
    n = len(p)
    scaled = np.asarray(p)[order] * n / np.arange(1, n + 1)
    out = np.empty(n)
    out[order] = np.minimum(np.minimum.accumulate(scaled[::-1])[::-1], 1)
    return out.tolist()


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    z = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))


def walked(xs: np.ndarray, ys: np.ndarray, k: int, start: int, stop: int) -> np.ndarray:
    """Max-norm distance of the points from ``start`` up to ``stop`` to their k-th nearest other ones; ``xs`` ascends.

    Points walk outwards along x, all at once and one step a side at a time; a point stops when the next ones are farther
    along x than its k-th best so far. With evenly spread points that takes about sqrt(k n) steps, not n."""
    n = len(xs)
    best = np.full((stop - start, k), np.inf)
    live = np.arange(start, stop)
    step = 0
    while len(live):
        step += 1
        going = np.zeros(len(live), bool)
        for side in (-step, step):
            other = live + side
            there = (other >= 0) & (other < n)
            mine, other = live[there], other[there]
            along = np.abs(xs[other] - xs[mine])
            near = along < best[mine - start, -1]
            going[np.nonzero(there)[0][near]] = True
            mine, other, along = mine[near], other[near], along[near]
            found = np.maximum(along, np.abs(ys[other] - ys[mine]))
            better = found < best[mine - start, -1]
            mine = mine[better] - start
            rows = best[mine]
            rows[:, -1] = found[better]
            best[mine] = np.sort(rows, axis=1)
        live = live[going]
    return best[:, -1]


def neighbour_distances(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Max-norm distance of each point to its k-th nearest other one."""
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = walked(x[order], y[order], k, 0, len(x))
    return out


def crowding(x: np.ndarray, y: np.ndarray, k: int, seed: int, part: int = 0, parts: int = 1) -> float:
    """Sum of the digammas of the points that lie along x and along y within reach of each point's k-th neighbour, over one part of
    the points. Ties are broken by noise of a ten-billionth of the spread."""
    rng = np.random.default_rng(seed)
    n = len(x)
    if len(np.unique(x)) < len(np.unique(y)):  # the estimate is symmetric, and along a column of few values no walk would end early
        x, y = y, x
    x, y = (v / (v.std() or 1) for v in (x, y))
    x, y = (v + 1e-10 * np.maximum(1, np.abs(v).mean()) * rng.normal(size=n) for v in (x, y))
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    start, stop = n * part // parts, n * (part + 1) // parts
    radius = walked(x, y, k, start, stop)
    inside = lambda v, s: np.searchsorted(s, v + radius * (1 - 1e-12), "left") - np.searchsorted(s, v - radius * (1 - 1e-12), "right")
    nx, ny = np.maximum(inside(x[start:stop], x), 1), np.maximum(inside(y[start:stop], np.sort(y)), 1)
    return float(np.sum(digamma(nx) + digamma(ny)))


def information_of(crowded: float, n: int, k: int = NEIGHBOURS) -> float:
    """The estimate from the sum of ``crowding`` over all n points, never below 0."""
    return max(0.0, float(digamma(np.array([n]))[0] + digamma(np.array([k]))[0] - crowded / n))


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = NEIGHBOURS, seed: int = 0) -> float:
    """Nearest-neighbour estimate for two continuous columns (max-norm balls), never below 0."""
    return information_of(crowding(x, y, k, seed), len(x), k) if len(x) > k + 1 else 0.0


def information_and_null(whole: DataFrame, n_features: int, seed: int) -> tuple[list[float], list[float]]:
    """Mutual information of y and each x over all rows, and of NULL_REPEATS shuffled y with each; a task walks from SLICE_POINTS of
    an estimate's points, or a SLICES-th of them if these are more.

    Every estimate needs all rows of two columns; the table is broadcast, and refused beyond ``resample.MAX_SUBJECTS`` rows."""
    from ..operators import resample

    names = [f"x{i}" for i in range(n_features)]
    rows = resample.bounded(whole.orderBy("y", *names), ["y", *names], "rows")
    if len(rows) <= NEIGHBOURS + 1:
        return [0.0] * n_features, [0.0] * n_features * NULL_REPEATS
    spark, parts = whole.sparkSession, min(SLICES, -(-len(rows) // SLICE_POINTS))
    shared = spark.sparkContext.broadcast((rows["y"].to_numpy(float), [rows[c].to_numpy(float) for c in names]))

    def estimate(batches):
        y, columns = shared.value
        for pdf in batches:
            out = []
            for i in pdf["id"].tolist():
                i, part = divmod(i, parts)
                turn, feature = divmod(i, n_features)
                moved = y if turn == 0 else np.random.default_rng([seed, turn]).permutation(y)
                out.append(crowding(columns[feature], moved, NEIGHBOURS, seed + turn, part, parts))
            yield pdf.assign(value=out)

    n = n_features * (1 + NULL_REPEATS) * parts
    sums = spark.range(0, n, 1, n).mapInPandas(estimate, "id long, value double").toPandas()  # sorted here: a sort in Spark would sample, and so estimate, twice
    sums = sums.sort_values("id")["value"].to_numpy()
    found = [information_of(s, len(rows)) for s in sums.reshape(-1, parts).sum(axis=1)]
    return found[:n_features], found[n_features:]


def feature_table(df: DataFrame, features: list[str], truth: str, q: float, seed: int = 20_260_911) -> dict:
    """Per feature: Pearson and Spearman with p and adjusted p (all rows), mutual information and its shuffled null's 95th percentile."""
    n = df.count()
    middle = medians(df, features) if features else {}
    whole = df.select(F.col(truth).alias("y"), *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(middle[c] or 0))).alias(f"x{i}") for i, c in enumerate(features)])
    pearson = whole.agg(*[F.corr(f"x{i}", "y").alias(f"r{i}") for i in range(len(features))]).first()
    spearman = []
    for i in range(len(features)):
        ranked = metrics.with_average_ranks(whole.select("y", f"x{i}"), {"y": "ry", f"x{i}": "rx"})
        spearman.append(ranked.agg(F.corr("rx", "ry")).first()[0])
    p = [[correlation_p(r, n) for r in rs] for rs in (pearson, spearman)]
    adjusted = [bh(v) for v in p]
    mi, null = information_and_null(whole, len(features), seed)
    rows = [
        {"feature": c, "pearson": pearson[i] or 0.0, "spearman": spearman[i] or 0.0, "p_pearson": p[0][i], "p_spearman": p[1][i], "q_pearson": adjusted[0][i], "q_spearman": adjusted[1][i], "mi": mi[i]}
        for i, c in enumerate(features)
    ]
    return {"features": rows, "null_p95": float(np.percentile(null, 95))}


def majority(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """(by, n, majority, base_rate): the commonest label, the smallest among ties, and its share; null labels are left out."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_label").alias("label")))
    out = counts.groupBy(*by).agg(F.sum("_n").alias("n"), best.alias("_best"))
    return out.select(*by, "n", F.col("_best.label").alias("majority"), (-F.col("_best.n") / F.col("n")).alias("base_rate"))


def grouped_probe(df: DataFrame, columns: list[str], label: str, fold: str) -> dict:
    """Out-of-fold accuracy of a logistic probe of ``label`` against the majority's share. Folds whose training rows have one class are skipped."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    rows = df.where(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(f"p{i}") for i, c in enumerate(columns)], F.col(label).cast("string").alias("lab"), F.col(fold).alias("f")).na.drop()
    n_classes, n, most = rows.groupBy("lab").count().agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0)), F.max("count")).first()
    if n_classes < 2:
        return {"accuracy": None, "base_rate": 1.0 if n else None, "margin": None, "n_classes": n_classes}
    rows = StringIndexer(inputCol="lab", outputCol="y", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    rows = VectorAssembler(inputCols=[f"p{i}" for i in range(len(columns))], outputCol="x").transform(rows).select("x", "y", "f").cache()
    good = scored = 0
    for k in [r[0] for r in rows.select("f").distinct().orderBy("f").collect()]:
        train, test = rows.where(F.col("f") != k), rows.where(F.col("f") == k)
        size, classes = train.agg(F.count("*"), F.count_distinct("y")).first()
        if classes < 2:
            continue
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / size, maxIter=50).fit(train)
        hit, total = model.transform(test).agg(F.count_if(F.col("prediction") == F.col("y")), F.count("*")).first()
        good, scored = good + hit, scored + total
    rows.unpersist()
    base = most / n
    accuracy = good / scored if scored else None
    return {"accuracy": accuracy, "base_rate": base, "margin": None if accuracy is None else accuracy - base, "n_classes": n_classes}
