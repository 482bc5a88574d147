"""Cross-validated ridge regression over whole-group folds, as distributed sums.

For every held-out fold: missing features take the training median, are standardised by the
training mean and population SD, and the penalty is chosen from ALPHAS by exact leave-one-out error.
Three passes over the rows, each returning sums whose size depends on folds and features only:
Gram matrices; squared leave-one-out errors for all penalties (from one eigendecomposition
a fold); predictions, which stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .quantiles import quantiles

ALPHAS = np.logspace(-3, 3, 25)


def _arrays(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)], axis=1) if p else np.zeros((batch.num_rows, 0))
    return x, batch.column(p).to_numpy(zero_copy_only=False).astype(float), batch.column(p + 1).to_numpy()


def _summed(df: DataFrame, make, shape: tuple[int, ...]) -> np.ndarray:
    """Sums over all batches of the arrays ``make`` gives: a task adds its own, Spark adds the tasks' by place,
    and the driver gets one number for each place, whatever the number of rows and tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += make(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["part"])

    places = df.mapInArrow(run, "part array<double>").select(F.posexplode("part").alias("place", "value"))
    found = places.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return out.reshape(shape)


def _filled(x: np.ndarray, medians: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), medians, x)


def grouped_ridge(df: DataFrame, features: list[str], truth: str, fold: str, out: str = "ridge_pred") -> DataFrame:
    """``df`` with out-of-fold predictions. Rows need a truth; with no features the training mean is predicted."""
    p = len(features)
    missing = F.lit(None).cast("double")
    rows = df.select(*[F.nanvl(F.col(f).cast("double"), missing).alias(f"_x{j}") for j, f in enumerate(features)], F.col(truth).cast("double").alias("_y"), F.col(fold).cast("long").alias("_fold"))
    rows = cut(rows.where(F.col("_y").isNotNull()), "ridge")  # several passes follow
    folds = [r[0] for r in rows.select("_fold").distinct().orderBy("_fold").collect()]
    medians = np.zeros((len(folds), p))
    holes = rows.agg(*[F.count_if(F.col(f"_x{j}").isNull()) for j in range(p)]).first() if p else []
    partly = [j for j, n in enumerate(holes) if n]  # exact medians take rounds, and only columns with holes need them
    if partly:
        # a row counts for every fold but its own
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(F.col("_fold") != k, F.col(f"_x{j}")).alias("v")) for i, k in enumerate(folds) for j in partly])
        for cell in quantiles(rows.select(F.explode(cells).alias("c")).select("c.*"), ["i", "j"], "v", [0.5], "m").collect():  # folds x columns
            medians[cell["i"], cell["j"]] = cell["m"][0] or 0.0

    def gram(batch: pa.RecordBatch) -> np.ndarray:
        x, y, at = _arrays(batch, p)
        parts = []
        for i, k in enumerate(folds):
            z = np.column_stack([np.ones(int((at != k).sum())), _filled(x, medians[i])[at != k], y[at != k]])
            parts.append(z.T @ z)
        return np.array(parts)

    grams = _summed(rows, gram, (len(folds), p + 2, p + 2)) if folds else []
    models = []
    for g in grams:
        n = max(g[0, 0], 1.0)
        mean, y_mean = g[0, 1:-1] / n, g[0, -1] / n
        centred = g[1:-1, 1:-1] - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(centred), 0) / n)
        sd = np.where(sd > 1e-12, sd, 1.0)
        values, vectors = np.linalg.eigh(centred / np.outer(sd, sd)) if p else (np.zeros(0), np.zeros((0, 0)))
        slope = vectors.T @ ((g[1:-1, -1] - n * mean * y_mean) / sd)
        models.append((n, mean, sd, y_mean, np.maximum(values, 0), vectors, slope))

    def errors(batch: pa.RecordBatch) -> np.ndarray:
        x, y, at = _arrays(batch, p)
        total = np.zeros((len(folds), len(ALPHAS)))
        for i, k in enumerate(folds):
            n, mean, sd, y_mean, values, vectors, slope = models[i]
            u = ((_filled(x, medians[i])[at != k] - mean) / sd) @ vectors
            shrink = 1 / (values[:, None] + ALPHAS[None, :])
            residual = y[at != k][:, None] - y_mean - (u * slope) @ shrink
            total[i] = np.sum((residual / np.maximum(1 - 1 / n - (u * u) @ shrink, 1e-12)) ** 2, axis=0)
        return total

    losses = _summed(rows, errors, (len(folds), len(ALPHAS))) if p and folds else None
    alphas = [float(ALPHAS[int(row.argmin())]) for row in losses] if losses is not None else [1.0] * len(folds)
    weights = {}
    for k, (n, mean, sd, y_mean, values, vectors, slope), a in zip(folds, models, alphas):
        beta = (vectors @ (slope / (values + a))) / sd
        weights[k] = (float(y_mean - mean @ beta), beta.tolist())
    at = {k: i for i, k in enumerate(folds)}
    guess = F.lit(None).cast("double")
    for k, (intercept, beta) in weights.items():
        value = F.lit(intercept)
        for j, f in enumerate(features):
            column = F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
            value = value + F.coalesce(column, F.lit(float(medians[at[k]][j]))) * F.lit(beta[j])
        guess = F.when(F.col(fold) == k, value).otherwise(guess)
    return df.withColumn(out, guess)


def transfer_ridge(train: DataFrame, test: DataFrame, features: list[str], truth: str, alpha: float, out: str = "ridge_pred") -> DataFrame:
    """``test`` with predictions of a ridge at ``alpha`` on ``train``: features standardised and missing ones filled by the training means."""
    value = {f: F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features}
    known = train.where(F.col(truth).isNotNull())
    means = known.agg(F.count("*").alias("n"), F.avg(truth).alias("y"), *[F.avg(value[f]).alias(f"m{j}") for j, f in enumerate(features)]).first()
    filled = [F.coalesce(value[f], F.lit(float(means[f"m{j}"] or 0.0))) - float(means[f"m{j}"] or 0.0) for j, f in enumerate(features)]
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    sums = known.agg(*[F.sum(filled[i] * filled[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(filled[j] * F.col(truth)).alias(f"c{j}") for j in range(len(features))]).first()
    gram = np.zeros((len(features), len(features)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"g{i}_{j}"] or 0.0
    sd = np.sqrt(np.diag(gram) / max(means["n"], 1))
    sd = np.where(sd > 1e-12, sd, 1.0)
    against = np.array([sums[f"c{j}"] or 0.0 for j in range(len(features))]) / sd
    beta = np.linalg.solve(gram / np.outer(sd, sd) + alpha * np.eye(len(features)), against) / sd if features else np.zeros(0)
    guess = F.lit(None if means["y"] is None else float(means["y"])).cast("double")
    for b, centred in zip(beta.tolist(), filled):
        guess = guess + b * centred
    return test.withColumn(out, guess)
