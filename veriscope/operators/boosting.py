"""Gradient-boosted regression trees over whole-group folds, from histograms of residuals.

A check for structure that a linear model misses. Features are cut into bins at exact quantiles of all rows (the truth plays no part in that), so a row is a few small
numbers. Rows of a fold with equal bins have equal predictions, so a histogram needs their number and the sum of their truths alone: one pass adds those up, and what is written
once is a row for each fold and combination of bins, as many as the rows only where no two agree. A tree grows level by level: one pass adds up, for each fold's model, node, feature and bin, the residuals and the rows; Spark adds
the tasks' tables, whose size depends on folds, nodes, features and bins only, and the driver picks the best splits of all folds at once. A pass works out
residuals from the trees so far, so no column of predictions is kept between passes, and a lost executor costs its part of a pass.

Every fold's model is trained on the other folds' rows; a row is predicted by its own fold's model.

Defined cases: a missing or NaN feature is a bin of its own, below all others; infinities are values; rows without a truth are predicted but not
trained on; a fold whose model has no rows to train on predicts null; ties between splits go to the first feature and the lowest bin; a node that no split improves
stays as it is. With no features the training mean is predicted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import cut
from .quantiles import quantiles
from .ridge import _summed

TREES, DEPTH, BINS, RATE = 30, 2, 16, 0.1
#: A split leaves at least this many rows on either side.
LEAST = 5


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """For each feature the ascending distinct inner quantiles that separate its bins."""
    if not features:
        return []
    pairs = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"`{f}`").cast("double").alias("v")) for j, f in enumerate(features)])
    found = quantiles(df.select(F.explode(pairs).alias("c")).select("c.*"), ["j"], "v", [k / bins for k in range(1, bins)], "q").collect()  # a row a feature
    edges = {r["j"]: sorted({v for v in r["q"] if v is not None}) for r in found}
    return [np.array(edges.get(j, []), float) for j in range(len(features))]


def binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """0 for a missing value, else 1 + the number of edges below it."""
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(edges, values, side="left")).astype(np.int8)


class Tree:
    """A full binary tree: a split (feature, last bin that goes left) for each inner node, a value for each leaf."""

    def __init__(self, depth: int):
        self.feature, self.last, self.value = np.full(2**depth - 1, -1), np.zeros(2**depth - 1, np.int64), np.zeros(2**depth)

    def place(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of the level after ``levels`` splits that each row reaches; a node without a split sends its rows left."""
        node = np.zeros(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[node]
            right = (f >= 0) & (bins[np.arange(len(bins)), f] > self.last[node])
            node = 2 * node + 1 + right
        return node - (2**levels - 1)

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.place(bins, int(np.log2(len(self.value))))]


def best_split(table: np.ndarray, least: int = LEAST) -> tuple[int, int, np.ndarray]:
    """(feature, last bin that goes left, ((sum, rows) left, (sum, rows) right)) of a node's table features x bins x (sum, rows); feature -1 if none improves it."""
    whole = table[0].sum(axis=0) if len(table) else np.zeros(2)
    left = np.cumsum(table, axis=1)[:, :-1]
    right = whole - left
    fits = (left[..., 1] >= least) & (right[..., 1] >= least)
    gain = np.where(fits, left[..., 0] ** 2 / np.maximum(left[..., 1], 1) + right[..., 0] ** 2 / np.maximum(right[..., 1], 1), -np.inf)
    if not gain.size or gain.max() <= whole[0] ** 2 / max(whole[1], 1) * (1 + 1e-9) + 1e-12:
        return -1, 0, np.array([whole, [0.0, 0.0]])
    j, b = np.unravel_index(int(np.argmax(gain > gain.max() * (1 - 1e-12))), gain.shape)
    return int(j), int(b), np.array([left[j, b], right[j, b]])


def boosted_trees(df: DataFrame, features: list[str], truth: str, fold: str, out: str = "boost_pred", trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> DataFrame:
    """``df`` with out-of-fold predictions."""
    edges = bin_edges(df, features, bins)
    p, size = len(features), bins + 1
    sources = df.select(*[F.col(f"`{f}`").cast("double").alias(f"x{j}") for j, f in enumerate(features)], F.col(truth).cast("double").alias("y"), F.col(fold).cast("long").alias("fold"))
    sources = sources.where("y is not null and not isnan(y) and fold is not null")

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [pa.array(binned(batch.column(j).to_numpy(zero_copy_only=False).astype(float), edges[j])) for j in range(p)]
            yield pa.RecordBatch.from_arrays([*x, batch.column(p), batch.column(p + 1)], batch.schema.names)

    each = sources.mapInArrow(to_bins, ", ".join([*(f"x{j} tinyint" for j in range(p)), "y double", "fold long"]))
    rows = cut(each.groupBy(*(f"x{j}" for j in range(p)), "fold").agg(F.sum("y").alias("y"), F.count("*").alias("n")).select(*(f"x{j}" for j in range(p)), "y", "fold", "n"), "boost-bins")
    # folds that only rows without a truth are in have a model too
    folds = [r[0] for r in df.where(F.col(fold).isNotNull()).select(F.col(fold).cast("long").alias("k")).distinct().orderBy("k").collect()]
    sums = {r["fold"]: (r["y"], r["n"]) for r in rows.groupBy("fold").agg(F.sum("y").alias("y"), F.sum("n").alias("n")).collect()}
    y_all, n_all = (sum(v[k] for v in sums.values()) for k in (0, 1))
    counts = {k: n_all - sums.get(k, (0, 0))[1] for k in folds}
    base = {k: (y_all - sums.get(k, (0.0, 0))[0]) / counts[k] if counts[k] else np.nan for k in folds}
    models: dict[int, list[Tree]] = {k: [] for k in folds}
    growing: dict[int, Tree] = {}

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = np.stack([batch.column(j).to_numpy() for j in range(p)], axis=1)
        return x, *(batch.column(p + k).to_numpy() for k in range(3))

    for _ in range(trees if p and rows.head(1) else 0):
        growing = {k: Tree(depth) for k in folds}
        for level in range(depth):

            def tables(batch: pa.RecordBatch, level: int = level) -> np.ndarray:
                x, y, at, n = read(batch)
                total = np.zeros((len(folds), 2**level, p, size, 2))
                for i, k in enumerate(folds):
                    mine = at != k
                    here = x[mine]
                    rest = y[mine] - n[mine] * (base[k] + rate * sum((t.values(here) for t in models[k]), np.zeros(len(here))))
                    node = growing[k].place(here, level)
                    for j in range(p):
                        cell = node * size + here[:, j]
                        for m, weight in enumerate((rest, n[mine])):
                            total[i, :, j, :, m] = np.bincount(cell, weight, 2**level * size).reshape(2**level, size)
                return total

            found = _summed(rows, tables, (len(folds), 2**level, p, size, 2))
            for i, k in enumerate(folds):
                for node in range(2**level):
                    feature, last, sides = best_split(found[i, node])
                    at = 2**level - 1 + node
                    growing[k].feature[at], growing[k].last[at] = feature, last
                    if level == depth - 1:
                        growing[k].value[2 * node : 2 * node + 2] = sides[:, 0] / np.maximum(sides[:, 1], 1)
        for k in folds:
            models[k].append(growing[k])

    @F.pandas_udf(DoubleType())
    def predict(at: pd.Series, *columns: pd.Series) -> pd.Series:
        x = np.stack([binned(c.to_numpy(float), e) for c, e in zip(columns, edges)], axis=1) if columns else np.zeros((len(at), 0), np.int8)
        own, value = at.to_numpy(float), np.full(len(at), np.nan)
        for k in folds:
            mine = own == k
            value[mine] = base[k] + rate * sum((t.values(x[mine]) for t in models[k]), np.zeros(int(mine.sum())))
        return pd.Series(value)

    value = predict(F.col(fold).cast("long"), *[F.col(f"`{f}`").cast("double") for f in features])
    return df.withColumn(out, F.nanvl(value, F.lit(None).cast("double")))
