"""Tissue reflectance, inversion by lookup, and variance-based sensitivity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def diffuse_reflectance(absorption: Column, scattering: Column, index: float = 1.4) -> Column:
    """Total diffuse reflectance of a half-space by the diffusion approximation, from absorption and reduced scattering."""
    inner = -1.440 / index**2 + 0.710 / index + 0.668 + 0.0636 * index
    k = (1 + inner) / (1 - inner)
    floor = F.lit(1e-9)
    a, s = F.greatest(absorption, floor), F.greatest(scattering, floor)
    albedo = s / (s + a)
    lost = 1 - albedo
    return albedo / (1 + 2 * k * lost + (1 + 2 * k / 3) * F.sqrt(3 * lost))


def nearest_on_table(obs: DataFrame, lut: DataFrame, columns: list[str], value: str) -> DataFrame:
    """``obs`` with the ``value`` of the nearest row of a lookup table, refined by a parabola through its neighbours.

    The table, of at most 10,000 rows, goes to every task; each batch of rows is searched as arrays (``mapInPandas``)."""
    rows = lut.orderBy(value).select(value, *columns).limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("the lookup table has more than 10,000 rows")
    grid = np.array([r[0] for r in rows], float)
    table = np.array([[r[c] for c in columns] for r in rows], float)

    def run(batches):
        for pdf in batches:
            x = pdf[columns].to_numpy(float)
            out = np.empty(len(x))
            for at in range(0, len(x), 4096):
                d = ((x[at : at + 4096, None, :] - table[None]) ** 2).sum(axis=2)
                best = d.argmin(axis=1)
                inner = np.clip(best, 1, len(grid) - 2)
                r = np.arange(len(best))
                left, mid, right = d[r, inner - 1], d[r, inner], d[r, inner + 1]
                bend = left - 2 * mid + right
                move = np.where((bend > 0) & (inner == best), 0.5 * (left - right) / np.where(bend > 0, bend, 1), 0)
                out[at : at + 4096] = grid[best] + np.clip(move, -0.5, 0.5) * (grid[1] - grid[0])
            yield pdf.assign(found=out)

    return obs.mapInPandas(run, obs.select("*", F.lit(0.0).alias("found")).schema)


def radical_inverse(i: np.ndarray, base: int) -> np.ndarray:
    out, scale, i = np.zeros(len(i)), 1.0, i.copy()
    while (i > 0).any():
        scale /= base
        out += scale * (i % base)
        i //= base
    return out


def _primes(n: int) -> list[int]:
    found, k = [], 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def unit_design(i: np.ndarray, d: int, seed: int) -> np.ndarray:
    """Points of a randomly shifted low-discrepancy sequence (radical inverses in the first primes): a point depends on its number alone."""
    shift = np.random.default_rng(seed).random(d)
    return np.stack([(radical_inverse(i + 1, p) + s) % 1.0 for p, s in zip(_primes(d), shift)], axis=1)


def evaluate_design(spark: SparkSession, f: Callable[[np.ndarray], np.ndarray], d: int, n: int, seed: int = 7) -> DataFrame:
    """(i, a, b, ab_0 .. ab_{d-1}): a vectorised f over the points of A, B and A with one column from B."""
    names = [f"ab_{k}" for k in range(d)]

    def run(batches):
        for pdf in batches:
            u = unit_design(pdf["id"].to_numpy(), 2 * d, seed)
            a, b = u[:, :d], u[:, d:]
            mixed = {}
            for k, name in enumerate(names):
                x = a.copy()
                x[:, k] = b[:, k]
                mixed[name] = f(x)
            yield pd.DataFrame({"i": pdf["id"], "a": f(a), "b": f(b), **mixed})

    return spark.range(n).mapInPandas(run, "i long, a double, b double, " + ", ".join(f"{x} double" for x in names))


def sensitivity(design: DataFrame, d: int) -> DataFrame:
    """(parameter, first_order, total): Saltelli's and Jansen's estimators as one aggregate."""
    both = F.explode(F.array("a", "b"))
    variance = design.select(both.alias("v")).agg(F.var_samp("v").alias("variance"))
    cells = [F.avg(F.col("b") * (F.col(f"ab_{k}") - F.col("a"))).alias(f"s_{k}") for k in range(d)]
    cells += [F.avg((F.col("a") - F.col(f"ab_{k}")) * (F.col("a") - F.col(f"ab_{k}")) / 2).alias(f"t_{k}") for k in range(d)]
    row = design.agg(*cells).crossJoin(variance)  # one row each
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("parameter"), (F.col(f"s_{k}") / F.col("variance")).alias("first_order"), (F.col(f"t_{k}") / F.col("variance")).alias("total")) for k in range(d)]))
    return row.select(parts.alias("p")).select("p.*")


def summary(value: str, low: float = 1.0, high: float = 2.0) -> list[Column]:
    """Aggregates of a distribution of errors against two bands."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
    return [
        F.count(v).alias("n"), F.median(v).alias("median"), F.avg(v).alias("mean"), q[0].alias("lo"), q[1].alias("hi"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg((v > high).cast("double")).alias("share_above"), F.avg((v < low).cast("double")).alias("share_below"),
        ((q[0] > high) | (q[1] < high)).alias("robust_at_high"), ((q[0] > low) | (q[1] < low)).alias("robust_at_low"),
    ]


def band(error: Column, low: float = 1.0, high: float = 2.0) -> Column:
    return F.when(error < low, "VIABLE").when(error <= high, "MARGINAL").otherwise("NOT RECOVERABLE")


def one_at_a_time(f: Callable[[dict], float], ranges: dict[str, tuple[float, float]], nominal: dict[str, float], points: int = 9) -> dict[str, float]:
    """Swing of f as each parameter alone crosses its range."""
    out = {}
    for name, (lo, hi) in ranges.items():
        values = [f({**nominal, name: float(v)}) for v in np.linspace(lo, hi, points)]
        out[name] = max(values) - min(values)
    return out


def layered_reflectance(layers: list[dict[str, np.ndarray | float]], deeper: float = 0.6, index: float = 1.4) -> np.ndarray:
    """Reflectance of stacked layers (absorption, scattering, thickness): each layer's own diffuse reflectance, weighed by
    what passes the layers above twice; layers below the first count ``deeper``."""
    inner = -1.440 / index**2 + 0.710 / index + 0.668 + 0.0636 * index
    k = (1 + inner) / (1 - inner)
    total, passed = 0.0, 1.0
    for depth, layer in enumerate(layers):
        a, s = np.maximum(layer["absorption"], 1e-9), np.maximum(layer["scattering"], 1e-9)
        w = s / (s + a)
        own = w / (1 + 2 * k * (1 - w) + (1 + 2 * k / 3) * np.sqrt(3 * (1 - w)))
        total = total + passed * own * (1.0 if depth == 0 else deeper)
        passed = passed * np.exp(-2 * a * layer["thickness"])
    return np.asarray(total)


def blackbody(wavelengths: np.ndarray, kelvin: float) -> np.ndarray:
    """Relative spectral power of a thermal light, 1 at 560 nm."""
    power = lambda nm: nm**-5.0 / np.expm1(1.4387769e7 / (nm * kelvin))
    return power(np.asarray(wavelengths, float)) / power(560.0)


def spectrum_to_rgb(wavelengths: np.ndarray, reflectance: np.ndarray, light: np.ndarray, curves: np.ndarray) -> np.ndarray:
    """Responses (rows of ``curves``) to reflected light by the trapezoid rule, against those to the light alone."""
    seen = np.trapezoid(reflectance * light * curves, wavelengths, axis=1)
    return seen / np.trapezoid(light * curves, wavelengths, axis=1)


def interpolated(table: np.ndarray, wavelengths: np.ndarray, outside: float | None = None) -> np.ndarray:
    """Column 1 of a table along column 0 by straight lines; beyond its ends the end values, or ``outside``."""
    return np.interp(wavelengths, table[:, 0], table[:, 1], left=outside, right=outside)


def perturbation(rng: np.random.Generator, target: float, difference: Callable[[np.ndarray], float], tolerance: float = 0.05, most: int = 60) -> np.ndarray:
    """Channel gains in a random direction whose colour difference is ``target``: the scale is bracketed, then bisected."""
    direction = rng.normal(size=3)
    direction = direction - direction.mean()
    direction /= np.linalg.norm(direction)
    gains = lambda s: np.exp(s * direction)
    low, high = 0.0, 0.01
    while difference(gains(high)) < target and high < 10:
        low, high = high, 2 * high
    for _ in range(most):
        middle = (low + high) / 2
        found = difference(gains(middle))
        if abs(found - target) <= tolerance:
            return gains(middle)
        low, high = (middle, high) if found < target else (low, middle)
    return gains((low + high) / 2)


def inversion_errors(grid: np.ndarray, chroma: np.ndarray, truth: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """|found - true| of each true value under each perturbation: the perturbed chromaticity's nearest entry of the table."""
    at = np.abs(grid[None] - truth[:, None]).argmin(axis=1)
    seen = chroma[at][:, None, :] * gains[None]
    seen = seen / seen.sum(axis=2, keepdims=True)
    distance = ((seen[:, :, None, :] - chroma[None, None]) ** 2).sum(axis=3)
    return np.abs(grid[distance.argmin(axis=2)] - truth[:, None])
