"""Colour, reflectance, signal and sensitivity operators over the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import colour, signals, simulation
from ..session import table
from .catalog import query

_BYTE = "(('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), {at}, 2))::BIGINT / 255.0::DOUBLE)"
_LIN = "CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"


def _bent(i: int) -> str:
    m, w = colour.TO_XYZ[i], colour.WHITE[i]
    return f"(r * {m[0]}::DOUBLE + g * {m[1]}::DOUBLE + b * {m[2]}::DOUBLE) / {w}::DOUBLE"


@query(f"""
WITH c AS (SELECT p_partkey, {_BYTE.format(at=1)} AS sr, {_BYTE.format(at=3)} AS sg, {_BYTE.format(at=5)} AS sb FROM part),
l AS (SELECT p_partkey, {_LIN.format(c='sr')} AS r, {_LIN.format(c='sg')} AS g, {_LIN.format(c='sb')} AS b FROM c),
x AS (SELECT p_partkey, {_bent(0)} AS x, {_bent(1)} AS y, {_bent(2)} AS z FROM l),
f AS (SELECT p_partkey, """ + ", ".join(f"CASE WHEN {v} > pow(6 / 29.0::DOUBLE, 3) THEN cbrt({v}) ELSE {v} * (841 / 108.0::DOUBLE) + 4 / 29.0::DOUBLE END AS {v}" for v in "xyz") + """ FROM x)
SELECT p_partkey, round(116 * y - 16, 4) AS L, round(500 * (x - y), 4) AS a, round(200 * (y - z), 4) AS b FROM f
""")
def colour_lab(spark, sf_dir):
    """sRGB bytes to linear light to Lab."""
    code = F.md5(F.col("p_partkey").cast("string"))
    byte = lambda at: F.conv(F.substring(code, at, 2), 16, 10).cast("long") / 255.0
    found = colour.lab(*[colour.to_linear(byte(at)) for at in (1, 3, 5)])
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 4).alias(n) for n, c in found.items()])


@query("""
WITH k AS (SELECT -1.440 / (1.4::DOUBLE * 1.4) + 0.710 / 1.4::DOUBLE + 0.668 + 0.0636 * 1.4::DOUBLE AS i),
m AS (SELECT (1 + i) / (1 - i) AS k FROM k),
p AS (SELECT p_partkey, greatest(p_size / 10.0::DOUBLE, 1e-9) AS a, greatest(p_retailprice / 100, 1e-9) AS s FROM part),
q AS (SELECT p_partkey, s / (s + a) AS w FROM p)
SELECT p_partkey, round(w / (1 + 2 * k * (1 - w) + (1 + 2 * k / 3) * sqrt(3 * (1 - w))), 6) AS reflectance FROM q, m
""")
def diffuse_reflectance(spark, sf_dir):
    found = simulation.diffuse_reflectance(F.col("p_size") / 10.0, F.col("p_retailprice") / 100)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(found, 6).alias("reflectance"))


@query()
def signal_features(spark, sf_dir):
    """Pulse features of the values of ten users at a time, read as a signal at 20 Hz; signals are as many as the data has users."""
    subject = F.floor(F.col("user_id") / 10).alias("subject")
    rows = table(spark, sf_dir, "events").where("value is not null and user_id is not null").select(subject, F.lit("value").alias("channel"), "event_id", "value")
    out = signals.per_channel(rows, "subject", "channel", "event_id", "value", rate=20.0)
    return out.select("subject", "channel", *[F.round(c, 4).alias(c) for c in signals.FEATURES])


@query()
def illuminant_estimates(spark, sf_dir):
    """Four illuminant estimates of each vector read as a small square image (filled up from its start), as angles from grey."""
    import pandas as pd

    names = ("grey_world", "max_rgb", "shades_of_grey", "grey_edge")

    def run(batches):
        for pdf in batches:
            angles = np.empty((len(pdf), len(names)))
            for k, v in enumerate(pdf["embedding"]):
                side = max(2, int(np.ceil(np.sqrt(len(v) / 3))))
                image = np.abs(np.resize(np.asarray(v, float), (side, side, 3)))
                angles[k] = [(colour_of / np.linalg.norm(colour_of)).sum() for colour_of in (getattr(colour, n)(image) for n in names)]
            angles = np.round(np.degrees(np.arccos(np.clip(angles / np.sqrt(3), -1, 1))), 4)
            yield pd.DataFrame({"vec_id": pdf["vec_id"].to_numpy(), **{n: angles[:, k] for k, n in enumerate(names)}})

    rows = table(spark, sf_dir, "embeddings").where("size(embedding) > 0").select("vec_id", "embedding")
    return rows.mapInPandas(run, "vec_id long, " + ", ".join(f"{n} double" for n in names))


@query()
def sobol_indices(spark, sf_dir):
    """Sensitivity indices of a function whose indices are known in closed form."""

    def ishigami(u):
        x = (2 * u - 1) * np.pi
        return np.sin(x[:, 0]) + 7 * np.sin(x[:, 1]) ** 2 + 0.1 * x[:, 2] ** 4 * np.sin(x[:, 0])

    out = simulation.sensitivity(simulation.evaluate_design(spark, ishigami, 3, 4096), 3)
    return out.select("parameter", F.round("first_order", 4).alias("first_order"), F.round("total", 4).alias("total"))
