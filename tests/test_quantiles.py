"""Exact quantiles against numpy, with brackets forced to be small."""

import random

import numpy as np
import pytest

from veriscope.operators.quantiles import medians, quantiles

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def groups():
    rng = random.Random(5)
    data = {
        "spread": [rng.gauss(0, 1) * 10 ** rng.randrange(-5, 9) for _ in range(3001)],
        "ties": [float(rng.randrange(3)) for _ in range(2000)],
        "same": [7.5] * 500,
        "half": [0.0] * 700 + [1.0] * 700,
        "one": [-3.25],
        "two": [1.0, 2.0],
        "ends": [float("inf"), float("-inf"), 1.0, 5.0],
        None: [float(k) for k in range(100)],
        "none": [None, float("nan")],
    }
    return data, [(g, v) for g, vs in data.items() for v in vs]


@pytest.mark.parametrize("small,grid", [(40, 20), (100_000, 1000)])
def test_quantiles_match_numpy(spark, small, grid):
    data, rows = groups()
    random.Random(6).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["quantiles"] for r in quantiles(df, ["g"], "v", LEVELS, small=small, grid=grid).collect()}
    assert set(got) == set(data) and got["none"] == [None] * len(LEVELS)
    for g, vs in data.items():
        if g not in ("none", "ends"):
            assert got[g] == pytest.approx(np.quantile(vs, LEVELS).tolist(), rel=1e-12, abs=1e-12)
    assert got["ends"][0] == float("-inf") and got["ends"][3] == 3.0 and got["ends"][5] == float("inf")


def test_medians_of_columns(spark):
    df = spark.createDataFrame([(1.0, None, float(k), None) for k in range(11)] + [(3.0, 2.0, None, None)], "a double, `b c` double, c double, d double")
    assert medians(df, ["a", "b c", "c", "d"]) == {"a": 1.0, "b c": 2.0, "c": 5.0, "d": None}
    assert medians(df.limit(0), ["a"]) == {"a": None}
    assert quantiles(df.limit(0), [], "a", [0.5]).collect()[0][0] == [None]
