"""Every query with a SQL twin gives the same rows as DuckDB."""

import math
import os

import duckdb
import numpy as np
import pytest

from veriscope.functions import signals
from veriscope.plans.catalog import submission
from veriscope.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(ORACLE_SQL[name])
    assert columns == sorted(rel.columns)
    ours = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(norm(r[rel.columns.index(c)]) for c in columns) for r in rel.fetchall())
    assert ours == theirs


def pandas(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def test_sobol_indices_of_a_known_function(spark):
    """Ishigami's function with 7 and 0.1: the indices are known in closed form."""
    got = pandas(spark, "sobol_indices").sort_values("parameter")
    assert got["first_order"].tolist() == pytest.approx([0.3139, 0.4424, 0.0], abs=0.03)
    assert got["total"].tolist() == pytest.approx([0.5576, 0.4424, 0.2437], abs=0.03)


def test_ridge_errors_by_fold(spark):
    """Fold by fold with numpy: standardise, choose the penalty by leave-one-out, predict."""
    s = submission(spark, SF).toPandas()
    x = np.column_stack([s["quantity"], s["sex"] == "A", s["sex"] == "N"]).astype(float)
    y = s["y_true"].to_numpy(float)
    got = pandas(spark, "grouped_ridge_cv").set_index("fold")
    for k in sorted(s["fold"].unique()):
        tr = (s["fold"] != k).to_numpy()
        mean, sd = x[tr].mean(axis=0), x[tr].std(axis=0)
        z, centre = (x - mean) / sd, y[tr].mean()
        best = None
        for alpha in np.logspace(-3, 3, 25):
            inverse = np.linalg.inv(z[tr].T @ z[tr] + alpha * np.eye(3))
            beta = inverse @ z[tr].T @ (y[tr] - centre)
            lever = np.einsum("ij,jk,ik->i", z[tr], inverse, z[tr]) + 1 / tr.sum()
            loss = np.sum(((y[tr] - centre - z[tr] @ beta) / (1 - lever)) ** 2)
            best = min(best or (np.inf,), (loss, beta.tolist()))
        error = np.abs(z[~tr] @ best[1] + centre - y[~tr])
        assert got.loc[k, "n"] == (~tr).sum() and got.loc[k, "mae"] == pytest.approx(error.mean(), abs=0.02)


def test_boosted_errors_by_fold(spark):
    """Fold by fold with a booster that grows its trees row by row."""
    from test_boosting import plain

    from veriscope.operators.boosting import BINS, bin_edges
    from veriscope.plans.model_queries import _TREES

    df = submission(spark, SF)
    s = df.toPandas()
    x = np.column_stack([s["quantity"], s["sex"] == "A", s["sex"] == "N"]).astype(float)
    y, fold = s["y_true"].to_numpy(float), s["fold"].to_numpy()
    edges = bin_edges(spark.createDataFrame(x.tolist(), "a double, b double, c double"), ["a", "b", "c"], BINS)
    got = pandas(spark, "boosted_trees_cv").set_index("fold")
    for k in np.unique(fold):
        test = np.nonzero(fold == k)[0]
        want = plain(x, y, edges, np.nonzero(fold != k)[0], test, _TREES, 2, 0.3)
        assert got.loc[k, "n"] == len(test) and got.loc[k, "mae"] == pytest.approx(np.abs(want - y[test]).mean(), abs=0.02)


def test_illuminants_of_vectors(spark, duck):
    got = pandas(spark, "illuminant_estimates").set_index("vec_id")
    rows = duck.sql("select vec_id, embedding from embeddings").fetchall()
    assert len(got) == len(rows)
    for i, v in rows:
        image = np.abs(np.resize(np.array(v, float), (5, 5, 3))).reshape(-1, 3)
        for name, e in (("grey_world", image.mean(axis=0)), ("max_rgb", np.percentile(image, 99, axis=0)), ("shades_of_grey", np.mean(image**6, axis=0) ** (1 / 6))):
            angle = np.degrees(np.arccos(min(1.0, e.sum() / np.sqrt(3) / np.sqrt(e @ e))))
            assert got.loc[i, name] == pytest.approx(angle, abs=2e-4)


def test_signals_of_users(spark, duck):
    """Every group of ten users long enough gives a row, of its own samples in order."""
    got = pandas(spark, "signal_features").set_index("subject")
    rows = duck.sql("select user_id // 10 as s, list(value order by event_id) as x from events where value is not null and user_id is not null group by 1").fetchall()
    assert set(got.index) == {str(s) for s, x in rows if len(x) >= 100}
    for s, x in rows:
        if len(x) >= 100:
            found = signals.channel_features(np.array(x), 20.0)
            assert got.loc[str(s), "dc"] == pytest.approx(found["dc"], abs=1e-3) and got.loc[str(s), "n_beats"] == found["n_beats"]
            assert abs(found["dc"] - np.mean(x)) < 3 * np.std(x) and 30 <= found["heart_rate_bpm"] <= 480


def test_audit_gives_every_check_a_verdict(spark):
    got = pandas(spark, "audit_report").set_index("check_id")
    assert len(got) == 8 and set(got["verdict"]) <= {"PASS", "FAIL", "INSUFFICIENT_DATA"}
    assert (got["headline"].str.len() > 10).all() and not got["headline"].str.contains("check failed").any()


def test_every_query_without_sql_is_named_here():
    assert set(QUERIES) - set(ORACLE_SQL) == {"sobol_indices", "grouped_ridge_cv", "boosted_trees_cv", "illuminant_estimates", "signal_features", "audit_report"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
