"""Boosted trees against a plain numpy booster, fold by fold."""

import numpy as np
import pytest

from veriscope.operators.boosting import bin_edges, boosted_trees


def plain(x, y, edges, train, test, trees, depth, rate, least=5):
    """Grow each tree row by row from the same bin edges."""
    bins = np.stack([np.where(np.isnan(c), 0, 1 + (np.asarray(es)[None, :] < c[:, None]).sum(axis=1)) for c, es in zip(x.T, edges)], axis=1).astype(int)
    pred = np.full(len(y), y[train].mean())
    for _ in range(trees):
        rest = y - pred

        def grow(rows, into, left_depth):
            best = None
            s, n = rest[rows].sum(), len(rows)
            if left_depth:
                for j in range(x.shape[1]):
                    for b in range(len(edges[j]) + 1):
                        left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                        if len(left) >= least and len(right) >= least:
                            gain = rest[left].sum() ** 2 / len(left) + rest[right].sum() ** 2 / len(right)
                            if best is None or gain > best[0] * (1 + 1e-12):
                                best = (gain, j, b, left, right)
            if best is None or best[0] <= s * s / n * (1 + 1e-9) + 1e-12:
                pred[into] += rate * s / n
                return
            _, j, b, left, right = best
            grow(left, into[bins[into, j] <= b], left_depth - 1)
            grow(right, into[bins[into, j] > b], left_depth - 1)

        grow(train, np.arange(len(y)), depth)
    return pred[test]


def test_matches_a_plain_booster(spark):
    rng = np.random.default_rng(8)
    n = 400
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.normal(size=n)])
    x[rng.random(n) < 0.1, 2] = np.nan
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 2) * x[:, 0] + 0.1 * rng.normal(size=n)
    fold = rng.integers(0, 3, n)
    rows = [(int(i), *(None if np.isnan(v) else float(v) for v in x[i]), float(y[i]), int(fold[i])) for i in range(n)]
    df = spark.createDataFrame([*rows, (1000, 0.5, None, float("nan"), None, 1), (1001, 0.1, 1.0, 1.0, 2.0, None)], "id long, a double, `b b` double, c double, y double, fold long").repartition(3)
    features = ["a", "b b", "c"]
    got = {r["id"]: r["boost_pred"] for r in boosted_trees(df, features, "y", "fold", trees=4, depth=2, bins=8, rate=0.3).collect()}
    edges = bin_edges(df, features, 8)
    for k in range(3):
        test = np.nonzero(fold == k)[0]
        want = plain(x, y, edges, np.nonzero(fold != k)[0], test, 4, 2, 0.3)
        assert [got[int(i)] for i in test] == pytest.approx(want.tolist(), abs=1e-9)
    assert got[1000] is not None and got[1001] is None
    assert np.mean([abs(got[i] - y[i]) for i in range(n)]) < 0.7 * np.mean(np.abs(y - y.mean()))


def test_edge_tables(spark):
    schema = "a double, y double, fold long"
    one = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 4.0, 0)], schema)
    assert [r["boost_pred"] for r in boosted_trees(one, ["a"], "y", "fold", trees=2).collect()] == [None, None]
    two = spark.createDataFrame([(1.0, 2.0, 0), (2.0, 4.0, 1)], schema)
    assert sorted(r["boost_pred"] for r in boosted_trees(two, [], "y", "fold").collect()) == [2.0, 4.0]
    assert boosted_trees(one.limit(0), ["a"], "y", "fold", trees=1).count() == 0


def test_passes_read_a_row_for_each_fold_and_combination_of_bins(spark, monkeypatch):
    from veriscope.operators import boosting

    written, cut = [], boosting.cut
    monkeypatch.setattr(boosting, "cut", lambda df, name: written.append(cut(df, name)) or written[-1])
    df = spark.range(5000).selectExpr("double(id % 4) a", "double(id % 3) b", "double(id % 7) y", "id % 2 fold")
    assert boosted_trees(df, ["a", "b"], "y", "fold", trees=2).where("boost_pred is not null").count() == 5000
    assert written[0].count() <= 2 * 4 * 3 and written[0].selectExpr("sum(n)").first()[0] == 5000
