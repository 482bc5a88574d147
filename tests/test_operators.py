"""Operators against brute force in numpy, and their properties."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriscope.functions import colour, information, metrics, power, signals, simulation
from veriscope.operators import resample, ridge, screening, similarity, splits
from veriscope.sources import files


def test_ridge_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    n, p = 200, 4
    x = rng.normal(size=(n, p))
    y = x @ np.array([1.0, -2, 0, 0.5]) + rng.normal(size=n)
    fold = np.arange(n) % 5
    holes = x.copy()
    holes[rng.random((n, p)) < 0.05] = np.nan
    df = spark.createDataFrame(pd.DataFrame({**{f"x{j}": holes[:, j] for j in range(p)}, "y": y, "fold": fold, "i": np.arange(n)})).repartition(3)
    got = {r["i"]: r["ridge_pred"] for r in ridge.grouped_ridge(df, [f"x{j}" for j in range(p)], "y", "fold").collect()}
    for k in range(5):
        tr, te = fold != k, fold == k
        z = np.where(np.isnan(holes), np.nanmedian(holes[tr], axis=0), holes)
        mean, sd = z[tr].mean(axis=0), z[tr].std(axis=0)
        z = (z - mean) / sd
        best = None
        for a in ridge.ALPHAS:
            inverse = np.linalg.inv(z[tr].T @ z[tr] + a * np.eye(p))
            beta = inverse @ z[tr].T @ (y[tr] - y[tr].mean())
            h = 1 / tr.sum() + np.einsum("ij,jk,ik->i", z[tr], inverse, z[tr])
            loss = np.mean(((y[tr] - y[tr].mean() - z[tr] @ beta) / (1 - h)) ** 2)
            if best is None or loss < best[0]:
                best = (loss, y[tr].mean() + z[te] @ beta)
        assert np.allclose([got[i] for i in np.nonzero(te)[0]], best[1])


def test_no_features_is_the_mean(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(10)], "y double, fold int")
    got = {(r["fold"], r["ridge_pred"]) for r in ridge.grouped_ridge(df, [], "y", "fold").collect()}
    assert got == {(0, 5.0), (1, 4.0)}


def test_splits_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"g{i % 20}", i, "x" if i % 20 < 10 else "y") for i in range(60)], "g string, i int, s string")
    for dealt in (splits.grouped_split(df, "g", {"train": 0.6, "val": 0.2, "test": 0.2}, 1), splits.grouped_split(df, "g", {"train": 0.6, "val": 0.2, "test": 0.2}, 1, "s")):
        rows = [r.asDict() for r in dealt.collect()]
        assert len(rows) == 20 and sorted(r["split"] for r in rows).count("train") == 12
    joined = df.join(splits.grouped_split(df, "g", {"a": 0.5, "b": 0.5}, 2), "g")
    assert splits.leaks(joined, "split", {"group": "g"}).count() == 0
    assert splits.leaks(spark.createDataFrame([("g", "a"), ("g", "b")], "g string, split string"), "split", {"group": "g"}).count() == 1
    folds = splits.group_kfold(df.repartition(7), "g", 4, 3).collect()
    assert sorted(folds) == sorted(splits.group_kfold(df, "g", 4, 3).collect())


@pytest.mark.parametrize(
    "rows, groups",
    [([("a", "SAME"), ("b", "SAME"), ("c", "other"), ("d", "third")], 3), ([("a", "H1"), ("b", "H1"), ("b", "H2"), ("c", "H2")], 1), ([("a", None), ("b", ""), ("b", "H")], 2)],
)
def test_leakproof_groups(spark, rows, groups):
    out = splits.leakproof_groups(spark.createDataFrame(rows, "s string, h string"), "s", "h").collect()
    assert len({r["group_id"] for r in out}) == groups and all(r["group_id"] <= r["s"] for r in out)


def test_hamming_pairs_match_brute_force(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(-(2**63), 2**63 - 1, 120)
    near = np.array([v ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 13), replace=False)) for v in values[:60]])
    values = np.concatenate([values, near, values[:5]])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(values)), "v": values}))
    got = {(r["key_a"], r["key_b"], r["distance"]) for r in similarity.hamming_pairs(df, "k", "v", 10).collect()}
    bits = values.astype(np.uint64)
    want = {(i, j, int(np.bitwise_count(bits[i] ^ bits[j]))) for i in range(len(bits)) for j in range(i + 1, len(bits)) if np.bitwise_count(bits[i] ^ bits[j]) <= 10}
    assert got == want


@pytest.mark.parametrize("block, pairs", [(3, 50), (256, 1 << 26)])
def test_hamming_pairs_are_dealt_in_bounded_tasks(spark, monkeypatch, block, pairs):
    """Copies of few values: blocks of keys meet, and the pairs are spread over as many tasks as they need."""
    monkeypatch.setattr(similarity, "KEY_BLOCK", block)
    monkeypatch.setattr(similarity, "TASK_PAIRS", pairs)
    values = [7] * 20 + [6] * 9 + [1 << 40] * 5 + [None, 4]
    keys = [f"k{i:02}" for i in range(len(values) - 1)] + [None]
    found = similarity.hamming_pairs(spark.createDataFrame(list(zip(keys, values)), "k string, v long"), "k", "v", 1)
    want = sorted((keys[i], keys[j], (values[i] ^ values[j]).bit_count()) for i in range(34) for j in range(i + 1, 34) if (values[i] ^ values[j]).bit_count() <= 1)
    assert sorted(tuple(r) for r in found.collect()) == want
    assert found.rdd.getNumPartitions() == (math.ceil((20 * 20 + 20 * 9 + 9 * 9 + 5 * 5) / 50) if pairs == 50 else 4)


def test_rounding_does_not_decide_a_permutation_test(spark):
    """A model that is always below the truth has the same error under every permutation, up to the order of the sums."""
    null = spark.createDataFrame([(16479.8745 * (1 + k * 1e-15),) for k in range(1, 100)], "e double")
    assert resample.empirical_p(null, "e", 16479.8745)["p"] == 1.0
    assert resample.empirical_p(null, "e", 16479.8745 * (1 + 2e-13), lower=False)["p"] == 1.0
    assert resample.empirical_p(null, "e", 16479.0)["p"] == 0.01


def test_permutations_go_through_gathered_batches(spark):
    """Subjects are ordered once a permutation for a task's rows, however many batches these come in."""
    batches = [pd.DataFrame({"a": range(i, i + 50)}) for i in range(0, 1000, 50)]
    assert [len(b) for b in resample.gathered(iter(batches), 120)] == [150] * 6 + [100]
    assert pd.concat(resample.gathered(iter(batches), 120))["a"].tolist() == list(range(1000))
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "50")
    try:
        rows = spark.range(0, 3000).selectExpr("CAST(id AS STRING) s", "id * 1.0D y", "id + 1.0D p", "id")
        null = resample.permuted_errors(rows, "s", "y", "id", {"p": "p"}, 5).collect()
    finally:
        spark.conf.set(setting, before)
    y = np.arange(3000.0)[np.argsort([str(i) for i in range(3000)])]
    for r in null:
        assert r["p"] == pytest.approx(np.abs(y + 1 - y[resample.subject_order(3000, r["replicate"])]).mean())


def test_hamming_links_join_the_same_groups(spark):
    from veriscope.operators.components import connected_components

    rng = np.random.default_rng(8)
    base = rng.integers(-(2**63), 2**63 - 1, 30)
    values = np.concatenate([base, base[:5], base[:5], [v ^ 5 for v in base[:8]], [v ^ 80 for v in base[:4]]])
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(len(values)), "v": values}))
    by_links = connected_components(similarity.hamming_links(df, "k", "v", 2)).collect()
    by_pairs = connected_components(similarity.hamming_pairs(df, "k", "v", 2), "key_a", "key_b").collect()
    assert by_links and sorted(by_links) == sorted(by_pairs)


def test_hamming_nearest_does_not_pair_copies(spark):
    """Copies of a value on both sides: 10^9 pairs of rows, four of values."""
    import time

    rows = spark.range(64_000).selectExpr("id k", "IF(id < 4, id, IF(id % 2 = 0, 7, 6)) v").unionByName(spark.createDataFrame([(70_000, None)], "k long, v long"))
    began = time.monotonic()
    got = {(r["distance"], r["nearest"], r["n"]) for r in similarity.hamming_nearest(rows.where("k % 2 = 0 or k = 70000"), rows.where("k % 2 = 1"), "k", "v", 3).groupBy("distance", "nearest").count().withColumnRenamed("count", "n").collect()}
    assert got == {(1, 1, 1), (1, 3, 31_999)}
    assert time.monotonic() - began < 30


@pytest.mark.parametrize("cell_rows", [7, 4096])
def test_near_values_in_blocks_of_cells(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(similarity, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(12)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    values = np.unique(np.concatenate([base, [v ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 13), replace=False)) for v in base for _ in range(3)]]))
    got = similarity.near_values(spark.createDataFrame(pd.DataFrame({"v": values})), 10).collect()
    bits = values.astype(np.uint64)
    want = {(int(values[i]), int(values[j])) for i in range(len(bits)) for j in range(i + 1, len(bits)) if np.bitwise_count(bits[i] ^ bits[j]) <= 10}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_running_sums(spark):
    from veriscope.operators.running import running_sums

    rng = np.random.default_rng(9)
    rows = pd.DataFrame({"g": rng.choice(["a", "b", None], 300), "x": rng.permutation(300) / 7.0, "n": rng.integers(1, 9, 300)})
    for slices in (2, 16, 512):
        got = {r["x"]: r for r in running_sums(spark.createDataFrame(rows), ["g"], "x", ["n"], slices).collect()}
        assert len(got) == 300
        for g, part in rows.groupby("g", dropna=False):
            part = part.sort_values("x")
            total = part["n"].cumsum().tolist()
            for k, x in enumerate(part["x"]):
                after = part["x"].tolist()[k + 1] if k + 1 < len(part) else None
                assert (got[x]["upto_n"], got[x]["all_n"], got[x]["next"]) == (total[k], total[-1], after)
    assert running_sums(spark.createDataFrame(rows).limit(0), [], "x", ["n"]).count() == 0


def test_cosine_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    for blocks in (1, 3, 8):
        got = {r["key"]: r["nearest"] for r in similarity.cosine_nearest(df, "k", "v", blocks).collect()}
        assert got == dict(enumerate(cosine.argmax(axis=1).tolist()))


def test_cosine_nearest_bounds_the_bytes_of_a_group(spark, monkeypatch):
    """Groups stay below a size in bytes, whatever the vectors' width and number, and single precision travels as it is."""
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 40 * 8 * 4)
    x = np.random.default_rng(4).normal(size=(600, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<float>")
    got = {r["key"]: r["nearest"] for r in similarity.cosine_nearest(df, "k", "v").collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, -2)
    assert got == dict(enumerate(cosine.argmax(axis=1).tolist()))
    plan = similarity.cosine_nearest(df, "k", "v")._jdf.queryExecution().toString()
    assert "0,1,2,3,4,5,6,7,8,9,10,11,12,13,14" in plan.replace(" ", "") or "sequence(0, 14" in plan
    assert "array<double>" not in plan


def test_screening(spark):
    df = spark.createDataFrame([(1, 1.0, 0), (1, 2.0, 1), (0, 2.0, 0), (0, 3.0, 1), (1, 4.0, 0), (0, 5.0, 1)], "t int, s double, f int")
    row = screening.ranking_metrics(df, "t", "s", []).first()
    pos, neg = [1.0, 2.0, 4.0], [2.0, 3.0, 5.0]
    assert row["auroc"] == pytest.approx(np.mean([(p < q) + 0.5 * (p == q) for p in pos for q in neg]))
    options = screening.cuts(screening.score_table(df, "t", "s", []), [])
    best = screening.cut_for_sensitivity(options, 0.6, []).first()
    assert best["reached"] and best["cut"] == 2.5 and best["specificity"] == pytest.approx(2 / 3)
    assert not screening.cut_for_sensitivity(options.where("sensitivity < 1"), 1.0, []).first()["reached"]
    assert screening.cut_for_specificity(options, 1.0, []).first()["cut"] == 1.5
    one = screening.ranking_metrics(df.where("t = 1"), "t", "s", []).first()
    assert one["auroc"] is None and one["n"] == 3
    calls = screening.nested_calls_matched(df.withColumn("r", df.s), "t", "s", "r", "f", 0.5, "specificity")
    assert calls.count() == 6
    with pytest.raises(Exception):
        spark.createDataFrame([("M", None)], "sex string, age double").select(screening.adult_threshold()).collect()
    assert spark.createDataFrame([("M", 40.0), ("F", 40.0)], "sex string, age double").select(screening.adult_threshold().alias("t")).collect() == [(13.0,), (12.0,)]
    assert screening.verdict(0.95, 0.6, [(0.2, 0.05)]) == "USEFUL" and screening.verdict(0.95, 0.6, [(0.2, -0.1)]) == "MARGINAL" and screening.verdict(0.8, 0.6, [(0.2, 0.1)]) == "NOT USEFUL"


def test_rates(spark):
    df = spark.createDataFrame([(t, True) for t in (1, 0, 0, 1, 0)], "t int, c boolean").agg(*metrics.confusion("t", "c"))
    row = df.select(*[c.alias(n) for n, c in metrics.screening_rates().items()]).first()
    assert (row["sensitivity"], row["specificity"], row["false_referral_rate"], row["npv"]) == (1.0, 0.0, 0.6, None)


def test_permutations_and_bootstrap(spark, monkeypatch):
    assert sorted(resample.subject_order(50, 5).tolist()) == list(range(50)) and (resample.subject_order(50, 5) != resample.subject_order(50, 6)).any()
    rows = pd.DataFrame({"subject": [f"s{i // 2}" for i in range(120)], "at": np.arange(120), "truth": np.arange(120.0), "good": np.arange(120.0) + 0.5})
    null = resample.permuted_errors(spark.createDataFrame(rows).repartition(3), "subject", "truth", "at", {"good": "good"}, 99)
    names = sorted(set(rows["subject"]))
    first = {s: t for s, t in zip(rows["subject"][::-1], rows["truth"][::-1])}
    for r in null.where("replicate < 3").collect():
        swapped = dict(zip(names, np.array([first[s] for s in names])[resample.subject_order(60, r["replicate"])]))
        assert r["good"] == pytest.approx(np.mean([abs(g - swapped[s]) for g, s in zip(rows["good"], rows["subject"])]))
    p = resample.empirical_p(null, "good", 0.75)
    assert p["p"] == p["floor"] == 0.01 and p["at_floor"]
    sums = resample.replicate_sums(spark.range(100).repartition(3), F.col("id"), {"x": F.col("id"), "none": F.lit(None)}, 300)
    ci = resample.interval(sums.select((F.col("x") / F.col("drawn")).alias("value")))
    assert ci["lo"] < 49.5 < ci["hi"] and ci["n"] == 300 and 2 < ci["se"] < 4
    first = sums.where("replicate = 7").first()
    times = resample.times_drawn(np.arange(100), 7)
    assert first["x"] == times @ np.arange(100) and first["drawn"] == times.sum() and first["none"] == 0
    drawn = resample.times_drawn(np.arange(200_000), 3)
    assert drawn.mean() == pytest.approx(1, abs=0.02) and drawn.var() == pytest.approx(1, abs=0.03) and (drawn == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert resample.replicate_sums(spark.range(0), F.col("id"), {}, 5).count() == 0
    assert [resample.drawn_hits(4, 5000, 1200, block) for block in (77, 1 << 20)] == [int((resample.scattered(resample.BOOTSTRAP_SEED, 4, 5000) % np.uint64(5000) < 1200).sum())] * 2
    line = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 * 3.0 + F.col("id") % 7).alias("y"), F.lit(5.0).alias("same"))
    found = {r["term"]: r for r in resample.least_squares_intervals(line, F.col("id"), ["y"], ["x"], 100).collect()}
    assert found["x"]["lo"] < 3 < found["x"]["hi"] and found["x"]["hi"] - found["x"]["lo"] < 0.3 and found["intercept"]["n"] == 100
    assert {r["skipped"] for r in resample.least_squares_intervals(line, F.col("id"), ["y"], ["x", "same"], 10).collect()} == {10}
    monkeypatch.setattr(resample, "MAX_SUBJECTS", 9)
    with pytest.raises(ValueError):
        resample.bounded(spark.range(10), ["id"])


def test_power(spark):
    test = power.TwoSided()
    assert test.reach(0.8) == pytest.approx(2.8016, abs=1e-4) and test.reach(0.9) == pytest.approx(3.2415, abs=1e-4)
    rows = [(1.0, test.reach(0.8), 100, 0.25), (2.0, 1.0, 50, 0.0), (float("nan"), 1.0, 10, 0.5), (None, 1.0, 10, 0.5), (0.0, 0.5, 10, 0.5), (0.1, float("inf"), 10, None), (1.0, -3.0, 10, 0.5)]
    got = power.assessed(spark.createDataFrame(rows, "se double, yardstick double, n long, share double"), share="share").collect()
    assert got[0]["power"] == pytest.approx(0.8, abs=1e-12) and got[0]["group_needed"] == pytest.approx(100) and got[0]["cohort_needed"] == pytest.approx(400)
    assert [r["adequacy"] for r in got] == ["ADEQUATELY POWERED", "UNDERPOWERED", "INDETERMINATE", "INDETERMINATE", "ADEQUATELY POWERED", "INDETERMINATE", "ADEQUATELY POWERED"]
    assert got[1]["group_needed"] == pytest.approx(50 * (2 * test.reach(0.8)) ** 2) and got[1]["cohort_needed"] is None and got[1]["subjects_moved"] == 50 and got[1]["crosses_band"]
    assert [got[k]["power"] for k in (2, 3, 4, 5)] == [None] * 4 and got[6]["power"] == pytest.approx(0.8508, abs=1e-4)
    xs = [-9.0, -7.5, -3.0, -0.1, 0.0, 1.0, 2.5, 6.0]
    cdf = spark.createDataFrame([(x,) for x in xs], "x double").select(power.normal_cdf(F.col("x"))).collect()
    assert [r[0] for r in cdf] == pytest.approx([NormalDist().cdf(x) for x in xs], abs=1e-13)


def test_log_slope(spark):
    df = spark.createDataFrame([(float(n), 3 * n**-0.5) for n in (10, 20, 40, 80)], "n double, se double")
    row = df.agg(*power.log_slope("n", "se")).first()
    assert row["slope"] == pytest.approx(0.5) and row["r2"] == pytest.approx(1.0)
    assert df.limit(2).agg(*power.log_slope("n", "se")).first()["slope"] is None


def pulse(bpm, seconds=40, gain=1.0, seed=1):
    t = np.arange(int(seconds * signals.RATE)) / signals.RATE
    beat = np.sin(2 * np.pi * bpm / 60 * t) + 0.4 * np.sin(4 * np.pi * bpm / 60 * t + 0.7)
    return gain * (1000 + 20 * beat + np.random.default_rng(seed).normal(0, 0.5, len(t)))


@pytest.mark.parametrize("bpm", [55, 75, 100])
def test_signal_features(bpm):
    found = signals.channel_features(pulse(bpm))
    assert abs(found["heart_rate_bpm"] - bpm) < 8 and abs(found["n_beats"] - bpm * 40 / 60) <= 3 and found["snr_db"] > 10
    louder = signals.channel_features(pulse(bpm, gain=3.0))
    assert louder["ac_dc"] == pytest.approx(found["ac_dc"], rel=1e-6) and louder["dc"] == pytest.approx(3 * found["dc"])


def test_short_and_flat_signals():
    assert signals.channel_features(np.ones(100)) is None and signals.channel_features(np.zeros(3000)) is None
    assert signals.for_network(np.ones(100)) is None and len(signals.for_network(pulse(60))) == 2000
    assert signals.spectrogram(pulse(60)[:500]).shape == (33, 28)


def test_filters():
    for cutoff, inside, outside in ((0.4, 0.05, 4.0), ((0.5, 8.0), 2.0, 40.0)):
        sections = signals.butterworth(4, cutoff, 200.0)
        gain = lambda f: abs(np.prod([np.polyval(s[2::-1], z) / np.polyval(s[:2:-1], z) for s in sections for z in [np.exp(-2j * np.pi * f / 200)]]))
        assert gain(inside) == pytest.approx(1, abs=0.01) and gain(outside) < 0.01
        for edge in np.atleast_1d(cutoff):
            assert gain(edge) == pytest.approx(2**-0.5, abs=1e-6)


def brute_peaks(x, distance, prominence):
    """Maxima one by one: plateaus count at their first sample, prominence is looked for sample by sample."""
    tops = []
    for i in range(1, len(x) - 1):
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            tops.append(i)
    kept = []
    for i in sorted(tops, key=lambda i: (-x[i], i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        left, right = i, i
        while left > 0 and x[left - 1] <= x[i]:
            left -= 1
        while right < len(x) - 1 and x[right + 1] <= x[i]:
            right += 1
        if x[i] - max(min(x[left : i + 1]), min(x[i : right + 1])) >= prominence:
            out.append(i)
    return out


def test_peaks_and_block_filters():
    rng = np.random.default_rng(11)
    for n, distance, prominence in ((400, 1, 0.0), (400, 9, 0.5), (90, 30, 1.0), (5, 1, 0.0), (2, 1, 0.0)):
        x = np.round(np.cumsum(rng.normal(size=n)), 1)
        assert signals.peaks(x, distance, prominence).tolist() == brute_peaks(x, distance, prominence)
    section, state = signals.butterworth(4, (0.5, 8.0), 200.0)[1], np.array([0.3, -0.2])
    x, want, (s0, s1) = rng.normal(size=1000), [], state
    b0, b1, b2, _, a1, a2 = section
    for v in x:
        want.append(b0 * v + s0)
        s0, s1 = b1 * v - a1 * want[-1] + s1, b2 * v - a2 * want[-1]
    assert np.allclose(signals._filter(section, x, state), want, atol=1e-12)


def test_subject_features(spark):
    rows = [("s1", c, i, float(v)) for k, c in enumerate(signals.CHANNELS) for i, v in enumerate(pulse(70, 6, seed=k))] + [("s2", 660, i, 1.0) for i in range(2000)]
    wide = signals.per_subject(signals.per_channel(spark.createDataFrame(rows, "s string, c int, i int, v double"), "s", "c", "i", "v"), "s", "c")
    got = wide.collect()
    assert [r["s"] for r in got] == ["s1"] and len(wide.columns) == 1 + 40 + 6 + 5 and got[0]["R_660_940"] == pytest.approx(1, abs=0.2)


def test_colour():
    pairs = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 0, 0), (50, -1, 2), 2.3669), ((50, 2.5, 0), (50, 0, -2.5), 4.3065), ((2.0776, 0.0795, -1.1350), (0.9033, -0.0636, -0.5514), 0.9082)]
    for a, b, want in pairs:
        assert float(colour.delta_e_2000(np.array(a), np.array(b))) == pytest.approx(want, abs=1e-4)
    grey = np.ones((8, 8, 3)) * np.array([0.2, 0.4, 0.4])
    want = colour.unit(np.array([0.2, 0.4, 0.4]))
    for f in (colour.grey_world, colour.max_rgb, colour.shades_of_grey):
        assert np.allclose(f(grey), want)
    ramp = grey * np.linspace(0.1, 1, 8)[:, None, None] ** 2
    assert np.allclose(colour.grey_edge(ramp), want) and np.allclose(colour.grey_edge(ramp, order=2), want)
    pixels = np.vstack([np.full((90, 3), 0.5), np.ones((5, 3)), np.zeros((5, 3))])
    assert np.allclose(colour.robust_colour(pixels), 0.5)
    prior = colour.ReflectancePrior().fit(np.array([[0.4, 0.3, 0.2]] * 3), np.array([[0.5, 0.5, 0.5]] * 3), ["a", "a", "b"])
    assert np.allclose(prior.illuminant([0.4, 0.3, 0.2], "a"), colour.unit(np.ones(3))) and set(prior.by_key) == {"a"}
    mask = np.array([[1, 0, 0, 1], [0, 1, 0, 1], [0, 0, 0, 0], [1, 1, 0, 0]], bool)
    assert colour.components(mask).max() == 3
    light = colour.unit(np.array([0.8, 0.5, 0.3]))
    bodies = [np.array([0.1, 0.5, 0.2]), np.array([0.5, 0.1, 0.1])]
    normals = [colour.dichromatic_normal(np.array([b * s + light * t for s, t in ((1, 0), (1, 1), (0.5, 2), (2, 0.3))])) for b in bodies]
    assert np.allclose(colour.plane_illuminant(normals), light)
    image = np.full((40, 40, 3), 30.0)
    image[10:13, 10:13] = [200, 190, 180]
    found = colour.highlights(image, np.ones((40, 40), bool))
    assert len(found) == 1 and found[0]["area"] == 9 and colour.highlights(np.full((40, 40, 3), 30.0), np.ones((40, 40), bool)) == []
    scores = colour.overlap_scores(colour.confusion(np.array([0, 0, 1]), np.array([0, 1, 1]), 3))
    assert scores["iou"][0] == 0.5 and math.isnan(scores["iou"][2])


def test_simulation(spark):
    def ishigami(u):
        x = (2 * u - 1) * np.pi
        return np.sin(x[:, 0]) + 7 * np.sin(x[:, 1]) ** 2 + 0.1 * x[:, 2] ** 4 * np.sin(x[:, 0])

    got = {r["parameter"]: r for r in simulation.sensitivity(simulation.evaluate_design(spark, ishigami, 3, 4096), 3).collect()}
    for k, (first, total) in enumerate(((0.3139, 0.5576), (0.4424, 0.4424), (0.0, 0.2437))):
        assert got[k]["first_order"] == pytest.approx(first, abs=0.03) and got[k]["total"] == pytest.approx(total, abs=0.03)
    lut = spark.createDataFrame([(v / 10, math.exp(-v / 50), v / 200) for v in range(20, 241)], "hb double, r double, g double")
    obs = spark.createDataFrame([(math.exp(-8.03 / 5), 8.03 / 20)], "r double, g double")
    assert simulation.nearest_on_table(obs, lut, ["r", "g"], "hb").first()["found"] == pytest.approx(8.03, abs=0.01)
    row = spark.range(100).selectExpr("id / 50.0d v").agg(*simulation.summary("v")).first()
    assert row["n"] == 100 and row["robust_at_high"] is not None
    assert simulation.one_at_a_time(lambda p: p["a"] * 2 + p["b"], {"a": (0, 1), "b": (0, 3)}, {"a": 0.5, "b": 0}) == {"a": 2.0, "b": 3.0}


def test_information():
    assert information.correlation_p(0.5, 30) == pytest.approx(0.00489, abs=2e-5)
    assert information.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    rng = np.random.default_rng(1)
    x = rng.normal(size=800)
    assert information.mutual_information(x, 0.9 * x + math.sqrt(1 - 0.81) * rng.normal(size=800)) == pytest.approx(-0.5 * math.log(1 - 0.81), abs=0.12)
    assert information.mutual_information(x, rng.normal(size=800)) < 0.08
    assert information.bh([0.01, 0.04, 0.03, 0.5]) == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.5])


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.PNG").write_bytes(b"1234")
    (tmp_path / "y.txt").write_text("12")
    got = {r["extension"]: (r["n_files"], r["n_bytes"]) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert got == {"png": (1, 4), "txt": (1, 2)} and files.files(spark, str(tmp_path), ("png",)).count() == 1
    log = tmp_path / "log.jsonl"
    log.write_text('{"i": 1, "v": 2}\n{"i": 2, "v": 3}\n{"i": 1, "v": 9}\n{"i": 3, "v"')
    done = files.read_jsonl(spark, str(log), "i long, v long", "i")
    assert {r["i"]: r["v"] for r in done.collect()} == {1: 9, 2: 3}
    assert [r["i"] for r in files.pending(spark, 4, done).orderBy("i").collect()] == [0, 3]
    with pytest.raises(PermissionError):
        files.guarded_write(done, f"{tmp_path}/raw/x", f"{tmp_path}/raw")
    files.guarded_write(done, f"{tmp_path}/out", f"{tmp_path}/raw")
    assert files.upsert(done, spark.createDataFrame([(2, 7), (5, 1)], "i long, v long"), "i").count() == 3
    assert files.preview(done, 1)[0].count() == 1


def test_images(spark, tmp_path):
    import struct
    import zlib

    from veriscope.sources import images

    def png(path, gray):
        h, w = gray.shape
        raw = b"".join(b"\0" + bytes(row) for row in gray.astype(np.uint8).tolist())
        part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b""))

    rng = np.random.default_rng(1)
    base = np.kron(rng.integers(20, 200, (8, 8)), np.ones((8, 8)))
    png(tmp_path / "s1.png", base)
    png(tmp_path / "s2.png", base + 20)
    png(tmp_path / "s3.png", np.kron(rng.integers(20, 200, (8, 8)), np.ones((8, 8))))
    (tmp_path / "s4.png").write_bytes(b"broken")
    got = {r["stem"]: r for r in images.content_hashes(spark, str(tmp_path)).collect()}
    away = lambda a, b: bin((got[a]["phash"] ^ got[b]["phash"]) & (2**64 - 1)).count("1")
    assert away("s1", "s2") <= 2 and away("s1", "s3") > 10 and got["s1"]["md5"] != got["s2"]["md5"] and got["s4"]["phash"] is None
    rows = spark.createDataFrame([(0, "s1"), (1, "s3"), (2, "none")], "_row long, subject_id string")
    assert images.attach_content(rows, images.content_hashes(spark, str(tmp_path))).count() == 2
    paths = spark.createDataFrame([(0, "x/s1.png|x/s2.png")], "_row long, image_path string")
    assert images.attach_content(paths, images.content_hashes(spark, str(tmp_path))).count() == 2
