import numpy as np
from pyspark.sql import functions as F

from veriscope.llm import itq_dedup as I


def brute(rows):
    good = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted({i for i, _ in rows})
    cosine = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) if len(a) == len(b) else 0
    links = {i: {j for j in good if j != i and i in good and cosine(good[i], good[j]) >= 0.95} for i in ids}
    label, moved = {i: i for i in ids}, True
    while moved:
        moved = False
        for i in ids:
            for j in links[i]:
                if label[j] < label[i]:
                    label[i], moved = label[j], True
    return {i: (len(links[i]), label[i], label[i] == i) for i in ids}


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for k in range(150):
        rows.append((100 + k, (base[k % 10] + rng.normal(0, 0.08, 16)).tolist()))
    rows += [(400 + k, base[30].tolist()) for k in range(20)]
    rows += [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [None] * 16), (504, [1.0]), (505, []), (506, (-base[3]).tolist()), (507, [float("inf")] * 16)]
    return rows


def test_matches_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"label": F.lit(1), "rep": F.lit(2), "weight": F.lit(3)})
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for block in (1024, 16):  # blocks of 16 entries send the large groups through pairs of blocks
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in I.near_duplicates(df, block=block).collect()}
        want = brute(exact)
        assert got.keys() == want.keys()
        found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
        assert found >= 0.9 * there and all(got[i][0] <= want[i][0] for i in got)
        assert sum(got[i] == want[i] for i in got) >= 0.9 * len(got)
        assert all(got[i] == (0, i, True) for i in (500, 501, 502, 503, 504, 505, 507))


def near(rng, base, cosine):
    """A vector at exactly this cosine to ``base``."""
    unit = base / np.linalg.norm(base)
    side = rng.normal(size=len(base))
    side -= side @ unit * unit
    return cosine * unit + np.sqrt(1 - cosine**2) * side / np.linalg.norm(side)


def test_recall_at_production_width(spark):
    """64 parts, 64 bits: pairs just above the threshold, where retrieval has to work, among vectors that link with nothing."""
    rng = np.random.default_rng(12)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 64)))]
    cosines = np.linspace(0.951, 0.999, 600)
    rows += [(2000 + k, near(rng, np.array(rows[k][1]), c).tolist()) for k, c in enumerate(cosines)]
    rows += [(4000 + k, near(rng, np.array(rows[k][1]), 0.93).tolist()) for k in range(1000, 1200)]
    got = {r["vec_id"]: r["n_links"] for r in I.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert np.mean([got[2000 + k] >= 1 for k in range(600)]) >= 0.97
    assert np.mean([got[2000 + k] >= 1 for k in range(100)]) >= 0.9
    assert not any(got[4000 + k] for k in range(1000, 1200))


def test_lengths_of_a_minority_link_among_themselves(spark):
    rng = np.random.default_rng(13)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 64)))]
    for k, dim in enumerate((2, 7, 32, 64, 65, 100)):
        base = rng.normal(size=dim)
        rows += [(1000 + 10 * k + j, (base * (j + 1)).tolist()) for j in range(3)] + [(1000 + 10 * k + 5, near(rng, base, 0.97).tolist())]
    rows += [(2000, rows[-1][1][:99]), (2001, rows[-1][1][:99])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in I.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == brute(rows)


def test_a_hot_bucket_is_dealt_in_blocks(spark):
    """A bucket that holds nearly all vectors makes no large task, and each pair of blocks meets once."""
    entries = spark.range(3000).selectExpr("if(id < 2000, 7L, id) as bucket", "id as rep", "id as code")
    dealt = I._dealt(entries, I.BLOCK)
    sizes = [r["count"] for r in dealt.groupBy("bucket", "lo", "hi").count().collect()]
    assert max(sizes) <= 3 * I.BLOCK and len(sizes) == 16 * 17 // 2


def test_rows_without_ids_and_repeats(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = sorted((tuple(r) for r in I.near_duplicates(df).collect()), key=str)
    assert rows == sorted([(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False)], key=str)
    assert I.near_duplicates(df.limit(0)).count() == 0
    assert I.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0]["component_id"] == 1


def test_rotation_is_orthogonal_and_balanced():
    x = np.random.default_rng(5).normal(size=(4000, 32)) @ np.diag(np.linspace(1, 3, 32))
    q = I.fit(x)
    learned = q.directions[:, :32]
    assert q.directions.shape == (32, 64) and np.allclose(learned.T @ learned, np.eye(32), atol=1e-8)
    bits = (x / np.linalg.norm(x, axis=1, keepdims=True) - q.mean) @ learned >= 0
    assert (np.abs(bits.mean(axis=0) - 0.5) < 0.06).all()
