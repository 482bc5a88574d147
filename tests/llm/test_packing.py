from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from veriscope.llm import packing


def brute(lengths, counts, k):
    best = None
    n = len(lengths)
    for used in range(1, min(k, n) + 1):
        for inner in combinations(range(n - 1), used - 1):
            bounds = [lengths[i] for i in (*inner, n - 1)]
            cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
            if best is None or cost < best:
                best = cost
    return best


def test_bounds_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.sort(rng.choice(200, int(rng.integers(1, 10)), replace=False))
        counts = rng.integers(1, 50, len(lengths))
        for k in (1, 2, 3, 5):
            bounds = packing.optimal_bounds(lengths, counts, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1]
            cost = sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))
            assert cost == brute(lengths.tolist(), counts.tolist(), k)
    assert packing.optimal_bounds(np.zeros(0, int), np.zeros(0, int), 4) == []


def test_batches(documents):
    data = [(i, "w " * (i % 40)) for i in range(400)] + [(500, None), (501, "w " * 5000), (None, "a b"), (3, "w w w"), (3, "w w w")]
    docs = documents(data)
    got = packing.pack_report(docs, n_buckets=4, budget=100).collect()
    assert len(got) == len(data)
    groups = {}
    for r in got:
        assert r["length"] <= r["bound"] and r["padding"] == r["bound"] - r["length"]
        groups.setdefault((r["bucket"], r["batch"]), []).append(r)
    for (bucket, _), rows in groups.items():
        assert len({r["bound"] for r in rows}) == 1
        assert len(rows) == 1 or rows[0]["bound"] * len(rows) <= 100
    for bucket in {b for b, _ in groups}:  # batches are full but for the last one
        mine = sorted(k for b, k in groups if b == bucket)
        assert mine == list(range(len(mine)))
        assert len({len(groups[bucket, k]) for k in mine[:-1]}) <= 1
    again = packing.pack_report(documents(list(reversed(data))).repartition(5), n_buckets=4, budget=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_packed_keeps_rows_and_columns(documents):
    docs = documents([(1, "a b c"), (1, "a"), (2, None), (None, "x y")]).withColumns({"pack_length": F.lit(-1), "within": F.lit(0), "offset": F.lit(9)})
    out = packing.packed(docs)
    assert out.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "within", "offset"]
    assert sorted((str(r["doc_id"]), r["pack_length"]) for r in out.collect()) == [("1", 1), ("1", 3), ("2", 0), ("None", 2)]
    assert packing.pack_report(documents([])).count() == 0


def test_one_long_document_moves_no_bound(documents):
    import duckdb

    from veriscope.llm.sql import PACKING_SQL

    rng = np.random.default_rng(6)
    sizes = [int(x) for x in rng.choice(900, 45, replace=False)]
    data = [(i, "w " * sizes[int(rng.integers(45))]) for i in range(700)] + [(700, "w " * 1_000_000)]
    got = sorted(tuple(r) for r in packing.pack_report(documents(data)).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    assert got == sorted(con.execute(PACKING_SQL).fetchall())
