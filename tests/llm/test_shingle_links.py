import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veriscope.llm import shingle_links as L
from veriscope.llm import simhash_dedup as S


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    label = {i: i for i, _ in rows}
    sets = {i: shingles(t) for i, t in rows}
    moved = True
    while moved:
        moved = False
        for i in label:
            for j in label:
                a, b = sets[i], sets[j]
                if (a == b or 5 * len(a & b) >= 4 * len(a | b)) and label[j] < label[i]:
                    label[i], moved = label[j], True
    return label


def corpus(n=40):
    """Copies with one to six words replaced: similarities on both sides of 0.8."""
    rng = random.Random(3)
    rows = []
    for base in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(80, 400))]
        rows.append((base, " ".join(words)))
        for k in range(1, 7):
            copy = list(words)
            for at in rng.sample(range(len(copy)), k):
                copy[at] = "changed"
            rows.append((1000 * k + base, " ".join(copy)))
    return [*rows, (9000, None), (9001, ""), (9002, "one two"), (9003, "ONE  two"), (9004, "one two three")]


def test_every_pair_of_eight_tenths_is_linked(documents):
    rows = corpus()
    kept = {r["doc_id"] for r in S.drop_near_duplicates(documents(rows), shingle=5).collect()}
    label = brute(rows)
    assert kept == {i for i in label if label[i] == i}


def labels_of(links, label):
    found = {i: i for i in label}
    for _ in label:
        for a, b in links:
            found[a] = found[b] = min(found[a], found[b])
    return found


def test_blocks(spark):
    """Chains away from the smallest document, two groups in one list, and members that belong to none."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows, words = [], list(base)
    for i in range(30):  # each close to the one before it, the last far from the first
        rows.append((i, " ".join(words)))
        words[rng.randrange(200)] = f"y{i}"
        words[rng.randrange(200)] = f"z{i}"
    other = [f"v{i}" for i in range(150)]
    rows += [(100 + i, " ".join([*other[:-1], f"u{i}"])) for i in range(25)] + [(200 + i, " ".join(f"t{i}-{k}" for k in range(80))) for i in range(8)]
    label = brute(rows)
    assert len(set(label.values())) == 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = docs.select(F.col("doc_id").alias("node"))
    for block in (4, 256):
        links = L.block_links(nodes.select(F.lit(7).cast("long").alias("token"), "node"), L.shingle_sets(docs, nodes, 5), block)
        assert labels_of([tuple(r) for r in links.collect()], label) == label


def test_wide_lists_give_the_same(spark, monkeypatch, documents):
    """A list whose pairs are too many to write goes through blocks."""
    rows = corpus(12)
    label = brute(rows)
    for wide in (0, 64):
        monkeypatch.setattr(L, "WIDE", wide)
        monkeypatch.setattr(L, "open_lists", lambda r, g, _open=L.open_lists, w=wide, **kw: _open(r, spark.createDataFrame([], "node long, component long"), w, **kw))
        got = {r["doc_id"]: r["component_id"] for r in L.components(documents(rows).select("doc_id", "text"), 5).collect()}
        monkeypatch.undo()
        assert got == label


def templated(n, seed=3):
    """Pages of one common block and as many words of their own, with copies of every 50th one."""
    rng = random.Random(seed)
    block = " ".join(f"menu{i}" for i in range(200))
    rows = []
    for i in range(n):
        own = [f"w{rng.randrange(10**7)}" for _ in range(100)]
        rows.append((i, block + " " + " ".join(own)))
        if i % 50 == 0:
            own[rng.randrange(100)] = "changed"
            rows.append((10**6 + i, block + " " + " ".join(own)))
    return rows


def test_templated_pages_do_not_meet(spark, monkeypatch):
    compared = []
    for n in (300, 1500):
        monkeypatch.setattr(L, "similar_pairs", lambda p, s, _f=L.similar_pairs: (compared.append(p.count()), _f(p, s))[1])
        rows = templated(n)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["component_id"] for r in L.components(docs, 5).collect()}
        monkeypatch.undo()
        assert got == {i: i % 10**6 for i, _ in rows}
    assert sum(compared[:2]) <= 2 * 300 and sum(compared[2:]) <= 2 * 1500


def test_tables_go(monkeypatch, documents, tmp_path):
    """What a run has written is gone when its components are, but for them and what the components' own rounds end with."""
    monkeypatch.setattr("veriscope.session.LOCAL_CHECKPOINTS", str(tmp_path))
    assert L.components(documents(corpus(4)).select("doc_id", "text"), 5).count() == 33
    left = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert left <= {"near-components", "edges", "small"}


def test_prefix_filter_loses_no_pair():
    rng = np.random.default_rng(4)
    sketch = rng.integers(0, 255, L.SKETCH, dtype=np.uint8)
    for _ in range(300):
        whole = np.unique(rng.integers(0, 2**64, 110, dtype=np.uint64))
        a, b = np.delete(whole, rng.choice(110, 11, False)), whole
        a, b = a, np.delete(b, rng.choice(110, 11, False))
        close = 5 * np.intersect1d(a, b).size >= 4 * np.union1d(a, b).size
        assert not close or np.intersect1d(L.prefix(a, sketch), L.prefix(b, sketch)).size
    assert not len(L.prefix(whole[:0], sketch)) and [L.prefix_length(n) for n in (1, 4, 5, 10)] == [1, 1, 2, 3]


def test_the_first_pass_counts_in_bytes():
    """Counters stop at 255, and a task's take their own 4 MB and little more."""

    class Rows:
        mapInArrow = staticmethod(lambda run, schema: run)  # noqa: N815

    batch = pa.RecordBatch.from_arrays([pa.array(range(301)), pa.array(["a b c d e"] * 300 + ["a b c d e f g"])], ["doc_id", "text"])
    tracemalloc.start()
    try:
        out = list(L.described(Rows(), 5)(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [b.num_rows for b in out[:-1]] == [301]
    counts = np.frombuffer(b"".join(out[-1].column("counts").to_pylist()), np.uint8)
    assert sorted(counts[counts > 0]) == [1, 1, 255]
    assert peak < 5 * L.SKETCH


def test_tables_go_once_nothing_reads_them(spark, monkeypatch):
    """What the near-copy stage holds at once: the prefixes are gone before sets are written, the first sets before the second ones."""
    from veriscope.llm import shingle_links

    live, seen, cut, discard = {}, {}, shingle_links.cut, shingle_links.discard

    def write(df, name):
        seen[name] = sorted(live.values())
        out = cut(df, name)
        live[id(out)] = name
        return out

    monkeypatch.setattr(shingle_links, "cut", write)
    monkeypatch.setattr(shingle_links, "discard", lambda *dfs: [live.pop(id(d)) for d in dfs] and discard(*dfs))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "other words than those of the first two"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_links.components(docs, 5).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    assert not {"near-prefixes", "near-tokens", "near-pairs", "near-fp"} & set(seen["near-links"]) - {"near-pairs"}
    assert "near-members" not in seen["near-members"] and "near-lists" not in seen["near-members"]
    assert [n for n in live.values()] == ["near-components"]


def test_counters_of_many_tasks_do_not_stop_at_a_byte(spark):
    """A rare shingle's counter is 300 and a common one's 1,020 where four tasks each have 75 and 255: the rare one still comes first."""
    part = np.full(L.SKETCH // L.SEGMENTS, 75, np.uint8)
    part[1] = 255
    first = spark.createDataFrame([(None, None, None, None, 0, part.tobytes())] * 4, L._FIRST)
    sketch = L.sketch_of(first)
    assert sketch[:3].tolist() == [300, 1020, 300]
    assert L.prefix(np.array([1, 2 + (1 << 40)], np.uint64), sketch).tolist() == [2 + (1 << 40)]


def test_a_written_table_leaves_no_shuffle_files(spark):
    """Shuffle files of a finished write would else stay until the driver collects its garbage."""
    import glob
    import time

    from veriscope.session import CLEANUP, cut

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before, set_before = files(), spark.conf.get(CLEANUP, None)
    out = cut(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).count(), "shuffled")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and out.count() == 7 and spark.conf.get(CLEANUP, None) == set_before
