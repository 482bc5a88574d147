import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from veriscope.llm import simhash_dedup as S


def brute_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return 0
    parts = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    label = {i: i for i in fps}
    moved = True
    while moved:
        moved = False
        for i in fps:
            for j in fps:
                if bin(fps[i] ^ fps[j]).count("1") <= 4 and label[j] < label[i]:
                    label[i] = label[j]
                    moved = True
    return label


def texts():
    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(500)}" for _ in range(300)) for _ in range(6)]
    out = list(base)
    for t in base:
        words = t.split()
        for _ in range(6):
            w = list(words)
            w[rng.randrange(300)] = "changed"
            out.append(" ".join(w))
    out += [base[0].upper(), base[0].replace(" ", "\n\t "), "Écrit ÀÉ", "écrit ÀÉ", None, "", " \x0b\n", "one", "one two three", "x " * 50_000]
    return out


def test_matches_brute_force(documents):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in S.near_duplicates(documents(rows), shingle=4).collect()}
    fps = {i: brute_fingerprint(t, 4) for i, t in rows}
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(fps)


def test_every_link_within_four_bits_is_found():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base[:20]:
        for n in (1, 2, 3, 4, 5):
            bits = rng.choice(64, n, replace=False)
            fps.append(int(b) ^ sum(1 << int(k) for k in bits))
    fps = np.array(sorted(set(fps)), np.uint64)
    rep = np.arange(len(fps))
    for bits in (6, 8):
        label = {i: i for i in rep.tolist()}

        def find(x):
            while label[x] != x:
                x = label[x]
            return x

        masks = [int(m) for group in S._masks(bits, 2) for m in group]
        tops = fps >> np.uint64(64 - bits)
        for prefix in range(1 << bits):
            near = np.array([int(t) ^ prefix in masks for t in tops])
            if near.any():
                for a, b in zip(*S._collisions(fps[near], rep[near], prefix, bits)):
                    x, y = find(int(a)), find(int(b))
                    label[max(x, y)] = min(x, y)
        want = brute_components({i: int(f) for i, f in enumerate(fps)})
        assert {i: find(i) for i in label} == want


def test_large_groups_are_split(spark):
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 2**63, dtype=np.uint64))
    fps = {centre ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(160)}
    fps |= {int(x) for x in rng.integers(0, 2**63, 40, dtype=np.uint64)}
    rows = [(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "fp long, rep long").cache()

    def label(links):
        out = {i: i for _, i in rows}
        for _ in out:
            for a, b in links:
                out[a] = out[b] = min(out[a], out[b])
        return out

    want = label([tuple(r) for r in S.near_links(df).collect()])
    assert want == brute_components({i: f for i, f in enumerate(sorted(fps))})
    for volume in (30_000, 2_000):  # groups are split once, and down to MAX_BITS
        assert want == label([tuple(r) for r in S.near_links(df, volume=volume).collect()])


def test_edges(documents):
    docs = documents([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (None, None)])
    docs = docs.withColumns({"fp": F.lit(1), "rep": F.lit(2), "component_id": F.lit(3)})
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == 5 and {r["component_id"] for r in rows if r["doc_id"] is not None} == {1}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None, None]
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "None", "None"]
    assert S.near_duplicates(documents([])).count() == 0
