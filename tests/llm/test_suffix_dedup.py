import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.llm import suffix_dedup as S


def brute(rows):
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[i : i + S.STRING] for r in raws for i in range(len(r) - S.STRING + 1))
    out = []
    for (i, _), raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 2, bool)
        for at in range(len(raw) - S.STRING + 1):
            if seen[raw[at : at + S.STRING]] > 1:
                gone[at + 1 : at + 1 + S.STRING] = True
        starts = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone[1:-1]])
        out.append((i, len(raw), len(raw) - len(kept), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in S.suffix_report(df).collect()), key=str)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def cases():
    rng = random.Random(11)
    base = words(rng, 400)
    rows = [(0, base), (1, base), (2, None), (3, ""), (4, "short"), (5, words(rng, 300))]
    for k in range(12):  # copies with a few changed letters: matches that end anywhere
        text = list(base)
        for at in rng.sample(range(len(text)), 5):
            text[at] = "Z"
        rows.append((10 + k, "".join(text)))
    passage = base[300:900]
    for k, size in enumerate((199, 200, 201, 202, 250, 299, 300, 301, 340, 400, 600)):  # passages around the length that counts, in other surroundings
        rows.append((30 + k, words(rng, 60) + passage[:size] + words(rng, 50)))
        rows.append((50 + k, words(rng, 20) + passage[-size:] + words(rng, 10)))
    rows += [(70, "a" * 700), (71, "ab" * 450), (72, words(rng, 10) + "a" * 199 + "b"), (73, words(rng, 30) + "xyz" * 100 + words(rng, 30))]
    rows += [(74, (one := words(rng, 45)) + words(rng, 30) + one), (75, "é" * 150 + words(rng, 20) + "é" * 120), (None, base[:500]), (5, words(rng, 80)), (5, passage)]
    rows += [(80 + k, words(rng, 4) + "\n" + passage[100:330] + "\n" + words(rng, 4)) for k in range(20)]
    return rows


@pytest.mark.parametrize("large", [3, 2000])
def test_matches_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(S, "LARGE", large)
    df = spark.createDataFrame(cases(), "doc_id long, text string").withColumns({"tid": F.lit("clash"), "h": F.lit(1), "text_key": F.lit("x")}).repartition(3)
    assert got(df) == brute(cases())


def test_recursion_and_merge_find_most(spark):
    """Without the last step by bytes, the sort of names alone covers the inside of all long matches."""
    rng = random.Random(12)
    base = words(rng, 900)
    long = [(k, words(rng, 40) + base[37 * k :] + words(rng, 40)) for k in range(7)]
    for rows, least in ((long, 0.9), ([(9, "ab" * 600), (10, words(rng, 9) + "ab" * 500)], 0.15)):  # a period of two bytes needs five levels, and unsampled places are not deepened
        keyed = S._keyed(spark.createDataFrame(rows, "doc_id long, text string"))
        hot = S.cut(S.hot_anchors(S.cut(S.anchored_texts(keyed))))
        string = hot.where("sym is not null").select("tid", "at", "sym", "step", F.col("step").alias("first"))
        inner = S.settled(hot, S.repeated_suffixes(string)).where("from is not null").count()
        assert inner >= least * string.count()


def test_anchors_in_blocks(monkeypatch):
    rng = random.Random(13)
    raw = (words(rng, 3000) + "a" * 3000 + words(rng, 300) + "abc" * 400).encode()
    whole = S.anchors(raw)
    hashes = S.string_hashes(np.frombuffer(raw, np.uint8), 104)
    assert len(set(hashes.tolist())) == len({raw[i : i + 104] for i in range(len(raw) - 103)})
    monkeypatch.setattr(S, "BLOCK", 777)
    S._scales.cache_clear()
    assert (hashes == S.string_hashes(np.frombuffer(raw, np.uint8), 104)).all()
    assert all((a == b).all() for a, b in zip(whole, S.anchors(raw)))
    _, place, start = whole
    last = np.append(start[1:], len(raw) - S.STRING + 1) - 1
    assert (np.diff(place) >= 1).all() and (np.diff(place) <= S.SPAN).all() and (place >= last).all() and (place - start < S.SPAN).all() and start[0] == 0
    S._scales.cache_clear()


def test_long_empty_and_repeated(spark):
    rng = random.Random(14)
    long = words(rng, 150_000)
    rows = [(1, long), (2, long[400_000:400_400]), (3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in S.suffix_report(df).collect()}
    assert out == {(1, len(long)): (400, 1), (2, 400): (400, 1), (3, 1): (0, 0)}
    assert S.suffix_report(df.limit(0)).count() == 0


@pytest.mark.parametrize(("seen", "large"), [(1 << 16, 5), (1, 5), (1, 2000)])
def test_equal_contexts_are_dealt_out_once(spark, monkeypatch, seen, large):
    """A string with many anchors: what is dealt out by windows is its distinct contexts, not its anchors, and no byte less is removed."""
    rng = random.Random(15)
    line = words(rng, 40)[:210] + "\n"
    rows = [(k, words(rng, 12) + "\n" + line * 8 + words(rng, 12)) for k in range(25)]
    rows += [(40, words(rng, 60) + line[:205] + words(rng, 60)), (41, words(rng, 60))]
    monkeypatch.setattr(S, "SEEN", seen)
    monkeypatch.setattr(S, "LARGE", large)
    dealt, plain = [], S._repeated

    def counted(found, key):
        if key == ["a", "b"]:
            dealt.append(found.count())
        return plain(found, key)

    monkeypatch.setattr(S, "_repeated", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(df) == brute(rows)
    assert dealt[-1] <= 25 * 2 * S.SPAN * 2  # both edges of each text and the line's own contexts; 25 * 8 lines have some 25 * 8 * 211 windows
