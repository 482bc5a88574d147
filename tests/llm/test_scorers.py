import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.llm import labels as labels_of
from veriscope.llm import quality, textfeatures, toxicity
from veriscope.llm.textfeatures import Words, batched, pieces

BAD = ("zorka", "zorkis", "mulvat", "grelb")


def corpus(n=600, seed=1):
    """(id, text, quality, toxic): toxic texts hold a few marked words; junk repeats words or is full of marks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "or", "thé", "in", "ea", "st")) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(30, 120))]
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        if not good:
            words = [w + rng.choice(("$$$", "%%%")) for w in words] if i % 2 else [w for w in words[:8] for _ in range(15)]
            toxic = int(any(w in BAD for w in words))
        rows.append((i, " ".join(words), good, toxic))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (10**6, 0, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def accuracy(got, rows, at):
    test = [r for r in rows if held(r[0])]
    return np.mean([got[r[0]]["predicted"] == r[at] for r in test])


def test_quality_on_held_out_rows(tables):
    rows, docs, labels = tables
    got = {r["doc_id"]: r for r in quality.quality_report(docs.withColumn("score", F.lit("clash")), labels).collect()}
    assert len(got) == len(rows) and all(got[r[0]]["held_out"] == held(r[0]) for r in rows)
    assert accuracy(got, rows, 2) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    again = {r["doc_id"]: r["score"] for r in quality.quality_report(docs.repartition(3), labels).collect()}
    assert again == {i: r["score"] for i, r in got.items()}
    kept = quality.accepted(docs.withColumn("quality", F.lit(0)), labels)
    assert kept.columns[:-1] == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["score"] >= 0.5}


def test_toxicity_on_held_out_rows(tables):
    rows, docs, labels = tables
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(docs.withColumn("score", F.lit("clash")), labels).collect()}
    assert accuracy(got, [r for r in rows if r[2]], 3) >= 0.95
    texts = {r[0]: r[1] for r in rows}
    spans = [texts[i][int(a) : int(b)] for i, r in got.items() if r["spans"] for a, b in (s.split(":") for s in r["spans"].split(","))]
    assert spans and np.mean([all(w in BAD for w in s.split()) for s in spans]) > 0.9


@pytest.mark.parametrize("report", [quality.quality_report, toxicity.toxicity_report])
def test_edges(spark, tables, report):
    _, docs, labels = tables
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (4, "x"), (None, "y z"), (5, "a" * 1_500_000), (6, "word " * 300_000), (7, "😀 é\x00")]
    more = docs.unionByName(spark.createDataFrame([(10_000 + i if i else None, t) for i, t in odd], "doc_id long, text string"), allowMissingColumns=True)
    got = report(more, labels).where("doc_id is null or doc_id >= 10000").collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (10_001, 10_002, 10_003)}) == 1
    assert report(docs.limit(0), labels).count() == 0
    untrained = report(docs.limit(5), labels.limit(0)).collect()
    assert len(untrained) == 5 and len({r["score"] for r in untrained}) == 1


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([3, 0, 1, 9, 7])
    emission, transition = rng.normal(0, 2, counts.sum()), rng.normal(0, 1, (2, 2))
    p, expected = toxicity.forward_backward(emission, toxicity.Blocks(counts), transition)
    at, want, pairs = 0, [], np.zeros((2, 2))
    for n in counts:
        e = emission[at : at + n]
        at += n
        if not n:
            continue
        paths = [[(k >> t) & 1 for t in range(n)] for k in range(1 << n)]
        weight = np.array([np.exp(sum(e[t] * s[t] + transition[s[t - 1] if t else 0, s[t]] for t in range(n))) for s in paths])
        weight /= weight.sum()
        want += [sum(w for w, s in zip(weight, paths) if s[t]) for t in range(n)]
        for w, s in zip(weight, paths):
            for t in range(n):
                pairs[s[t - 1] if t else 0, s[t]] += w
    assert np.allclose(p, want) and np.allclose(expected, pairs)


def test_blocks_do_not_matter():
    rng = np.random.default_rng(6)
    emission, transition = rng.normal(0, 2, 1000), rng.normal(0, 1, (2, 2))
    whole, _ = toxicity.forward_backward(emission, toxicity.Blocks(np.array([1000])), transition)
    a = np.exp(transition)
    forward = [np.array([1.0, 0.0])]
    for e in emission:
        v = forward[-1] @ a * np.array([1, np.exp(e)])
        forward.append(v / v.sum())
    back, want = np.ones(2), np.zeros(1000)
    for t in range(999, -1, -1):
        both = forward[t + 1] * back
        want[t] = both[1] / both.sum()
        back = a @ (back * np.array([1, np.exp(emission[t])]))
        back /= back.sum()
    assert np.allclose(whole, want)


def long_texts(rng):
    """Texts of many pieces once PIECE is small: spans over edges, wide gaps, and words longer than a piece."""
    word = lambda: rng.choice(("zorka", "mulvat", "and", "thé", "ora", "x"))
    texts = [" ".join(word() for _ in range(400)), "zorka " * 300, "and" + " " * 700 + "zorka\tmulvat\n\n" * 40]
    return texts + ["q" * 900 + " zorka " + "é" * 500, "z" * 2000, " " * 2000, "\t".join(word() for _ in range(300)), None, "zorka"]


def test_pieces_change_nothing(monkeypatch):
    """Spans, expectations, scores and features of texts read in small pieces and slices are those of whole texts."""
    texts = long_texts(random.Random(4))
    rng = np.random.default_rng(8)
    weight = rng.normal(0, 0.5, 1 << toxicity.BUCKET_BITS).astype(np.float32)
    for word in (b"zorka", b"mulvat"):
        weight[toxicity.token_features(Words([word]))[0, 0]] = 6.0
    model = toxicity.ToxicityModel(weight, -2.0, np.array([[1.0, -1.0], [-0.5, 1.5]]), None)
    scorer = quality.QualityModel(rng.normal(0, 1, 1 << quality.BUCKET_BITS).astype(np.float32), 0.1)

    def features(text):
        reader = quality.Reader()
        return sorted(b for owners, parts in batched([text]) for _, found in reader.features(owners, parts) for b in found.tolist())

    whole, scores, buckets = model.documents(texts), scorer.scores(texts), [features(t) for t in texts]
    assert sum(map(len, whole[2])) > 100
    for piece, batch, part in ((64, 128, 1 << 12), (200, 300, 256), (1 << 18, 1 << 19, 100)):
        monkeypatch.setattr(textfeatures, "PIECE", piece)
        monkeypatch.setattr(textfeatures, "BATCH", batch)
        monkeypatch.setattr(textfeatures, "SLICE", part)
        got = model.documents(texts)
        assert np.allclose(got[0], whole[0]) and np.allclose(got[1], whole[1]) and got[2] == whole[2]
        assert np.allclose(scorer.scores(texts), scores, atol=1e-12) and [features(t) for t in texts] == buckets


def test_training_rows_are_whole_and_bounded(spark):
    """Long labelled texts train where short ones are too few; held-out, unlabelled and text-less rows never do."""
    rows = [(i, ("x" * 10 + f" {i}") if i < 40 else "y" * (100 + i)) for i in range(80)] + [(90, None), (41, "y" * 500), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("wanted", F.lit(5))
    known = spark.createDataFrame([(i, int(i >= 40)) for i in range(100) if i != 50] + [(None, 1)], "doc_id long, toxic int")
    got = labels_of.training_rows(docs, known, "toxic", per_class=10, max_chars=60)
    texts = {t: i for i, t in rows if t and i != 41} | {"y" * 500: 41}
    assert sum(not y for _, y in got) == 10 and all(not held(texts[t]) and texts[t] != 50 for t, _ in got)
    long = [len(t) for t, y in got if y]
    want = [n for i, n in sorted((i, len(t)) for t, i in texts.items() if i is not None and i >= 40 and not held(i) and i != 50)]
    assert sorted(long) == sorted(want)[: len(long)] and sum(long) <= 600 and 3 <= len(long)
    assert labels_of.chosen([(1, 10**6), (2, 5)], 1, 10) == [1]


def brute_quality(text):
    """Buckets of words, neighbouring words' pairs and n-grams, one by one."""
    parts = (text or "").encode().split()
    at = lambda h: int(h) >> (64 - quality.BUCKET_BITS)
    h = [Words([w]).hashes()[0] for w in parts]
    found = [at(x) for x in h] + [at(textfeatures.mixed(np.array([b]) - np.array([a]) + np.uint64(1))[0]) for a, b in zip(h, h[1:])]
    whole = b"\n" + (text or "").encode() + b"\n"
    space = b" \t\n\x0b\x0c\r"
    for n in quality.GRAMS:
        for i in range(len(whole) - n + 1):
            gram = whole[i : i + n]
            if not any(c in space for c in gram[1:-1]):
                value = np.uint64(128 + n)
                for k, c in enumerate(gram):
                    value ^= textfeatures._TABLE[k][32 if c in space else c]
                found.append(at(textfeatures.mixed(np.array([value]))[0]))
    return found


def test_queries_match_brute_force(tables):
    """op8's scores from features taken one by one; op1's from a forward-backward pass over plain lists."""
    rows, docs, labels = tables
    rows = rows[:40]
    docs = docs.where("doc_id < 40")
    model = quality.train([(t, q) for _, t, q, _ in corpus(60, 5)])
    got = {r["doc_id"]: r["score"] for r in quality.with_score(docs, model).collect()}
    for i, text, _, _ in rows:
        z = np.mean([float(model.weight[b]) for b in brute_quality(text)]) + model.bias
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-6
    model = toxicity.train([(t, x) for _, t, _, x in corpus(200, 5)])
    expected, largest, spans = model.documents([t for _, t, _, _ in rows])
    a = np.exp(model.transition)
    for k, (_, text, _, _) in enumerate(rows):
        words = text.lower().split(" ")
        x = [np.exp(np.clip(model.emission(Words([w.encode()]))[0], -30, 30)) for w in words]
        ahead, back = [np.array([1.0, 0.0])], np.ones(2)
        for e in x:
            v = ahead[-1] @ a * np.array([1, e])
            ahead.append(v / v.sum())
        p = []
        for t in range(len(x) - 1, -1, -1):
            both = ahead[t + 1] * back
            p.insert(0, both[1] / both.sum())
            back = a @ (back * np.array([1, x[t]]))
            back /= back.sum()
        want, at, last = [], 0, -2
        for t, w in enumerate(words):
            if p[t] >= 0.5:
                want = [*want[:-1], (want[-1][0], at + len(w))] if last == t - 1 else [*want, (at, at + len(w))]
                last = t
            at += len(w) + 1
        assert spans[k] == want and abs(expected[k] - sum(v for v in p if v >= 0.5)) < 1e-9 and abs(largest[k] - max(p)) < 1e-9
    z = toxicity.document_statistics(expected, largest) @ model.layer
    assert np.allclose(model.scores(expected, largest), 1 / (1 + np.exp(-z)))


def test_words_and_pieces():
    parts = [b"one two", b"", b" three\n", b"two"]
    w = Words(parts)
    assert [bytes(w.data[a:b]) for a, b in zip(w.start, w.end)] == [b"one", b"two", b"three", b"two"]
    assert w.doc.tolist() == [0, 0, 2, 3] and w.counts().tolist() == [2, 0, 1, 1]
    h = w.hashes()
    assert h[1] == h[3] and len(set(h.tolist())) == 3
    text = "abc " * 400_000
    assert b"".join(pieces(text)) == text.encode()
    assert [o for o, _ in batched(["a"] * 3)] == [[0, 1, 2]]


def test_quality_trains_in_a_task(tables, monkeypatch):
    """The driver holds neither texts nor features of the sample, and the model is the one that the same rows give anywhere."""
    _, docs, known = tables
    want, driver, plain = quality.train(labels_of.training_rows(docs, known, "quality")), os.getpid(), quality.train

    def watched(rows, seed=7):
        assert os.getpid() != driver
        return plain(rows, seed)

    monkeypatch.setattr(quality, "train", watched)
    got = quality.fit(docs, known)
    assert (got.weight == want.weight).all() and got.bias == want.bias and want.weight.any()
