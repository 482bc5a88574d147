"""Each stage against a brute-force version of its decisions, on its own input."""

import random
import re
import string

import corpus_pipeline as P
from veriscope.llm import mixing, packing, quality
from veriscope.session import cut


def build(spark, tmp_path):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(("an", "or", "thé", "in", "ea", "st", "ou")) for _ in range(rng.randrange(1, 4)))
    shared = " ".join(word() for _ in range(20))
    rows, labels = [], []
    for i in range(240):
        text = " ".join(word() for _ in range(rng.randrange(40, 200)))
        good = int(i % 5 != 0)
        if not good:
            text = " ".join(w + "###" for w in text.split())
        if good and i % 6 == 1:
            text += "\n" + shared
        if good and i % 11 == 3:
            text = rows[1][1]
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, good, 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows


def brute_texts(rows):
    """Text of each document after the line stage, line by line."""
    key = lambda line: line.strip("\x20\t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    holders = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if r["doc_id"] is not None and len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(r["doc_id"])

    def stays(i, line):
        held = holders.get(key(line), ())
        return i is None or len(held) < 5 or i == max(held)

    return {r["doc_id"]: r["text"] and "\n".join(x for x in r["text"].split("\n") if stays(r["doc_id"], x)) for r in rows}


def brute_groups(texts):
    """Smallest document of each group of texts with a shingle similarity of 0.8 or more, pair by pair."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {i: shingles(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    close = [(i, j) for i in texts for j in texts if i < j and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))]
    for _ in label:
        for i, j in close:
            label[i] = label[j] = min(label[i], label[j])
    return label


#: Columns of the user with names that the stages could want for themselves.
RESERVED = ["'a' as quality_score", "'b' as drop_doc", "'c' as drop_keys", "'d' as mix_key", "'e' as MIX_TIMES", "'f' as pack_key", "'g' as pack_turn", "'h' as __quality", "'i' as __drops", "'j' as __drop_doc", "'k' as __mix_key", "'l' as __pack_key"]


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing names, a very long text, no labels, and an empty table."""
    long = "\n".join(f"line {i} of a long text with words of its own" for i in range(30_000))
    rows = [(1, "a few words that stay here", "s0"), (1, "a few words that stay here", "s0"), (2, None, None), (3, "", "s1"), (None, "no id but some words", "s1"), (4, long, "s2"), (5, long + " more", "s2"), (6, " \n", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.selectExpr("doc_id", "text", "'en' as lang", "source", "length(text) as n_chars", "1 as component_id", "'x' as hi", "2 as pack_bound", "3 as size", "'y' as fp", *RESERVED)
    for name, table in (("full", docs), ("none", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in P.STAGES[:3]:
        kept = cut(stage(spark, kept, f"{tmp_path}/full"), "stage")
        assert kept.columns == docs.columns
        got = kept.collect()
        assert len(got) == (5 if name == "simhash near-dedup" else 8)
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "2", "4", "None"]
    out = P.run(spark, f"{tmp_path}/full").collect()
    mine = [x.split(" as ") for x in RESERVED]
    assert all(r[name] == value.strip("'") for r in [*got, *out] for value, name in mine)
    assert {r["doc_id"] for r in out} <= {1, 4, None} and any(r["pack_length"] > 250_000 for r in out)
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_stages(spark, tmp_path):
    rows = build(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    inputs, columns = [docs], docs.columns
    for name, stage in P.STAGES:
        inputs.append(cut(stage(spark, inputs[-1], str(tmp_path)), "stage"))
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "source mixing", "packing"]
    assert all(d.columns == columns for d in inputs[:-1]) and inputs[-1].columns[: len(columns)] == columns
    stages = [[r.asDict() for r in d.collect()] for d in inputs]

    scores = {r["doc_id"]: r["score"] for r in quality.quality_report(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    kept = {r["doc_id"] for r in stages[1]}
    assert kept == {i for i, s in scores.items() if s >= 0.5}
    clean = {i for i in range(240) if i % 5}
    assert len(kept & clean) >= 0.98 * len(clean) and len(kept & (set(range(240)) - clean)) <= 2

    want = brute_texts(stages[1])
    after = {r["doc_id"]: r["text"] for r in stages[2]}
    assert after == want and sum(after[r["doc_id"]] != r["text"] for r in stages[1]) > 10
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in stages[2])

    label = brute_groups({r["doc_id"]: r["text"] for r in stages[2]})
    assert {r["doc_id"] for r in stages[3]} == {i for i in label if label[i] == i} and len(stages[3]) < len(stages[2])

    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix_report(inputs[3]).collect()}
    copies = {}
    for r in stages[4]:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    for i, (t, s) in taken.items():
        assert abs(copies.get(i, 0) - (t / s if s else 0)) <= 0.5 + 1e-9

    assert len(stages[5]) == len(stages[4])
    lengths = sorted(len((r["text"] or "").split()) for r in stages[4])
    assert sorted(r["pack_length"] for r in stages[5]) == lengths
    bounds = sorted({r["pack_bound"] for r in stages[5]})
    distinct = sorted(set(lengths))
    import numpy as np

    assert bounds == packing.optimal_bounds(np.array(distinct), np.array([lengths.count(x) for x in distinct]), packing.N_BUCKETS)
    assert len(rows) == 242


def test_run(spark, tmp_path):
    build(spark, tmp_path)
    out = P.run(spark, str(tmp_path))
    assert out.count() > 0 and "pack_batch" in out.columns
