import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.llm import token_alignment as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.FOLDER), reason="no tokenizer files")


@pytest.fixture(scope="module")
def plain():
    """Both tokenizers by the libraries that read the files as they are."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{T.FOLDER}/{T.FILE_A}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{T.FOLDER}/{T.FILE_B}")
    letters = T.byte_letters()

    def run(text):
        """Tokens of A and B as (id, bytes); none where the bytes differ."""
        if not text:
            return [], []
        raw = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        in_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids_a]
        in_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace(chr(0x2581), " ").encode()) for i in ids_b]
        same = b"".join(x for _, x in in_a) == raw == b"".join(x for _, x in in_b)
        return (in_a, in_b) if same else ([], [])

    return run


def brute(rows, plain):
    each = []
    for i, text in rows:
        a, b = plain(text)
        ends = lambda ts: list(np.cumsum([len(x) for _, x in ts]))
        ea, eb = ends(a), ends(b)
        links = [(a[p][0], b[q][0]) for p in range(len(a)) for q in range(len(b)) if max(ea[p] - len(a[p][1]), eb[q] - len(b[q][1])) < min(ea[p], eb[q])]
        groups, p, q = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            np_, nq = ea.index(e) + 1, eb.index(e) + 1
            groups.append(f"{','.join(str(t) for t, _ in a[p:np_])}|{','.join(str(t) for t, _ in b[q:nq])}")
            p, q = np_, nq
        each.append((i, a, b, groups, links))
    held = Counter(k for r in each for k in set(r[4]))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, len(a), len(b), len(g), len(k), sum(held[x] == top[x[0]] for x in k), sum(held[x] for x in k), sha(g)) for i, a, b, g, k in each]


def cases():
    rng = random.Random(5)
    parts = ["word", "Tokenizers", " ", "  ", "   ", "\n", "\n\n", "\t", "\r\n", "\r", ";\r", ")", ";", "{", "don't", "'S", "<|endoftext|>", "</s>", "<s>", "<0x41>", "a_b", "12345", "...", "!!", "_", "x" * 70]
    parts += ["".join(map(chr, c)) for c in ((233, 116, 233), (0x65E5, 0x672C, 0x8A9E), (0x1D4B3,), (0xA0,), (0x3000,), (0x2003,), (0x1C,), (0x85,), (0xFB01,), (101, 0x301), (0x120,), (0x1F600,), (0,), (0x200B,))]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    odd = ["", None, " ", "\n", "a " + chr(0x2581) + " b", "plain words only here", "  leading", "trailing  ", "a" * 3000, "same text twice", "same text twice"]
    return list(enumerate([*texts, *odd])) + [(None, "no id"), (7, "same id"), (7, "same id")]


@pytest.mark.parametrize("slice_keys", [40, 1_000_000])
def test_matches_brute_force(spark, plain, slice_keys):
    rows = cases()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"slice": F.lit("clash"), "key": F.lit(1)}).repartition(3)
    got = [tuple(r) for r in T.alignment_report(df, slice_keys=slice_keys).collect()]
    want = brute(rows, plain)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] == 0 for r in want) >= 3 and sum(r[1] > 0 for r in want) > 250


def test_chunks_are_what_whole_texts_give(plain, monkeypatch):
    monkeypatch.setattr(T, "CACHED", 500)
    tools = T.Tokenizers(T.FOLDER)
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(chr(rng.choice((9, 10, 13, 32, 32, 32, 0xA0, 0x2003, 39, 41, 59, 125, 46, 48, 65, 97, 115, 233, 0x301, 0x4E00, 0x1F600, rng.randrange(1, 0xD000)))) for _ in range(rng.randrange(1, 25)))
        a, b = plain(text)
        found = tools.encoded(text)
        assert ([i for i, _ in a], [i for i, _ in b]) == (([], []) if found is None else tuple(x.tolist() for x in found))


def test_packing_and_empty(spark):
    keys, times = np.array([3, 9, 1 << 40, 1 << 47], np.int64), np.array([1, 2, 70_000, 1], np.int64)
    assert [list(x) for x in T.unpacked(T.packed(keys, times), 2)] == [list(keys), list(times)]
    assert [len(x) for x in T.unpacked(T.packed(keys[:0], times[:0]), 2)] == [0, 0]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.alignment_report(none).count() == 0
    assert T.pair_counts(spark.createDataFrame([(1, "a b"), (2, "a")], "doc_id long, text string")).agg(F.sum("n_docs")).first()[0] == 3
