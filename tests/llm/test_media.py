import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.llm import media_chunks as M


def test_gear_hash_is_the_rolling_one():
    data = bytes(random.Random(1).randrange(256) for _ in range(5000))
    h, want = 0, []
    for b in data:
        h = ((h << 1) + int(M._GEAR[b])) % 2**32
        want.append(h)
    assert M.gear(np.frombuffer(data, np.uint8)).tolist() == want


def test_round_trip_and_insertions():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 123) for _ in range(200_000))
    parts = M.chunks(data)
    assert b"".join(parts) == data and max(map(len, parts)) <= M.MAX_CHUNK
    assert all(len(p) >= M.MIN_CHUNK for p in parts[:-1])
    moved = M.chunks(data[:1000] + b"inserted" + data[1000:])
    assert len(set(moved) & set(parts)) >= len(parts) - 3  # cuts depend on content
    form = M.encode(parts, [M.digest(p) for p in parts])
    assert M.decode(form) == parts
    with pytest.raises(ValueError):
        M.decode(form[:-1] + bytes([form[-1] ^ 1]))


def brute_form(data):
    """The stored form, byte by byte: a cut where the rolling hash of the last bytes has 11 leading zeros, from 512 to 8,192 bytes."""
    pieces, start, h = [], 0, 0
    for at, byte in enumerate(data):
        h = (h * 2 + int(M._GEAR[byte])) % 2**32
        size = at + 1 - start
        if size == 8192 or (size >= 512 and h < 2**21) or at + 1 == len(data):
            pieces.append(data[start : at + 1])
            start = at + 1
    head = b"".join(struct.pack("<I", len(c)) + hashlib.blake2b(c, digest_size=16).digest() for c in pieces)
    return b"CDM1" + struct.pack("<I", len(pieces)) + head + b"".join(pieces)


def test_report(documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(6))
    passage = " ".join(word() for _ in range(6000))
    texts = [" ".join(word() for _ in range(n)) for n in (1, 50, 400, 3000, 30_000)]
    texts += [texts[3], texts[3], passage, word() + " " + passage, passage + " " + word(), None, "", "é" * 288, "a" * 576, "a" * 20_000, " ".join(f"{i}é☃" for i in range(150_000))]
    rows = [*enumerate(texts), (None, texts[2]), (1, texts[1])]
    docs = documents(rows).withColumns({"key": F.lit(1), "place": F.lit(2), "n_bytes": F.lit(3)})
    got = M.media_report(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, text in rows:
        raw = (text or "").encode()
        data = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        form = brute_form(data)
        want = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(form), hashlib.sha256(form).hexdigest())
        assert want in [g[:6] for g in by_text[i]]
    assert by_text[5] == by_text[6] == by_text[3] and by_text[10] == by_text[11]


def test_empty(documents):
    assert M.media_report(documents([])).count() == 0


def test_every_document_has_a_stored_object(documents):
    shared = " ".join(f"part{i}" for i in range(4000))
    texts = [shared, "head " + shared, shared, "alone " * 900, "", None, "naïve ☃"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    got = M.media_objects(documents(rows)).collect()
    assert len(got) == len(rows)
    want = {i: (t or "").encode() for i, t in rows}
    report = {r["doc_id"]: r for r in M.media_report(documents(rows)).collect()}
    for r in got:
        data = b"".join(M.decode(bytes(r["media"])))
        assert data[: r["n_bytes"]] == want[r["doc_id"]] and set(data[r["n_bytes"] :]) <= {255}
        assert report[r["doc_id"]]["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
