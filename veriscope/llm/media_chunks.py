"""Media columns: content-defined chunks, deduplicated by digest joins.

A document's payload is its UTF-8 text, then bytes 255 up to a positive multiple of
FRAME. A rolling gear hash over the last 32 bytes cuts it where the hash's top bits
are zero, between MIN_CHUNK and MAX_CHUNK bytes. Chunks are named by a 128-bit digest;
a media object is an ordered list of chunk names with lengths, and the chunks.

1. All chunk names are counted (partial aggregation); names held by more than one
   payload are the shared ones. They go into a bit filter of FILTER_BITS bits, a size that does not
   depend on the data; a false positive only sends a chunk the longer way.
2. A payload without shared chunks is stored as one self-contained object, in the row of its document.
3. Payloads with shared chunks are stored in parts: shared chunks once each in a pool keyed
   by digest, the rest inline. Ordered chunk lists are joined to the pool by digest, and
   grouped by payload to rebuild the object. Equal payloads are rebuilt and stored once, and
   documents are joined to the stored object by the payload's digest.
4. Both kinds of objects are tables in the shared folder. ``media_objects`` returns every document's stored
   form from them, and ``media_report`` describes what it reads back from them.

The stored form is MAGIC, the number of chunks, (length, digest) for each chunk in order,
then the chunks; reading it back checks every digest. It depends on the text alone, so
equal texts have equal forms.

Defined cases: a null text is empty, and its payload is FRAME bytes of 255. A long text is chunked whole, block by block. Ties
do not arise: equal chunks have one name. Rows that
repeat a doc_id, and null ids, each give their row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir

FRAME = 576
MIN_CHUNK = 512
MAX_CHUNK = 8192
#: A cut is expected every 2 ** CUT_BITS bytes beyond MIN_CHUNK.
CUT_BITS = 11
WINDOW = 32
FILTER_BITS = 1 << 25
#: A batch of stored forms is passed on from this size.
OUT_BYTES = 8 << 20
MAGIC = b"CDM1"
_GEAR = np.random.Generator(np.random.PCG64(576)).integers(0, 1 << 32, 256, np.uint32)

STORED = ["doc_id", "payload_key", "n_bytes", "media", "place", "name", "chunk", "common"]
FORM = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded payload, and the number of bytes before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    whole = max(1, -(-len(raw) // FRAME)) * FRAME
    return raw.ljust(whole, b"\xff"), len(raw)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash of the WINDOW bytes up to each byte: sum of GEAR[byte] << age, in 32 bits."""
    h = _GEAR[data]
    span = 1
    while span < WINDOW:
        older = np.zeros_like(h)
        older[span:] = h[:-span]
        h = h + (older << np.uint32(span))
        span *= 2
    return h


def boundaries(data: bytes) -> list[int]:
    """End offsets of the chunks."""
    n, ends, start = len(data), [], 0
    block = 1 << 20  # the hash looks back WINDOW bytes only, so blocks overlap by that
    found = []
    for at in range(0, n, block):
        back = min(at, WINDOW)
        h = gear(np.frombuffer(data, np.uint8, min(block, n - at) + back, at - back))[back:]
        found.append(np.nonzero(h >> np.uint32(32 - CUT_BITS) == 0)[0] + at + 1)
    for cut_at in np.concatenate(found).tolist():
        while cut_at - start > MAX_CHUNK:
            start += MAX_CHUNK
            ends.append(start)
        if cut_at - start >= MIN_CHUNK:
            ends.append(cut_at)
            start = cut_at
    while n - start > MAX_CHUNK:
        start += MAX_CHUNK
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = boundaries(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def encode(parts: list[bytes], names: list[bytes]) -> bytes:
    head = b"".join(struct.pack("<I", len(c)) + d for c, d in zip(parts, names))
    return MAGIC + struct.pack("<I", len(parts)) + head + b"".join(parts)


def decode(form: bytes) -> list[bytes]:
    """The chunks of a stored form; raises ValueError if one does not match its name."""
    if form[:4] != MAGIC:
        raise ValueError("not a stored form")
    (n,) = struct.unpack_from("<I", form, 4)
    at, out = 8 + 20 * n, []
    for k in range(n):
        (size,) = struct.unpack_from("<I", form, 8 + 20 * k)
        out.append(form[at : at + size])
        at += size
        if digest(out[-1]) != form[12 + 20 * k : 28 + 20 * k]:
            raise ValueError(f"chunk {k} is not what its digest says")
    return out


def described(form: bytes, n_bytes: int) -> tuple:
    """What FORM lists, from a stored form that is read back here."""
    parts = decode(form)
    data = b"".join(parts)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / len(data)
    mean = float(counts @ np.arange(256)) / len(data)
    entropy = float(-(share * np.log2(share)).sum())
    feature = f"frames={len(data) // FRAME};chunks={len(parts)};mean={mean:.3f};entropy={entropy:.3f};peak={int(counts.argmax())}"
    return (n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature)


def _name_halves(name: bytes) -> tuple[int, int]:
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def _filter_word(hi: int) -> tuple[int, int]:
    bit = hi % FILTER_BITS
    return bit >> 6, bit & 63


def shared_filter(texts: DataFrame) -> np.ndarray:
    """The bit filter (64-bit words) over names of chunks that more than one payload holds, or one payload twice."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo = [], []
            for text in batch.column(1):
                for name in {digest(c) for c in chunks(payload(text.as_py())[0])}:
                    h, low = _name_halves(name)
                    hi.append(h)
                    lo.append(low)
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])

    shared = texts.mapInArrow(names, "hi long, lo long").groupBy("hi", "lo").count().where("count > 1")
    bit = F.pmod("hi", F.lit(FILTER_BITS))
    words = shared.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hi, {FILTER_BITS}) % 64 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    found = words.toArrow()  # FILTER_BITS / 64 rows at most, whatever the data
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``cut`` for tables of stored forms, with closer compression."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored tables: ``(doc_id, payload_key, n_bytes, media)`` for every row, where media is null if the payload has
    shared chunks, and ``(payload_key, n_bytes, media)`` for each of those payloads (payload_key is null for the others)."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(shared_filter(texts))

    def split(text: str | None) -> tuple[list[bytes], list[bytes], list[bool], int]:
        data, n = payload(text)
        parts = chunks(data)
        names = [digest(c) for c in parts]
        words = shared.value
        common = [bool(int(words[w]) >> b & 1) for w, b in (_filter_word(_name_halves(x)[0]) for x in names)]
        return parts, names, common, n

    part_types = [pa.int32(), pa.binary(), pa.binary(), pa.bool_()]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents' rows (place is null): the stored form of a payload of unshared chunks, the payload's name alone for others.
        Parts' rows, once for each batch and payload with shared chunks: its list, inline chunks, and shared chunks."""
        for batch in batches:
            seen, pooled, start, held, rows, parts_rows = set(), set(), 0, 0, [], []
            ids = batch.column(0)
            for at, text in enumerate(batch.column(1)):
                parts, names, common, n = split(text.as_py())
                if not any(common):
                    rows.append((None, n, encode(parts, names)))
                    held += len(rows[-1][2])
                else:
                    key = digest(b"".join(names))
                    rows.append((key, n, None))
                    if key not in seen:
                        seen.add(key)
                        for k, (part, name, is_common) in enumerate(zip(parts, names, common)):
                            sent = is_common and name in pooled
                            pooled.add(name)
                            parts_rows.append((key, n, k, name, None if sent else zlib.compress(part, 1), is_common))
                            held += 64 + len(parts_rows[-1][4] or b"")
                if held >= OUT_BYTES or at + 1 == batch.num_rows:
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.binary()))]
                    arrays += [pa.nulls(len(rows), t) for t in part_types]
                    yield pa.RecordBatch.from_arrays([ids.slice(start, len(rows)), *arrays], STORED)
                    if parts_rows:
                        key, n, *rest = zip(*parts_rows)
                        arrays = [pa.nulls(len(key), ids.type), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.nulls(len(key), pa.binary())]
                        yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, t) for c, t in zip(rest, part_types))], STORED)
                    start, held, rows, parts_rows = at + 1, 0, [], []

    def rebuild(key, group):
        rows = sorted(group.select(["place", "n_bytes", "name", "chunk"]).to_pylist(), key=lambda r: r["place"])
        last, parts, names = -1, [], []
        for r in rows:
            if r["place"] != last:  # a payload may have come from several batches
                parts.append(zlib.decompress(r["chunk"]))
                names.append(r["name"])
                last = r["place"]
        one = (key[0].as_py(), rows[0]["n_bytes"], encode(parts, names))
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(one, [pa.binary(), pa.int64(), pa.binary()])], ["payload_key", "n_bytes", "media"])

    whole = texts.mapInArrow(stored, f"doc_id {kind}, payload_key binary, n_bytes long, media binary, place int, name binary, chunk binary, common boolean")
    whole = _stored(whole, "media-stored")
    first = whole.where("place is null").select("doc_id", "payload_key", "n_bytes", "media")
    pieces = whole.where("place is not null").select(F.col("payload_key").alias("key"), "n_bytes", "place", "name", "chunk", "common")
    pool = cut(pieces.where("common").groupBy("name").agg(F.min("chunk").alias("pooled")), "media-pool")
    lists = pieces.where("common").select("key", "n_bytes", "place", "name").distinct().join(pool, "name")
    lists = lists.select("key", "n_bytes", "place", "name", F.col("pooled").alias("chunk"))
    inline = pieces.where("not common").select("key", "n_bytes", "place", "name", "chunk")
    objects = lists.unionByName(inline).groupBy("key").applyInArrow(rebuild, "payload_key binary, n_bytes long, media binary")
    return first, _stored(objects, "media-objects")


def media_objects(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)`` for every row of ``docs``: the stored form, of which the first n_bytes of the payload are the text."""
    first, objects = store(docs)
    joined = first.where("payload_key is not null").select("doc_id", "payload_key").join(objects, "payload_key")
    return first.where("payload_key is null").select("doc_id", "n_bytes", "media").unionByName(joined.select("doc_id", "n_bytes", "media"))


def read_back(stored: DataFrame, key: str) -> DataFrame:
    """``key`` and the columns of FORM, from a table with n_bytes and media."""
    kind = stored.schema[key].dataType.simpleString()
    columns = [c.split()[0] for c in FORM.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(form.as_py(), n.as_py()) for n, form in zip(batch.column(1), batch.column(2))]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, *columns])

    return stored.select(key, "n_bytes", "media").mapInArrow(run, f"{key} {kind}, {FORM}")


def media_report(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of FORM for every row of ``docs``, from the stored tables."""
    first, objects = store(docs)
    objects = cut(read_back(objects, "payload_key"), "media-described")
    joined = first.where("payload_key is not null").select("doc_id", "payload_key").join(objects, "payload_key")
    return read_back(first.where("payload_key is null"), "doc_id").unionByName(joined.drop("payload_key"))
