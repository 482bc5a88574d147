"""Alignment of two tokenizers over the same texts, with corpus-wide counts of linked id pairs.

A text (with a space before it) is encoded by A, a byte-level BPE, and by B, a sentence-piece BPE; both give back its bytes, so
their tokens are ranges of the same bytes. Where tokens of both end at one byte a group ends; a token of A and one of B that
overlap are a link. A link's key is one packed int64, A's id << 32 | B's id, and a key's count is the number of documents that hold it.

1. Texts are encoded and aligned in ``mapInArrow``. Neither tokenizer merges across the start of a run of white space (B's pieces are looked through for
   that when it is loaded; a carriage return is no such start), so a text is the chain of its chunks, white space with the word after it, and the ids of the chunks met last are
   kept, a bounded number of them. Token ends are marks over the text's bytes. A slice of at most about SLICE_KEYS keys of documents shares an id;
   ``np.unique`` gives its partial counts. Documents (keys sorted, packed by differences) and partial counts are written to the shared folder.
2. A task sums the partial counts it holds (``np.unique``); what is left is range-partitioned on the key and sorted, and runs of a key are summed: sorted
   count shards, a key in one of them only. The highest count of each id of A is a table of at most as many rows as A has ids.
3. The keys of a slice are joined to their counts. A task that looks up a slice writes its sorted keys and counts to a memory-mapped file, deleted
   when the slice is done, and looks its documents' keys up by ``searchsorted``. What it holds is bounded by SLICE_KEYS (or by one text, if that is larger), not by the corpus.

A's merges are applied by the faster of two libraries that read the same vocabulary; the ids are those of the vocabulary file.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an empty
groups_sha256; they hold no key. Every row is a document, so rows that repeat a doc_id (or have none) count one by one; ties for the highest count are
all best. Long texts are encoded whole. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

FOLDER = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_KEYS = 1_000_000
#: Fixed value: how the byte-level BPE splits a text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks whose ids a worker keeps, in two generations of this many, and the longest of them.
CACHED, CACHED_CHARS = 150_000, 64
#: Unicode's White_Space, and the sign that stands for a space in pieces.
SPACES = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
MARK = chr(0x2581)
#: A chunk begins where white space other than a carriage return follows something else: pieces do join a carriage return to what stands before it.
_CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+(?:\r[{SPACES}]*[^{SPACES}]+)*(?:\r[{SPACES}]*)?|[{SPACES}]+")
_CROSSING = re.compile(f"[^{SPACES}{MARK}][{SPACES.replace('\r', '')}{MARK}]")
#: One row a document; after those of a slice, one row for it.
TABLE = "slice string, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, held binary, part_keys binary, part_counts binary"


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and the decimal ids that a group is written in."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/{FILE_A}", encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [ranks[bytes(letters[c] for c in ("".join(m) if isinstance(m, list) else m.replace(" ", "")))] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of A do not follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
        self.bytes_b = [b""] * self.b.get_piece_size()
        for i in range(len(self.bytes_b)):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[3:5], 16)])
            elif not self.b.is_control(i) and not self.b.is_unknown(i):
                self.bytes_b[i] = piece.replace(MARK, " ").encode()
                if _CROSSING.search(piece):
                    raise ValueError("a piece of B crosses the start of white space")
        self.size_a, self.size_b = np.zeros(max(ranks.values()) + 1, np.int64), np.array(list(map(len, self.bytes_b)))
        for raw, i in ranks.items():
            self.size_a[i] = len(raw)
        #: Decimal ids with the sign that follows, zeros behind: A's with a comma, A's with a bar, B's with a comma, B's with a semicolon.
        written = [f"{i}{sign}".encode() for n, signs in ((len(self.size_a), ",|"), (len(self.size_b), ",;")) for sign in signs for i in range(n)]
        self.digits = np.array(written).view(np.uint8).reshape(len(written), -1)

        self.kept: dict[str, tuple] = {}
        self.before: dict[str, tuple] = {}

    def _new(self, chunks: list[str]) -> dict[str, tuple]:
        """Ids of chunks, as bytes of int32, by A and B; by B none where they do not give back the chunk. B's mark before a text is set against a letter, which is taken off again."""
        out = {}
        for chunk, b in zip(chunks, self.b.encode(["a" + c for c in chunks], num_threads=1)):
            raw = chunk.encode("utf-8", "surrogatepass")
            ids = array("i", b[1:]).tobytes() if b"".join([self.bytes_b[i] for i in b[1:]]) == raw else None
            out[chunk] = array("i", self.a.encode_ordinary(chunk)).tobytes(), ids
        return out

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and ``text``; None if either tokenizer gives back other bytes."""
        chunks = _CHUNK.findall(" " + text)
        found = list(map(self.kept.get, chunks))
        if None in found:
            missing = {c: self.before.get(c) for c, x in zip(chunks, found) if x is None}
            missing |= self._new([c for c, x in missing.items() if x is None])
            found = [x or missing[c] for c, x in zip(chunks, found)]
            self.kept.update((c, x) for c, x in missing.items() if len(c) <= CACHED_CHARS)
            if len(self.kept) > CACHED:
                self.kept, self.before = {}, self.kept
        if any(b is None for _, b in found):
            return None
        return tuple(np.frombuffer(b"".join([x[k] for x in found]), np.int32).astype(np.int64) for k in range(2))

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """The groups as text; ``last_*``: tokens that end one."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        upto_a, upto_b = np.nonzero(last_a)[0] + 1, np.nonzero(last_b)[0] + 1
        codes = np.zeros(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.append(0, upto_b)[group_a]] = a + last_a * len(self.size_a)
        codes[np.arange(len(b)) + upto_a[group_b]] = 2 * len(self.size_a) + b + last_b * len(self.size_b)
        out = self.digits[codes].ravel()
        return out[out != 0][:-1].tobytes()


@lru_cache(maxsize=2)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


def aligned(text: str | None, tools: Tokenizers) -> tuple:
    """(n_a, n_b, n_groups, n_links, groups_sha256, keys ascending, times of each)."""
    nothing = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
    raw = (" " + text).encode("utf-8", "surrogatepass") if text else b""
    ids = tools.encoded(text) if text else None
    if ids is None or tools.size_a[ids[0]].sum() != len(raw):
        return nothing
    a, b = ids
    end_a, end_b = np.cumsum(tools.size_a[a]), np.cumsum(tools.size_b[b])
    is_a, is_b = np.zeros(len(raw) + 1, bool), np.zeros(len(raw) + 1, bool)
    is_a[end_a] = is_b[end_b] = True
    ends = np.nonzero(is_a | is_b)[0]  # a link ends where either token does
    at_a, at_b = is_a[ends], is_b[ends]
    keys = a[np.cumsum(at_a) - at_a] << 32 | b[np.cumsum(at_b) - at_b]
    distinct, times = np.unique(keys, return_counts=True)
    sha = hashlib.sha256(tools.groups(a, b, is_b[end_a], is_a[end_b])).hexdigest()
    return len(a), len(b), int((at_a & at_b).sum()), len(keys), sha, distinct, times


def packed(*columns: np.ndarray) -> bytes:
    """int64 arrays of one length, the first one ascending, as planes of bytes of its differences and of the others."""
    import zstandard

    first = np.diff(columns[0], prepend=0)
    planes = [np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8).T) for c in (first, *columns[1:])]
    return zstandard.compress(b"".join(p.tobytes() for p in planes), 1)


def unpacked(blob: bytes, columns: int) -> list[np.ndarray]:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    each = [np.ascontiguousarray(p.T).view("<i8").ravel() for p in planes.reshape(columns, 8, -1)]
    return [np.cumsum(each[0]), *each[1:]]


def aligned_documents(docs: DataFrame, folder: str = FOLDER, slice_keys: int = SLICE_KEYS) -> DataFrame:
    """Rows of TABLE: each document with its packed keys, and after each slice its distinct keys with the number of documents that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tools, schema = tokenizers(folder), pa.schema([(n.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[n.split()[1]]) for n in TABLE.split(", ")])
        task, number, rows, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def batch_of(last: bool) -> pa.RecordBatch:
            name = f"{task}-{number}"
            out = [(name, *r, None, None) for r in rows]
            if last and size:
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                out.append((name, *[None] * 7, keys.astype("<i8").tobytes(), n.astype("<i8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n_a, n_b, n_groups, n_links, sha, keys, times = aligned(text.as_py(), tools)
                rows.append((doc_id, n_a, n_b, n_groups, n_links, sha, packed(keys, times)))
                held.append(keys)
                size += len(keys)
                if size >= slice_keys:
                    yield batch_of(True)
                    number, rows, held, size = number + 1, [], [], 0
                elif len(rows) >= 2000:
                    yield batch_of(False)
                    rows = []
        if rows or size:
            yield batch_of(True)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TABLE)


def slice_counts(table: DataFrame) -> DataFrame:
    """``(slice, key, n)``: the partial counts of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                key, count = np.frombuffer(keys, "<i8"), np.frombuffer(n, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key), pa.array(count)], ["slice", "key", "n"])

    return table.where("part_keys is not null").select("slice", "part_keys", "part_counts").mapInArrow(run, "slice string, key long, n long")


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, n)
    return distinct, total


def count_shards(table: DataFrame) -> DataFrame:
    """``(key, n)``: documents that hold each key, in shards sorted by key."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for more, counts in zip(*(c.to_pylist() for c in batch.columns)):
                keys, n = _sums(np.append(keys, np.frombuffer(more, "<i8")), np.append(n, np.frombuffer(counts, "<i8")))
                if len(keys) > 4 * SLICE_KEYS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
                    keys, n = keys[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # rows are sorted: all runs but the last one of a batch are whole
            keys = np.append(keys, batch.column(0).to_numpy())
            heads = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0] if len(keys) else np.zeros(0, np.int64)
            n = np.append(n, batch.column(1).to_numpy())
            if len(heads):
                keys, n = keys[heads], np.add.reduceat(n, heads)
                yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(n[:-1])], ["key", "n"])
                keys, n = keys[-1:], n[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    parts = table.where("part_keys is not null").select("part_keys", "part_counts").mapInArrow(partial, "key long, n long")
    shards = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(runs, "key long, n long")


def _looked_up(rows: DataFrame) -> DataFrame:
    """Documents with ``n_best`` and ``count_sum``; ``rows`` has each slice's keys in order, and then its documents."""
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name, size, mapped = None, None, 0, None
        try:
            for batch in batches:
                at, slices, is_doc = 0, batch.column(0).to_pylist(), batch.column(1).to_pylist()
                bounds = [k for k in range(1, batch.num_rows) if slices[k] != slices[k - 1] or is_doc[k] != is_doc[k - 1]]
                for end in [*bounds, batch.num_rows]:
                    part = batch.slice(at, end - at)
                    if slices[at] != name:
                        if shard:
                            shard.close()
                        shard, name, size, mapped = tempfile.TemporaryFile(), slices[at], 0, None
                    if not is_doc[at]:
                        shard.write(np.stack([part.column(k).to_numpy() for k in (2, 3, 4)], axis=1).astype("<i8").tobytes())
                        size += len(part)
                    else:
                        if mapped is None:
                            shard.flush()
                            mapped = np.memmap(shard, "<i8", "r", shape=(size, 3)) if size else np.zeros((0, 3), np.int64)
                        best, total = [], []
                        for blob in part.column(part.num_columns - 1).to_pylist():
                            keys, times = unpacked(blob, 2)
                            place = np.searchsorted(mapped[:, 0], keys)
                            counts, top = mapped[place, 1], mapped[place, 2]
                            best.append(int(times[counts == top].sum()))
                            total.append(int(times @ counts))
                        columns = [part.column(5 + k) for k in range(len(names))]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.int64()), pa.array(total, pa.int64())], [*names, "n_best", "count_sum"])
                    at = end
        finally:
            if shard:
                shard.close()

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def pair_counts(docs: DataFrame, folder: str = FOLDER) -> DataFrame:
    """``(a_id, b_id, n_docs)``: the documents that hold each linked pair of ids."""
    counts = count_shards(cut(aligned_documents(docs, folder), "aligned"))
    return counts.select(F.shiftright("key", 32).cast("int").alias("a_id"), F.col("key").bitwiseAND((1 << 32) - 1).cast("int").alias("b_id"), F.col("n").alias("n_docs"))


def alignment_report(docs: DataFrame, folder: str = FOLDER, slice_keys: int = SLICE_KEYS) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row of ``docs``."""
    found = cut(aligned_documents(docs, folder, slice_keys), "aligned")
    counts = cut(count_shards(found), "pair-counts").withColumn("a", F.shiftright("key", 32))
    top = cut(counts.groupBy("a").agg(F.max("n").alias("top")), "pair-tops")  # at most a row for each id of A
    counts = counts.join(F.broadcast(top), "a").select("key", F.col("n").alias("count"), "top")
    keys = slice_counts(found).join(counts, "key")
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held"]
    none = {f.name: f.dataType for f in found.schema}
    keys = keys.select("slice", F.lit(False).alias("is_doc"), "key", "count", "top", *[F.lit(None).cast(none[c]).alias(c) for c in kept])
    null = F.lit(None).cast("long")
    rows = found.where("held is not null").select("slice", F.lit(True).alias("is_doc"), null.alias("key"), null.alias("count"), null.alias("top"), *kept)
    out = _looked_up(keys.unionByName(rows).repartition("slice").sortWithinPartitions("slice", "is_doc", "key"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
