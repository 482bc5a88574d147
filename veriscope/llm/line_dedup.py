"""Line dedup over levelled sorted runs of line hashes.

Documents arrive in batches. A batch counts its own line keys (documents that
hold the key, largest such doc_id), keyed by a 128-bit hash. A merge anti-join against the runs
leaves the keys that no run holds yet; these alone become a new sorted run on level 0,
so over all runs a key has exactly one entry, made by the batch that saw it first.
The batch's other keys are increments: they add to the entry of their key when the runs are read.
When a level has ``fan_in`` runs they are compacted: merge-joined into one sorted run of the
next level. Keys found in at least ``min_documents`` documents lose all lines but those of
the largest document.

Runs and batch counts are Parquet tables in the shared folder, bucketed and sorted by hash into as many
buckets as a shuffle has partitions. Buckets of two tables hold the same keys, so an anti-join or a
compaction reads bucket against bucket and shuffles nothing; a batch is shuffled once on its keys
when it is counted, after partial counts.

Defined cases: a null or empty text is one empty line; nothing is dropped from a
document with a null doc_id, and it counts for no key. Rows that repeat a doc_id
count as one document, and a kept key stays in each of them. Equal keys tie on the largest doc_id. A long text is hashed line by line
and its keys are passed on in slices. Extra columns pass through ``drop_lines`` unread.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard, shared_dir
from .labels import unused

MIN_CHARS = 40
MIN_DOCUMENTS = 5
N_BATCHES = 4
FAN_IN = 2
KEY = ["hi", "lo"]
#: Keys that leave a Python worker at once.
OUT_ROWS = 1 << 16


def line_key(line: bytes) -> bytes | None:
    """The stripped, A-Z lower-cased line, or None under MIN_CHARS code points."""
    key = line.strip().lower()
    if len(key) < MIN_CHARS or (not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < MIN_CHARS):
        return None
    return key


def _digest(key: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(key)


def _lines(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split(b"\n")


def line_hashes(docs: DataFrame) -> DataFrame:
    """``(doc_id, hi, lo)``: the distinct line keys of every document."""
    names = ["doc_id", "hi", "lo"]

    def batch_of(ids: list[int], sizes: list[int], digests: list[bytes]) -> pa.RecordBatch:
        both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = (np.repeat(np.array(ids, np.int64), sizes), both[:, 0].copy(), both[:, 1].copy())
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, digests = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                keys = {_digest(k) for line in _lines(text.as_py()) if (k := line_key(line)) is not None}
                ids.append(doc_id.as_py())
                sizes.append(len(keys))
                digests += keys
                if len(digests) >= OUT_ROWS:
                    yield batch_of(ids, sizes, digests)
                    ids, sizes, digests = [], [], []
        yield batch_of(ids, sizes, digests)

    picked = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, "doc_id long, hi long, lo long")


class LineRuns:
    """The levelled runs: bucketed ``(hi, lo, n_docs, last_doc)`` tables, a key in one of them only."""

    def __init__(self, spark, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.increments: list[DataFrame] = []
        self._tables: dict[str, DataFrame] = {}

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _written(self, rows: DataFrame) -> DataFrame:
        """A bucketed, sorted table of ``rows``; each bucket is one file if a task holds whole buckets."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", path).saveAsTable(name)
        self._tables[name] = self.spark.table(name)
        self._tables[name].__dict__["cut_path"] = path
        return self._tables[name]

    def add(self, counts: DataFrame) -> None:
        """Add a batch's counts (a row a key): keys that no run holds as a new run, the others as increments."""
        counts = self._written(counts)
        fresh = counts
        for run in self.runs():
            fresh = fresh.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        if self.runs():
            fresh = self._written(fresh)
            self.increments.append(counts.join(fresh.select(*KEY).hint("merge"), KEY, "left_anti"))
        self.levels[0].append(fresh)
        self._compact()

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fan_in:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                merged = runs[0]
                for run in runs[1:]:
                    other = run.select(*KEY, F.col("n_docs").alias("n"), F.col("last_doc").alias("last"))
                    merged = merged.join(other.hint("merge"), KEY, "full_outer").select(*KEY, F.coalesce("n_docs", "n").alias("n_docs"), F.coalesce("last_doc", "last").alias("last_doc"))
                self.levels[level + 1].append(self._written(merged))
                self.levels[level] = []

    def totals(self) -> DataFrame:
        """``(hi, lo, n_docs, last_doc)`` of every key: its entry and all increments to it."""
        whole = self.runs()[0]
        for run in self.runs()[1:]:
            whole = whole.unionByName(run)
        if not self.increments:
            return whole
        more = self.increments[0]
        for rows in self.increments[1:]:
            more = more.unionByName(rows)
        more = more.groupBy(*KEY).agg(F.sum("n_docs").alias("n"), F.max("last_doc").alias("last"))
        n_docs = F.col("n_docs") + F.coalesce("n", F.lit(0))
        return whole.join(more, KEY, "left").select(*KEY, n_docs.alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))

    def forget(self) -> None:
        """Drop the tables and delete their files; nothing that reads the runs works after that."""
        for name, rows in self._tables.items():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(rows)
        self._tables = {}


def batch_counts(hashes: DataFrame) -> DataFrame:
    """``(hi, lo, n_docs, last_doc)`` of a batch of ``(doc_id, hi, lo)``; repeats of a doc_id count once."""
    once = hashes.groupBy(*KEY, "doc_id").agg(F.lit(1)).groupBy(*KEY)
    return once.agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def repeated_keys(hashes: DataFrame, n_batches: int = N_BATCHES, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(hi, lo, last_doc)`` of keys that at least ``min_documents`` documents hold, written once."""
    runs = LineRuns(hashes.sparkSession)
    try:
        for batch in range(n_batches):
            runs.add(batch_counts(hashes.where(F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)) == batch)))
        return cut(runs.totals().where(F.col("n_docs") >= min_documents).select(*KEY, "last_doc"), "line-repeated")
    finally:
        runs.forget()


def _drops(docs: DataFrame, n_batches: int, min_documents: int) -> DataFrame:
    """``(doc, keys)``: the keys, 16 bytes each, that a document loses."""
    hashes = cut(line_hashes(docs), "line-hashes")
    dropped = repeated_keys(hashes, n_batches, min_documents)
    held = hashes.join(dropped, KEY).where(F.col("doc_id") < F.col("last_doc"))
    return held.select(F.col("doc_id").alias("doc"), F.struct(*KEY).alias("key")).groupBy("doc").agg(F.collect_set("key").alias("keys"))


def _filtered(docs: DataFrame, n_batches: int, min_documents: int) -> DataFrame:
    """``docs`` and, as the last column, the keys that each loses."""
    doc, keys = unused(docs.columns, "drop_doc", "drop_keys")
    drops = _drops(docs, n_batches, min_documents).toDF(doc, keys)
    return docs.join(drops, F.col("doc_id") == F.col(doc), "left").drop(doc)


def _keep(text: str | None, drops: pa.StructScalar) -> tuple[list[bytes], int]:
    lines = _lines(text)
    if not drops.is_valid:
        return lines, 0
    keys = drops.values
    both = np.stack([keys.field(k).to_numpy() for k in range(2)], axis=1).astype("<i8").tobytes()
    gone = {both[at : at + 16] for at in range(0, len(both), 16)}
    kept = [line for line in lines if (k := line_key(line)) is None or _digest(k) not in gone]
    return kept, len(lines) - len(kept)


def line_report(docs: DataFrame, n_batches: int = N_BATCHES, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_sha256)`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, sha = [], [], []
            for text, drops in zip(batch.column(1), batch.column(2)):
                kept, n = _keep(text.as_py(), drops)
                total.append(len(kept) + n)
                gone.append(n)
                sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
            out = [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = _filtered(docs, n_batches, min_documents)
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, n_batches: int = N_BATCHES, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text`` and ``n_chars`` counted anew; all other columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [
                b"\n".join(_keep(text.as_py(), drops)[0]).decode("utf-8", "surrogatepass") if drops.is_valid else text.as_py()
                for text, drops in zip(batch.column(at), batch.column(batch.num_columns - 1))
            ]
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    rows = _filtered(docs, n_batches, min_documents)
    out = rows.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out
