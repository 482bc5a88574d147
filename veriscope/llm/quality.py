"""Quality classifier: supervised subword embeddings.

Every word, character n-gram of 3 to 5 bytes (with word edges) and word pair owns a
learned vector by its hash; a document is the average of its vectors, and a
softmax over two classes scores it. Vectors and output layer are trained together by
stochastic gradient descent in numpy. A pair's hash is the difference of its words'
hashes, so all immediate repetitions share one vector.

For scoring, the output layer is multiplied into the vectors once (the average and the
product commute), which leaves one number for each bucket; that table is broadcast
and has a fixed size.

Defined cases: a null or empty text has the features of an empty line and gets a
number from 0 to 1 like any other; equal texts get equal scores. A text of any length is read whole, in pieces that
lose no word, pair or n-gram. Repeated rows and tied scores need no rule. With no labelled rows of
both classes nothing is learned and every score is 0.5 (accepted). Extra columns
pass through ``accepted``. doc_id, lang, source and labels are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, in_order, training_frame, unused
from .textfeatures import Words, batched, mixed

BUCKET_BITS = 18
DIM = 8
EPOCHS = 4
RATE = 40.0
GRAMS = (3, 4, 5)
CUT = 0.5


class Reader:
    """Features of pieces that come in order. A word's pair with the one before it crosses the edge of a piece."""

    def __init__(self):
        self.owner, self.last = -1, np.zeros(0, np.uint64)

    def features(self, owners: list[int], parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(piece number, bucket) arrays, in an order that depends on each piece and the word before it only."""
        words = Words(parts)
        shift = np.uint64(64 - BUCKET_BITS)
        h, owner, doc = words.hashes(), np.asarray(owners)[words.doc], words.doc
        yield doc, (h >> shift).astype(np.int64)
        if len(h):
            if owner[0] == self.owner:
                h, owner, doc = np.concatenate((self.last, h)), np.append(self.owner, owner), np.append(0, doc)
            self.owner, self.last = int(owner[-1]), h[-1:]
            same = owner[1:] == owner[:-1]
            yield doc[1:][same], (mixed((h[1:] - h[:-1])[same] + np.uint64(1)) >> shift).astype(np.int64)
        for n in GRAMS:
            for at, g in words.grams(n):
                yield np.maximum(np.searchsorted(words.first, at + 1, side="right") - 1, 0), (g >> shift).astype(np.int64)


class QualityModel:
    """``weight[bucket]`` and ``bias``: the log-odds that vectors and output layer come to."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight, bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        reader = Reader()
        for owners, parts in batched(texts):
            mine = np.asarray(owners)
            for doc, bucket in reader.features(owners, parts):
                if len(doc):
                    np.add.at(total, mine, np.bincount(doc, self.weight[bucket], len(parts)))
                    np.add.at(count, mine, np.bincount(doc, minlength=len(parts)))
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -60, 60)))


def train(rows: list[tuple[str, int]], seed: int = 7) -> QualityModel:
    """Fit on (text, label) rows; rows of one class only give the constant model."""
    size = 1 << BUCKET_BITS
    if len({y for _, y in rows}) < 2:
        return QualityModel(np.zeros(size, np.float32), 0.0)
    rng = np.random.Generator(np.random.PCG64(seed))
    documents = []
    for text, y in rows:
        reader = Reader()
        found = [b for owners, parts in batched([text]) for _, b in reader.features(owners, parts)]
        buckets, n = np.unique(np.concatenate(found), return_counts=True)
        documents.append((buckets, (n / max(n.sum(), 1)).astype(np.float32)[:, None], y))
    share = np.array([1.0, len(rows) / 2 / max(1, sum(y for _, y in rows))])
    share[0] = len(rows) / 2 / max(1, sum(1 - y for _, y in rows))
    vectors = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    output = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    steps, total = 0, EPOCHS * len(documents)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(documents)):
            buckets, part, y = documents[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            mean = (vectors[buckets] * part).sum(axis=0)
            z = mean @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= share[y]
            slope = output @ p
            vectors[buckets] -= rate * part * slope
            output -= rate / 100 * np.outer(mean, p)
            bias -= rate / 1000 * p
    side = output[:, 1] - output[:, 0]
    return QualityModel((vectors @ side).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """The model, trained on the bounded sample in a task: its texts and features take no memory of the driver, which gets the weights."""
    sample = training_frame(docs, labels, "quality")
    if sample is None:
        return train([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(in_order(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns))))
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"])

    found = sample.select("doc_id", "wanted", "text").repartition(1).mapInArrow(run, "weight binary, bias double").first()
    return train([]) if found is None else QualityModel(np.frombuffer(found["weight"], np.float32), found["bias"])


def with_score(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """``docs`` and a double ``column``; reads ``text`` alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))
    schema = docs.select("*", F.lit(0.0).alias(column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = QualityModel(*shared.value)
        for batch in batches:
            scores = model.scores(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, column])

    return docs.mapInArrow(run, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row."""
    scored = with_score(docs.select("doc_id", F.col("text").cast("string")), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns as they were."""
    (score,) = unused(docs.columns, "quality_score")
    return with_score(docs, fit(docs, labels), score).where(F.col(score) >= CUT).drop(score)
