"""Toxicity: a two-state linear-chain conditional random field over tokens.

Labelled tokens come from labelled documents: a word, or a word beginning, that a
share of SURE or more of its (class-balanced) training documents are toxic ones marks its
tokens in them, if a COMMON share of the toxic documents has it. Near copies in the
training sample count once. The field has hashed word and beginning features for the
toxic state and a 2 x 2 transition table, trained by AdaGrad on forward-backward
marginals. In scoring, forward-backward runs exactly over each whole document, in
blocks of BLOCK tokens: block products first, then a scan over blocks, then inside
all blocks at once. A long text is read in pieces that end at white space; the forward vector goes from piece to
piece and the backward vector back, so pieces change nothing. Marginals aggregate to a document score (logistic in the expected
number of toxic tokens among those that are likelier toxic than not, and the largest
marginal), and runs of such tokens are the offending spans, in code points.

Defined cases: a null or empty text has no tokens and no spans and gets the score
of an expectation of zero. A text of any length is scored whole. With no labelled rows of both classes nothing is learned and all
scores are 0. Equal texts get equal scores; repeated rows, ties and clashing extra
columns do not matter. doc_id, lang, source and labels are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_out, training_rows
from .textfeatures import Words, batched, pieces

BUCKET_BITS = 20
BLOCK = 64
PREFIXES = (4, 5, 6)
SURE = 0.97
COMMON = 0.015
EPOCHS = 15
CUT = 0.7
N_FEATURES = 1 + len(PREFIXES)


def token_features(words: Words) -> np.ndarray:
    """Bucket of each feature of each token; shape (tokens, N_FEATURES)."""
    kinds = [words.hashes(), *[words.prefixes(n) for n in PREFIXES]]
    shift = np.uint64(64 - BUCKET_BITS)
    return np.stack([(h >> shift).astype(np.int64) for h in kinds], axis=1) if len(words.start) else np.zeros((0, N_FEATURES), np.int64)


class Blocks:
    """Tokens of documents laid out as rows of BLOCK places; ``real`` marks the filled ones."""

    def __init__(self, counts: np.ndarray):
        self.per_doc = -(-counts // BLOCK)
        self.first = np.cumsum(self.per_doc) - self.per_doc
        n = int(self.per_doc.sum())
        token = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        self.place = np.repeat(self.first, counts) * BLOCK + token
        self.real = np.zeros(n * BLOCK, bool)
        self.real[self.place] = True
        self.real = self.real.reshape(n, BLOCK)

    def spread(self, values: np.ndarray, fill: float) -> np.ndarray:
        out = np.full(self.real.size, fill)
        out[self.place] = values
        return out.reshape(self.real.shape)


def _scan(blocks: Blocks, product: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward vector before, and backward vector after, each block of its document; then the forward vector
    after, and the backward vector before, each document. Vectors are (2, number)."""
    n = product.shape[2]
    before, after = np.zeros((2, n)), np.ones((2, n))
    most = int(blocks.per_doc.max(initial=0))
    order = np.argsort(-blocks.per_doc, kind="stable")
    sizes, first = blocks.per_doc[order], blocks.first[order]
    live = np.searchsorted(-sizes, -np.arange(most), side="left")  # documents with more than k blocks
    ahead, back = begin[:, order].copy(), stop[:, order].copy()
    for k in range(most):
        at, now = first[: live[k]] + k, ahead[:, : live[k]]
        before[:, at] = now
        step = product[:, :, at]
        moved = now[0] * step[0] + now[1] * step[1]
        ahead[:, : live[k]] = moved / (moved[0] + moved[1])
    for k in range(most - 1, -1, -1):
        at, now = first[: live[k]] + k, back[:, : live[k]]
        after[:, at] = now
        step = product[:, :, at]
        moved = step[:, 0] * now[0] + step[:, 1] * now[1]
        back[:, : live[k]] = moved / (moved[0] + moved[1])
    inverse = np.argsort(order)
    return before, after, ahead[:, inverse], back[:, inverse]


class Field:
    """The chains of some documents: block products, then marginals from any forward and backward vectors at the ends.

    ``emission`` is each token's log-potential of the toxic state over the clean one."""

    def __init__(self, emission: np.ndarray, blocks: Blocks, transition: np.ndarray):
        self.blocks, self.a = blocks, np.exp(transition)
        self.x = np.exp(np.clip(blocks.spread(emission, 0.0), -30, 30))
        a, n = self.a, len(self.x)
        product = np.zeros((2, 2, n))
        product[0, 0] = product[1, 1] = 1.0
        for t in range(BLOCK):
            real = blocks.real[:, t]
            if not real.any():
                break
            clean = product[:, 0] * a[0, 0] + product[:, 1] * a[1, 0]
            toxic = (product[:, 0] * a[0, 1] + product[:, 1] * a[1, 1]) * self.x[:, t]
            total = clean[0] + clean[1] + toxic[0] + toxic[1]
            product = np.where(real, np.stack([clean / total, toxic / total], axis=1), product)
        self.product = product

    def passed(self, begin: np.ndarray) -> np.ndarray:
        """The forward vectors after the documents."""
        return _scan(self.blocks, self.product, begin, np.ones_like(begin))[2]

    def marginals(self, begin: np.ndarray, stop: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginal of the toxic state by token, backward vectors before the documents, and, if ``pairs``, the expected
        transitions 2 x 2 summed over tokens)."""
        blocks, x, a = self.blocks, self.x, self.a
        n = len(x)
        before, back, _, early = _scan(blocks, self.product, begin, stop)
        forward = np.zeros((BLOCK + 1, 2, n))
        forward[0] = before
        for t in range(BLOCK):
            clean = forward[t, 0] * a[0, 0] + forward[t, 1] * a[1, 0]
            toxic = (forward[t, 0] * a[0, 1] + forward[t, 1] * a[1, 1]) * x[:, t]
            forward[t + 1] = np.where(blocks.real[:, t], np.stack([clean, toxic]) / (clean + toxic), forward[t])
        marginal, expected = np.zeros((n, BLOCK)), np.zeros((2, 2))
        for t in range(BLOCK - 1, -1, -1):
            real = blocks.real[:, t]
            both = forward[t + 1] * back
            marginal[:, t] = both[1] / (both[0] + both[1])
            clean, toxic = back[0], back[1] * x[:, t]
            if pairs:
                pair = forward[t][:, None] * a[:, :, None] * np.stack([clean, toxic])[None]
                expected += (pair / pair.sum(axis=(0, 1)))[:, :, real].sum(axis=2)
            moved = np.stack([clean * a[0, 0] + toxic * a[0, 1], clean * a[1, 0] + toxic * a[1, 1]])
            back = np.where(real, moved / (moved[0] + moved[1]), back)
        return marginal.ravel()[blocks.place], early, expected


def ends(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward vectors before, and backward vectors after, n whole documents: each begins after a virtual clean token."""
    return np.tile([[1.0], [0.0]], (1, n)), np.ones((2, n))


def forward_backward(emission: np.ndarray, blocks: Blocks, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of the toxic state by token, expected transitions 2 x 2 summed over tokens) of whole documents."""
    p, _, expected = Field(emission, blocks, transition).marginals(*ends(len(blocks.per_doc)), pairs=True)
    return p, expected


def _points(data: np.ndarray) -> np.ndarray:
    """Code points that begin at or before each byte."""
    return np.cumsum((data & 0xC0) != 0x80)


def _runs(p: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of each run of tokens that are likelier toxic than not."""
    hot = np.nonzero(p >= 0.5)[0]
    glue = (np.diff(hot) == 1) & (doc[hot[1:]] == doc[hot[:-1]])
    edge = np.array([True])[: len(hot)]
    return hot[np.concatenate((edge, ~glue))], hot[np.concatenate((~glue, edge))]


class ToxicityModel:
    """Feature weights, bias, transitions, and the logistic layer over document statistics."""

    def __init__(self, weight: np.ndarray, bias: float, transition: np.ndarray, layer: np.ndarray | None):
        self.weight, self.bias, self.transition, self.layer = weight, bias, transition, layer

    def emission(self, words: Words) -> np.ndarray:
        return self.weight[token_features(words)].sum(axis=1, dtype=np.float64) + self.bias

    def documents(self, texts: list[str | None], spans: bool = True) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]]]:
        """(expected toxic tokens, largest marginal, spans) of each text."""
        expected, largest = np.zeros(len(texts)), np.zeros(len(texts))
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        short: list[int] = []
        for i, text in enumerate(texts):
            parts = list(pieces(text))
            if len(parts) == 1:
                short.append(i)
            else:
                expected[i], largest[i], found[i] = self._long(parts)
        for owners, parts in batched([texts[i] for i in short]):
            words = Words(parts, lower=True)
            if not len(words.start):
                continue
            p, _, _ = Field(self.emission(words), Blocks(words.counts()), self.transition).marginals(*ends(len(parts)))
            owner = np.array(short)[np.array(owners)[words.doc]]
            np.add.at(expected, owner, np.where(p >= 0.5, p, 0.0))
            np.maximum.at(largest, owner, p)
            if spans:
                heads, tails = _runs(p, words.doc)
                points = _points(words.data)
                base = points[words.first[words.doc[heads]] - 1]
                for i, a, b in zip(owner[heads].tolist(), (points[words.start[heads] - 1] - base).tolist(), (points[words.end[tails] - 1] - base).tolist()):
                    found[i].append((a, b))
        return expected, largest, found

    def _long(self, parts: list[bytes]) -> tuple[float, float, list[tuple[int, int]]]:
        """The same for a text of several pieces: forward vectors are carried over the pieces in order, backward
        vectors in turn, so the field is that of the whole text."""
        begin, stop = ends(1)
        begins, bases = [begin], [0]
        for part in parts:
            words = Words([part], lower=True)
            field = Field(self.emission(words), Blocks(words.counts()), self.transition)
            begins.append(field.passed(begins[-1]))
            bases.append(bases[-1] + int(_points(words.data[1:-1])[-1]))
        total, most, late, late_hot = 0.0, 0.0, [], False
        for part, begin, base in zip(parts[::-1], begins[-2::-1], bases[-2::-1]):
            words = Words([part], lower=True)
            if not len(words.start):
                continue
            p, stop, _ = Field(self.emission(words), Blocks(words.counts()), self.transition).marginals(begin, stop)
            total += float(p[p >= 0.5].sum())
            most = max(most, float(p.max()))
            heads, tails = _runs(p, words.doc)
            points = _points(words.data)
            here = list(zip((points[words.start[heads] - 1] - 1 + base).tolist(), (points[words.end[tails] - 1] - 1 + base).tolist()))
            if late_hot and p[-1] >= 0.5:  # a run that goes on in the next piece
                here[-1] = (here[-1][0], late.pop()[1])
            late += here[::-1]
            late_hot = bool(p[0] >= 0.5)
        return total, most, late[::-1]

    def scores(self, expected: np.ndarray, largest: np.ndarray) -> np.ndarray:
        if self.layer is None:
            return np.zeros(len(expected))
        z = document_statistics(expected, largest) @ self.layer
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def document_statistics(expected: np.ndarray, largest: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(expected)), np.log1p(expected), largest], axis=1)


def token_labels(features: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """0/1 for each token: whether its word or a beginning of it is found in toxic documents almost only."""
    size = 1 << BUCKET_BITS
    used = range(1 + len(PREFIXES))
    seen = np.zeros((2, len(used), size))
    for f, y in zip(features, labels):
        for k in used:
            seen[y, k, np.unique(f[:, k])] += 1
    total = np.maximum(np.bincount(labels, minlength=2), 1)
    toxic, clean = seen[1] / total[1], seen[0] / total[0]
    sure = (seen[1] >= max(2, COMMON * total[1])) & (toxic / np.maximum(toxic + clean + 0.2 / total[0], 1e-9) >= SURE)
    return [
        (np.any([sure[k, f[:, k]] for k in used], axis=0) if y else np.zeros(len(f), bool)).astype(np.float64)
        for f, y in zip(features, labels)
    ]


def _sketch(features: np.ndarray) -> tuple[int, ...]:
    """The three smallest word buckets: near copies have them in common."""
    return tuple(np.unique(features[:, 0] * 2654435761 % (1 << 32))[:3].tolist())


def train(rows: list[tuple[str, int]]) -> ToxicityModel:
    size = 1 << BUCKET_BITS
    weight, transition = np.zeros(size), np.zeros((2, 2))
    if len({y for _, y in rows}) < 2:
        return ToxicityModel(weight.astype(np.float32), 0.0, transition, None)
    distinct = {}
    for text, y in rows:
        found = np.concatenate([token_features(Words(parts, lower=True)) for _, parts in batched([text])])
        distinct.setdefault((y, _sketch(found)), (text, y, found))
    rows = [(text, y) for text, y, _ in distinct.values()]
    features = [found for _, _, found in distinct.values()]
    labels = np.array([y for _, y in rows], np.int64)
    tags = token_labels(features, labels)
    marked = [i for i in range(len(rows)) if tags[i].any() or not labels[i]]
    f = np.concatenate([features[i] for i in marked])
    y = np.concatenate([tags[i] for i in marked])
    blocks = Blocks(np.array([len(features[i]) for i in marked]))
    ids, where = np.unique(f, return_inverse=True)
    where = where.reshape(f.shape)
    theta, bias = np.full(len(ids), 0.0), -4.0
    previous = np.concatenate(([0.0], y[:-1]))
    starts = np.cumsum([len(features[i]) for i in marked]) - [len(features[i]) for i in marked]
    previous[starts[starts < len(previous)]] = 0.0
    observed = np.array([[np.sum((previous == i) & (y == j)) for j in (0, 1)] for i in (0, 1)], float)
    seen, turned = np.full(len(ids), 1e-6), np.full((2, 2), 1e-6)  # squared slopes so far; the bias stays
    for _ in range(EPOCHS):
        p, expected = forward_backward(theta[where].sum(axis=1) + bias, blocks, transition)
        gap = np.repeat(y - p, N_FEATURES)
        slope = np.bincount(where.ravel(), gap, len(ids)) - 1e-3 * theta
        seen += slope**2
        theta += 0.5 * slope / np.sqrt(seen)
        slope = observed - expected
        turned += slope**2
        transition = transition + 0.2 * slope / np.sqrt(turned)
    weight[ids] = theta
    model = ToxicityModel(weight.astype(np.float32), bias, transition, None)
    expected, largest, _ = model.documents([text for text, _ in rows], spans=False)
    x = document_statistics(expected, largest)
    balance = len(rows) / 2 / np.bincount(labels, minlength=2)[labels]
    layer = np.zeros(3)
    for _ in range(30):  # Newton steps of a ridge logistic fit
        p = 1 / (1 + np.exp(-np.clip(x @ layer, -30, 30)))
        slope = x.T @ (balance * (labels - p)) - 0.1 * layer
        curve = (x * (balance * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        layer = layer + np.linalg.solve(curve, slope)
    model.layer = layer
    return model


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return train(training_rows(docs, labels, "toxic", per_class=2500, max_chars=6000))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_spans, spans)``; spans are ``start:end`` in code points, comma-joined."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.transition, model.layer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(*shared.value)
        for batch in batches:
            expected, largest, spans = model.documents(batch.column(1).to_pylist())
            scores = model.scores(expected, largest)
            text = [",".join(f"{a}:{b}" for a, b in s) for s in spans]
            columns = [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= CUT).astype(np.int32))]
            columns += [pa.array([len(s) for s in spans], pa.int64()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "n_spans", "spans"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_spans long, spans string")
