"""Groups of documents whose word-shingle sets have a Jaccard similarity of 0.8 or more, found without a loss.

Two sets of that similarity share one of their first n // 5 + 1 shingles in any common order (prefix filter). The order here is rare
first: by a count sketch of SKETCH counters, whose size does not depend on the data, then by hash. A block that many pages have in common ranks
last, so templated pages do not meet.

1. One pass gives each document's fingerprint, the digest of its set, and the sketch. Documents with equal sets are one node.
2. A second pass gives the prefixes; those shingles that one document alone has go (a bit filter of fixed size, then an exact join).
3. Leads: a node is compared with the smallest node of the shingle lists that most of its prefix falls into, and with the smallest of its SimHash
   component (``simhash_dedup.near_links``). In a group of close copies that links nearly all, with one or two comparisons a node.
4. Lists that then still hold nodes of more than one group: pairs of nodes from different groups are counted by their common prefix
   shingles; c common ones leave room for at most c + max(n - prefix) common shingles in all, and pairs that cannot reach
   the similarity go. A list whose pairs would be more than WIDE times its nodes is compared in blocks of BLOCK nodes inside tasks instead, which
   return links only.
5. What is left is compared by exact sets of 64-bit shingle hashes.

Defined cases: texts with equal sets are one node; texts without words are one group; a text of fewer
words than the shingle is one shingle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut, discard
from .bits import bit_filter, passes

SKETCH = 1 << 22
SEGMENTS = 1024
BLOCK = 256
WIDE = 64
#: The least similarity, as a fraction.
LEAST = (4, 5)
_FIRST = "doc_id long, fp long, set_a long, set_b long, segment long, counts binary"


def prefix_length(n):
    """Of n shingles, those of which two similar sets share one."""
    return n - (n * LEAST[0] + LEAST[1] - 1) // LEAST[1] + 1


def prefix(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones first."""
    order = np.lexsort((hashes, sketch[(hashes & np.uint64(SKETCH - 1)).astype(np.int64)]))
    return hashes[order[: prefix_length(len(hashes))]] if len(hashes) else hashes


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first member of its group, by links of LEAST or more."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    label = np.arange(n)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    member = np.zeros(token.max() + 1 if len(token) else 1, np.int64)
    for i in range(n):
        if (label == label[0]).all():
            break
        mine = token[starts[i] : ends[i]]
        member[mine] = 1
        both = np.add.reduceat(member[token], starts)
        member[mine] = 0
        close = np.nonzero(both * LEAST[1] >= LEAST[0] * (sizes[i] + sizes - both))[0]
        if len(close):
            met = np.unique(np.append(label[close], label[i]))
            label[np.isin(label, met)] = met[0]
    return label


def tally(counts: np.ndarray, places: list[np.ndarray]) -> None:
    """Add one for each of ``places`` to counters of a byte, which stop at 255."""
    at, more = np.unique(np.concatenate(places), return_counts=True)
    counts[at] = np.minimum(counts[at] + more, 255)


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """A row of _FIRST for each document (fingerprint and set digest), and SEGMENTS rows of each task's part of the sketch."""
    from .simhash_dedup import shingle_hashes, simhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["doc_id", "fp", "set_a", "set_b", "segment", "counts"]
        counts, held, size = np.zeros(SKETCH, np.uint8), [], 0
        for batch in batches:
            fps, digests = [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), shingle)
                fps.append(simhash(hashes))
                hashes = np.unique(hashes)
                digests.append(np.frombuffer(xxhash.xxh128_digest(hashes.tobytes()), np.int64))
                held.append((hashes & np.uint64(SKETCH - 1)).astype(np.uint32))
                size += len(hashes)
                if size >= 1 << 20:
                    tally(counts, held)
                    held, size = [], 0
            both = np.array(digests, np.int64).reshape(-1, 2)
            null = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), null, pa.nulls(batch.num_rows, pa.binary())], names)
        if held:
            tally(counts, held)
        parts = counts.reshape(SEGMENTS, -1)
        some = np.nonzero(parts.any(axis=1))[0]
        null = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([null, null, null, null, pa.array(some), pa.array([parts[k].tobytes() for k in some], pa.binary())], names)

    return docs.mapInArrow(run, _FIRST)


def sketch_of(first: DataFrame) -> np.ndarray:
    """The sum of all tasks' counters. A task's stop at 255, their sum at 2^32 - 1: counters that all stand at their limit would leave the order to the
    hashes, and blocks that many pages have in common would fall into prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for segment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if segment != at:
                    if total is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.astype(np.uint32).tobytes()], pa.binary())], ["segment", "counts"])
                    at, total = segment, np.zeros(SKETCH // SEGMENTS, np.int64)
                total = np.minimum(total + np.frombuffer(counts, np.uint8), 2**32 - 1)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.astype(np.uint32).tobytes()], pa.binary())], ["segment", "counts"])

    parts = first.where("segment is not null").select("segment", "counts").repartition("segment").sortWithinPartitions("segment")
    out = np.zeros((SEGMENTS, SKETCH // SEGMENTS), np.uint32)
    for segment, counts in zip(*(c.to_pylist() for c in parts.mapInArrow(run, "segment long, counts binary").toArrow().columns)):
        out[segment] = np.frombuffer(counts, np.uint32)
    return out.ravel()


def prefixes(docs: DataFrame, sketch: np.ndarray, shingle: int) -> DataFrame:
    """``(token, doc, n)``: the prefix of each document's set of n shingles."""
    from .simhash_dedup import shingle_hashes

    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in part.column(1)]
                first = [prefix(s, shared.value) for s in sets]
                sizes = list(map(len, first))
                columns = [np.concatenate(first).view(np.int64), np.repeat(part.column(0).to_numpy(), sizes), np.repeat(list(map(len, sets)), sizes).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "doc", "n"])

    return docs.mapInArrow(run, "token long, doc long, n long")


def shared_prefixes(rows: DataFrame, nodes: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = cut) -> DataFrame:
    """The ``rows`` of documents in ``nodes`` (rep) whose token is in more than one row."""
    again = keep(rows.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "near-tokens")
    shared = rows.sparkSession.sparkContext.broadcast(bit_filter(again, "token"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(shared.value, batch.column(0).to_numpy())))

    some = rows.mapInArrow(run, rows.schema).join(again, "token", "left_semi")
    return some.join(nodes.select(F.col("rep").alias("doc")), "doc", "left_semi")


def _comparable(n: Column, m: Column) -> Column:
    return F.least(n, m) * LEAST[1] >= F.greatest(n, m) * LEAST[0]


def _room(n: Column, m: Column) -> Column:
    """The least number of common prefix shingles with which sets of n and m shingles can be similar."""
    total = sum(LEAST)
    rest = lambda k: k - (k - F.floor((k * LEAST[0] + LEAST[1] - 1) / LEAST[1]) + 1)
    return F.ceil((n + m) * LEAST[0] / total) - F.greatest(rest(n), rest(m))


def leads(rows: DataFrame) -> DataFrame:
    """``(src, dst)``: each node and the smallest node of the lists that most of its prefix falls into, if they could be similar."""
    least = rows.groupBy("token").agg(F.min(F.struct("doc", "n")).alias("lead"))
    pairs = rows.join(least, "token").select("doc", "n", F.col("lead.doc").alias("dst"), F.col("lead.n").alias("m"))
    counts = pairs.where((F.col("doc") != F.col("dst")) & _comparable(F.col("n"), F.col("m"))).groupBy("doc", "n", "dst", "m").agg(F.count("*").alias("c"))
    counts = counts.where(2 * F.col("c") >= _room(F.col("n"), F.col("m")))  # other lists of this pair can have smaller nodes
    return counts.groupBy("doc").agg(F.max(F.struct("c", -F.col("dst"))).alias("best")).select(F.col("doc").alias("src"), (-F.col("best.col2")).alias("dst"))


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles)`` of the documents in ``nodes`` (node): sorted distinct shingle hashes."""
    from .simhash_dedup import shingle_hashes

    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(passes(shared.value, batch.column(0).to_numpy())))
            for part in (some.slice(at, 512) for at in range(0, some.num_rows, 512)):
                sets = pa.array([np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary").join(nodes, "node", "left_semi")


def similar_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (src, dst) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = []
            for own, lead in zip(batch.column(2), batch.column(3)):
                mine, other = (np.frombuffer(v.as_py(), np.uint64) for v in (own, lead))
                both = len(np.intersect1d(mine, other, assume_unique=True))
                flags.append(both * LEAST[1] >= LEAST[0] * (len(mine) + len(other) - both))
            yield batch.select(["src", "dst"]).filter(pa.array(flags, pa.bool_()))

    own, other = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in ("src", "dst"))
    return pairs.join(own, "src").join(other, "dst").select("src", "dst", "src_set", "dst_set").mapInArrow(run, "src long, dst long")


def block_links(groups: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(src, dst)`` that connect the similar nodes of each group in ``groups`` (token, node): pairs of blocks, each in a task that returns at most one link a node."""
    import pandas as pd

    blocks = groups.groupBy("token").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    at = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = groups.join(blocks, "token").withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("token", "node", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi")).join(sets, "node")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("node").sort_values("node")
        node = pdf["node"].to_numpy()
        first = similar([np.frombuffer(b, np.uint64) for b in pdf["shingles"]])
        linked = np.nonzero(first != np.arange(len(node)))[0]
        return pd.DataFrame({"src": node[linked], "dst": node[first[linked]]})

    return dealt.groupBy("token", "lo", "hi").applyInPandas(meet, "src long, dst long")


def open_lists(rows: DataFrame, groups: DataFrame, wide: int = WIDE, keep: Callable[[DataFrame, str], DataFrame] = cut) -> tuple[DataFrame, DataFrame]:
    """Of lists that hold nodes of several ``groups`` (node, component): the pairs (src, dst) that could be similar, and the lists with too many pairs
    as ``(token, node)``. A pair that shares such a list is left to it."""
    own = groups.select(F.col("node").alias("doc"), "component")
    rows = rows.join(own, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    sizes = rows.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token")
    sizes = sizes.agg(F.count("*").alias("parts"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("squares")).where("parts > 1")
    rows = keep(rows.join(sizes.select("token", (F.col("k") * F.col("k") - F.col("squares") > 2 * wide * F.col("k")).alias("wide")), "token"), "near-open")
    few = rows.where("not wide").select("token", F.col("doc").alias("src"), F.col("n"), F.col("component").alias("a"))
    other = few.select("token", F.col("src").alias("dst"), F.col("n").alias("m"), F.col("a").alias("b"))
    met = few.join(other, "token").where((F.col("src") > F.col("dst")) & (F.col("a") != F.col("b")) & _comparable(F.col("n"), F.col("m")))
    counts = met.groupBy("src", "dst", "n", "m").agg(F.count("*").alias("c"))
    return counts.where(F.col("c") >= _room(F.col("n"), F.col("m"))).select("src", "dst"), rows.where("wide").select("token", F.col("doc").alias("node"))


def components(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs`` (doc_id, text) with a doc_id."""
    from .simhash_dedup import near_links

    tables: list[tuple[str, DataFrame]] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        """A written table that goes when ``done`` names it."""
        out = cut(df, name)
        tables.append((name, out))
        return out

    def done(*names: str) -> None:
        """Delete the tables of these names: nothing that is still to be written reads them."""
        discard(*[df for name, df in tables if name in names])
        tables[:] = [t for t in tables if t[0] not in names]

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    first = keep(described(docs, shingle), "near-first")
    found = first.where("segment is null").select("doc_id", "fp", "set_a", "set_b")
    sets = keep(found.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp")), "near-sets")
    rows = keep(shared_prefixes(keep(prefixes(docs, sketch_of(first), shingle), "near-prefixes"), sets, keep), "near-lists")
    done("near-prefixes", "near-tokens")
    distinct = keep(sets.groupBy("fp").agg(F.min("rep").alias("rep")), "near-fp")
    same = sets.join(distinct.withColumnRenamed("rep", "dst"), "fp").select(F.col("rep").alias("src"), "dst").where("src <> dst")
    close = connected_components(near_links(distinct).unionByName(same)).where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))
    pairs = keep(leads(rows).unionByName(close).distinct(), "near-pairs")
    done("near-fp")
    ends = lambda p: p.select(F.explode(F.array("src", "dst")).alias("node"))
    links = keep(similar_pairs(pairs, keep(shingle_sets(docs, ends(pairs).distinct(), shingle), "near-members")), "near-links")
    done("near-pairs", "near-members")
    groups = connected_components(links)
    pairs, lists = open_lists(rows, groups, keep=keep)
    pairs, lists = keep(pairs, "near-pairs"), keep(lists, "near-wide")
    done("near-lists", "near-open")
    members = keep(shingle_sets(docs, ends(pairs).unionByName(lists.select("node")).distinct(), shingle), "near-members")
    links = links.unionByName(similar_pairs(pairs, members)).unionByName(block_links(lists, members))
    exact = connected_components(links)
    done("near-pairs", "near-wide", "near-members", "near-links")
    labels = sets.join(exact.withColumnRenamed("node", "rep"), "rep", "left")
    labels = keep(labels.select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id")), "near-labels")
    out = cut(found.select("doc_id", "set_a", "set_b").join(labels, ["set_a", "set_b"]).select("doc_id", "component_id"), "near-components")
    done(*{name for name, _ in tables})
    return out
