"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard

#: Rows of a round's table that one task writes.
ROWS_A_FILE = 250_000


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge list; component is the
    smallest node reachable. Nodes that only have a loop to themselves are kept;
    edges with a null end are ignored.

    Each round moves every node's larger neighbours to its smallest neighbour and
    then does the same for smaller ones, so the edge set never grows and the
    number of rounds is logarithmic in the longest path. The per-node minimum is
    a partial aggregate; it is written before it is joined, so both join sides
    are plain exchanges that AQE can split when one hub owns most of the edges.
    Raises RuntimeError if the components are not final after ``max_rounds`` rounds: a partial answer is none.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull()
    )
    whole = cut(e.distinct(), "edges")
    loops, e = whole.where("u = v").select(F.col("u").alias("node")), whole.where("u <> v")
    before, used, settled = _fingerprint(e), [], False
    # no table of a round has more rows than twice the edges, so it needs no more files than that
    few = lambda df: df.coalesce(max(1, -(-2 * before[0] // ROWS_A_FILE)))
    for _ in range(max_rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))), "low")
        large = e.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u <> v")
        large = cut(few(large.distinct()), "large")
        least = cut(few(large.groupBy("u").agg(F.min("v").alias("m"))), "low")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(few(small.unionByName(least.withColumnRenamed("m", "v")).distinct()), "small")
        after = _fingerprint(e)
        discard(low, large, least, *used)
        used = [e]
        settled = after == before
        if settled:
            break
        before = after
    if before[0] and not settled:
        raise RuntimeError(f"components are not final after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).unionByName(loops).distinct()
    roots = roots.join(e.select(F.col("u").alias("node")), "node", "left_anti")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
