"""Bootstrap and permutation without rows on the driver.

**Bootstrap.** A row derives from a hash of its key and a replicate's number how often it is drawn in that replicate: a Poisson number of mean 1. So rows stay
where they are, a task adds its rows' weighted columns for all replicates, Spark adds the tasks' sums, and a statistic is an expression over a replicate's sums. Any task, and
any SQL engine, can redo any draw. What reaches the driver has a row a replicate at most.

**Permutation.** Whole subjects swap labels; one row a subject (two numbers) is broadcast, and its size is checked first."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subjects that a replicate may hold in memory; larger tables are refused, not cut.
MAX_SUBJECTS = 5_000_000
#: Relative difference of two means that comes of the order in which their terms were added.
ROUNDING = 1e-10
#: Rows that a task gathers before it goes through the permutations, each of which orders all subjects.
ROWS_HELD = 1 << 20
PERMUTATION_SEED = 770_000
BOOTSTRAP_SEED = 20_260_911
#: The odd constants of the 64-bit mixing function.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def bounded(df: DataFrame, columns: list[str], what: str = "subjects") -> pd.DataFrame:
    """``columns`` on the driver, ordered by all of them; raises beyond MAX_SUBJECTS rows."""
    n = df.count()
    if n > MAX_SUBJECTS:
        raise ValueError(f"{n} {what} are more than the {MAX_SUBJECTS} that one replicate may hold")
    return df.select(*columns).toPandas()


def scattered_at(stream: int, i: int, places: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes of places in replicate i: a mixing function of stream + 2^32 i + place."""
    z = (places.astype(np.uint64) + np.uint64(((i << 32) + stream) % (1 << 64))) * np.uint64(MIX[0])
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[1])
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[2])
    return z ^ (z >> np.uint64(31))


def scattered(stream: int, i: int, n: int) -> np.ndarray:
    """The hashes of places 0 to n - 1."""
    return scattered_at(stream, i, np.arange(n, dtype=np.uint64))


def scattered_sql(stream: int, i: str, place: str) -> str:
    """The same hash in SQL with 128-bit integers."""
    wrap = "18446744073709551616"
    x = f"(({place})::UHUGEINT + ({i})::UHUGEINT * 4294967296 + {stream}) % {wrap} * {MIX[0]} % {wrap}"
    for shift, factor in ((30, MIX[1]), (27, MIX[2])):
        x = f"xor(({x}), ({x}) // {1 << shift}) * {factor} % {wrap}"
    return f"xor(({x}), ({x}) // {1 << 31})"


#: A hash below the k-th bound is drawn k times at most: the distribution function of the Poisson law of mean 1, in 64 bits.
DRAWS = [int(sum(Fraction(1, math.factorial(m)) for m in range(k + 1)) * Fraction(math.exp(-1)) * 2**64) for k in range(12)]


def times_drawn(keys: np.ndarray, i: int, seed: int = BOOTSTRAP_SEED) -> np.ndarray:
    """How often rows with these keys are drawn in replicate i."""
    return np.searchsorted(np.array(DRAWS, np.uint64), scattered_at(seed, i, keys), side="right")


def times_drawn_sql(hashed: str) -> str:
    """The same number in SQL, from a column that holds the hash (``scattered_sql``)."""
    return f"CASE {' '.join(f'WHEN {hashed} < {d}::UHUGEINT THEN {k}' for k, d in enumerate(DRAWS))} ELSE {len(DRAWS)} END"


def text_key(column: str) -> Column:
    """A key of 60 bits for a column of any type."""
    return F.conv(F.substring(F.md5(F.col(column).cast("string")), 1, 15), 16, 10).cast("long")


def text_key_sql(column: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({column} AS VARCHAR)), 1, 15) AS BIGINT)"


def replicate_sums(df: DataFrame, key: Column, columns: dict[str, Column], n: int, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """``(replicate, drawn, *columns)``: for each of n replicates the rows drawn and the sum of each column over them. Rows that share a key are
    drawn together; a null counts as 0."""
    names = list(columns)
    rows = df.select(key.cast("long").alias("_key"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_c{k}") for k, c in enumerate(columns.values())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((n, 1 + len(names))), False
        for batch in batches:
            some = some or batch.num_rows > 0
            keys = batch.column(0).to_numpy().view(np.uint64)
            values = np.stack([np.ones(batch.num_rows), *(c.to_numpy() for c in batch.columns[1:])], axis=1)
            for i in range(n):
                total[i] += times_drawn(keys, i, seed) @ values
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *(pa.array(c.copy()) for c in total.T)], ["replicate", "drawn", *(f"_c{k}" for k in range(len(names)))])

    sums = rows.mapInArrow(add, ", ".join(["replicate long", "drawn double", *(f"_c{k} double" for k in range(len(names)))]))
    return sums.groupBy("replicate").agg(F.sum("drawn").alias("drawn"), *[F.sum(f"_c{k}").alias(name) for k, name in enumerate(names)])


def subject_order(n: int, i: int) -> np.ndarray:
    """The i-th permutation of n subjects: which one's label each gets."""
    return np.argsort(scattered(PERMUTATION_SEED, i, n), kind="stable")


def gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in batches of ``rows`` or more, and a rest."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= rows:
            yield pd.concat(held)
            held, n = [], 0
    if n:
        yield pd.concat(held)


def permuted_errors(rows: DataFrame, subject: str, truth: str, order: str, candidates: dict[str, str], n: int) -> DataFrame:
    """(replicate, *candidates): mean absolute error of each candidate (name to column) under truths that whole subjects swap.

    A subject stands for its first row's truth. One row a subject is broadcast; the rows stay where they are: each task adds up
    its rows' errors under every permutation, and Spark adds the tasks' sums."""
    spark = rows.sparkSession
    names = list(candidates)
    held = rows.groupBy(F.col(subject).cast("string").alias("subject")).agg(F.min_by(truth, order).cast("double").alias("truth"))
    held = bounded(held.orderBy("subject").select(F.xxhash64("subject").alias("subject"), "truth"), ["subject", "truth"])  # in the order of the subjects' names
    by_hash = np.argsort(held["subject"].to_numpy(), kind="stable")
    if (np.diff(held["subject"].to_numpy()[by_hash]) == 0).any():
        raise ValueError("two subjects share a hash")
    shared = spark.sparkContext.broadcast((held["subject"].to_numpy()[by_hash], by_hash, held["truth"].to_numpy(float)))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, place, truths = shared.value
        total, seen = np.zeros((n, len(names))), 0
        for pdf in gathered(batches, ROWS_HELD):
            at, preds = place[np.searchsorted(known, pdf["subject"].to_numpy())], pdf[names].to_numpy(float)
            seen += len(at)
            for i in range(n):
                total[i] += np.abs(preds - truths[subject_order(len(known), i)][at][:, None]).sum(axis=0)
        if seen:
            yield pd.DataFrame([[i, seen, *total[i]] for i in range(n)], columns=["replicate", "n", *names])

    picked = rows.select(F.xxhash64(F.col(subject).cast("string")).alias("subject"), *[F.col(f"`{c}`").cast("double").alias(name) for name, c in candidates.items()])
    sums = picked.repartition(spark.sparkContext.defaultParallelism).mapInPandas(add, "replicate long, n long, " + ", ".join(f"`{name}` double" for name in names))
    return sums.groupBy("replicate").agg(*[(F.sum(f"`{name}`") / F.sum("n")).alias(name) for name in names])


def empirical_p(null: DataFrame, column: str, real: float, lower: bool = True) -> dict:
    """(k + 1) / (n + 1) with its floor, null mean, SD and z; ``lower`` when small values are extreme. Errors that differ by the
    rounding of their sums only are ties, whatever order tasks added in."""
    slack = ROUNDING * abs(real)
    hit = F.col(column) <= real + slack if lower else F.col(column) >= real - slack
    row = null.agg(F.count_if(hit).alias("k"), F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_pop(column).alias("s")).first()
    n = row["n"]
    if not n:
        return {"p": None, "floor": None, "at_floor": None, "n": 0, "null_mean": None, "z": None}
    z = (real - row["m"]) / row["s"] if row["s"] else None
    return {"p": (row["k"] + 1) / (n + 1), "floor": 1 / (n + 1), "at_floor": row["k"] == 0, "n": n, "null_mean": row["m"], "z": z}


def interval(values: DataFrame, column: str = "value", level: float = 0.95) -> dict:
    """Percentile interval of the finite replicates, and how many were undefined."""
    good = F.col(column).isNotNull() & ~F.isnan(column)
    q = F.percentile(F.when(good, F.col(column)), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    row = values.agg(q.alias("q"), F.count_if(good).alias("n"), F.count_if(~good).alias("skipped"), F.stddev_samp(F.when(good, F.col(column))).alias("se")).first()
    lo, hi = row["q"] if row["q"] else (None, None)
    return {"lo": lo, "hi": hi, "n": row["n"], "skipped": row["skipped"], "se": row["se"]}


def paired_gain(df: DataFrame, key: str, a: str, b: str, n: int = 2000) -> dict:
    """Mean of a - b over rows (one a subject) with the percentile interval of resamples of subjects."""
    rows = df.select(text_key(key).alias("_key"), (F.col(a) - F.col(b)).alias("gap")).where("gap is not null")
    sums = replicate_sums(rows, F.col("_key"), {"gaps": F.col("gap")}, n)
    found = interval(sums.select((F.col("gaps") / F.nullif(F.col("drawn"), F.lit(0.0))).alias("value")))
    whole = rows.agg(F.count("*").alias("n"), F.avg("gap").alias("gain")).first()
    return {**found, "n": whole["n"], "gain": float("nan") if whole["gain"] is None else whole["gain"]}


def least_squares_intervals(df: DataFrame, key: Column, responses: list[str], terms: list[str], n: int = 1000, level: float = 0.95) -> DataFrame:
    """``(response, term, lo, hi, n, skipped)``: percentile intervals of least-squares coefficients. A replicate's normal equations are sums of weighted
    products, so one pass gives all of them; a replicate whose terms are collinear is skipped. Rows with a missing value are left out."""
    names = ["_one", *terms]
    rows = df.select(key.alias("_key"), F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in (*terms, *responses)]).na.drop()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]] + [(a, r) for r in responses for a in names]
    sums = replicate_sums(rows, F.col("_key"), {f"s{k}": F.col(a) * F.col(b) for k, (a, b) in enumerate(pairs)}, n)
    labels = [(r, t) for r in responses for t in ["intercept", *terms]]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                at = {p: row[f"s{k}"] for k, p in enumerate(pairs)}
                gram = np.array([[at.get((a, b), at.get((b, a))) for b in names] for a in names])
                scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
                sound = np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-12) == len(names)
                for r in responses:
                    beta = np.linalg.solve(gram / np.outer(scale, scale), np.array([at[a, r] for a in names]) / scale) / scale if sound else [np.nan] * len(names)
                    out += [(r, t, float(v)) for t, v in zip(["intercept", *terms], beta)]
            yield pd.DataFrame(out, columns=["response", "term", "value"])

    found = sums.mapInPandas(solve, "response string, term string, value double")
    good = F.col("value").isNotNull() & ~F.isnan("value")
    q = F.percentile(F.when(good, F.col("value")), F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    out = found.groupBy("response", "term").agg(q.alias("q"), F.count_if(good).alias("n"), F.count_if(~good).alias("skipped"))
    order = F.create_map(*[F.lit(v) for i, (r, t) in enumerate(labels) for v in (f"{r}|{t}", i)])
    return out.orderBy(order[F.concat_ws("|", "response", "term")]).select("response", "term", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n", "skipped")


def drawn_hits(i: int, total: int, hits: int, block: int = 1 << 20) -> int:
    """Hits among ``total`` draws with replacement from as many rows, counted a block of draws at a time."""
    found = 0
    for at in range(0, total, block):
        places = np.arange(at, min(at + block, total), dtype=np.uint64)
        found += int((scattered_at(BOOTSTRAP_SEED, i, places) % np.uint64(total) < np.uint64(hits)).sum())
    return found


def rate_intervals(counts: DataFrame, by: list[str], hits: str, total: str, n: int = 2000, level: float = 0.95) -> DataFrame:
    """``counts`` with rate, lo and hi: resampling ``total`` rows of which ``hits`` are hits needs the two counts alone, so no row
    travels; a task draws one replicate of one group."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["_total"].to_numpy()
            hit = [drawn_hits(i, k, h) for i, k, h in zip(pdf["_i"].tolist(), size.tolist(), pdf["_hits"].tolist())]
            yield pdf.assign(_rate=np.array(hit) / size)

    rows = counts.where(F.col(total) > 0).select(*by, F.col(hits).cast("long").alias("_hits"), F.col(total).cast("long").alias("_total"))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(counts.sparkSession.sparkContext.defaultParallelism, *by, "_i")
    schema = rows.withColumn("_rate", F.lit(0.0)).schema
    q = F.percentile("_rate", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    found = rows.mapInPandas(draw, schema).groupBy(*by).agg(q.alias("_q"))
    out = counts.join(found, by, "left")
    return out.select(*counts.columns, (F.col(hits) / F.nullif(F.col(total), F.lit(0))).alias("rate"), F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))
