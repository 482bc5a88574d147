"""Exact quantiles and medians of groups of any size, by rounds of narrowing brackets.

A round takes a grid of approximate quantiles of each group (a sketch of fixed size, partial before it travels), places around each rank asked
for a bracket of two grid values, and counts exactly what lies below it, on its ends and inside. A rank on an end is settled, however many rows tie there; for the
others the rows strictly inside go on, at most about seven grid cells of them, with the rank counted anew. A bracket that the sketch has put beside its
rank is opened on both sides. When no bracket (at first: no group) holds more than SMALL rows the order statistics are read off. So no task holds the distinct values of a
group, and 10^12 rows take three rounds.

Values are doubles; null and NaN ones are left out. Quantiles interpolate linearly between order statistics, as SQL's continuous percentiles do. For
groups that are many and small (one a subject) the built-in percentile is the better plan; this one is for few groups of many rows.

Defined cases: a group without values has null quantiles; infinities are values; ties, null group keys and empty tables need no rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

GRID = 1000
BRACKET = 2
SMALL = 100_000
MAX_ROUNDS = 12


def _same(keys: list[str], left: str = "r", right: str = "s") -> Column:
    """All keys equal, nulls included."""
    found = F.lit(True)
    for k in keys:
        found = found & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return found


def _brackets(rows: DataFrame, targets: DataFrame, keys: list[str], grid: int) -> DataFrame:
    """``targets`` (keys, _t, _k: the rank from 0 that is asked for) with ``_lo`` and ``_hi``."""
    places = F.array(*[F.lit(i / grid) for i in range(grid + 1)])
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", places, F.lit(10 * grid)).alias("_grid"), F.count("*").alias("_n"))
    found = targets.alias("r").join(sketch.alias("s"), _same(keys)).select("r.*", "s._grid", "s._n")
    cell = F.col("_k") / F.col("_n") * grid
    below, above = F.floor(cell).cast("int") - BRACKET, F.ceil((F.col("_k") + 1) / F.col("_n") * grid).cast("int") + BRACKET
    lo = F.when(below > 0, F.get("_grid", below)).otherwise(F.lit(float("-inf")))
    hi = F.when(above < grid, F.get("_grid", above)).otherwise(F.lit(float("inf")))
    return found.select(*dict.fromkeys([*keys, "_t"]), "_k", lo.alias("_lo"), hi.alias("_hi"))


def order_statistics(rows: DataFrame, targets: DataFrame, keys: list[str], small: int = SMALL, grid: int = GRID) -> DataFrame:
    """``(keys, _t, _a)``: the value of rank _k among the ``_v`` of the key's rows, for each of ``targets`` (keys, _t, _k)."""
    if grid < 20 or small < 2 * grid:
        raise ValueError("brackets narrow only if grid is 20 or more and small twice that")
    done, at = None, keys
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(MAX_ROUNDS):
        if most <= small:
            break
        bracket = cut(_brackets(rows, targets, at, grid), "quantile-brackets")
        met = rows.alias("r").join(bracket.alias("s"), _same(at)).select(*[F.col(f"s.`{k}`").alias(k) for k in keys], "s._t", "s._k", "s._lo", "s._hi", "r._v")
        v, lo, hi, k = (F.col(c) for c in ("_v", "_lo", "_hi", "_k"))
        parts = {"_under": v < lo, "_first": v == lo, "_in": (v > lo) & (v < hi), "_last": (v == hi) & (v > lo)}
        counts = met.groupBy(*keys, "_t", "_k", "_lo", "_hi").agg(*[F.count_if(c).alias(name) for name, c in parts.items()])
        start = k - F.col("_under")
        inner = start - F.col("_first")
        holds = (start >= 0) & (inner < F.col("_in") + F.col("_last"))
        value = F.when(holds & (inner < 0), lo).when(holds & (inner >= F.col("_in")), hi)
        left, right = F.when(holds, lo).otherwise(float("-inf")), F.when(holds, hi).otherwise(float("inf"))
        counts = counts.select(*keys, "_t", value.alias("_a"), F.when(holds, inner).otherwise(k).alias("_k"), left.alias("_lo"), right.alias("_hi"), F.when(holds, F.col("_in")).alias("_in"))
        counts = cut(counts, "quantile-counts")
        settled = counts.where("_a is not null").select(*keys, "_t", "_a")
        done = settled if done is None else done.unionByName(settled)
        open_ones = counts.where("_a is null")
        largest = open_ones.agg(F.count("*"), F.max(F.coalesce("_in", F.lit(small + 1)))).first()
        if not largest[0]:
            return done
        inside = (F.col("r._v") > F.col("s._lo")) & (F.col("r._v") < F.col("s._hi")) | F.col("s._in").isNull()
        kept = rows.alias("r").join(open_ones.alias("s"), _same(at) & inside)
        rows, targets, at = kept.select(*[F.col(f"s.`{k}`").alias(k) for k in keys], "s._t", "r._v"), open_ones.select(*keys, "_t", "_k"), [*keys, "_t"]
        most = largest[1]
        if most > small:
            rows = cut(rows, "quantile-rows")
    else:
        raise RuntimeError(f"quantiles are not settled after {MAX_ROUNDS} rounds")
    held = rows.groupBy(*at).agg(F.sort_array(F.collect_list("_v")).alias("_all"))  # at most ``small`` values
    read = targets.alias("r").join(held.alias("s"), _same(at)).select("r.*", F.get("_all", F.col("_k").cast("int")).alias("_a")).select(*keys, "_t", "_a")
    return read if done is None else done.unionByName(read)


def quantiles(df: DataFrame, by: list[str], value: str, levels: list[float], out: str = "quantiles", small: int = SMALL, grid: int = GRID) -> DataFrame:
    """``(by, out)``: for every group of ``by`` the array of its continuous quantiles at ``levels``."""
    v = F.col(value).cast("double")
    rows = df.select(*by, v.alias("_v"))
    sizes = cut(rows.groupBy(*by).agg(F.count_if(F.col("_v").isNotNull() & ~F.isnan("_v")).alias("_n")), "quantile-sizes")
    rows = rows.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ask = F.explode(F.array(*[F.struct(F.lit(i).alias("_t"), F.lit(float(q)).alias("_q")) for i, q in enumerate(levels)]))
    place = (F.col("_n") - 1) * F.col("_ask._q")
    asked = sizes.where("_n > 0").select(*by, F.col("_n"), ask.alias("_ask")).select(*by, F.col("_ask._t").alias("_t"), F.floor(place).alias("_k"), (place - F.floor(place)).alias("_f"))
    # two ranks for a quantile between two values
    ranks = asked.select(*by, F.explode(F.array(F.struct((2 * F.col("_t")).alias("_t"), "_k"), F.struct((2 * F.col("_t") + 1).alias("_t"), (F.col("_k") + F.ceil("_f")).alias("_k")))).alias("_r"))
    found = order_statistics(rows, ranks.select(*by, "_r._t", "_r._k"), by, small, grid)
    value = lambda i: F.max(F.when(F.col("_t") == i, F.col("_a")))
    wide = found.groupBy(*by).agg(*[value(i).alias(f"_q{i}") for i in range(2 * len(levels))])
    joined = sizes.alias("r").join(wide.alias("s"), _same(by), "left").select(*[F.col(f"r.`{k}`").alias(k) for k in by], "_n", *[f"_q{i}" for i in range(2 * len(levels))])

    def between(i: int, q: float) -> Column:
        a, b, at = F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}"), (F.col("_n") - 1) * F.lit(float(q))
        return F.when(a == b, a).otherwise(a + (b - a) * (at - F.floor(at)))

    return joined.select(*by, F.array(*[between(i, q) for i, q in enumerate(levels)]).alias(out))


def medians(df: DataFrame, columns: list[str], **how) -> dict[str, float | None]:
    """The exact median of each column over all rows; None for one without values."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])).alias("c")).select("c.i", "c.v")
    found = {r["i"]: r["m"][0] for r in quantiles(long, ["i"], "v", [0.5], "m", **how).collect()}  # one row a column
    return {c: found.get(i) for i, c in enumerate(columns)}
