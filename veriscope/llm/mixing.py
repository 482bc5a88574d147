r"""Mixing sources to target weights along a time-varying curriculum.

Size is the number of words ``[^\x20\x09-\x0D]+``. Sources in code point order,
null last, weigh 1, 2, 3, 1, ...; targets share the sum of all sizes by weight,
stop at ``MAX_EPOCHS`` times their source's size, and the excess is shared again
by weight. That is the level L with sum(min(weight * L, cap)) = total, found in one
window over the sources ordered by cap / weight.

Over training time t in [0, 1] a source is drawn at the rate
target * (1 + tilt * (2t - 1)); its integral is the cumulative token demand
target * (t + tilt * (t * t - t)). A source's documents in a fixed pseudo-random order
(MD5 of doc_id) fill that demand, epoch after epoch, so a copy that begins at
q words gets the t at which the demand is q: the inverse of the integral. Rows are
range-sorted by that position.

Running sums over a source use two levels (4,096 slices of the order, then the rows
of a slice), so a source with a third of all rows is dealt over all tasks. All of
it is built-in DataFrame functions.

Defined cases: a null text has size 0 and is never taken; a null source is a source
of its own; a row without a doc_id orders by its text; repeated rows each count and
take their own place (among equal rows the places are exchangeable). Extra columns
pass through ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .labels import unused

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: How a source's rate changes over time, by weight: early, level, late.
TILTS = (-0.5, 0.0, 0.5)
MAX_EPOCHS = 3
SLICES = 4096


def _source_key(column: str = "source"):
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def order_key():
    """What a row's fixed place comes from: the MD5 of its id, or of its text where it has none, so rows without ids do not meet in one slice."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text").cast("string"), F.lit("")))


def row_key():
    """Equal for rows that repeat a doc_id, and for rows without one that repeat a text."""
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.concat(F.lit("~"), F.md5(F.col("text").cast("string"))), F.lit(""))


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, size, source_key, row_key, place, slice)``, written once."""
    place = order_key()
    return cut(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
            _source_key().alias("source_key"),
            row_key().alias("row_key"),
            place.alias("place"),
            F.conv(F.substring(place, 1, 3), 16, 10).cast("int").alias("slice"),
        ),
        "mix-sizes",
    )


def targets(by_source: DataFrame) -> DataFrame:
    """Adds weight, tilt and target to ``(source_key, source, source_size)``; one row a source."""
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    number = F.row_number().over(in_order)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), ((number - 1) % len(values) + 1).cast("int"))
    rows = by_source.withColumns({"weight": pick(WEIGHTS).cast("double"), "tilt": pick(TILTS), "cap": (MAX_EPOCHS * F.col("source_size")).cast("double")})
    rows = rows.withColumn("full_at", F.col("cap") / F.col("weight"))
    by_fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everywhere).cast("double")
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    still = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (total - capped) / still)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(everywhere)["level"]
    rows = rows.withColumn("target", F.least(F.col("weight") * level, F.col("cap")))
    return rows.select("source_key", "source_size", "weight", "tilt", "target")


def demand_time(words, target, tilt):
    """The time at which a source's cumulative demand reaches ``words``."""
    share = words / F.nullif(target, F.lit(0.0))
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * share)
    return F.when(tilt == 0, share).otherwise((root - (1 - tilt)) / (2 * F.nullif(tilt, F.lit(0.0))))


def placed(sizes: DataFrame) -> DataFrame:
    """Each row of ``sizes`` with its source's figures, ``start`` (words of the source before it) and ``taken``."""
    by_slice = cut(sizes.groupBy("source_key", "slice").agg(F.sum("size").alias("words"), F.first("source").alias("source")), "mix-slices")
    by_source = by_slice.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"))
    earlier = Window.partitionBy("source_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_slice.select("source_key", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    offsets = cut(offsets.join(targets(by_source), "source_key"), "mix-offsets")
    within = Window.partitionBy("source_key", "slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sizes.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source_key", "slice"])
    rows = rows.withColumn("start", F.col("offset") + F.col("inside"))
    whole = F.floor("target")
    epoch = lambda k: F.greatest(F.lit(0), F.least(F.col("size"), whole - (F.col("start") + k * F.col("source_size"))))
    rows = rows.withColumn("epochs", F.array(*[epoch(k).cast("long") for k in range(MAX_EPOCHS)]))
    return rows.withColumn("taken", sum(F.col("epochs")[k] for k in range(MAX_EPOCHS)))


def mix_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, position)`` in order of position; position is null where nothing is taken."""
    rows = placed(sized(docs))
    at = F.when(F.col("taken") > 0, demand_time(F.col("start"), F.col("target"), F.col("tilt")))
    rows = rows.select("doc_id", "size", "source_size", "target", "taken", at.alias("position"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the curriculum draws them: a row for every epoch that takes at least
    half of a document's words, range-sorted by position, columns as they were."""
    rows = placed(sized(docs))
    begins = F.transform("epochs", lambda taken, k: F.when((taken > 0) & (taken * 2 >= F.col("size")), F.col("start") + k * F.col("source_size")))
    times = F.transform(F.filter(begins, lambda q: q.isNotNull()), lambda q: demand_time(q, F.col("target"), F.col("tilt")))
    key, number, when, time = unused(docs.columns, "mix_key", "mix_turn", "mix_times", "mix_time")
    turn = Window.partitionBy(key).orderBy("source_key", "size", "start")
    rows = rows.select(F.col("row_key").alias(key), "source_key", "size", "start", times.alias(when))
    rows = rows.withColumn(number, F.row_number().over(turn)).where(F.size(when) > 0).select(key, number, when)
    # rows that repeat a doc_id pair up in the same order on both sides
    words = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    turn = Window.partitionBy(key).orderBy(_source_key(), words, F.xxhash64("text"))
    texts = docs.withColumn(key, row_key()).withColumn(number, F.row_number().over(turn))
    drawn = texts.join(rows, [key, number]).select(*docs.columns, F.explode(when).alias(time))
    return drawn.orderBy(time, "doc_id").select(*docs.columns)
