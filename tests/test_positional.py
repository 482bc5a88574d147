import pytest
from pyspark.sql import functions as F

from veriscope.operators.positional import OrderMismatch, positional_concat, positional_join, with_position


def sides(spark, n=500):
    left = spark.range(n).select(F.col("id").alias("a"), (F.col("id") * 7 % 11).alias("x")).repartition(5)
    right = spark.range(n).select((F.col("id") * 10).alias("t"), F.col("id").alias("b"), (F.col("id") % 3).alias("y")).repartition(3)
    return left, right


def test_rows_meet_by_position(spark):
    left, right = sides(spark)
    got = positional_join(left, right, ["a"], ["t"], {"a": "b"}).orderBy("position").collect()
    assert [tuple(r) for r in got] == [(i, i, i * 7 % 11, 10 * i, i, i % 3) for i in range(500)]


def test_a_swapped_pair_raises(spark):
    left, right = sides(spark)
    swapped = right.withColumn("b", F.when(F.col("b") == 41, 42).when(F.col("b") == 42, 41).otherwise(F.col("b")))
    with pytest.raises(OrderMismatch, match=r"row 41: \['41'\] beside \['42'\]"):
        positional_join(left, swapped, ["a"], ["t"], {"a": "b"})
    with pytest.raises(OrderMismatch, match="499 rows beside 500"):
        positional_join(left.where("a <> 7"), right, ["a"], ["t"], {"a": "b"})
    with pytest.raises(ValueError, match="names on both sides"):
        positional_join(left, left, ["a"], ["a"])


def test_ties_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, 1), (2, 5), (2, 3), (2, 3), (1, 9)], "k int, v int")
    for parts in (1, 4):
        got = [tuple(r)[:2] for r in with_position(rows.repartition(parts), ["k"]).orderBy("position").collect()]
        assert [k for k, _ in got] == [None, 1, 2, 2, 2] and got == sorted(got, key=lambda r: [g[0] for g in got].index(r[0]))
    first = [tuple(r) for r in with_position(rows.repartition(4), ["k"]).orderBy("position").collect()]
    assert first == [tuple(r) for r in with_position(rows.coalesce(1), ["k"]).orderBy("position").collect()]
    left, right = sides(spark, 0)
    assert positional_join(left, right, ["a"], ["t"], {"a": "b"}).count() == 0
    three = [(spark.range(4).select(F.col("id").alias(c)), [c]) for c in "pqr"]
    assert sorted(tuple(r) for r in positional_concat(three).collect()) == [(i, i, i) for i in range(4)]
