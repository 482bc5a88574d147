import random

import pytest

from veriscope.operators.components import connected_components


def brute(edges):
    label = {x: x for e in edges for x in e}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    edges += [(100 + i, 101 + i) for i in range(30)] + [(200, 201 + i) for i in range(40)] + [(500, 500)]
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert connected_components(spark.createDataFrame([(None, 1)], "src long, dst long")).count() == 0


def test_components_that_are_not_final_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long")
    with pytest.raises(RuntimeError, match="1 rounds"):
        connected_components(path, max_rounds=1).count()
    assert {r.component for r in connected_components(path).collect()} == {0}
