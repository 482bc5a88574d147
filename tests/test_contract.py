"""The submission contract, results as JSON, image hashes and small helpers, case by case."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veriscope import session
from veriscope.functions import colour, information
from veriscope.operators import profiles, resample
from veriscope.plans import contract
from veriscope.plans.verdict import canonical
from veriscope.sources import images, tables

ROWS = [("a", "1.5", "1", "M", None, "x", 0.5), ("a", "2", "2.5", "F", None, None, 1.5), ("b", "nan", "1", None, None, "y", None), (None, "3", "3", "M", None, "x", 1.0), ("c", "4", "inf", "M", None, "z", 2.0), ("d", "5", "4", "F", None, "x", 0.0)]
SCHEMA = "subject_id string, y_true string, y_pred string, sex string, age double, site string, feat double"


@pytest.fixture(scope="module")
def frame(spark):
    return contract.load(spark.createDataFrame(ROWS, SCHEMA).withColumns({"y_pred__other": F.lit(1.0), "y_pred_seed__7": F.lit(2.0), "group": F.lit("g")}))


def test_validate_counts_what_goes(spark):
    errors, notes, gone = contract.validate(spark.createDataFrame(ROWS, SCHEMA))
    assert not errors and gone == 3
    assert any("1 rows without a numeric y_true" in n for n in notes) and any("1 rows without a subject" in n for n in notes) and any("only 4 subjects" in n for n in notes)
    assert contract.validate(spark.createDataFrame([("a", "x", "1")], "subject_id string, y_true string, y_pred string"))[0] == ["y_true has no numeric value"]
    assert contract.validate(spark.createDataFrame([("a", "1", None), ("b", None, "1")], "subject_id string, y_true string, y_pred string"))[0] == ["no complete row"]
    assert contract.validate(spark.createDataFrame([("a",)], "subject_id string"))[0] == ["missing required column: y_true", "missing required column: y_pred"]


def test_column_families_and_grouping(frame):
    assert frame.dropped == 3 and frame.df.count() == 3
    assert frame.candidates == {"submitted": "y_pred", "other": "y_pred__other"} and frame.seeds == {"7": "y_pred_seed__7"}
    assert frame.features == ["feat"] and frame.demographics == ["sex", "site"] and not frame.has("age")
    assert frame.grouping == "group" and frame.summary["n_subjects"] == 2 and frame.summary["grouping"] == "group"


def test_encoded_levels_come_from_the_whole_table(frame):
    df, names = contract.encoded(frame, ["sex", "site", "feat"], frame.df)
    assert names == ["_sex_0", "_site_0", "feat"]  # F | M without the last; nan | x without the last
    got = {(r["sex"], r["site"]): (r["_sex_0"], r["_site_0"]) for r in df.collect()}
    assert got == {("M", "x"): (0.0, 0.0), ("F", None): (1.0, 1.0), ("F", "x"): (1.0, 0.0)}
    one, names = contract.encoded(frame, ["group"], frame.df)
    assert names == ["_group_0"] and {r[0] for r in one.select("_group_0").collect()} == {1.0}


def test_canonical_json():
    text = canonical({"b": [np.int64(2), float("inf")], "a": {"é": (1, {3, 1})}})
    assert text == '{"a":{"é":[1,[1,3]]},"b":[2,null]}' and json.loads(text)["b"] == [2, None]


def test_hashes_of_images():
    rng = np.random.default_rng(2)
    gray = np.kron(rng.random((8, 9)) * 255, np.ones((10, 10)))
    assert images.resize(gray, 80, 90) == pytest.approx(gray) and images.resize(np.full((50, 70), 7.0), 8, 9) == pytest.approx(np.full((8, 9), 7.0))
    ramp = np.tile(np.arange(90.0), (80, 1))
    assert images.dhash(ramp) == -1 and images.dhash(-ramp) == 0
    distance = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert distance(images.phash(gray), images.phash(gray * 0.9 + 3)) <= 2 < 10 < distance(images.phash(gray), images.phash(rng.random((80, 90)) * 255))
    assert images.luma(np.array([[[10.0, 20.0, 30.0]]])).item() == pytest.approx(10 * 0.114 + 20 * 0.587 + 30 * 0.299)


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00" + b"\x00" * 4
    found = tables.image_header(png)
    assert (found["width"], found["height"]) == (640, 480)
    assert not tables.image_header(b"not an image").get("width")


def test_probe_and_majority(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "lab": np.where(x + 0.3 * rng.normal(size=400) > 0, "p", "q"), "f": np.arange(400) % 4}))
    found = information.grouped_probe(df, ["x"], "lab", "f")
    assert found["accuracy"] > 0.85 and found["n_classes"] == 2 and found["margin"] == pytest.approx(found["accuracy"] - found["base_rate"])
    assert information.grouped_probe(df.where("lab = 'p'"), ["x"], "lab", "f") == {"accuracy": None, "base_rate": 1.0, "margin": None, "n_classes": 1}
    tie = spark.createDataFrame([("s", 1), ("s", 0), ("t", None), ("t", 1)], "site string, y int")
    assert {r["site"]: (r["n"], r["majority"], r["base_rate"]) for r in information.majority(tie, "y", ["site"]).collect()} == {"s": (2, 0, 0.5), "t": (1, 1, 1.0)}


def test_conditional_counts_and_ratios(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    got = {r["k"]: (r["n"], r["big"], r["known"]) for r in profiles.conditional_counts("k", df, {"big": F.col("v") > 2, "known": F.col("v").isNotNull()}).collect()}
    assert got == {"a": (2, 1, 2), "b": (1, 0, 0)}
    shares = spark.createDataFrame([(1.0, 2.0, 5.0), (0.0, 0.0, 0.0)], "r double, g double, b double").select(*colour.channel_shares(*map(F.col, "rgb"))).collect()
    assert tuple(shares[0]) == pytest.approx((0.125, 0.25, 0.625)) and tuple(shares[1]) == (None, None, None)


def test_draws_depend_on_replicate_and_place_alone():
    a, b = resample.scattered(7, 3, 1000), resample.scattered(7, 3, 10)
    assert (a[:10] == b).all() and len(set(a.tolist())) == 1000 and abs(np.mean(a / 2**64) - 0.5) < 0.05
    assert (resample.scattered(7, 4, 10) != b).all()


def test_tables_in_the_shared_folder(spark, monkeypatch):
    kept = session.cut(spark.range(5), "test")
    assert kept.count() == 5
    session.discard(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept.__dict__["cut_path"]).count()

    class Far:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Far)
    Far.sparkContext.master = "local[8]"
    assert session.shared_dir(Far) == session.LOCAL_CHECKPOINTS


def test_mutual_information_uses_all_rows(spark):
    """A relation that only the last thousandth of the rows shows; neighbours are exact."""
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=900), np.round(rng.normal(size=900), 1)
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    assert np.array_equal(information.neighbour_distances(x, y, 3), np.partition(d, 3, axis=1)[:, 3])
    z = np.concatenate([rng.normal(size=3000), np.linspace(50, 90, 60)])
    rows = pd.DataFrame({"y": np.concatenate([rng.normal(size=3000), np.linspace(90, 50, 60)]), "x0": z, "x1": rng.normal(size=3060)})
    mi, null = information.information_and_null(spark.createDataFrame(rows), 2, 1)
    assert mi[0] > max(null) and mi[0] > mi[1] and len(null) == 2 * information.NULL_REPEATS and not math.isnan(mi[1])


def test_mutual_information_is_dealt_in_parts(spark, monkeypatch):
    """No task walks from all points, and the parts add up to the whole estimate."""
    monkeypatch.setattr(information, "SLICE_POINTS", 100)
    rng = np.random.default_rng(6)
    rows = pd.DataFrame({"y": np.round(rng.normal(size=730), 1)})
    rows["x0"] = rows["y"] + rng.normal(size=730)
    rows = rows.sort_values(["y", "x0"], ignore_index=True)
    x, y = rows["x0"].to_numpy(), rows["y"].to_numpy()
    mi, null = information.information_and_null(spark.createDataFrame(rows), 1, 9)
    assert mi == [pytest.approx(information.mutual_information(x, y, seed=9))] and mi[0] > max(null)
    assert null == [pytest.approx(information.mutual_information(x, np.random.default_rng([9, t]).permutation(y), seed=9 + t)) for t in range(1, 6)]
    assert information.information_and_null(spark.createDataFrame(rows.head(4)), 1, 9) == ([0.0], [0.0] * 5)
