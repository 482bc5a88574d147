"""Manifests, odd readers, regression helpers, the service and the remaining kernels."""

import io
import math
import struct
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.functions import colour, simulation
from veriscope.operators import regression
from veriscope.plans.contract import ContractError
from veriscope.plans.service import AuditService, listed
from veriscope.sources import manifest, tables


def test_manifest(spark):
    rows = [("d/Non-Anemic-007.png", "a"), ("d/Anemic-12.png", "b"), ("d/odd.png", "a")]
    df = manifest.parsed_names(spark.createDataFrame(rows, "file_path string, k string"), "file_path", [("number", r"-(\d+)$"), ("cls", r"^(Non-Anemic|Anemic)")], None)
    sheet = spark.createDataFrame([("a", "11,5", "F")], "k string, raw string, sex string")
    from veriscope.functions.parse import decimal_comma

    df = manifest.with_dimension(df, sheet, "k", {"sex": "?"}).withColumns({"hb_g_dl": decimal_comma("raw"), "dataset": F.when(F.col("k") == "a", "x").otherwise("y"), "number": F.coalesce("number", F.lit("0"))})
    out = manifest.finalise(df.withColumn("image_id", manifest.image_ids("x", "k", number="number")), {"z": "wrong"})
    assert out.columns[: len(manifest.SCHEMA)] == list(manifest.SCHEMA)
    got = {r["image_id"]: r for r in out.collect()}
    assert got["x:a:007"]["hb_label_trusted"] and got["x:a:007"]["hb_g_dl"] == 11.5 and not got["x:b:012"]["hb_label_trusted"] and got["x:b:012"]["sex"] == "?"
    assert manifest.trusted(out).count() == 2
    untrusted = manifest.finalise(df, {"x": "sheet was shifted"}).where("hb_label_untrusted_reason is not null")
    assert untrusted.count() == 2 and manifest.trusted(manifest.finalise(df, {"x": "r"})).count() == 0
    assert [r[0] for r in out.orderBy("image_id").select(manifest.derived_label()).collect()] == [1, 1, None]
    row = manifest.integrity(out.unionByName(out)).first()
    assert (row["n_rows"], row["n_repeated"], row["n_out_of_range"]) == (6, 3, 0)
    assert spark.createDataFrame([("a=1; b=x",)], "notes string").select(manifest.notes()["b"]).first()[0] == "x"
    with pytest.raises(ValueError):
        manifest.trusted(df)
    with pytest.raises(ValueError):
        manifest.with_dimension(df, sheet.unionByName(sheet), "k")


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png16(samples, kinds):
    h, w = samples.shape
    rows = samples.astype(">u2").tobytes()
    line, out, before = 2 * w, b"", bytes(2 * w)
    for y in range(h):
        row = rows[y * line : (y + 1) * line]
        kind = kinds[y % len(kinds)]
        coded = []
        for x in range(line):
            a, b, c = (row[x - 2] if x >= 2 else 0), before[x], (before[x - 2] if x >= 2 else 0)
            p = a + b - c
            nearest = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            coded.append((row[x] - (0, a, b, (a + b) // 2, nearest)[kind]) % 256)
        out += bytes([kind, *coded])
        before = row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_image_readers(spark, tmp_path):
    samples = np.random.default_rng(1).integers(0, 65536, (10, 7))
    content = png16(samples, [0, 1, 2, 3, 4])
    assert (tables.png_samples(content)[..., 0] == samples).all()
    linear, full = tables.linear_image(content, dark=100.0, saturation=60000.0)
    assert (linear[..., 0] == np.maximum(samples - 100.0, 0)).all() and (full == (samples >= 60000)).all()
    (tmp_path / "a.png").write_bytes(content)
    (tmp_path / "b.jpg").write_bytes(b"nothing")
    jpeg = b"\xff\xd8\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([57] * 36 + [58] * 28) + b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 20, 30, 3)
    (tmp_path / "c.jpg").write_bytes(jpeg)
    got = {r["path"][-5:]: r for r in tables.image_headers(spark, str(tmp_path)).collect()}
    assert (got["a.png"]["width"], got["a.png"]["height"], got["a.png"]["depth"]) == (7, 10, 16)
    assert got["b.jpg"]["error"] and (got["c.jpg"]["width"], got["c.jpg"]["height"], got["c.jpg"]["quality"]) == (30, 20, 50)


def test_table_readers(spark, tmp_path):
    (tmp_path / "s1.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "s2.csv").write_text("5,6\r\n7,8")
    got = sorted(map(tuple, tables.signal_files(spark, str(tmp_path), ["a", "b"]).collect()))
    assert got == [("s1", 0, 1.0, 2.0), ("s1", 1, 3.0, 4.0), ("s2", 0, 5.0, 6.0), ("s2", 1, 7.0, 8.0)]
    (tmp_path / "t.txt").write_text("# head\nlambda x y\n 250  1.5e3\t2\n252 1 1\n")
    assert [tuple(r) for r in tables.space_table(spark, str(tmp_path / "t.txt"), ["w", "x", "y"]).collect()] == [(250.0, 1500.0, 2.0), (252.0, 1.0, 1.0)]
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>id</t></si><si><r><t>H</t></r><r><t>b</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>12,5</t></is></c></row><row/></sheetData></worksheet>')
    (tmp_path / "x.xlsx").write_bytes(book.getvalue())
    df = tables.spreadsheet(spark, str(tmp_path / "x.xlsx"))
    assert df.columns == ["id", "_1", "Hb"] and [tuple(r) for r in df.collect()] == [("7", None, "12,5")]


def test_regression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 2))
    df = spark.createDataFrame([(float(a), float(b), float(1 + 2 * a - b), float(a)) for a, b in x], "a double, b double, y double, z double")
    fit = regression.least_squares(df, ["y", "z"], ["a", "b"])
    assert fit["y"] == pytest.approx({"intercept": 1, "a": 2, "b": -1}) and fit["z"] == pytest.approx({"intercept": 0, "a": 1, "b": 0}, abs=1e-9)
    pairs = spark.createDataFrame([(float(i), 0.0) for i in range(1, 11)], "a double, b double")
    assert regression.wilcoxon(pairs, "a", "b") == {"n": 10, "w": 55.0, "p": pytest.approx(2 / 1024)}
    assert regression.wilcoxon(pairs.limit(5), "a", "b")["p"] is None
    tied = spark.createDataFrame([(1.0 if i % 2 else -1.0, 0.0) for i in range(40)], "a double, b double")
    assert regression.wilcoxon(tied, "a", "b")["p"] == pytest.approx(1.0)
    many = spark.range(1, 6001).selectExpr("double(id) a", "0.0 b")
    z = regression.wilcoxon(many, "a", "b", exact_to=0)["z"]
    simpson = "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(x * i / 2000, 2) / 2)))"
    for x in (-z, 0.3, 1.7, 5.0, 27.4, 212.1):  # the sign of a rounded zero included
        want = duckdb.sql(f"SELECT round(least(1.0, 1 - x / 3000 / sqrt(2 * pi()) * {simpson}), 9) FROM (SELECT {x!r}::DOUBLE AS x)").fetchall()[0][0]
        assert repr(round(regression.simpson_p(-x), 9)) == repr(want)
    curve = spark.createDataFrame([("k", 0.0, 0.0), ("k", 1.0, 4.0), ("k", 2.0, 2.0), ("j", 0.0, 1.0), ("j", 1.0, 1.5)], "k string, x double, y double")
    assert [tuple(r) for r in regression.crossings(curve, "x", "y", 3.0, ["k"]).collect()] == [("k", 0.75)]


def test_remaining_kernels():
    thick = [{"absorption": np.array([0.1, 5.0]), "scattering": np.array([10.0, 10.0]), "thickness": 0.02}, {"absorption": np.array([1.0, 1.0]), "scattering": np.array([10.0, 10.0]), "thickness": 1.0}]
    both, one = simulation.layered_reflectance(thick), simulation.layered_reflectance(thick[:1])
    assert (both > one).all() and one[0] > one[1] and (both < 1).all()
    wl = np.arange(400.0, 701, 5)
    warm, cold = simulation.blackbody(wl, 2800), simulation.blackbody(wl, 7000)
    assert warm[-1] > warm[0] and cold[0] > cold[-1]
    curves = np.stack([np.exp(-(((wl - c) / 40) ** 2)) for c in (600, 550, 450)])
    assert np.allclose(simulation.spectrum_to_rgb(wl, np.full(len(wl), 0.4), cold, curves), 0.4)
    assert simulation.interpolated(np.array([[1.0, 2], [3, 4]]), np.array([0.0, 2, 9]), 0.0).tolist() == [0.0, 3.0, 0.0]
    grid = np.arange(2.0, 24.01, 0.5)
    raw = np.stack([np.exp(-grid / 20), np.exp(-grid / 8), np.exp(-grid / 6)], axis=1)
    chroma = raw / raw.sum(axis=1, keepdims=True)
    away = lambda g: 10 * float(np.abs(np.log(g)).max())
    gains = simulation.perturbation(np.random.default_rng(3), 1.5, away)
    assert away(gains) == pytest.approx(1.5, abs=0.06)
    truth = np.array([4.0, 10.0])
    assert (simulation.inversion_errors(grid, chroma, truth, np.ones((1, 3))) == 0).all() and simulation.inversion_errors(grid, chroma, truth, gains[None]).max() > 0
    mask = np.zeros((9, 9), bool)
    mask[3:6, 3:6] = True
    assert colour.grown(mask, 1).sum() == 25 and colour.grown(mask, -1).sum() == 1 and sum(h.sum() for h in colour.halves(mask)) == 9
    image = np.full((9, 9, 3), 100.0)
    image[3, 3] = [250, 20, 20]
    assert not colour.vessel_free(image, mask)[3, 3] and colour.region_quality(image, mask)["score"] > 0 and colour.region_quality(image, ~np.ones_like(mask))["score"] == 0
    assert colour.centre_crop(image, 1 / 3).shape == (3, 3, 3) and colour.near_black(np.zeros((2, 2, 3))) == 1
    assert colour.chroma_clusters([np.array([1, 1, 1]), np.array([2, 2, 2.1]), np.array([3, 1, 1])]) == 2
    assert math.isnan(colour.spread(np.array([[50, 0, 0]]))["mean"])


def test_service(spark, tmp_path):
    service = AuditService(spark, str(tmp_path))
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(f"s{i}", float(v), float(v + e)) for i, (v, e) in enumerate(zip(rng.normal(12, 1, 60), rng.normal(0, 0.3, 60)))], "subject_id string, y_true double, y_pred double")
    info = service.submit(df)
    assert info["summary"]["n_rows"] == 60 and not info["available"]["ceiling"] and len(service.preview(info["id"], 5)["rows"]) == 5
    plan = service.declare("declared beforehand", {"permutation": {"n_permutations": 50}})
    run = service.run(info["id"], ["permutation", "ceiling"], preregistration=plan["id"])
    assert run["status"] == "done" and {r["check_id"]: r["verdict"] for r in run["report"]["results"]} == {"permutation": "PASS", "ceiling": "INSUFFICIENT_DATA"}
    assert "Permutation" in service.report(run["id"]) or "chance" in service.report(run["id"])
    assert service.run(info["id"], ["nothing"])["status"] == "failed" and len(service.runs()) == 2 and len(service.checks()) == 8
    assert [r["check_id"] for r in listed(run["report"]["results"], {"PASS"})] == ["permutation"] and len(listed(run["report"]["results"], by="duration")) == 2
    with pytest.raises(ContractError):
        service.submit(spark.createDataFrame([(1,)], "x int"))


def test_csv_and_zip(spark, tmp_path):
    import zipfile

    from veriscope.sources import files

    rows = spark.createDataFrame([(1, 'a "quoted", text\nof two lines', [1, 2]), (2, None, None)], "i int, t string, v array<int>")
    files.guarded_csv(rows, f"{tmp_path}/out", f"{tmp_path}/raw")
    back = spark.read.csv(f"{tmp_path}/out", header=True, multiLine=True, escape='"').orderBy("i").collect()
    assert [tuple(r) for r in back] == [("1", 'a "quoted", text\nof two lines', "[1,2]"), ("2", None, None)]
    with pytest.raises(PermissionError):
        files.guarded_csv(rows, f"{tmp_path}/raw/../raw/x", f"{tmp_path}/raw")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name in ("ok.csv", "deep/er.CSV", "../out.csv", "/root.csv", "c:/x.csv", "skip.txt", "folder/"):
            z.writestr(name, name * 3)
    got = {r["member"]: bytes(r["content"]) for r in files.zip_members(spark, f"{tmp_path}/a.zip", ("csv",)).collect()}
    assert got == {"ok.csv": b"ok.csv" * 3, "deep/er.CSV": b"deep/er.CSV" * 3}
    with pytest.raises(Exception, match="unpacks to"):
        files.zip_members(spark, f"{tmp_path}/a.zip", largest=5).collect()


def test_signed_ranks_of_means_that_are_computed_once(spark):
    """Sums of floats can differ in their last bits when they are computed again; ranks join by value, so such rows were lost."""
    import random

    def shaken(frames):
        for f in frames:
            yield f.assign(a=[v * (1 + random.SystemRandom().randrange(1, 1000) * 1e-14) for v in f["a"]])

    df = spark.createDataFrame([(1.0 + i, 0.5) for i in range(60)], "a double, b double").mapInPandas(shaken, "a double, b double")
    found = regression.wilcoxon(df, "a", "b", least=1, exact_to=0)
    assert (found["n"], found["w"]) == (60, 1830.0)
