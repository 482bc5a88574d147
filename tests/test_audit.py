"""Fault injection: each fault must be found by its check, and a clean table must pass."""

import numpy as np
import pandas as pd
import pytest

from veriscope.plans import contract
from veriscope.plans.audit import availability, catalogue, external_markdown, markdown, run_audit
from veriscope.plans.ingest import IngestSpec, NotAuditable, ingest
from veriscope.plans import prereg
from veriscope.plans.verdict import FAIL, INSUFFICIENT, PASS, plain


#: The clean table: target and prediction are a level, a share of sex and of the signal, and noise.
CLEAN = {"y_true": (1.2, 0.8, 0.6), "y_pred": (1.1, 0.8, 0.4)}
#: What a fault changes: ``pred`` replaces the prediction, ``drift`` moves each seed column, ``copies`` and ``moved`` put
#: images and subjects of one split into the other.
FAULTS = {
    "clean": {},
    "no_signal": {"pred": lambda t: t.y_true.mean() + 0.9 * t.noise},
    "demographic_proxy": {"pred": lambda t: 13 + 1.2 * t.is_male + 0.25 * t.noise},
    "few_subjects": {"pred": lambda t: t.y_true.where(t.place % 12 == 5, t.y_true.mean()) + 0.05 * t.noise},
    "seed_unstable": {"drift": 1.2},
    "duplicates_across_split": {"copies": 3},
    "subject_across_split": {"moved": 5},
}


def synth(kind: str, n: int = 240) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The submission with this fault, and its images' hashes by row."""
    fault = FAULTS[kind]
    draw = np.random.Generator(np.random.Philox(key=list(FAULTS).index(kind) + 41))
    t = pd.DataFrame({"place": np.arange(n), "is_male": draw.permutation(n) % 2, "signal": draw.normal(size=n), "noise": draw.normal(size=n)})
    for column, (of_sex, of_signal, spread) in CLEAN.items():
        t[column] = 13 + of_sex * t.is_male + of_signal * t.signal + spread * draw.normal(size=n)
    if "pred" in fault:
        t["y_pred"] = fault["pred"](t)
    t = t.assign(
        subject_id=[f"p{i}" for i in range(n)], sex=np.where(t.is_male, "M", "F"), age=20.0 + draw.integers(0, 50, n), split=np.where(10 * t.place < 7 * n, "train", "test"),
        signal_feature=t.signal + 0.3 * draw.normal(size=n), noise_feature=draw.normal(size=n),
        **{f"y_pred_seed__{k}": t.y_pred + fault.get("drift", 0.0) * draw.normal() + 0.05 * draw.normal(size=n) for k in range(5)},
    )
    content = pd.DataFrame({"md5": [f"image {i}" for i in range(n)], "phash": draw.integers(-(2**62), 2**62, n) * 2})
    copied = range(fault.get("copies", 0))
    for column in content:
        content.loc[[n - 1 - i for i in copied], column] = content.loc[list(copied), column].to_numpy()
    again = slice(0, fault.get("moved", 0))
    t, content = (pd.concat([f, f.iloc[again]], ignore_index=True) for f in (t, content))
    t.loc[t.index >= n, "split"] = "test"
    t["_row"] = content["_row"] = np.arange(len(t))
    return t.drop(columns=["place", "is_male", "signal", "noise"]), content


def frame(spark, kind):
    df, content = synth(kind)
    return contract.load(spark.createDataFrame(df), content=spark.createDataFrame(content.astype({"phash": "int64"})))


def verdicts(report):
    return {r.check_id: r.verdict for r in report.results}


def test_clean_submission_passes(spark):
    report = run_audit(frame(spark, "clean"), thresholds={"permutation": {"n_permutations": 100}})
    assert verdicts(report) == dict.fromkeys(verdicts(report), PASS), [(r.check_id, r.headline, r.details.get("traceback")) for r in report.results if r.verdict != PASS]
    assert len(report.results) == 8 and report.counts[PASS] == 8
    text = markdown(report)
    assert "8 pass" in text and report.fingerprint() in text
    assert report.to_frame(spark).count() == 8


@pytest.mark.parametrize(
    "kind, check, verdict",
    [
        ("duplicates_across_split", "duplicates", FAIL),
        ("duplicates_across_split", "split_integrity", FAIL),
        ("subject_across_split", "split_integrity", FAIL),
        ("demographic_proxy", "demographic_baseline", FAIL),
        ("demographic_proxy", "proxy_probe", FAIL),
        ("no_signal", "permutation", FAIL),
        ("no_signal", "proxy_probe", INSUFFICIENT),
        ("no_signal", "seed_stability", FAIL),
        ("few_subjects", "subgroup_robustness", FAIL),
        ("seed_unstable", "seed_stability", FAIL),
    ],
)
def test_fault_is_found(spark, kind, check, verdict):
    report = run_audit(frame(spark, kind), [check], {"permutation": {"n_permutations": 60}})
    assert verdicts(report) == {check: verdict}, (report.results[0].headline, report.results[0].measured, report.results[0].details)


def test_missing_inputs_are_insufficient(spark):
    df, _ = synth("clean")
    bare = contract.load(spark.createDataFrame(df[["subject_id", "y_true", "y_pred"]]))
    report = run_audit(bare, [c["check_id"] for c in catalogue() if c["check_id"] not in ("permutation", "subgroup_robustness")])
    assert set(verdicts(report).values()) == {INSUFFICIENT}
    assert availability(bare)["permutation"] and not availability(bare)["ceiling"]


def test_permutation_limits(spark):
    f = frame(spark, "clean")
    assert run_audit(f, ["permutation"], {"permutation": {"n_permutations": 10}}).results[0].verdict == INSUFFICIENT
    df, _ = synth("clean")
    df["y_pred__holes"] = np.where(np.arange(len(df)) == 3, np.nan, df["y_pred"])
    assert run_audit(contract.load(spark.createDataFrame(df)), ["permutation"]).results[0].verdict == INSUFFICIENT


def test_contract_errors(spark):
    with pytest.raises(contract.ContractError):
        contract.load(spark.createDataFrame([("a", 1.0)], "subject_id string, y_true double"))
    with pytest.raises(contract.ContractError):
        contract.load(spark.createDataFrame([("a", "x", "1")], "subject_id string, y_true string, y_pred string"))
    rows = [("a", "1.5", "2"), ("b", "bad", "2"), (None, "1", "1")]
    f = contract.load(spark.createDataFrame(rows, " subject_id string, y_true string, y_pred string".strip()))
    assert f.dropped == 2 and f.df.count() == 1
    with pytest.raises(ValueError):
        run_audit(f, ["no such check"])


def test_ingest(spark, tmp_path):
    rows = [(f"subj{i // 2:03d}_shot{i % 2}.jpg", 120.0 + i, 121.0 + i, "training", "male") for i in range(60)]
    df = spark.createDataFrame(rows, "image string, Hgb double, prediction double, fold string, Gender string")
    names = {"image": "image_path", "Hgb": "y_true", "prediction": "y_pred", "fold": "split", "Gender": "sex"}
    with pytest.raises(NotAuditable):
        ingest(df, IngestSpec(names))
    f, record = ingest(df, IngestSpec(names, unit="g/L", subject_pattern=r"^(subj\d+)_", aggregate=True))
    assert f.df.count() == 30 and not record.unsupported
    one = f.df.where("subject_id = 'subj000'").first()
    assert abs(one["y_true"] - 12.05) < 1e-9 and one["split"] == "train" and one["sex"] == "M" and one["image_path"] == "subj000_shot0.jpg|subj000_shot1.jpg"
    f, record = ingest(df, IngestSpec(names, unit="g/L"))
    report = run_audit(f, ["split_integrity"], unsupported=record.unsupported)
    assert report.results[0].verdict == INSUFFICIENT
    assert "How the table was read" in external_markdown(report, record.to_dict())
    with pytest.raises(NotAuditable):
        ingest(df, IngestSpec(names, unit="g/L", subject_pattern="^(other)_"))
    with pytest.raises(NotAuditable):
        ingest(spark.createDataFrame([(0.0, 0.4), (1.0, 0.9)], "y_true double, y_pred double"), IngestSpec({}))


def test_preregistration():
    record = prereg.stamped("a declared plan", {"permutation": {"alpha": 0.01}}, declared_at="2026-01-01T00:00:00Z", notes="why", checks_planned=["ceiling", "permutation"])
    again = prereg.loads(prereg.dumps(record))
    assert again == record and prereg.standing(again).counts
    assert prereg.standing(again, "2026-01-01T00:00:00Z").counts and not prereg.standing(again, "2025-12-31T23:59:59Z").in_time
    assert not prereg.standing(again, "yesterday").in_time
    assert prereg.declared_for(again, "permutation") == ({"alpha": 0.01}, True) and prereg.declared_for(again, "ceiling") == ({}, False) and prereg.declared_for(None, "ceiling") == ({}, False)
    for change in ({"notes": "other"}, {"checks_planned": []}, {"thresholds": {"permutation": {"alpha": 0.5}}}):
        assert not prereg.standing({**record, **change}).intact
    assert prereg.stamp({**record, "checks_planned": ["permutation", "ceiling"]}) == record["fingerprint"]
    for bad in (lambda: prereg.stamped("short"), lambda: prereg.stamped("a declared plan", owner="x"), lambda: prereg.loads("{}")):
        with pytest.raises(ValueError):
            bad()


def test_plain():
    assert plain({"a": np.float64("nan"), "b": {1, 2}, "c": (np.int64(3), None), "d": np.array([1.5])}) == {"a": None, "b": [1, 2], "c": [3, None], "d": [1.5]}
