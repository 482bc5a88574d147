"""The eight checks. Each takes an AuditFrame and thresholds and returns a CheckResult."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import information, metrics
from ..operators import resample, ridge, similarity, splits
from ..operators.components import connected_components
from ..operators.running import rank_in_slices, sliced
from ..session import cut
from .contract import AuditFrame, encoded
from .verdict import FAIL, INSUFFICIENT, PASS, CheckResult

PHASH_NEAR = 10
MIN_SEEDS = 3
EXAMPLES = 25


@dataclass(frozen=True)
class Check:
    check_id: str
    title: str
    run: Callable[..., CheckResult]
    needs: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)


CHECKS: dict[str, Check] = {}


def check(check_id: str, title: str, needs: tuple[str, ...] = (), **defaults):
    def keep(f):
        def run(frame: AuditFrame, thresholds: dict | None = None, **more) -> CheckResult:
            limits = {**defaults, **(thresholds or {})}
            result = f(frame, limits, **more)
            result.check_id, result.title, result.threshold = check_id, title, limits
            return result

        CHECKS[check_id] = Check(check_id, title, run, needs, defaults)
        return run

    return keep


def _result(verdict: str, headline: str, measured: dict | None = None, missing: list[str] | None = None, **details) -> CheckResult:
    rounded = {k: round(v, 5) if isinstance(v, float) and math.isfinite(v) else v for k, v in (measured or {}).items()}
    return CheckResult("", "", verdict, headline, rounded, {}, missing or [], details)


def _split():
    return F.coalesce(F.col("split"), F.lit("nan"))


def _held_content(frame: AuditFrame) -> DataFrame | None:
    """Rows with their content hashes, or None where nothing is hashed."""
    if frame.content is None:
        return None
    rows = cut(frame.content.where("md5 is not null").join(frame.df, "_row"), "content")
    return rows if rows.limit(1).count() else None


@check("duplicates", "Duplicate and near-duplicate content", ("image_path",), max_duplicate_rate=0.0)
def duplicates(frame: AuditFrame, limits: dict) -> CheckResult:
    rows = _held_content(frame)
    if rows is None:
        return _result(INSUFFICIENT, "no readable content", missing=["image_path, or a table of content hashes"])
    n, unique = rows.agg(F.count("*"), F.count_distinct("md5")).first()
    links = similarity.hamming_links(rows, "_row", "phash", PHASH_NEAR)
    parts = connected_components(links, "src", "dst").withColumnRenamed("node", "_row")
    near = cut(rows.join(parts, "_row", "left").withColumn("component", F.coalesce("component", "_row")), "near")
    near_rate = 1 - near.agg(F.count_distinct("component")).first()[0] / n
    rate = 1 - unique / n
    measured = {"n_content": n, "n_unique": unique, "duplicate_rate": rate, "near_duplicate_rate": near_rate}
    if not frame.has("split"):
        if rate > limits["max_duplicate_rate"] or near_rate > 0:
            return _result(INSUFFICIENT, f"{rate:.1%} exact and {near_rate:.1%} near duplicates, and no split to hold them against", measured, ["split"])
        return _result(PASS, f"no duplicates among {n} items", measured)

    def crossing(key: str) -> DataFrame:
        groups = near.groupBy(key).agg(F.collect_set(_split()).alias("splits"), F.count("*").alias("rows"))
        return groups.where((F.size("splits") > 1) & (F.col("rows") > 1))

    exact, close = crossing("md5"), crossing("component")
    measured |= {"n_exact_groups_across_splits": exact.count(), "n_near_groups_across_splits": close.count()}
    shown = {"exact": [r["md5"] for r in exact.orderBy("md5").limit(EXAMPLES).collect()], "near": [r["component"] for r in close.orderBy("component").limit(EXAMPLES).collect()]}
    bad = measured["n_exact_groups_across_splits"] + measured["n_near_groups_across_splits"]
    return _result(FAIL if bad else PASS, f"{bad} groups of equal or close content lie in more than one split", measured, **shown)


@check("split_integrity", "Splits keep subjects and content apart", ("split",))
def split_integrity(frame: AuditFrame, limits: dict) -> CheckResult:
    if not frame.has("split"):
        return _result(INSUFFICIENT, "no split to test", missing=["split"])
    df = frame.df.withColumn("split", _split())
    subjects = df.groupBy("subject_id").agg(F.count_distinct("split").alias("n"))
    n_subjects, crossing = subjects.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    measured = {"n_subjects": n_subjects, "n_subjects_across_splits": crossing, "content_available": False}
    problems = {}
    rows = _held_content(frame)
    if rows is not None:
        groups = splits.leakproof_groups(rows, "subject_id", "md5")
        joined = cut(rows.withColumn("split", _split()).join(groups, "subject_id"), "leakproof")
        found = splits.leaks(joined, "split", {"subject": "subject_id", "hash": "md5", "group": "group_id"})
        problems = {r["axis"]: r["count"] for r in found.groupBy("axis").count().collect()}
        names, parts = joined.agg(F.count_distinct("subject_id"), F.count_distinct("group_id")).first()
        measured |= {"content_available": True, "nominal_subjects": names, "leakproof_groups": parts, "collapsed": names - parts, **{f"n_{k}_across_splits": v for k, v in problems.items() if k != "subject"}}
        if frame.has("group"):
            claims = joined.groupBy("group_id").agg(F.count_distinct(F.coalesce("group", F.lit("nan"))).alias("n"))
            problems["claimed"] = claims.where("n > 1").count()
            measured["n_components_cut_by_group"] = problems["claimed"]
    if crossing or any(problems.values()):
        return _result(FAIL, f"{crossing} subjects lie in more than one split; content problems: {sum(problems.values())}", measured)
    if rows is None:
        return _result(INSUFFICIENT, "no subject crosses a split; content was not available", measured, ["content hashes"])
    return _result(PASS, "no subject, content or component crosses a split", measured)


def _mae(df: DataFrame, column: str) -> float:
    return df.agg(metrics.mae("y_true", column)).first()[0]


def _ridge_error(frame: AuditFrame, columns: list[str], extra: list[str] | None = None) -> float:
    df, names = encoded(frame, columns, frame.folded)
    return _mae(ridge.grouped_ridge(df, [*names, *(extra or [])], "y_true", "_fold"), "ridge_pred")


@check("demographic_baseline", "The model beats the best single demographic", ("age", "sex", "device", "site"), model_must_beat_best_demographic_by=0.0)
def demographic_baseline(frame: AuditFrame, limits: dict) -> CheckResult:
    names = frame.demographics
    if not names:
        return _result(INSUFFICIENT, "no demographic to compare with", missing=["one of age, sex, device, site"])
    model = _mae(frame.df, "y_pred")
    singles = {c: _ridge_error(frame, [c]) for c in names}
    best = min(singles, key=lambda c: (singles[c], c))
    margin = singles[best] - model
    sd = frame.summary["y_sd"] or 0.0
    measured = {"model_mae": model, "population_mean_mae": frame.mean_error, "best_single": best, "best_single_mae": singles[best], "margin": margin, "margin_is_narrow": abs(margin) < 0.05 * sd}
    if len(names) > 1:
        measured["all_demographics_mae"] = _ridge_error(frame, names)
    verdict = FAIL if margin <= limits["model_must_beat_best_demographic_by"] else PASS
    return _result(verdict, f"model {model:.4f} against {best} alone {singles[best]:.4f}", measured, singles=singles)


@check("proxy_probe", "Skill is not a demographic in disguise", ("age", "sex", "device", "site"), max_skill_explained_by_demographic=0.75, max_probe_margin=0.10)
def proxy_probe(frame: AuditFrame, limits: dict, representation: list[str] | None = None) -> CheckResult:
    """``representation``: numeric columns whose power to tell a demographic counts as evidence."""
    names = frame.demographics
    if not names:
        return _result(INSUFFICIENT, "no demographic to probe for", missing=["one of age, sex, device, site"])
    model, mean = _mae(frame.df, "y_pred"), frame.mean_error
    advantage = mean - model
    if advantage <= 0:
        return _result(INSUFFICIENT, "the model does not beat the population mean, so there is no skill to explain", {"model_mae": model, "population_mean_mae": mean}, ["an advantage over the population mean"])
    explained, probes = {}, {}
    for c in names:
        gain = _ridge_error(frame, [c]) - _ridge_error(frame, [c], ["y_pred"])
        explained[c] = min(1.0, max(0.0, 1 - gain / advantage))
        if c != "age":
            probes[c] = information.grouped_probe(frame.folded, representation or ["y_pred"], c, "_fold")
    worst = max(explained, key=lambda c: (explained[c], c))
    hits = [c for c, p in probes.items() if representation and p["margin"] is not None and p["margin"] >= limits["max_probe_margin"]]
    measured = {"model_mae": model, "population_mean_mae": mean, "advantage": advantage, "worst_demographic": worst, "worst_explained": explained[worst]}
    bad = explained[worst] >= limits["max_skill_explained_by_demographic"] or bool(hits)
    return _result(FAIL if bad else PASS, f"{worst} explains {explained[worst]:.0%} of the advantage", measured, explained=explained, probes=probes, probe_hits=hits)


@check("permutation", "Better than chance, selection included", alpha=0.05, n_permutations=1000)
def permutation(frame: AuditFrame, limits: dict) -> CheckResult:
    n, alpha = int(limits["n_permutations"]), limits["alpha"]
    floor = 1 / (n + 1)
    if floor >= alpha:
        return _result(INSUFFICIENT, f"{n} permutations cannot reach {alpha}", {"n_permutations": n, "floor": floor}, [f"more than {math.ceil(1 / alpha) - 1} permutations"])
    columns = frame.candidates
    holes = frame.df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(columns.values())]).first()
    broken = [name for name, k in zip(columns, holes) if k]
    if broken:  # a missing prediction would make every null draw undefined and the p-value its floor
        return _result(INSUFFICIENT, "candidates with missing predictions cannot be permuted", {"candidates": broken}, ["predictions for every row of every candidate"])
    names = [f"c{i}" for i in range(len(columns))]
    null = cut(resample.permuted_errors(frame.df, "subject_id", "y_true", "_row", dict(zip(names, columns.values())), n), "null")
    mae = frame.df.agg(*[metrics.mae("y_true", F.col(f"`{c}`")).alias(k) for k, c in zip(names, columns.values())]).first()
    real = {name: float(mae[k]) for name, k in zip(columns, names)}
    null = null.withColumn("best", F.least(*names) if len(names) > 1 else F.col("c0"))
    best = min(real, key=lambda k: (real[k], k))
    alone = resample.empirical_p(null, "c0", real["submitted"])
    primary = resample.empirical_p(null, "best", real[best]) if len(names) > 1 else alone
    measured = {"n_permutations": n, "floor": floor, "p": primary["p"], "at_floor": primary["at_floor"], "z": primary["z"], "real_mae": real[best], "null_mean": primary["null_mean"],
                "p_submitted_alone": alone["p"], "selection_cost": alone["null_mean"] - primary["null_mean"], "best_candidate": best}
    return _result(PASS if primary["p"] < alpha else FAIL, f"p = {primary['p']:.4g} over {n} permutations of whole subjects", measured, candidates=real)


@check("seed_stability", "The effect exceeds the spread over seeds", ("y_pred_seed__k",), min_effect_to_seed_sd_ratio=3.0)
def seed_stability(frame: AuditFrame, limits: dict, effect: float | None = None) -> CheckResult:
    columns = list(frame.seeds.values())
    if len(columns) < MIN_SEEDS:
        return _result(INSUFFICIENT, f"{len(columns)} seed columns, {MIN_SEEDS} are needed", {"n_seeds": len(columns)}, [f"{MIN_SEEDS} columns y_pred_seed__<k>"])
    wide = frame.df.agg(*[metrics.mae("y_true", F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)])
    s = wide.unpivot([], [f"s{i}" for i in range(len(columns))], "seed", "mae").agg(F.avg("mae").alias("m"), F.stddev_samp("mae").alias("sd"), F.min("mae").alias("lo"), F.max("mae").alias("hi")).first()
    effect = frame.mean_error - s["m"] if effect is None else effect
    ratio = effect / s["sd"] if s["sd"] else math.inf
    measured = {"n_seeds": len(columns), "mae_mean": s["m"], "mae_sd": s["sd"], "mae_range": s["hi"] - s["lo"], "effect": effect, "ratio": ratio if math.isfinite(ratio) else None}
    if effect <= 0:
        return _result(FAIL, "there is no effect over the population mean", measured)
    good = ratio >= limits["min_effect_to_seed_sd_ratio"]
    return _result(PASS if good else FAIL, f"effect is {ratio:.2f} times the spread over seeds", measured)


#: Levels that a report lists; it says how many more there are.
SUBGROUPS = 1000


@check("subgroup_robustness", "The advantage does not rest on a few subjects", min_retained_advantage_fraction=0.5, drop_fraction=0.10)
def subgroup_robustness(frame: AuditFrame, limits: dict) -> CheckResult:
    means = splits.training_means(frame.folded, "_fold", "y_true")
    errors = frame.folded.join(F.broadcast(means), "_fold").withColumns(  # one row a fold
        {"_b": F.abs(F.coalesce("train_mean", F.lit(0.0)) - F.col("y_true")), "_m": F.abs(F.col("y_pred") - F.col("y_true"))}
    )
    errors = cut(errors, "errors")
    per = errors.groupBy("subject_id").agg(F.count("*").alias("n"), F.sum("_b").alias("b"), F.sum("_m").alias("m"))
    ranked = rank_in_slices(sliced(per.withColumn("e", F.col("m") / F.col("n")), "e"), [], ["e", "subject_id"])
    take = F.greatest(F.lit(1), F.bround(F.col("_k") * limits["drop_fraction"], 0).cast("long"))
    kept = F.col("_i") > take
    row = ranked.agg(
        (F.sum(F.col("b") - F.col("m")) / F.sum("n")).alias("all"),
        (F.sum(F.when(kept, F.col("b") - F.col("m"))) / F.sum(F.when(kept, F.col("n")))).alias("kept"),
        F.max(take).alias("dropped"),
        F.max("_k").alias("subjects"),
    ).first()
    attributes = [c for c in ("device", "site", "sex") if frame.has(c)]
    table = []
    if attributes:
        pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("variable"), F.coalesce(F.col(a), F.lit("nan")).alias("level")) for a in attributes]))
        levels = errors.select(pairs.alias("g"), "subject_id", "_b", "_m").groupBy("g.variable", "g.level")
        levels = levels.agg(F.count("*").alias("n_rows"), F.count_distinct("subject_id").alias("n_subjects"), F.avg("_b").alias("baseline_mae"), F.avg("_m").alias("model_mae"))
        shown = levels.where("n_rows >= 5").withColumn("advantage", F.col("baseline_mae") - F.col("model_mae")).orderBy("variable", "level")
        table = [r.asDict() for r in shown.limit(SUBGROUPS).collect()]
        more = shown.count() - len(table) if len(table) == SUBGROUPS else 0
        if more:
            table.append({"variable": "not listed", "level": f"{more} more levels"})
    retained = row["kept"] / row["all"] if row["all"] and row["all"] > 0 and row["kept"] is not None else None
    floor = limits["min_retained_advantage_fraction"]
    measured = {"advantage": row["all"], "advantage_kept": row["kept"], "retained": retained, "n_subjects": row["subjects"], "n_dropped": row["dropped"],
                "near_threshold": retained is not None and abs(retained - floor) < 0.15}
    if row["all"] is None or row["all"] <= 0:
        return _result(FAIL, "there is no advantage over the population mean", measured, subgroups=table)
    good = retained is not None and retained >= floor
    return _result(PASS if good else FAIL, f"{(retained or 0):.0%} of the advantage stays without the best subjects", measured, subgroups=table)


@check("ceiling", "The features carry information on the truth", ("feature columns",), min_features_above_null=1, fdr_q=0.05)
def ceiling(frame: AuditFrame, limits: dict) -> CheckResult:
    names = frame.features
    if not names:
        return _result(INSUFFICIENT, "no feature columns", missing=["numeric feature columns"])
    spread = frame.df.agg(*[F.stddev_pop(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    names = [c for c, s in zip(names, spread) if s]
    if not names:
        return _result(INSUFFICIENT, "every feature column is constant", missing=["features that vary"])
    found = information.feature_table(frame.df, names, "y_true", limits["fdr_q"])
    above = [f for f in found["features"] if f["mi"] > found["null_p95"]]
    survive = [f for f in found["features"] if f["q_pearson"] <= limits["fdr_q"] or f["q_spearman"] <= limits["fdr_q"]]
    measured = {"n_features": len(names), "max_mi": max(f["mi"] for f in found["features"]), "mi_null_p95": found["null_p95"], "n_above_null": len(above), "n_surviving_fdr": len(survive)}
    good = len(above) >= limits["min_features_above_null"] or bool(survive)
    top = sorted(found["features"], key=lambda f: (-abs(f["pearson"]), f["feature"]))[:10]
    return _result(PASS if good else FAIL, f"{len(above)} features above the null, {len(survive)} correlations survive", measured, top_features=top)
