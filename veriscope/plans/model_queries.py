"""Model metrics, screening, power, resampling and similarity over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, power, windows
from ..operators import boosting, resample, ridge, screening, similarity
from ..operators.running import rank_in_slices, sliced
from ..session import table
from .catalog import SCREENING_SQL, SUBMISSION_SQL, bucket, query, screening_table, sql_bucket, submission


@query()
def grouped_ridge_cv(spark, sf_dir):
    """Out-of-fold error of ridge regression on two numeric and two encoded columns, by fold."""
    s = submission(spark, sf_dir).withColumns({"is_a": (F.col("sex") == "A").cast("double"), "is_n": (F.col("sex") == "N").cast("double")})
    out = ridge.grouped_ridge(s, ["quantity", "is_a", "is_n"], "y_true", "fold")
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round(metrics.mae("y_true", "ridge_pred"), 2).alias("mae"), F.round(metrics.r2("y_true", "ridge_pred"), 4).alias("r2"))


_TREES = 10


@query()
def boosted_trees_cv(spark, sf_dir):
    """Out-of-fold error of boosted trees on the columns of the ridge, by fold: what a linear model misses."""
    s = submission(spark, sf_dir).withColumns({"is_a": (F.col("sex") == "A").cast("double"), "is_n": (F.col("sex") == "N").cast("double")})
    out = boosting.boosted_trees(s, ["quantity", "is_a", "is_n"], "y_true", "fold", trees=_TREES, rate=0.3)
    return out.groupBy("fold").agg(F.count("*").alias("n"), F.round(metrics.mae("y_true", "boost_pred"), 2).alias("mae"), F.round(metrics.r2("y_true", "boost_pred"), 4).alias("r2"))


_ADVANTAGE_SQL = f"""
s AS ({SUBMISSION_SQL}), t AS (SELECT avg(y_true) AS mean FROM s),
e AS (SELECT s.*, abs(mean - y_true) AS base_error, abs(y_pred - y_true) AS model_error FROM s, t)
"""


def _errors(spark, sf_dir):
    s = submission(spark, sf_dir)
    mean = s.agg(F.avg("y_true").alias("mean"))
    gaps = {"base_error": F.abs(F.col("mean") - F.col("y_true")), "model_error": F.abs(F.col("y_pred") - F.col("y_true"))}
    return s.crossJoin(F.broadcast(mean)).withColumns(gaps)  # one number


@query(f"""
WITH {_ADVANTAGE_SQL}, u AS (SELECT 'device' AS attribute, device AS level, * FROM e UNION ALL SELECT 'sex', sex, * FROM e)
SELECT attribute, level, count(*) AS n, round(avg(base_error) - avg(model_error), 2) AS advantage FROM u GROUP BY attribute, level HAVING count(*) >= 5
""")
def subgroup_table(spark, sf_dir):
    """The model's advantage over the population mean, by level of each attribute."""
    e = _errors(spark, sf_dir)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("level")) for a in ("device", "sex")]))
    long = e.select(pairs.alias("g"), "base_error", "model_error").select("g.attribute", "g.level", "base_error", "model_error")
    out = long.groupBy("attribute", "level").agg(F.count("*").alias("n"), F.round(F.avg("base_error") - F.avg("model_error"), 2).alias("advantage"))
    return out.where("n >= 5")


@query(f"""
WITH {_ADVANTAGE_SQL}, g AS (SELECT subject_id, count(*) AS n, sum(base_error) AS b, sum(model_error) AS m FROM e GROUP BY subject_id),
r AS (SELECT *, row_number() OVER (ORDER BY m / n, subject_id) AS i, count(*) OVER () AS k FROM g)
SELECT count(*) AS n_subjects, CAST(greatest(1, round_even(max(k) * 0.1, 0)) AS BIGINT) AS n_dropped,
       round((sum(b) - sum(m)) / sum(n), 2) AS advantage,
       round(sum(CASE WHEN i > greatest(1, round_even(k * 0.1, 0)) THEN b - m END) / sum(CASE WHEN i > greatest(1, round_even(k * 0.1, 0)) THEN n END), 2) AS kept
FROM r
""")
def best_decile_drop(spark, sf_dir):
    """The advantage with and without the best tenth of the subjects."""
    g = _errors(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("n"), F.sum("base_error").alias("b"), F.sum("model_error").alias("m"))
    r = rank_in_slices(sliced(g.withColumn("e", F.col("m") / F.col("n")), "e"), [], ["e", "subject_id"])
    take = F.greatest(F.lit(1), F.bround(F.col("_k") * 0.1, 0).cast("long"))
    kept = F.col("_i") > take
    return r.agg(
        F.count("*").alias("n_subjects"),
        F.max(take).alias("n_dropped"),
        F.round((F.sum("b") - F.sum("m")) / F.sum("n"), 2).alias("advantage"),
        F.round(F.sum(F.when(kept, F.col("b") - F.col("m"))) / F.sum(F.when(kept, F.col("n"))), 2).alias("kept"),
    )


@query("WITH s AS (SELECT l_extendedprice AS y_true, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem), p AS (" + " UNION ALL ".join(
    f"SELECT {k} AS seed, avg(abs(y_true * 0.5 + {sql_bucket(chr(39) + f'seed{k}:' + chr(39) + ' || CAST(row_id AS VARCHAR)', 20000)} - y_true)) AS mae FROM s" for k in range(5)
) + ") SELECT count(*) AS n_seeds, round(avg(mae), 2) AS mean_mae, round(stddev_samp(mae), 3) AS sd FROM p")
def seed_spread(spark, sf_dir):
    """Spread (sample SD) of the error over replicate prediction columns."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y_true"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"))
    gap = lambda k: F.abs(F.col("y_true") * 0.5 + bucket(F.concat(F.lit(f"seed{k}:"), F.col("row_id").cast("string")), 20000) - F.col("y_true"))
    wide = lines.agg(*[F.avg(gap(k)).alias(f"s{k}") for k in range(5)])
    long = wide.unpivot([], [f"s{k}" for k in range(5)], "seed", "mae")
    return long.agg(F.count("*").alias("n_seeds"), F.round(F.avg("mae"), 2).alias("mean_mae"), F.round(F.stddev_samp("mae"), 3).alias("sd"))


_PERMUTED = 60


@query(f"""
WITH s AS ({SUBMISSION_SQL}),
u AS (SELECT subject_id, avg(y_true) AS truth, avg(y_pred) AS submitted, avg(quantity) AS other, row_number() OVER (ORDER BY subject_id) - 1 AS j FROM s GROUP BY subject_id),
h AS (SELECT i, j, {resample.scattered_sql(resample.PERMUTATION_SEED, "i", "j")} AS h FROM u, range({_PERMUTED}) r(i)),
o AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY h) - 1 AS r FROM h),
e AS (SELECT i, avg(abs(a.submitted - b.truth)) AS submitted, avg(abs(a.other - b.truth)) AS other FROM o JOIN u a ON a.j = o.r JOIN u b ON b.j = o.j GROUP BY i)
SELECT count(*) AS n_permutations, round(avg(least(submitted, other)), 4) AS null_mean, round(min(least(submitted, other)), 4) AS null_min FROM e
""")
def permutation_check(spark, sf_dir):
    """Null distribution of the best of two candidates under subject-wise label permutation, summarised."""
    rows = submission(spark, sf_dir).groupBy(F.col("subject_id").alias("subject")).agg(F.avg("y_true").alias("truth"), F.avg("y_pred").alias("submitted"), F.avg("quantity").alias("other"))
    null = resample.permuted_errors(rows, "subject", "truth", "subject", {"submitted": "submitted", "other": "other"}, _PERMUTED)
    return null.agg(
        F.count("*").alias("n_permutations"),
        F.round(F.avg(F.least("submitted", "other")), 4).alias("null_mean"),
        F.round(F.min(F.least("submitted", "other")), 4).alias("null_min"),
    )


@query(f"""
WITH p AS (SELECT p_partkey AS k, p_brand AS grp, ({sql_bucket("'p:' || CAST(p_partkey AS VARCHAR)", 1000)} + 1) / 1000.0::DOUBLE AS p FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, k) AS i, count(*) OVER (PARTITION BY grp) AS n FROM p)
SELECT k, grp, p, round(least(1.0, min(p * n / i) OVER (PARTITION BY grp ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r
""")
def bh_fdr(spark, sf_dir):
    p = (bucket(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")), 1000) + 1) / 1000.0
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("grp"), p.alias("p"))
    return metrics.benjamini_hochberg(rows, "p", "q", ["grp"]).withColumn("q", F.round("q", 9))


@query("""
WITH r AS (SELECT l_returnflag AS flag, l_quantity AS a, l_extendedprice AS b,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS ra,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS rb FROM lineitem)
SELECT flag, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY flag
""")
def pearson_spearman(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    ranked = metrics.with_average_ranks(rows, {"a": "ra", "b": "rb"}, ["flag"])
    return ranked.groupBy("flag").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("pearson"), F.round(F.corr("ra", "rb"), 6).alias("spearman"))


_RATES_SQL = """round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity,
  round(tp / nullif(tp + fp, 0)::DOUBLE, 6) AS ppv, round(tn / nullif(tn + fn, 0)::DOUBLE, 6) AS npv, round((tp + fp) / n::DOUBLE, 6) AS referral_rate,
  round(fp / n::DOUBLE, 6) AS false_referral_rate, round(n / nullif(tp, 0)::DOUBLE, 6) AS needed_to_screen"""


@query(f"""
WITH s AS ({SCREENING_SQL}), c AS (SELECT fold, count(*) FILTER (WHERE truth = 1 AND score < 70) AS tp, count(*) FILTER (WHERE truth = 0 AND score < 70) AS fp,
  count(*) FILTER (WHERE truth = 0 AND score >= 70) AS tn, count(*) FILTER (WHERE truth = 1 AND score >= 70) AS fn, count(*) AS n FROM s GROUP BY fold)
SELECT fold, tp, fp, tn, fn, {_RATES_SQL} FROM c
""")
def confusion_metrics(spark, sf_dir):
    counts = screening_table(spark, sf_dir).groupBy("fold").agg(*metrics.confusion("truth", F.col("score") < 70))
    return counts.select("fold", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(n) for n, c in metrics.screening_rates().items()])


@query(f"""
WITH s AS ({SCREENING_SQL}), g AS (SELECT fold, score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth = 0) AS neg FROM s GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g WINDOW w AS (PARTITION BY fold ORDER BY score ROWS UNBOUNDED PRECEDING))
SELECT fold, CAST(sum(pos + neg) AS BIGINT) AS n, round(sum(pos) / sum(pos + neg), 6) AS prevalence,
       CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (sum(pos) * sum(neg)), 6) END AS auroc,
       CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN round(sum(pos * tp / (tp + fp)::DOUBLE) / sum(pos), 6) END AS auprc
FROM c GROUP BY fold
""")
def auroc_auprc(spark, sf_dir):
    out = screening.ranking_metrics(screening_table(spark, sf_dir), "truth", "score", ["fold"])
    return out.select("fold", "n", *[F.round(c, 6).alias(c) for c in ("prevalence", "auroc", "auprc")])


def _cuts_sql(table: str) -> str:
    return f"""
g AS (SELECT fold, score, sum(pos) AS pos, sum(neg) AS neg FROM {table} GROUP BY fold, score),
w AS (SELECT fold, score, sum(pos) OVER u AS tp, sum(neg) OVER u AS fp, sum(pos) OVER p AS n_pos, sum(neg) OVER p AS n_neg,
             coalesce((score + lead(score) OVER o) / 2.0::DOUBLE, score + 1) AS cut, row_number() OVER o AS i
      FROM g WINDOW p AS (PARTITION BY fold), o AS (PARTITION BY fold ORDER BY score), u AS (PARTITION BY fold ORDER BY score ROWS UNBOUNDED PRECEDING)),
k AS (SELECT fold, cut, tp, fp, n_pos, n_neg FROM w UNION ALL SELECT fold, score - 1.0::DOUBLE, 0, 0, n_pos, n_neg FROM w WHERE i = 1),
q AS (SELECT fold, cut, tp / nullif(n_pos, 0)::DOUBLE AS sensitivity, 1 - fp / nullif(n_neg, 0)::DOUBLE AS specificity FROM k),
b AS (SELECT *, sensitivity >= 0.9 AS reached, row_number() OVER (PARTITION BY fold ORDER BY sensitivity >= 0.9 DESC,
      CASE WHEN sensitivity >= 0.9 THEN specificity ELSE sensitivity END DESC, cut) AS i FROM q)
"""


@query(f"WITH s AS ({SCREENING_SQL}), t AS (SELECT fold, CAST(score AS DOUBLE) AS score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth = 0) AS neg FROM s GROUP BY ALL), {_cuts_sql('t')} SELECT fold, cut, round(sensitivity, 6) AS sensitivity, round(specificity, 6) AS specificity, reached FROM b WHERE i = 1")
def choose_cut(spark, sf_dir):
    options = screening.cuts(screening.score_table(screening_table(spark, sf_dir), "truth", "score", ["fold"]), ["fold"])
    best = screening.cut_for_sensitivity(options, 0.9, ["fold"])
    return best.select("fold", "cut", F.round("sensitivity", 6).alias("sensitivity"), F.round("specificity", 6).alias("specificity"), "reached")


@query(f"""
WITH s AS ({SCREENING_SQL}), o AS (SELECT fold, CAST(score AS DOUBLE) AS score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth = 0) AS neg FROM s GROUP BY ALL),
t AS (SELECT h.fold, o.score, o.pos, o.neg FROM o, (SELECT DISTINCT fold FROM o) h WHERE o.fold <> h.fold), {_cuts_sql('t')}
SELECT s.row_id, s.fold, b.cut, s.score < b.cut AS called FROM s JOIN b ON s.fold = b.fold AND b.i = 1
""")
def nested_calls(spark, sf_dir):
    """Calls by a cut that the other folds choose."""
    return screening.nested_calls(screening_table(spark, sf_dir), "truth", "score", "fold", 0.9).select("row_id", "fold", "cut", "called")


_RESAMPLES = 200
_FITS = 40


@query(f"""
WITH s AS ({SCREENING_SQL}),
h AS (SELECT i, truth, score, {resample.scattered_sql(resample.BOOTSTRAP_SEED, "i", "row_id")} AS h FROM s, range({_RESAMPLES}) r(i)),
d AS (SELECT i, truth, score, {resample.times_drawn_sql("h")} AS w FROM h),
v AS (SELECT i, CASE WHEN sum(w * truth) > 0 AND sum(w * (1 - truth)) > 0 THEN sum(CASE WHEN score < 70 THEN w * truth ELSE 0 END) / sum(w * truth)::DOUBLE END AS v FROM d GROUP BY i)
SELECT count(v) AS n, count(*) - count(v) AS skipped, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi FROM v
""")
def bootstrap_ci(spark, sf_dir):
    """Percentile interval of the sensitivity at a fixed cut; one-class resamples are counted as skipped."""
    positive = F.col("truth").cast("double")
    columns = {"positives": positive, "caught": F.when(F.col("score") < 70, positive)}
    sums = resample.replicate_sums(screening_table(spark, sf_dir), F.col("row_id"), columns, _RESAMPLES)
    value = F.when((F.col("positives") > 0) & (F.col("positives") < F.col("drawn")), F.col("caught") / F.col("positives"))
    found = resample.interval(sums.select(value.alias("value")))
    digits = lambda v: None if v is None else round(v, 9)
    return spark.createDataFrame([(found["n"], found["skipped"], digits(found["lo"]), digits(found["hi"]))], "n long, skipped long, lo double, hi double")


@query(f"""
WITH s AS (SELECT l_extendedprice::DOUBLE AS y, l_quantity::DOUBLE AS x, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem),
h AS (SELECT i, x, y, {resample.scattered_sql(resample.BOOTSTRAP_SEED, "i", "row_id")} AS h FROM s, range({_FITS}) r(i)),
d AS (SELECT i, x, y, {resample.times_drawn_sql("h")} AS w FROM h),
q AS (SELECT i, sum(w) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy FROM d GROUP BY i),
b AS (SELECT (n * xy - x * y) / (n * xx - x * x) AS slope, (y - (n * xy - x * y) / (n * xx - x * x) * x) / n AS intercept FROM q)
SELECT t.term, round(quantile_cont(t.v, 0.025), 3) AS lo, round(quantile_cont(t.v, 0.975), 3) AS hi, count(*) AS n FROM (SELECT 'intercept' AS term, intercept AS v FROM b UNION ALL SELECT 'l_quantity', slope FROM b) t GROUP BY t.term
""")
def least_squares_intervals(spark, sf_dir):
    """Intervals of a least-squares line's coefficients over resampled rows."""
    rows = table(spark, sf_dir, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = resample.least_squares_intervals(rows, F.col("row_id"), ["l_extendedprice"], ["l_quantity"], _FITS)
    return found.select("term", F.round("lo", 3).alias("lo"), F.round("hi", 3).alias("hi"), "n")


@query(f"""
WITH {_ADVANTAGE_SQL}
SELECT sex, count(*) AS n, round(avg(base_error - model_error), 2) AS diff, round(stddev_samp(base_error - model_error) / sqrt(count(*)), 3) AS se,
       round(sqrt((var_samp(base_error) + var_samp(model_error)) / count(*)), 3) AS se_unpaired, round(corr(base_error, model_error), 6) AS correlation,
       round(2.801585218 * stddev_samp(base_error - model_error) / sqrt(count(*)), 2) AS mde_80,
       round(3.241515550 * stddev_samp(base_error - model_error) / sqrt(count(*)), 2) AS mde_90 FROM e GROUP BY sex
""")
def paired_se_mde(spark, sf_dir):
    out = power.paired_errors(_errors(spark, sf_dir), "base_error", "model_error", ["sex"])
    out = out.withColumns({f"mde_{round(100 * p)}": power.detectable(F.col("se"), p) for p in power.POWERS})
    digits = {"diff": 2, "se": 3, "se_unpaired": 3, "correlation": 6, "mde_80": 2, "mde_90": 2}
    return out.select("sex", "n", *[F.round(c, d).alias(c) for c, d in digits.items()])


_INTEGRAL = "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(x * i / 2000, 2) / 2)))"


@query(f"""
WITH {_ADVANTAGE_SQL},
stat AS (SELECT sex, count(*) AS n, stddev_samp(base_error - model_error) / sqrt(count(*)) AS se, CASE sex WHEN 'N' THEN 300.0::DOUBLE WHEN 'A' THEN 100.0::DOUBLE ELSE 0.5::DOUBLE END AS yardstick FROM e GROUP BY sex),
ask AS (SELECT *, yardstick / se - 1.959963984540054 AS x, 2.801585218112969 * se AS mde FROM stat)
SELECT sex, round(0.5 + x / 6000 / sqrt(2 * pi()) * {_INTEGRAL}, 6) AS power, CASE WHEN mde <= yardstick THEN 'ADEQUATELY POWERED' ELSE 'UNDERPOWERED' END AS adequacy,
       round(n * pow(mde / yardstick, 2), 2) AS group_needed, round(n * pow(mde / yardstick, 2) / 0.25, 2) AS cohort_needed, yardstick >= 1.0 AS crosses_band, round(yardstick * n, 4) AS subjects_moved FROM ask
""")
def power_design(spark, sf_dir):
    """Power at a yardstick declared in advance, and the sizes at which it would be found."""
    rows = power.paired_errors(_errors(spark, sf_dir), "base_error", "model_error", ["sex"])
    rows = rows.withColumns({"yardstick": F.when(F.col("sex") == "N", 300.0).when(F.col("sex") == "A", 100.0).otherwise(0.5), "share": F.lit(0.25)})
    out = power.assessed(rows, share="share")
    digits = {"power": 6, "group_needed": 2, "cohort_needed": 2, "subjects_moved": 4}
    return out.select("sex", "adequacy", "crosses_band", *[F.round(c, d).alias(c) for c, d in digits.items()])


_HASH_SQL = "SELECT p_partkey AS k, (('0x' || substr(md5(p_brand || p_type), 1, 15))::BIGINT & ~63::BIGINT) + (p_size % 16) AS h FROM part"


def _hashes(spark, sf_dir):
    """A 64-bit value for each part: of brand and type, with low bits that vary by size."""
    raw = F.conv(F.substring(F.md5(F.concat("p_brand", "p_type")), 1, 15), 16, 10).cast("long")
    value = raw.bitwiseAND(F.lit(~63)) + F.col("p_size") % 16
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), value.alias("h"))


@query(f"WITH h AS ({_HASH_SQL}) SELECT a.k AS key_a, b.k AS key_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM h a JOIN h b ON a.k < b.k WHERE bit_count(xor(a.h, b.h)) <= 3")
def hamming_pairs(spark, sf_dir):
    """Pairs within three bits, by disjoint bands."""
    return similarity.hamming_pairs(_hashes(spark, sf_dir), "k", "h", 3)


@query(f"""
WITH h AS ({_HASH_SQL}), d AS (SELECT a.k AS key, b.k AS nearest, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS distance FROM h a, h b WHERE a.k % 2 = 0 AND b.k % 2 = 1 AND bit_count(xor(a.h, b.h)) <= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY distance, nearest) AS i FROM d)
SELECT key, nearest, distance FROM r WHERE i = 1
""")
def hamming_nearest(spark, sf_dir):
    """The nearest value of one collection for each of another."""
    h = _hashes(spark, sf_dir)
    return similarity.hamming_nearest(h.where("k % 2 = 0"), h.where("k % 2 = 1"), "k", "h", 3)


@query("""
WITH c AS (SELECT a.vec_id AS key, b.vec_id AS nearest, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY cosine DESC, nearest) AS i FROM c)
SELECT key, nearest, round(cosine, 6) AS cosine FROM r WHERE i = 1
""")
def cosine_nn(spark, sf_dir):
    return similarity.cosine_nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumn("cosine", F.round("cosine", 6))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
w AS (SELECT user_id, value, i, n, unnest(range(CAST(greatest(0, ceil((i - 19) / 10.0)) AS BIGINT), CAST(least(floor((n - 20) / 10.0), floor(i / 10.0)) AS BIGINT) + 1)) AS win FROM r WHERE n >= 20),
s AS (SELECT *, avg(value) OVER (PARTITION BY user_id, win) AS m, stddev_pop(value) OVER (PARTITION BY user_id, win) AS sd FROM w)
SELECT user_id, win AS "window", i - win * 10 AS i, value, round((value - m) / sd, 6) AS z FROM s WHERE sd >= 1e-9
""")
def hopping_windows(spark, sf_dir):
    """Windows of 20 samples every 10 over each user's events, standardised."""
    out = windows.hopping_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 20, 10)
    return out.withColumn("i", F.col("i").cast("long")).withColumn("z", F.round("z", 6))
