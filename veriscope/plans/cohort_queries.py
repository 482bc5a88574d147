"""Registered queries on cohorts: thresholds, cuts, rollups, comparisons with a baseline, transfer between sites, nearest pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import information, windows
from ..operators import profiles, resample, ridge, screening, similarity
from ..session import table
from .catalog import SCREENING_SQL, SUBMISSION_SQL, bucket, query, screening_table, sql_bucket, submission
from .ingest import SEXES, SPLITS, IngestRecord, _mapped, per_subject

_REPLICATES = 200
_PEOPLE_SQL = f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'unknown' END AS sex, 15 + {sql_bucket("'age:' || CAST(c_custkey AS VARCHAR)", 60)} AS age FROM customer"


def _people(spark, sf_dir):
    k = F.col("c_custkey")
    sex = F.when(k % 3 == 0, "M").when(k % 3 == 1, "F").otherwise("unknown")
    return table(spark, sf_dir, "customer").select(k, sex.alias("sex"), (15 + bucket(F.concat(F.lit("age:"), k.cast("string")), 60)).alias("age"))


@query(f"WITH p AS ({_PEOPLE_SQL}) SELECT c_custkey, CASE sex WHEN 'M' THEN 13.0::DOUBLE WHEN 'F' THEN 12.0::DOUBLE END AS threshold FROM p")
def adult_thresholds(spark, sf_dir):
    """The threshold of every adult; null for an unknown sex."""
    return _people(spark, sf_dir).select("c_custkey", screening.adult_threshold().alias("threshold"))


@query(f"""
WITH s AS ({SCREENING_SQL}), t AS (SELECT site, score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth = 0) AS neg FROM s GROUP BY ALL),
w AS (SELECT site, score, sum(pos) OVER u AS tp, sum(neg) OVER u AS fp, sum(pos) OVER p AS n_pos, sum(neg) OVER p AS n_neg, coalesce((score + lead(score) OVER o) / 2.0::DOUBLE, score + 1) AS cut, row_number() OVER o AS i
      FROM t WINDOW p AS (PARTITION BY site), o AS (PARTITION BY site ORDER BY score), u AS (PARTITION BY site ORDER BY score ROWS UNBOUNDED PRECEDING)),
k AS (SELECT site, cut, tp, fp, n_pos, n_neg FROM w UNION ALL SELECT site, score - 1.0::DOUBLE, 0, 0, n_pos, n_neg FROM w WHERE i = 1),
q AS (SELECT site, cut, tp / nullif(n_pos, 0)::DOUBLE AS sensitivity, 1 - fp / nullif(n_neg, 0)::DOUBLE AS specificity FROM k),
c AS (SELECT site, max(sensitivity) FILTER (WHERE specificity >= 0.8) AS best FROM q GROUP BY site)
SELECT q.site, round(c.best, 6) AS sensitivity, round(max(specificity) FILTER (WHERE specificity >= 0.8 AND sensitivity = c.best), 6) AS specificity FROM q JOIN c ON q.site = c.site GROUP BY ALL
""")
def specificity_cuts(spark, sf_dir):
    """By site: the sensitivity left at the best cut that keeps a specificity of 0.8, and the largest specificity that goes with it."""
    options = screening.cuts(screening.score_table(screening_table(spark, sf_dir), "truth", "score", ["site"]), ["site"])
    chosen = screening.cut_for_specificity(options, 0.8, ["site"]).select("site", F.when(F.col("reached"), F.col("sensitivity")).alias("best"))
    met = options.join(F.broadcast(chosen), "site")  # one row a site
    kept = F.when((F.col("specificity") >= 0.8) & (F.col("sensitivity") == F.col("best")), F.col("specificity"))
    return met.groupBy("site").agg(F.round(F.max("best"), 6).alias("sensitivity"), F.round(F.max(kept), 6).alias("specificity"))


@query(f"""
WITH s AS ({SUBMISSION_SQL}),
a AS (SELECT subject_id, median(y_true) AS y_true, median(y_pred) AS y_pred, min(row_id) AS _row, arg_min(sex, row_id) AS sex, arg_min(device, row_id) AS device FROM s GROUP BY subject_id)
SELECT subject_id, round(y_true, 6) AS y_true, round(y_pred, 6) AS y_pred, _row, sex, device FROM a
""")
def subject_rollup(spark, sf_dir):
    """Rows to subjects as the ingestion does it: medians, first known attributes in row order."""
    rows = submission(spark, sf_dir).select("subject_id", "y_true", "y_pred", F.col("row_id").alias("_row"), "sex", "device")
    out = per_subject(rows, IngestRecord())
    return out.withColumns({c: F.round(c, 6) for c in ("y_true", "y_pred")})


@query("""
WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN ' Male' WHEN 1 THEN 'f' WHEN 2 THEN 'Woman ' WHEN 3 THEN NULL ELSE 'x' END AS raw, CASE doc_id % 4 WHEN 0 THEN 'training' WHEN 1 THEN 'valid' WHEN 2 THEN 'test' ELSE 'extra' END AS part FROM documents)
SELECT doc_id, CASE WHEN lower(trim(raw)) IN ('m', 'male', 'man') THEN 'M' WHEN lower(trim(raw)) IN ('f', 'female', 'woman') THEN 'F' ELSE raw END AS sex,
       CASE part WHEN 'training' THEN 'train' WHEN 'valid' THEN 'val' ELSE part END AS split FROM d
""")
def normalised_names(spark, sf_dir):
    """Spellings of sexes and splits brought to the contract's; unknown ones stay as they are."""
    i = F.col("doc_id")
    raw = F.when(i % 5 == 0, " Male").when(i % 5 == 1, "f").when(i % 5 == 2, "Woman ").when(i % 5 == 4, "x")
    part = F.when(i % 4 == 0, "training").when(i % 4 == 1, "valid").when(i % 4 == 2, "test").otherwise("extra")
    known = F.create_map(*[F.lit(x) for kv in SEXES.items() for x in kv])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(known[F.lower(F.trim(raw))], raw).alias("sex"), _mapped(part, SPLITS).alias("split"))


@query("""
WITH r AS (SELECT l_linestatus AS mode, l_returnflag AS flag, l_discount >= 0.05 AS hit, l_quantity AS area FROM lineitem)
SELECT CASE WHEN grouping(mode) = 0 THEN 'mode' ELSE 'flag' END AS dimension, coalesce(mode, flag) AS level, count(*) AS n, round(100.0 * count(*) FILTER (WHERE hit) / count(*), 6) AS rate_pct, round(median(area), 6) AS median_area
FROM r GROUP BY GROUPING SETS ((mode), (flag))
""")
def rate_table(spark, sf_dir):
    """Share of hits and median size by the levels of each dimension, in one pass."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("mode"), F.col("l_returnflag").alias("flag"), (F.col("l_discount") >= 0.05).alias("hit"), F.col("l_quantity").alias("area"))
    out = profiles.rates_by_dimension(rows, ["mode", "flag"], "hit", "area")
    return out.withColumns({"rate_pct": F.round("rate_pct", 6), "median_area": F.round("median_area", 6)})


@query("""
WITH l AS (SELECT 'brand' AS criterion, p_brand AS category, p_size FROM part UNION ALL SELECT 'type', p_type, p_size FROM part UNION ALL SELECT 'initial', left(p_name, 1), p_size FROM part)
SELECT criterion, category, count(*) FILTER (WHERE p_size < 10) AS small, count(*) FILTER (WHERE p_size BETWEEN 10 AND 29) AS medium, count(*) FILTER (WHERE p_size >= 30) AS large FROM l GROUP BY ALL
""")
def category_counts(spark, sf_dir):
    """Counts of each criterion's categories by class, classes as columns."""
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    parts = table(spark, sf_dir, "part").withColumns({"size_class": size, "initial": F.left("p_name", F.lit(1))})
    return profiles.category_counts(parts, {"brand": "p_brand", "type": "p_type", "initial": "initial"}, "size_class", ["small", "medium", "large"])


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS key_a, b.vec_id AS key_b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a JOIN v b ON a.vec_id < b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.4
""")
def cosine_pairs(spark, sf_dir):
    """Pairs with a cosine of 0.4 or more (few vectors of these tables are closer)."""
    return similarity.cosine_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.4).withColumn("cosine", F.round("cosine", 6))


_WORD_SQL = "SELECT p_partkey AS k, ('0x' || substr(md5(p_name), 1, 8))::BIGINT AS h FROM part"
_LEVELS = (0, 2, 5, 10, 15, 20)


@query(f"""
WITH w AS ({_WORD_SQL}), d AS (SELECT a.k, min(bit_count(xor(a.h, b.h))) AS d FROM w a, w b WHERE a.k % 3 = 0 AND b.k % 3 <> 0 GROUP BY a.k)
SELECT t AS at_most, (SELECT count(*) FROM d WHERE d.d <= t) AS n_rows FROM (VALUES {", ".join(f"({t})" for t in _LEVELS)}) v(t)
""")
def hamming_thresholds(spark, sf_dir):
    """How many rows of one collection have a value of the other within so many bits."""
    word = F.conv(F.substring(F.md5("p_name"), 1, 8), 16, 10).cast("long")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), word.alias("h"))
    least = similarity.hamming_least(rows.where("k % 3 = 0"), rows.where("k % 3 <> 0"), "k", "h")
    return similarity.within_thresholds(least, "distance", _LEVELS)


@query(f"""
WITH s AS ({SUBMISSION_SQL}), m AS (SELECT avg(quantity) AS x, stddev_pop(quantity) AS sd, avg(y_true) AS y, count(*) AS n FROM s WHERE device = 'O'),
b AS (SELECT any_value(m.x) AS x, any_value(m.sd) AS sd, any_value(m.y) AS y, sum((s.quantity - m.x) / m.sd * s.y_true) / (any_value(m.n) + 10.0) AS beta FROM s, m WHERE device = 'O')
SELECT site, count(*) AS n, round(avg(abs(b.y + (s.quantity - b.x) / b.sd * b.beta - s.y_true)), 4) AS mae FROM s, b WHERE device <> 'O' GROUP BY site
""")
def transfer_error(spark, sf_dir):
    """A ridge fit on one device's rows, judged on the other's by site."""
    rows = submission(spark, sf_dir)
    scored = ridge.transfer_ridge(rows.where("device = 'O'"), rows.where("device <> 'O'"), ["quantity"], "y_true", 10.0)
    return scored.groupBy("site").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("ridge_pred") - F.col("y_true"))), 4).alias("mae"))


@query(f"""
WITH s AS ({SUBMISSION_SQL}), u AS (SELECT subject_id, avg(abs(y_pred - y_true)) AS m, avg(abs(20000 + 100 * quantity - y_true)) AS b FROM s GROUP BY subject_id),
k AS (SELECT *, {resample.text_key_sql("subject_id")} AS key FROM u),
h AS (SELECT i, b - m AS gap, {resample.scattered_sql(resample.BOOTSTRAP_SEED, "i", "key")} AS h FROM k, range({_REPLICATES}) r(i)),
d AS (SELECT i, gap, {resample.times_drawn_sql("h")} AS w FROM h),
v AS (SELECT i, sum(w * gap) / nullif(sum(w), 0) AS v FROM d GROUP BY i)
SELECT (SELECT count(*) FROM u) AS n_subjects, (SELECT round(avg(b - m), 4) FROM u) AS gain, round(quantile_cont(v, 0.025), 4) AS lo, round(quantile_cont(v, 0.975), 4) AS hi, quantile_cont(v, 0.025) > 0 AS better FROM v
""")
def baseline_comparison(spark, sf_dir):
    """The model against a baseline on the same subjects: mean gain in error with the interval of whole-subject resamples."""
    rows = submission(spark, sf_dir).groupBy("subject_id").agg(F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("m"), F.avg(F.abs(20000 + 100 * F.col("quantity") - F.col("y_true"))).alias("b"))
    found = resample.paired_gain(rows, "subject_id", "b", "m", _REPLICATES)
    out = (found["n"], round(found["gain"], 4), round(found["lo"], 4), round(found["hi"], 4), found["lo"] > 0)
    return spark.createDataFrame([out], "n_subjects long, gain double, lo double, hi double, better boolean")


@query(f"""
WITH s AS ({SCREENING_SQL}), c AS (SELECT site, count(*) AS n, count(*) FILTER (WHERE score < 70) AS hits FROM s WHERE truth = 1 GROUP BY site),
d AS (SELECT site, i, hits, n, unnest(range(n)) AS j FROM c, range({_REPLICATES}) r(i)),
v AS (SELECT site, i, count(*) FILTER (WHERE {resample.scattered_sql(resample.BOOTSTRAP_SEED, "i", "j")} % n::UHUGEINT < hits::UHUGEINT) / any_value(n)::DOUBLE AS v FROM d GROUP BY site, i)
SELECT c.site, c.n, round(c.hits / c.n::DOUBLE, 6) AS sensitivity, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM v JOIN c ON v.site = c.site GROUP BY ALL
""")
def site_rate_intervals(spark, sf_dir):
    """Sensitivity at a fixed cut by site, with its resampling interval."""
    hits = screening_table(spark, sf_dir).where("truth = 1").groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.col("score") < 70).alias("hits"))
    out = resample.rate_intervals(hits, ["site"], "hits", "n", _REPLICATES)
    return out.select("site", "n", *[F.round(c, 6).alias(n) for c, n in (("rate", "sensitivity"), ("lo", "lo"), ("hi", "hi"))])


@query(f"""
WITH s AS (SELECT l_extendedprice AS y, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem),
p AS (SELECT row_id, y, {" , ".join(f"y * 0.5 + {sql_bucket(chr(39) + f'seed{k}:' + chr(39) + ' || CAST(row_id AS VARCHAR)', 20000)} AS s{k}" for k in range(3))} FROM s)
SELECT count(*) AS n, round(avg(abs((s0 + s1 + s2) / 3 - y)), 4) AS mae_of_mean, round((avg(abs(s0 - y)) + avg(abs(s1 - y)) + avg(abs(s2 - y))) / 3, 4) AS mean_of_mae FROM p
""")
def seed_average(spark, sf_dir):
    """Error of the seeds' mean prediction beside the seeds' mean error."""
    y = F.col("l_extendedprice")
    row = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    seeds = [(y * 0.5 + bucket(F.concat(F.lit(f"seed{k}:"), row), 20000)).alias(f"s{k}") for k in range(3)]
    rows = table(spark, sf_dir, "lineitem").select(y.alias("y"), *seeds)
    mean = profiles.row_mean(["s0", "s1", "s2"])
    each = sum(F.avg(F.abs(F.col(f"s{k}") - F.col("y"))) for k in range(3)) / 3
    return rows.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(mean - F.col("y"))), 4).alias("mae_of_mean"), F.round(each, 4).alias("mean_of_mae"))


@query("""
WITH c AS (SELECT DISTINCT event_type, row_number() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)),
w AS (SELECT event_type, CASE WHEN 600 + 50 * i > 720 THEN 0.0 ELSE i / 10.0 END::DOUBLE AS w FROM c)
SELECT user_id, round(sum(w * value), 6) AS mixed FROM (SELECT user_id, event_type, avg(value) AS value FROM events WHERE value IS NOT NULL GROUP BY ALL) e JOIN w ON e.event_type = w.event_type GROUP BY user_id
""")
def channel_mix(spark, sf_dir):
    """A weighted sum of each user's channel features; channels beyond 720 nm weigh nothing."""
    events = table(spark, sf_dir, "events").where("value is not null")
    means = events.groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))
    names = sorted(r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect())  # the kinds of channel
    weights = {name: (i / 10.0, 600 + 50 * i) for i, name in enumerate(names, 1)}
    return profiles.weighted_channels(means, "user_id", "event_type", "value", weights, 720).withColumn("mixed", F.round("mixed", 6))


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL),
w AS (SELECT user_id, value, unnest(range(CAST(greatest(0, ceil((i - 19) / 10.0)) AS BIGINT), CAST(least(floor((n - 20) / 10.0), floor(i / 10.0)) AS BIGINT) + 1)) AS win FROM r WHERE n >= 20),
p AS (SELECT user_id, win, stddev_pop(value) AS sd, max(value) AS top FROM w GROUP BY ALL)
SELECT user_id, count(*) AS n_windows, round(median(top), 6) AS prediction FROM p WHERE sd >= 1e-9 GROUP BY user_id
""")
def window_medians(spark, sf_dir):
    """A value for each window, and the median over a user's windows."""
    wins = windows.hopping_windows(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 20, 10)
    tops = wins.groupBy("user_id", "window").agg(F.max("value").alias("top"))
    return tops.groupBy("user_id").agg(F.count("*").alias("n_windows"), F.round(F.median("top"), 6).alias("prediction"))


@query(f"""
WITH s AS ({SCREENING_SQL}), m AS (SELECT site, max(n) / sum(n)::DOUBLE AS base_rate, arg_max(truth, n * 2 - truth) AS majority, CAST(sum(n) AS BIGINT) AS n FROM (SELECT site, truth, count(*) AS n FROM s GROUP BY ALL) GROUP BY site)
SELECT site, n, majority, round(base_rate, 6) AS base_rate FROM m
""")
def majority_rates(spark, sf_dir):
    """The commonest class of each site and its share; ties go to the smaller class."""
    return information.majority(screening_table(spark, sf_dir), "truth", ["site"]).withColumn("base_rate", F.round("base_rate", 6))
