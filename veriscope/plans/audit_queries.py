"""The audit itself, and the operators around it, over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regression, screening, splits
from ..sources import manifest
from ..session import cut, table
from .audit import run_audit
from .catalog import MEASUREMENT_SQL, SCREENING_SQL, SUBMISSION_SQL, measurements, query, screening_table, submission
from .contract import load


@query()
def audit_report(spark, sf_dir):
    """All eight checks over suppliers as subjects: one row a check."""
    s = submission(spark, sf_dir)
    rows = s.groupBy("subject_id", "site").agg(F.avg("y_true").alias("y_true"), F.avg("y_pred").alias("y_pred"), F.avg("quantity").alias("quantity"))
    rows = cut(rows, "suppliers")  # line items are added up once, not again for each pass of a check
    dealt = splits.grouped_split(rows, "subject_id", {"train": 0.7, "test": 0.3}, seed=1)
    seeds = {f"y_pred_seed__{k}": F.col("y_pred") * (1 + k / 1000) for k in range(3)}
    rows = rows.join(dealt, "subject_id").withColumns(seeds).withColumn("_row", F.xxhash64("subject_id"))
    content = rows.select("_row", F.md5("subject_id").alias("md5"), F.xxhash64("subject_id", F.lit(7)).alias("phash"))
    report = run_audit(load(rows, content=content), thresholds={"permutation": {"n_permutations": 99}})
    return report.to_frame(spark).select("check_id", "title", "verdict", "headline", "preregistered")


@query(f"""
WITH s AS (SELECT * FROM ({SCREENING_SQL}) WHERE truth IS NOT NULL), g AS (SELECT fold, CAST(score AS DOUBLE) AS score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth = 0) AS neg FROM s GROUP BY ALL),
w AS (SELECT fold, score, sum(pos) OVER u AS tp, sum(neg) OVER u AS fp, sum(pos) OVER p AS np, sum(neg) OVER p AS nn, coalesce((score + lead(score) OVER o) / 2, score + 1) AS cut, row_number() OVER o AS i
      FROM g WINDOW p AS (PARTITION BY fold), o AS (PARTITION BY fold ORDER BY score), u AS (PARTITION BY fold ORDER BY score ROWS UNBOUNDED PRECEDING)),
k AS (SELECT fold, cut, tp, fp, np, nn FROM w UNION ALL SELECT fold, score - 1, 0, 0, np, nn FROM w WHERE i = 1)
SELECT fold, cut, round(tp / nullif(np, 0)::DOUBLE, 6) AS tpr, round(fp / nullif(nn, 0)::DOUBLE, 6) AS fpr FROM k
""")
def roc_points(spark, sf_dir):
    points = screening.roc_points(screening_table(spark, sf_dir), "truth", "score", ["fold"])
    return points.select("fold", "cut", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


@query(f"""
SELECT row_id, site FROM ({MEASUREMENT_SQL}) ORDER BY md5('5:' || CAST(row_id AS VARCHAR)), row_id LIMIT 50
""")
def exact_sample(spark, sf_dir):
    """Exactly fifty rows in hash order."""
    return splits.sample_rows(measurements(spark, sf_dir), "row_id", 50, seed=5).select("row_id", "site")


@query(f"""
WITH s AS ({SUBMISSION_SQL}), c AS (SELECT sex AS k, quantity AS x, avg(y_true) AS y FROM s GROUP BY ALL),
n AS (SELECT k, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM c WINDOW w AS (PARTITION BY k ORDER BY x))
SELECT k, round(min(x + (52000.0::DOUBLE - y) / (ny - y) * (nx - x)), 4) AS crossing FROM n WHERE (y - 52000.0::DOUBLE) * (ny - 52000.0::DOUBLE) <= 0 AND y <> ny GROUP BY k
""")
def threshold_crossing(spark, sf_dir):
    """Where a mean curve first passes a level, by linear interpolation."""
    curve = submission(spark, sf_dir).groupBy(F.col("sex").alias("k"), F.col("quantity").alias("x")).agg(F.avg("y_true").alias("y"))
    return regression.crossings(curve, "x", "y", 52000.0, ["k"]).select("k", F.round("crossing", 4).alias("crossing"))


@query("""
SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem
""")
def least_squares(spark, sf_dir):
    fit = regression.least_squares(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], ["l_quantity"])["l_extendedprice"]
    return spark.createDataFrame([(fit["intercept"], fit["l_quantity"])], "a double, b double").select(F.round("a", 3).alias("intercept"), F.round("b", 4).alias("slope"))


@query(f"""
WITH s AS ({SUBMISSION_SQL}), m AS (SELECT avg(y_true) AS mean FROM s),
g AS (SELECT avg(abs(mean - y_true)) - avg(abs(y_pred - y_true)) AS d FROM s, m GROUP BY subject_id),
r AS (SELECT d, abs(d) AS a, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rank FROM g WHERE d <> 0),
w AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN rank ELSE 0 END) AS w, (SELECT coalesce(sum(c * (c * c - 1)), 0) FROM (SELECT count(*) AS c FROM r GROUP BY a)) AS ties FROM r),
z AS (SELECT n, w, (n * (n + 1) / 4.0::DOUBLE - least(w, n * (n + 1) / 2.0::DOUBLE - w)) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE - ties / 48.0::DOUBLE) AS x FROM w)
SELECT n, w, round(least(1.0, 1 - x / 3000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(x * i / 2000, 2) / 2)))), 9) AS p FROM z
""")
def signed_rank(spark, sf_dir):
    """Wilcoxon's test (normal form) of the model's errors against the population mean's, over suppliers."""
    s = submission(spark, sf_dir)
    mean = s.agg(F.avg("y_true").alias("mean"))
    rows = s.crossJoin(F.broadcast(mean)).groupBy("subject_id")  # one number
    rows = rows.agg(F.avg(F.abs(F.col("mean") - F.col("y_true"))).alias("a"), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("b"))
    found = regression.wilcoxon(rows, "a", "b", least=1, exact_to=0)
    p = regression.simpson_p(found.get("z"))
    return spark.createDataFrame([(found["n"], found["w"], None if p is None else round(p, 9))], "n long, w double, p double")


@query("""
WITH d AS (SELECT 'docs:' || source || ':' || CASE WHEN length(CAST(doc_id AS VARCHAR)) >= 3 THEN CAST(doc_id AS VARCHAR) ELSE lpad(CAST(doc_id AS VARCHAR), 3, '0') END AS image_id,
  source AS dataset, CAST(n_chars % 90 AS DOUBLE) / 5 AS hb_g_dl, CASE WHEN doc_id % 2 = 0 THEN 'M' ELSE 'F' END AS sex FROM documents)
SELECT image_id, dataset, hb_g_dl, sex, CAST(hb_g_dl < CASE sex WHEN 'M' THEN 13 ELSE 12 END AS BIGINT) AS anemia_label,
       dataset <> 'src0' AS hb_label_trusted, CASE WHEN dataset = 'src0' THEN 'sheet was shifted' END AS hb_label_untrusted_reason FROM d
""")
def manifest_finalise(spark, sf_dir):
    """A manifest from a table: ids, derived labels, trust and its reason."""
    d = table(spark, sf_dir, "documents").select(
        manifest.image_ids("docs", "source", number="doc_id").alias("image_id"),
        F.col("source").alias("dataset"),
        ((F.col("n_chars") % 90).cast("double") / 5).alias("hb_g_dl"),
        F.when(F.col("doc_id") % 2 == 0, "M").otherwise("F").alias("sex"),
    )
    out = manifest.finalise(d.withColumn("anemia_label", manifest.derived_label()), {"src0": "sheet was shifted"})
    return out.select("image_id", "dataset", "hb_g_dl", "sex", "anemia_label", "hb_label_trusted", "hb_label_untrusted_reason")


@query(f"""
WITH s AS ({SCREENING_SQL}), h AS (SELECT *, CASE WHEN fold < 3 THEN 'train' ELSE 'test' END AS part FROM s),
g AS (SELECT CAST(score AS DOUBLE) AS score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth = 0) AS neg FROM h WHERE part = 'train' GROUP BY 1),
w AS (SELECT score, sum(pos) OVER u AS tp, sum(neg) OVER u AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn, coalesce((score + lead(score) OVER o) / 2, score + 1) AS cut, row_number() OVER o AS i
      FROM g WINDOW o AS (ORDER BY score), u AS (ORDER BY score ROWS UNBOUNDED PRECEDING)),
k AS (SELECT cut, tp, fp, np, nn FROM w UNION ALL SELECT score - 1, 0, 0, np, nn FROM w WHERE i = 1),
b AS (SELECT cut FROM k ORDER BY tp / nullif(np, 0)::DOUBLE >= 0.9 DESC, CASE WHEN tp / nullif(np, 0)::DOUBLE >= 0.9 THEN 1 - fp / nullif(nn, 0)::DOUBLE ELSE tp / nullif(np, 0)::DOUBLE END DESC, cut LIMIT 1),
c AS (SELECT part, cut, count(*) FILTER (WHERE truth = 1 AND score < cut) AS tp, count(*) FILTER (WHERE truth = 0 AND score < cut) AS fp,
             count(*) FILTER (WHERE truth = 0 AND score >= cut) AS tn, count(*) FILTER (WHERE truth = 1 AND score >= cut) AS fn FROM h, b GROUP BY part, cut)
SELECT part, cut, tp, fp, tn, fn, round(tp / nullif(tp + fn, 0)::DOUBLE, 6) AS sensitivity, round(tn / nullif(tn + fp, 0)::DOUBLE, 6) AS specificity FROM c
""")
def cross_site_metrics(spark, sf_dir):
    """A cut chosen on some sites, applied to the others."""
    from ..functions import metrics

    rows = screening_table(spark, sf_dir).withColumn("part", F.when(F.col("fold") < 3, "train").otherwise("test"))
    options = screening.cuts(screening.score_table(rows.where("part = 'train'"), "truth", "score", []), [])
    chosen = screening.cut_for_sensitivity(options, 0.9, []).select("cut")
    counts = rows.crossJoin(F.broadcast(chosen)).groupBy("part", "cut").agg(*metrics.confusion("truth", F.col("score") < F.col("cut")))  # one cut
    rates = metrics.screening_rates()
    return counts.select("part", "cut", "tp", "fp", "tn", "fn", *[F.round(rates[n], 6).alias(n) for n in ("sensitivity", "specificity")])
