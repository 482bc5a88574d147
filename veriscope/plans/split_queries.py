"""Split integrity, components, folds and protocols."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits
from .catalog import MEASUREMENT_SQL, SUBMISSION_SQL, measurements, query, submission


@query(f"""
WITH d AS ({MEASUREMENT_SQL})
SELECT 'subject' AS axis, subject_id AS key, count(DISTINCT split) AS n_splits, count(*) AS n_rows
FROM d GROUP BY subject_id HAVING count(DISTINCT split) > 1
UNION ALL
SELECT 'hash', content_hash, count(DISTINCT split), count(*) FROM d GROUP BY content_hash HAVING count(DISTINCT split) > 1
""")
def split_leaks(spark, sf_dir):
    """Subjects and content hashes that occur in more than one split."""
    return splits.leaks(measurements(spark, sf_dir), "split", {"subject": "subject_id", "hash": "content_hash"})


_GROUPS_SQL = f"""
m AS ({MEASUREMENT_SQL}), e AS (SELECT DISTINCT a.subject_id AS u, b.subject_id AS v FROM m a JOIN m b USING (content_hash)),
c(u, v) AS (SELECT u, v FROM e UNION SELECT c.u, e.v FROM c JOIN e ON c.v = e.u),
g AS (SELECT u AS subject_id, min(v) AS grp FROM c GROUP BY u)
"""


@query(f"WITH RECURSIVE {_GROUPS_SQL} SELECT m.subject_id, grp AS group_id, count(*) AS n_rows FROM m JOIN g ON m.subject_id = g.subject_id GROUP BY ALL")
def leakproof_groups(spark, sf_dir):
    """Components of subjects that share content, named by their smallest subject."""
    groups = splits.leakproof_groups(measurements(spark, sf_dir), "subject_id", "content_hash")
    return measurements(spark, sf_dir).join(groups, "subject_id").groupBy("subject_id", "group_id").agg(F.count("*").alias("n_rows"))


@query(f"""
WITH s AS (SELECT DISTINCT CAST(doc_id % 200 AS VARCHAR) AS subject_id FROM documents WHERE text IS NOT NULL),
r AS (SELECT subject_id, row_number() OVER (ORDER BY md5('7:' || subject_id), subject_id) AS i FROM s)
SELECT subject_id, CAST((i - 1) % 5 AS INTEGER) AS fold FROM r
""")
def group_kfold(spark, sf_dir):
    return splits.group_kfold(measurements(spark, sf_dir), "subject_id", 5, seed=7)


@query(f"""
WITH s AS (SELECT CAST(doc_id % 200 AS VARCHAR) AS subject_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY md5('7:' || subject_id), subject_id) AS i, count(*) OVER () AS k FROM s)
SELECT subject_id, n AS n_rows, CASE WHEN i <= round_even(k * 0.6, 0) THEN 'train' WHEN i <= round_even(k * 0.8, 0) THEN 'val' ELSE 'test' END AS split FROM r
""")
def grouped_split(spark, sf_dir):
    m = measurements(spark, sf_dir)
    dealt = splits.grouped_split(m, "subject_id", {"train": 0.6, "val": 0.2, "test": 0.2}, seed=7)
    return m.groupBy("subject_id").agg(F.count("*").alias("n_rows")).join(dealt, "subject_id")


@query(f"""
WITH r AS (SELECT row_id, site, row_number() OVER (PARTITION BY site ORDER BY md5('3:' || CAST(row_id AS VARCHAR)), row_id) AS i,
           count(*) OVER (PARTITION BY site) AS n FROM ({MEASUREMENT_SQL}))
SELECT row_id, site FROM r WHERE i <= greatest(least(4, n), CAST(round_even(n * 0.2, 0) AS BIGINT))
""")
def stratified_sample(spark, sf_dir):
    """A fifth of each site, four rows at least."""
    return splits.stratified_sample(measurements(spark, sf_dir), "site", "row_id", 0.2, least=4, seed=3).select("row_id", "site")


@query(f"""
WITH s AS ({SUBMISSION_SQL}), t AS (SELECT sum(y_true) AS total, count(*) AS n FROM s),
f AS (SELECT fold, sum(y_true) AS fs, count(*) AS fn FROM s GROUP BY fold)
SELECT fold, CAST(count(*) AS BIGINT) AS n, round(avg(abs((total - fs) / (t.n - fn) - y_true)), 2) AS mae
FROM s JOIN f USING (fold), t GROUP BY fold
""")
def population_mean_cv(spark, sf_dir):
    """Error of the training folds' mean on each held-out fold."""
    s = submission(spark, sf_dir)
    means = splits.training_means(s, "fold", "y_true")
    return s.join(means, "fold").groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("train_mean") - F.col("y_true"))), 2).alias("mae"))


@query(f"""
WITH s AS ({SUBMISSION_SQL}), t AS (SELECT sex, sum(y_true) AS total, count(*) AS n FROM s GROUP BY sex),
f AS (SELECT fold, sex, sum(y_true) AS fs, count(*) AS fn FROM s GROUP BY fold, sex)
SELECT s.fold, count(*) AS n, round(avg(abs((total - fs) / nullif(t.n - fn, 0) - y_true)), 2) AS mae
FROM s JOIN f ON s.fold = f.fold AND s.sex = f.sex JOIN t ON s.sex = t.sex GROUP BY s.fold
""")
def sex_alone_baseline(spark, sf_dir):
    """Error of the training folds' mean per level of one attribute."""
    s = submission(spark, sf_dir)
    means = splits.training_means(s, "fold", "y_true", ["sex"])
    return s.join(means, ["fold", "sex"]).groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("train_mean") - F.col("y_true"))), 2).alias("mae"))


