"""Profiles, aggregations, joins and set operations over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import metrics, parse
from ..operators import profiles
from ..operators.quantiles import quantiles
from ..session import table
from .catalog import MEASUREMENT_SQL, SUBMISSION_SQL, bucket, measurements, query, sql_bucket, submission


@query("""
SELECT event_type, count(*) AS n_rows, count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS n_missing,
       count(DISTINCT user_id) AS n_subjects, count(*) FILTER (WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) IS NULL) AS n_not_numeric,
       round(avg(value), 4) AS mean_value, round(stddev_pop(value), 4) AS sd_value
FROM events GROUP BY event_type
""")
def contract_profile(spark, sf_dir):
    """Validation counts in one aggregate: missing and non-numeric values, subjects, mean and population SD."""
    k = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("value").isNull() | F.isnan("value")).alias("n_missing"),
        F.count_distinct("user_id").alias("n_subjects"),
        F.count_if(k.isNull()).alias("n_not_numeric"),
        F.round(F.avg("value"), 4).alias("mean_value"),
        F.round(F.stddev_pop("value"), 4).alias("sd_value"),
    )


@query("""
SELECT n_name AS site, count(*) AS n, count(DISTINCT l_suppkey) AS n_subjects, count(*) FILTER (WHERE l_discount > 0.05) AS n_high,
       count(*) FILTER (WHERE l_quantity < 5) AS n_low, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def manifest_profile(spark, sf_dir):
    """Rows, subjects, conditional counts and range per site."""
    lines, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    rows = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("site")).agg(
        F.count("*").alias("n"),
        F.count_distinct("l_suppkey").alias("n_subjects"),
        F.count_if(F.col("l_discount") > 0.05).alias("n_high"),
        F.count_if(F.col("l_quantity") < 5).alias("n_low"),
        F.min("l_extendedprice").alias("lowest"),
        F.max("l_extendedprice").alias("highest"),
    )


@query(f"WITH m AS ({MEASUREMENT_SQL}) SELECT site, count(*) AS n, round(1 - count(DISTINCT content_hash) / CAST(count(*) AS DOUBLE), 6) AS rate FROM m GROUP BY site")
def duplicate_rate(spark, sf_dir):
    return measurements(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"), F.round(metrics.duplicate_rate("content_hash"), 6).alias("rate"))


@query(f"""
WITH m AS ({MEASUREMENT_SQL}),
g AS (SELECT site, content_hash, count(*) AS n, count(DISTINCT subject_id) AS s FROM m GROUP BY ALL)
SELECT site, count(*) FILTER (WHERE n > 1) AS n_groups, CAST(sum(CASE WHEN n > 1 THEN n - 1 ELSE 0 END) AS BIGINT) AS redundant,
       count(*) FILTER (WHERE n > 1 AND s > 1) AS n_spanning FROM g GROUP BY site
""")
def duplicate_profile(spark, sf_dir):
    return profiles.duplicate_summary(measurements(spark, sf_dir), "content_hash", "subject_id", "site")


_LABELLED_SQL = f"WITH m AS (SELECT m.*, CAST(l.quality + 2 * l.toxic AS INTEGER) AS label FROM ({MEASUREMENT_SQL}) m JOIN labels l ON m.row_id = l.doc_id)"


def _labelled(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("label"))
    return measurements(spark, sf_dir).join(labels, "row_id")


@query(_LABELLED_SQL + """, k AS (SELECT substr(content_hash, 1, 2) AS key, label FROM m)
SELECT key, count(*) AS n, count(DISTINCT label) AS n_labels, min(label) AS lowest, max(label) AS highest, max(label) - min(label) AS spread
FROM k GROUP BY key HAVING count(DISTINCT label) > 1
""")
def label_conflict(spark, sf_dir):
    rows = _labelled(spark, sf_dir).select(F.substring("content_hash", 1, 2).alias("key"), "label")
    return profiles.label_conflicts(rows, "key", "label")


@query(_LABELLED_SQL + """,
c AS (SELECT site AS key, label, count(*) AS n FROM m WHERE label IS NOT NULL GROUP BY ALL),
t AS (SELECT key, label AS mode, row_number() OVER (PARTITION BY key ORDER BY n DESC, label) AS i FROM c)
SELECT site AS key, t.mode, count(*) AS n, round(avg(CASE WHEN label = t.mode THEN 1.0 ELSE 0.0 END), 6) AS agreement
FROM m JOIN t ON m.site = t.key AND t.i = 1 GROUP BY site, t.mode
""")
def label_agreement(spark, sf_dir):
    rows = _labelled(spark, sf_dir).withColumnRenamed("site", "key")
    agreed = rows.join(profiles.smallest_mode(rows, "key", "label"), "key")
    return agreed.groupBy("key", "mode").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("mode")).cast("double")), 6).alias("agreement"))


@query(f"""
WITH m AS ({MEASUREMENT_SQL}), c AS (SELECT site, content_hash, count(*) AS n FROM m GROUP BY ALL)
SELECT a.site AS side_a, b.site AS side_b, count(*) AS shared, CAST(sum(a.n * b.n) AS BIGINT) AS row_pairs
FROM c a JOIN c b ON a.content_hash = b.content_hash AND a.site < b.site GROUP BY a.site, b.site
""")
def set_overlap(spark, sf_dir):
    return profiles.overlap(measurements(spark, sf_dir), "content_hash", "site")


@query("""
WITH d AS (SELECT lang, CAST(doc_id AS VARCHAR) AS id FROM documents)
SELECT lang, """ + ", ".join(f"count(*) FILTER (WHERE {sql_bucket(chr(39) + 'fold:' + chr(39) + ' || id', 5)} = {k}) AS fold_{k}" for k in range(5)) + """
FROM d GROUP BY lang
""")
def fold_pivot(spark, sf_dir):
    """Rows per language and fold."""
    rows = table(spark, sf_dir, "documents").select("lang", bucket(F.concat(F.lit("fold:"), F.col("doc_id").cast("string")), 5).alias("fold"))
    counts = rows.groupBy("lang").pivot("fold", list(range(5))).count().na.fill(0)
    return counts.select("lang", *[F.col(str(k)).alias(f"fold_{k}") for k in range(5)])


@query("""
SELECT user_id AS subject_id, round(median(value), 4) AS median_value, arg_min(event_type, event_id) AS first_type,
       count(*) AS n, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY event_id) AS ids, count(DISTINCT event_type) > 1 AS mixed
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
""")
def subject_collapse(spark, sf_dir):
    """Measurements to subjects: median, first non-null attribute in row order, joined ids."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda i: i.cast("string")), "|")
    return table(spark, sf_dir, "events").where("user_id is not null").groupBy(F.col("user_id").alias("subject_id")).agg(
        F.round(F.median("value"), 4).alias("median_value"),
        F.min_by("event_type", "event_id").alias("first_type"),
        F.count("*").alias("n"),
        ids.alias("ids"),
        (F.count_distinct("event_type") > 1).alias("mixed"),
    )


@query(f"""
WITH s AS ({SUBMISSION_SQL})
SELECT site, count(*) AS n, round(avg(abs(y_pred - y_true)), 2) AS mae, round(sqrt(avg((y_pred - y_true) * (y_pred - y_true))), 2) AS rmse,
       round(avg(y_pred - y_true), 2) AS bias, round(1 - sum((y_pred - y_true) * (y_pred - y_true)) / (var_pop(y_true) * count(*)), 6) AS r2,
       round(corr(y_true, y_pred), 6) AS r FROM s GROUP BY site
""")
def metric_bundle(spark, sf_dir):
    named = submission(spark, sf_dir).groupBy("site").agg(*metrics.metric_bundle("y_true", "y_pred", 9))
    return named.select("site", "n", *[F.round(c, 2).alias(c) for c in ("mae", "rmse", "bias")], F.round("r2", 6).alias("r2"), F.round("r", 6).alias("r"))


@query("""
WITH r AS (
  SELECT o_orderpriority AS grp, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS i,
         count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
t AS (SELECT *, greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT)) AS k FROM r)
SELECT grp AS priority, count(*) AS n, round(avg(v), 2) AS mean, round(quantile_cont(v, 0.5), 2) AS median,
       round((quantile_cont(v, 0.25) + 2 * quantile_cont(v, 0.5) + quantile_cont(v, 0.75)) / 4, 2) AS trimean,
       round(avg(v) FILTER (WHERE i <= k), 2) AS best, round(avg(v) FILTER (WHERE i > n - k), 2) AS worst, max(v) AS max
FROM t GROUP BY grp
""")
def error_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    out = profiles.order_summary(orders, "o_totalprice", ["priority"], "o_orderkey")
    return out.select("priority", "n", *[F.round(c, 2).alias(c) for c in ("mean", "median", "trimean", "best", "worst")], "max")


@query("""
SELECT o_orderstatus AS status, """ + ", ".join(f"round(quantile_cont(o_totalprice, {q / 100}), 2) AS p{q}" for q in (10, 25, 50, 75, 90)) + """
FROM orders GROUP BY o_orderstatus
""")
def quantile_vector(spark, sf_dir):
    levels = (10, 25, 50, 75, 90)
    out = quantiles(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), ["status"], "o_totalprice", [q / 100 for q in levels], "q")
    return out.select("status", *[F.round(F.col("q")[i], 2).alias(f"p{q}") for i, q in enumerate(levels)])


@query("""
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(59, floor((o_totalprice - lo) / ((hi - lo) / 60))) AS BIGINT) AS bin,
       round(lo + least(59, floor((o_totalprice - lo) / ((hi - lo) / 60))) * ((hi - lo) / 60), 3) AS left, count(*) AS n
FROM orders, e GROUP BY 1, 2
""")
def equal_width_histogram(spark, sf_dir):
    out = profiles.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 60)
    return out.select("bin", F.round("left", 3).alias("left"), "n")


@query("""
WITH b AS (SELECT CAST(floor(l_quantity - (SELECT min(l_quantity) FROM lineitem)) AS BIGINT) AS bin, count(*) AS n, avg(l_extendedprice) AS mean
           FROM lineitem GROUP BY 1)
SELECT bin, n, round(mean, 2) AS mean, round(abs(lead(mean) OVER (ORDER BY bin) - mean), 2) AS step,
       CASE WHEN lead(n) OVER (ORDER BY bin) IS NULL THEN n ELSE least(n, lead(n) OVER (ORDER BY bin)) END AS weight FROM b
""")
def binned_signal(spark, sf_dir):
    out = profiles.binned_signal(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("bin", "n", F.round("mean", 2).alias("mean"), F.round("step", 2).alias("step"), "weight")


@query("""
SELECT l_shipmode_key AS device, n, round(slope, 4) AS slope, round(r2, 6) AS r2, round(sd / abs(mean), 6) AS total_cv,
       round(sd * sqrt(greatest(0, 1 - r2)) / abs(mean), 6) AS residual_cv, round(sd * sqrt(greatest(0, 1 - r2)) / abs(slope), 4) AS equivalent_noise
FROM (SELECT l_linestatus || ':' || l_returnflag AS l_shipmode_key, count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS slope,
             regr_r2(l_extendedprice, l_quantity) AS r2, stddev_pop(l_extendedprice) AS sd, avg(l_extendedprice) AS mean
      FROM lineitem GROUP BY 1) WHERE n >= 20
""")
def variance_split(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("device", F.concat_ws(":", "l_linestatus", "l_returnflag"))
    out = profiles.linear_split(lines, "l_extendedprice", "l_quantity", ["device"])
    return out.select("device", "n", *[F.round(c, d).alias(c) for c, d in (("slope", 4), ("r2", 6), ("total_cv", 6), ("residual_cv", 6), ("equivalent_noise", 4))])


@query("""
WITH r AS (
  SELECT l_suppkey, l_quantity AS v, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS m, avg(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag) AS a,
         avg(l_quantity) OVER (PARTITION BY l_suppkey, l_linestatus) AS b, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
k AS (SELECT * FROM r WHERE n >= 4), g AS (SELECT avg(v) AS grand FROM k)
SELECT count(DISTINCT l_suppkey) AS n_units, count(*) AS n, round(sum((a - m) * (a - m)), 2) AS ss_first, round(sum((b - m) * (b - m)), 2) AS ss_second,
       round(sum((v - m) * (v - m)) - sum((a - m) * (a - m)) - sum((b - m) * (b - m)), 2) AS ss_residual,
       round(sum((m - grand) * (m - grand)), 2) AS ss_between FROM k, g
""")
def anova_two_way(spark, sf_dir):
    out = profiles.two_way_variance(table(spark, sf_dir, "lineitem"), "l_quantity", "l_suppkey", "l_returnflag", "l_linestatus")
    return out.select("n_units", "n", *[F.round(c, 2).alias(c) for c in ("ss_first", "ss_second", "ss_residual", "ss_between")])


@query("""
SELECT user_id, event_type, event_id, value, CAST(i AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS i FROM events) WHERE i <= 2
""")
def topk_per_cell(spark, sf_dir):
    out = profiles.top_per_cell(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.col("value").desc_nulls_last(), F.col("event_id")], 2)
    return out.select("user_id", "event_type", "event_id", "value", "rank")


@query("""
SELECT r_name AS region, n_name AS site, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'train' ELSE 'test' END AS role, p.protocol,
       count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
CROSS JOIN (VALUES ('asia_to_rest', 'ASIA'), ('europe_to_rest', 'EUROPE')) AS p(protocol, home)
WHERE r_name = p.home OR r_name NOT IN ('ASIA', 'EUROPE') GROUP BY ALL
""")
def cross_site_protocol(spark, sf_dir):
    """Every row once for each protocol it plays a part in, with its role there."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    protocols = spark.createDataFrame([("asia_to_rest", "ASIA"), ("europe_to_rest", "EUROPE")], "protocol string, home string")
    homes = F.col("r_name").isin("ASIA", "EUROPE")
    dealt = rows.crossJoin(F.broadcast(protocols)).where((F.col("r_name") == F.col("home")) | ~homes)  # two literal rows
    return dealt.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("site"), F.when(homes, "train").otherwise("test").alias("role"), "protocol").agg(F.count("*").alias("n"))


@query("""
WITH k AS (SELECT DISTINCT s_nationkey AS held_out FROM supplier)
SELECT held_out, count(*) FILTER (WHERE s_nationkey = held_out) AS n_test, count(*) FILTER (WHERE s_nationkey <> held_out) AS n_train
FROM supplier, k GROUP BY held_out
""")
def leave_one_out(spark, sf_dir):
    """Leave-one-key-out sizes. The expansion of rows by keys is not made: counts come from the totals."""
    counts = table(spark, sf_dir, "supplier").where("s_nationkey is not null").groupBy(F.col("s_nationkey").alias("held_out")).agg(F.count("*").alias("n_test"))
    total = counts.agg(F.sum("n_test").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("held_out", "n_test", (F.col("total") - F.col("n_test")).alias("n_train"))


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
       regexp_extract(url, '/([a-z]{2})/[0-9]+', 1) AS lang, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number,
       regexp_extract(url, '\.([a-z]+)(?:[?#]|$)', 1) AS suffix, regexp_matches(url, '[?&]ref=') AS referred FROM pages
""")
def filename_grammar(spark, sf_dir):
    """Fields of a name by patterns; a field that is not there is empty."""
    return table(spark, sf_dir, "pages").select("page_id", *parse.grammar("url", parse.PAGE_GRAMMAR), F.col("url").rlike("[?&]ref=").alias("referred"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '_' WHEN 1 THEN ' n/a' WHEN 2 THEN '-' ELSE replace(CAST(o_totalprice AS VARCHAR), '.', ',') END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN trim(raw) IN ('_', '-', '/', 'n/a', 'NA', '') THEN NULL ELSE TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE) END AS value FROM t WHERE o_orderkey % 5 < 3
UNION ALL
SELECT o_orderkey, raw, TRY_CAST(replace(trim(raw), ',', '.') AS DOUBLE) FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ',25' AS raw FROM orders WHERE o_orderkey % 5 >= 3)
""")
def decimal_comma(spark, sf_dir):
    """Numbers with a decimal comma, and marks that stand for a missing one."""
    kind = F.col("o_orderkey") % 5
    raw = F.when(kind == 0, "_").when(kind == 1, " n/a").when(kind == 2, "-").otherwise(F.concat(F.floor("o_totalprice").cast("long").cast("string"), F.lit(",25")))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("value", parse.decimal_comma("raw"))


@query("""
SELECT embedding_pairs.vec_id, round(degrees(acos(least(1.0, greatest(-1.0, d)))), 4) AS angle FROM (
  SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS d
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) AS embedding_pairs
""")
def angular_error(spark, sf_dir):
    """Angle in degrees between each vector and the next one by id."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return pairs.select("vec_id", F.round(parse.angle_degrees("e", "f"), 4).alias("angle"))


@query(f"""
WITH s AS ({SUBMISSION_SQL}),
u AS (SELECT 'submitted' AS candidate, y_true, y_pred AS p FROM s UNION ALL SELECT 'half', y_true, y_true * 0.5 FROM s UNION ALL SELECT 'quantity', y_true, quantity * 1000 FROM s),
m AS (SELECT candidate, count(*) AS n, avg(abs(p - y_true)) AS mae FROM u GROUP BY candidate)
SELECT candidate, n, round(mae, 2) AS mae, mae = min(mae) OVER () AS best FROM m
""")
def unpivot_candidates(spark, sf_dir):
    """A family of prediction columns as rows, and the best of them."""
    s = submission(spark, sf_dir)
    wide = s.select("y_true", F.col("y_pred").alias("submitted"), (F.col("y_true") * 0.5).alias("half"), (F.col("quantity") * 1000).alias("quantity"))
    long = wide.unpivot("y_true", ["submitted", "half", "quantity"], "candidate", "p")
    scores = long.groupBy("candidate").agg(F.count("*").alias("n"), metrics.mae("y_true", "p").alias("mae"))
    from pyspark.sql import Window

    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per candidate
    return scores.select("candidate", "n", F.round("mae", 2).alias("mae"), (F.col("mae") == F.min("mae").over(everything)).alias("best"))
