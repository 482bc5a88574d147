"""Registered queries on manifests: lookups, trusted labels, integrity, names in paths, registers, error bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse, power, simulation
from ..operators import positional
from ..session import table
from ..sources import files, manifest
from .catalog import SUBMISSION_SQL, bucket, query, sql_bucket, submission

_ROWS_SQL = f"""SELECT CASE WHEN doc_id % 7 = 0 THEN 'shared' ELSE 'docs:' || CAST(doc_id AS VARCHAR) END AS image_id, source AS dataset,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST({sql_bucket("'hb:' || CAST(doc_id AS VARCHAR)", 300)} AS DOUBLE) / 10 END AS hb_g_dl,
  CASE doc_id % 5 WHEN 0 THEN 'unparsed; lang=' || lang WHEN 1 THEN NULL ELSE 'lang=' || lang || '; src=' || source END AS notes FROM documents"""


def _rows(spark, sf_dir):
    i = F.col("doc_id")
    hb = (bucket(F.concat(F.lit("hb:"), i.cast("string")), 300).cast("double") / 10)
    notes = F.when(i % 5 == 0, F.concat(F.lit("unparsed; lang="), "lang")).when(i % 5 > 1, F.concat(F.lit("lang="), "lang", F.lit("; src="), "source"))
    return table(spark, sf_dir, "documents").select(
        F.when(i % 7 == 0, "shared").otherwise(F.concat(F.lit("docs:"), i.cast("string"))).alias("image_id"), F.col("source").alias("dataset"), F.when(i % 11 != 0, hb).alias("hb_g_dl"), notes.alias("notes")
    )


@query(f"WITH r AS ({_ROWS_SQL}) SELECT dataset, count(*) AS n, round(avg(hb_g_dl), 6) AS mean_hb FROM r WHERE hb_g_dl IS NOT NULL AND dataset NOT IN ('src1', 'src2') GROUP BY dataset")
def trusted_labels(spark, sf_dir):
    """Rows whose label is known and whose dataset is not declared untrusted, by dataset."""
    rows = manifest.trusted(manifest.finalise(_rows(spark, sf_dir), {"src1": "copied by hand", "src2": "another unit"}))
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), F.round(F.avg("hb_g_dl"), 6).alias("mean_hb"))


@query(f"""
WITH r AS ({_ROWS_SQL}) SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT (hb_g_dl > 1 AND hb_g_dl < 25)) AS n_out_of_range, count(*) FILTER (WHERE contains(notes, 'unparsed')) AS n_unparsed,
       (SELECT coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM r GROUP BY image_id)) AS n_repeated FROM r
""")
def manifest_integrity(spark, sf_dir):
    """Repeated keys, labels out of range and unparsed notes of a manifest."""
    return manifest.integrity(_rows(spark, sf_dir))


@query(f"WITH r AS ({_ROWS_SQL}), m AS (SELECT regexp_extract(notes, '(?:^|; )lang=([^;]*)', 1) AS lang, regexp_extract(notes, '(?:^|; )src=([^;]*)', 1) AS src FROM r WHERE notes IS NOT NULL) SELECT nullif(lang, '') AS lang, nullif(src, '') AS src, count(*) AS n FROM m GROUP BY ALL")
def manifest_notes(spark, sf_dir):
    """Notes of the form ``k=v; k=v`` read as maps."""
    m = _rows(spark, sf_dir).where("notes is not null").select(manifest.notes().alias("m"))
    return m.groupBy(F.col("m")["lang"].alias("lang"), F.col("m")["src"].alias("src")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) ON c_nationkey = n_nationkey")
def dimension_lookup(spark, sf_dir):
    """Rows joined to a sheet by a unique key, with defaults where the sheet has none."""
    sheet = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))
    out = manifest.with_dimension(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), sheet, "c_nationkey", {"n_name": "unknown", "n_regionkey": -1})
    return out.select("c_custkey", "n_name", "n_regionkey")


@query(r"""
WITH p AS (SELECT p_partkey, 'raw/' || p_brand || '/' || replace(p_type, ' ', '_') || '_' || CAST(p_size AS VARCHAR) || '.JPG' AS path FROM part),
s AS (SELECT p_partkey, path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]*$', '') AS stem FROM p)
SELECT p_partkey, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS extension, stem, coalesce(nullif(regexp_extract(stem, '_([0-9]+)$', 1), ''), 'none') AS size,
       coalesce(nullif(regexp_extract(stem, '^(STEEL|SMALL|LARGE)', 1), ''), 'none') AS kind,
       'parts:' || CASE WHEN p_partkey < 1000 THEN lpad(CAST(p_partkey AS VARCHAR), 3, '0') ELSE CAST(p_partkey AS VARCHAR) END AS image_id FROM s
""")
def parsed_paths(spark, sf_dir):
    """Stem, extension, grammar fields with defaults, and padded ids of file paths."""
    path = F.concat(F.lit("raw/"), "p_brand", F.lit("/"), F.replace("p_type", F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"), F.lit(".JPG"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"))
    rows = manifest.parsed_names(rows, "path", (("size", r"_([0-9]+)$"), ("kind", r"^(STEEL|SMALL|LARGE)")), "none")
    return rows.select("p_partkey", parse.extension("path").alias("extension"), parse.stem("path").alias("stem"), "size", "kind", manifest.image_ids("parts", number="p_partkey").alias("image_id"))


@query("SELECT s_suppkey AS slug, s_acctbal AS balance, 'kept' AS origin FROM supplier WHERE s_suppkey % 4 <> 1 UNION ALL SELECT s_suppkey, 0.0, 'new' FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT -1, 0.0, 'new'")
def register_upsert(spark, sf_dir):
    """Register rows replaced by those of equal slug, new ones added."""
    register = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slug"), F.col("s_acctbal").alias("balance"), F.lit("kept").alias("origin"))
    more = register.where("slug % 4 = 1").select("slug").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("slug")))
    return files.upsert(register, more.select("slug", F.lit(0.0).alias("balance"), F.lit("new").alias("origin")), "slug")


@query("SELECT DISTINCT c_nationkey AS key FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL AND s_acctbal > 8000) AND c_nationkey IS NOT NULL")
def value_difference(spark, sf_dir):
    """Values of one column that another lacks."""
    have, known = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")), table(spark, sf_dir, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("key"))
    return have.where("key is not null").subtract(known)


@query(f"""
WITH s AS ({SUBMISSION_SQL}), g AS (SELECT site, count(*) AS n, stddev_samp(y_true) / sqrt(count(*)) AS se FROM s GROUP BY site)
SELECT round(-regr_slope(ln(se), ln(n)), 6) AS slope, round(regr_r2(ln(se), ln(n)), 6) AS r2, count(*) AS n_points FROM g WHERE n > 0 AND se > 0
""")
def scaling_slope(spark, sf_dir):
    """How standard errors go with the number of rows, over sites."""
    sites = submission(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"), (F.stddev_samp("y_true") / F.sqrt(F.count("*"))).alias("se"))
    row = sites.agg(*power.log_slope("n", "se"))
    return row.select(F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"), "n_points")


@query("""
WITH e AS (SELECT l_returnflag AS flag, abs(l_extendedprice / 1000 - l_quantity) / 10 AS error FROM lineitem)
SELECT flag, CASE WHEN error < 1 THEN 'VIABLE' WHEN error <= 2 THEN 'MARGINAL' ELSE 'NOT RECOVERABLE' END AS band, count(*) AS n FROM e GROUP BY ALL
""")
def error_bands(spark, sf_dir):
    """Errors by band: under one, up to two, beyond."""
    error = F.abs(F.col("l_extendedprice") / 1000 - F.col("l_quantity")) / 10
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), simulation.band(error).alias("band"))
    return rows.groupBy("flag", "band").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, o_orderkey AS order_key, o_totalprice AS price FROM orders),
b AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position, o_orderkey AS file_key, o_custkey AS customer FROM orders)
SELECT position, order_key, price, file_key, customer FROM a JOIN b USING (position)
""")
def positional_pairs(spark, sf_dir):
    """Two tables that only their order ties together, joined by position after their orders are found to agree."""
    orders = table(spark, sf_dir, "orders")
    left = orders.select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("dated"))
    right = orders.select(F.col("o_orderkey").alias("file_key"), F.col("o_custkey").alias("customer"), F.col("o_orderdate").alias("filed"))
    found = positional.positional_join(left, right, ["dated", "order_key"], ["filed", "file_key"], {"order_key": "file_key"})
    return found.select("position", "order_key", "price", "file_key", "customer")
