"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under its name, with the SQL that gives the same rows."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def bucket(text: Column, modulus: int) -> Column:
    """Engine-neutral hash bucket: the first 32 bits of an MD5, modulo."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(modulus))


def sql_bucket(text: str, modulus: int) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {modulus})"


#: A regression submission over the order lines: one row per line, suppliers as subjects.
SUBMISSION_SQL = f"""
  SELECT l_orderkey * 10 + l_linenumber AS row_id, CAST(l_suppkey AS VARCHAR) AS subject_id, l_returnflag AS sex,
         l_linestatus AS device, n_name AS site, l_extendedprice AS y_true, l_quantity AS quantity,
         l_extendedprice * 0.5 + {sql_bucket("'noise:' || CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)", 20000)} AS y_pred,
         {sql_bucket("'fold:' || CAST(l_suppkey AS VARCHAR)", 5)} AS fold
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""


def submission(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    lines, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    row_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        row_id.alias("row_id"),
        F.col("l_suppkey").cast("string").alias("subject_id"),
        F.col("l_returnflag").alias("sex"),
        F.col("l_linestatus").alias("device"),
        F.col("n_name").alias("site"),
        F.col("l_extendedprice").alias("y_true"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") * 0.5 + bucket(F.concat(F.lit("noise:"), row_id.cast("string")), 20000)).alias("y_pred"),
        bucket(F.concat(F.lit("fold:"), F.col("l_suppkey").cast("string")), 5).alias("fold"),
    )


#: Documents as measurements: 200 subjects, a content hash, a hash-dealt split.
MEASUREMENT_SQL = f"""
  SELECT doc_id AS row_id, CAST(doc_id % 200 AS VARCHAR) AS subject_id, md5(text) AS content_hash, source AS site, lang, n_chars,
         CASE WHEN {sql_bucket("'split:' || CAST(doc_id AS VARCHAR)", 10)} < 7 THEN 'train' ELSE 'test' END AS split
  FROM documents WHERE text IS NOT NULL
"""


def measurements(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    dealt = bucket(F.concat(F.lit("split:"), F.col("doc_id").cast("string")), 10)
    return (
        table(spark, sf_dir, "documents")
        .where("text is not null")
        .select(
            F.col("doc_id").alias("row_id"),
            (F.col("doc_id") % 200).cast("string").alias("subject_id"),
            F.md5("text").alias("content_hash"),
            F.col("source").alias("site"),
            "lang",
            "n_chars",
            F.when(dealt < 7, "train").otherwise("test").alias("split"),
        )
    )


#: A binary screening table: labelled documents with a score that is informative but noisy; low scores call positive.
SCREENING_SQL = f"""
  SELECT d.doc_id AS row_id, CAST(l.quality AS INTEGER) AS truth,
         CAST({sql_bucket("'score:' || CAST(d.doc_id AS VARCHAR)", 100)} + 60 * (1 - l.quality) AS BIGINT) AS score,
         {sql_bucket("'fold:' || CAST(d.doc_id AS VARCHAR)", 5)} AS fold, d.source AS site
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""


def screening_table(spark, sf_dir: str) -> DataFrame:
    from ..session import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    key = F.col("doc_id").cast("string")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("int").alias("truth"),
        (bucket(F.concat(F.lit("score:"), key), 100) + 60 * (1 - F.col("quality"))).cast("long").alias("score"),
        bucket(F.concat(F.lit("fold:"), key), 5).alias("fold"),
        F.col("source").alias("site"),
    )
