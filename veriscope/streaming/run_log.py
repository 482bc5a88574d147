"""A log of runs as a stream: JSON lines arrive in files, and the last record of each key is the table's row.

A micro-batch keeps the last record of each of its keys and writes them as one folder, ``batch=<id>``, in place of what that folder held. A batch that is
replayed after a failure (Structured Streaming gives it the same rows and the same id) so changes nothing, and no batch rewrites the
table. Reading takes each key's record from its latest batch; ``compacted`` folds the batches into a new folder when there are many.

A line that is no JSON object (torn by a crash of its writer) or has no key is dropped. Within a batch, later files (by time, then name) and later lines win.
State is on disk only: any executor can be lost, and a key that owns many records is one partial aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def parsed(lines: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """The records of a text stream or table with ``_at``, which ascends with file and line."""
    seen = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_block_start").alias("block"))
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.rtrim("value").endswith("}").alias("_whole"), seen.alias("_file"))
    return rows.where(F.col("_whole") & F.col(f"r.`{key}`").isNotNull()).select("r.*", "_file")


def last_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """The row of each key that is last in ``order``."""
    columns = [c for c in rows.columns if not c.startswith("_")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select("r.*")


def merge_batch(target: str, key: str) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls: write the batch's last records as its own folder."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_line", F.monotonically_increasing_id())
        last_of_each(rows, key, [F.col("_file.time"), F.col("_file.name"), F.col("_file.block"), F.col("_line")]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return merge


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, schema: T.StructType | str, key: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Start to merge the log files of the folder ``source`` into ``target``; ends when all that is there has been read. Started again with the same
    ``checkpoint`` it goes on with new files only."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    lines = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(source)
    rows = parsed(lines, schema, key)
    return rows.writeStream.foreachBatch(merge_batch(target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, target: str, key: str) -> DataFrame:
    """The last record of each key over all batches."""
    rows = spark.read.parquet(target)
    return last_of_each(rows.withColumnRenamed("batch", "_batch"), key, [F.col("_batch")])


def compacted(spark: SparkSession, target: str, into: str, key: str) -> None:
    """Fold the batches of ``target`` into the new folder ``into``, as its only batch, with the last batch's number: ``into`` can then take further batches."""
    last = spark.read.parquet(target).agg(F.max("batch")).first()[0]
    table(spark, target, key).write.mode("overwrite").parquet(f"{into}/batch={last}")
