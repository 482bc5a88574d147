"""Sources and sinks beyond plain tables: file inventories, content hashes, JSON lines, guarded writes."""

from __future__ import annotations

import io
import posixpath
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parse import extension

IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "gif")


def files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(path, modificationTime, length, content) of all files below ``root`` with one of the suffixes, any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.where(extension("path").isin(*suffixes)) if suffixes else found


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(extension, n_files, n_bytes); file contents are not read."""
    return files(spark, root).groupBy(extension("path").alias("extension")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def preview(df: DataFrame, n: int = 20) -> tuple[DataFrame, list[tuple[str, str]]]:
    """The first rows, 200 at most, and the columns' types."""
    return df.limit(max(0, min(n, 200))), df.dtypes


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines without those that cannot be read (a torn last one); of rows with equal keys the last in the files counts.

    Position is file name and offset block, so it does not depend on how the scan is split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = lines.select(F.from_json("value", schema).alias("r"), "f", "b", "i").where(F.col(f"r.{key}").isNotNull())
    return rows.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", F.struct("f", "b", "i")).alias("r")).select("r.*")


def append_block(df: DataFrame, path: str) -> None:
    """A block of finished work as one Parquet append; readers take the last row of a key."""
    df.write.mode("append").parquet(path)


def pending(spark: SparkSession, n: int, done: DataFrame, key: str = "i") -> DataFrame:
    """Work units below ``n`` that are not done."""
    return spark.range(n).withColumnRenamed("id", key).join(done.select(key), key, "left_anti")


def _guard(path: str, raw_root: str) -> None:
    target, root = posixpath.normpath(path), posixpath.normpath(raw_root)
    if target == root or target.startswith(root.rstrip("/") + "/"):
        raise PermissionError(f"{path} lies in the raw data, which is read-only")


def guarded_write(df: DataFrame, path: str, raw_root: str, mode: str = "errorifexists") -> None:
    """Write Parquet anywhere but below the folder of raw data."""
    _guard(path, raw_root)
    df.write.mode(mode).parquet(path)


def guarded_csv(df: DataFrame, path: str, raw_root: str, mode: str = "errorifexists") -> None:
    """The same as CSV with a header; arrays, maps and structs become JSON, so every column can be written and read as text."""
    _guard(path, raw_root)
    nested = (T.ArrayType, T.MapType, T.StructType)
    columns = [F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*columns).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def zip_members(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (), largest: int = 1 << 30) -> DataFrame:
    """(archive, member, length, content) of the files in ZIP archives at ``path``, one archive a task.

    Members that would leave the folder (absolute, a drive, or through ``..``) and folders are left out; one that unpacks to
    more than ``largest`` bytes raises, before it is unpacked."""

    def unpack(batches):
        for batch in batches:
            rows = []
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for info in z.infolist():
                        name = info.filename.replace("\\", "/")
                        unsafe = name.startswith("/") or ":" in name.split("/")[0] or ".." in name.split("/")
                        wanted = not suffixes or name.rsplit(".", 1)[-1].lower() in suffixes
                        if info.is_dir() or unsafe or not wanted:
                            continue
                        if info.file_size > largest:
                            raise ValueError(f"{name} in {archive} unpacks to {info.file_size} bytes")
                        rows.append((archive, name, info.file_size, z.read(info)))
            types = (pa.string(), pa.string(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays(arrays, ["archive", "member", "length", "content"])

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInArrow(unpack, "archive string, member string, length long, content binary")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with rows of equal key replaced and new ones added."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
