"""Images: Spark decodes them, kernels hash them in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import stem
from .files import IMAGE_SUFFIXES, files

LANCZOS = 3


def resize(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """Separable Lanczos resampling, the kernel widened when shrinking."""

    def weights(n_in: int, n_out: int) -> np.ndarray:
        scale = n_in / n_out
        spread = max(scale, 1.0)
        centre = (np.arange(n_out)[:, None] + 0.5) * scale - 0.5
        x = (np.arange(n_in)[None] - centre) / spread
        w = np.where(np.abs(x) < LANCZOS, np.sinc(x) * np.sinc(x / LANCZOS), 0.0)
        return w / w.sum(axis=1, keepdims=True)

    return weights(gray.shape[0], height) @ gray @ weights(gray.shape[1], width).T


def luma(bgr: np.ndarray) -> np.ndarray:
    """Grey values by the usual luma weights."""
    return bgr[..., 2] * 0.299 + bgr[..., 1] * 0.587 + bgr[..., 0] * 0.114


def _packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel()).view(">i8")[0])


def dhash(gray: np.ndarray) -> int:
    """64 comparisons of horizontal neighbours on a 9 x 8 thumbnail."""
    small = resize(gray, 8, 9)
    return _packed(small[:, 1:] > small[:, :-1])


def phash(gray: np.ndarray) -> int:
    """64 low frequencies of a 32 x 32 cosine transform against their median without the constant one."""
    n = 32
    k, i = np.arange(n)[:, None], np.arange(n)[None]
    basis = np.cos(np.pi * k * (2 * i + 1) / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    low = (basis @ resize(gray, n, n) @ basis.T)[:8, :8]
    return _packed(low > np.median(low.ravel()[1:]))


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, stem, md5, dhash, phash); hashes of pixels are null where an image cannot be decoded."""
    bytes_ = files(spark, root, IMAGE_SUFFIXES).select(F.col("path"), F.md5("content").alias("md5"))
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root)
    flat = images.select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
                gray = pixels[..., 0] if r.nChannels == 1 else luma(pixels)
                rows.append((r.path, dhash(gray), phash(gray)))
            yield pd.DataFrame(rows, columns=["path", "dhash", "phash"])

    hashed = flat.mapInPandas(kernel, "path string, dhash long, phash long")
    slim = lambda c: F.regexp_replace(c, "^file:/*", "/")
    return bytes_.withColumn("path", slim("path")).join(hashed.withColumn("path", slim("path")), "path", "left").withColumn("stem", stem("path"))


def attach_content(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """(_row, md5, dhash, phash): by path where rows have paths (several are joined by ``|``), else by subject and file stem."""
    if "image_path" in rows.columns:
        paths = rows.select("_row", F.explode(F.split("image_path", r"\|")).alias("p"))
        named = hashes.withColumn("p", F.regexp_extract("path", r"([^/]+)$", 1))
        return paths.withColumn("p", F.regexp_extract("p", r"([^/\\]+)$", 1)).join(named, "p").select("_row", "md5", "dhash", "phash")
    return rows.join(hashes, rows.subject_id == hashes.stem).select("_row", "md5", "dhash", "phash")
