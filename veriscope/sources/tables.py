"""Readers of odd tables: per-subject signal files, white-space tables, spreadsheets, image headers."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, time, timedelta
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import stem
from ..session import cut
from .files import IMAGE_SUFFIXES, files


def signal_files(spark: SparkSession, pattern: str, channels: list[str]) -> DataFrame:
    """(subject_id, i, *channels) from one CSV file a subject, named after it; i counts a file's samples from 0.

    Order is that of the file, so a file must not be split: they are read as whole texts."""
    texts = files(spark, pattern).select(stem("path").alias("subject_id"), F.decode("content", "UTF-8").alias("t"))
    lines = texts.select("subject_id", F.posexplode(F.split("t", r"\r?\n")).alias("line", "row"))
    cells = F.split("row", ",")
    rows = lines.select("subject_id", "line", *[F.trim(F.get(cells, k)).try_cast("double").alias(c) for k, c in enumerate(channels)])
    rows = rows.where(" and ".join(f"`{c}` is not null" for c in channels))
    first = rows.groupBy("subject_id").agg(F.min("line").alias("first"))
    return rows.join(first, "subject_id").select("subject_id", (F.col("line") - F.col("first")).alias("i"), *channels)


def space_table(spark: SparkSession, path: str, columns: list[str], comment: str = "#") -> DataFrame:
    """Numbers separated by white space; lines that are not all numbers are left out."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith(comment)).select(*[F.get(cells, k).try_cast("double").alias(c) for k, c in enumerate(columns)])
    return rows.where(" and ".join(f"`{c}` is not null" for c in columns))


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1


#: The number formats that every spreadsheet has for dates and times.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
_DAY_ZERO = datetime(1899, 12, 30)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _texts(z: zipfile.ZipFile, member: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of one name in a member, one at a time; each is forgotten once it was used."""
    if member in z.namelist():
        with z.open(member) as f:
            for _, element in ElementTree.iterparse(f):
                if _local(element) == tag:
                    yield element
                    element.clear()


def sheets(content: bytes) -> list[tuple[str, str]]:
    """(name, member of the archive) of a workbook's sheets, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "xl/workbook.xml" not in z.namelist():  # a bare sheet
            return [(m.rpartition("/")[2].removesuffix(".xml"), m) for m in sorted(z.namelist()) if m.startswith("xl/worksheets/sheet")]
        targets = {e.get("Id"): e.get("Target") for e in _texts(z, "xl/_rels/workbook.xml.rels", "Relationship")}
        out = []
        for k, e in enumerate(_texts(z, "xl/workbook.xml", "sheet"), 1):
            link = next((v for name, v in e.attrib.items() if name.endswith("}id")), None)
            target = targets.get(link, f"worksheets/sheet{k}.xml")
            out.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        return out


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    dated, styles = set(_DATE_FORMATS), set()
    for part in ElementTree.fromstring(z.read("xl/styles.xml")):
        if _local(part) == "numFmts":
            dated |= {int(e.get("numFmtId")) for e in part if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", "").lower()))}
        if _local(part) == "cellXfs":
            styles = {k for k, e in enumerate(part) if int(e.get("numFmtId", 0)) in dated}
    return styles


def sheet_cells(content: bytes, member: str) -> Iterator[list[str | None]]:
    """The rows of a sheet as text, read as a stream: shared strings resolved, dates as ISO text, errors null."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        joined = lambda e: "".join(t.text or "" for t in e.iter() if _local(t) == "t")
        shared, dated = [joined(e) for e in _texts(z, "xl/sharedStrings.xml", "si")], _date_styles(z)
        for row in _texts(z, member, "row"):
            cells: dict[int, str | None] = {}
            for k, cell in enumerate(row):
                kind, value = cell.get("t"), next((c.text for c in cell if _local(c) == "v"), None)
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "inlineStr":
                    value = joined(cell)
                elif kind == "b":
                    value = {"1": "true", "0": "false"}.get(value)
                elif kind == "e":
                    value = None
                elif kind in (None, "n") and value is not None and int(cell.get("s", 0)) in dated:
                    moment = _DAY_ZERO + timedelta(days=float(value))
                    value = moment.date().isoformat() if moment.time() == time.min else moment.isoformat(sep=" ", timespec="seconds")
                cells[_column(cell.get("r")) if cell.get("r") else k] = value
            yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]


def sheet_rows(content: bytes, sheet: int = 1) -> list[list[str | None]]:
    """The cells of a workbook's n-th sheet."""
    return list(sheet_cells(content, sheets(content)[sheet - 1][1]))


def workbook_rows(spark: SparkSession, path: str, sheet: str | int = 1, batch: int = 5000) -> DataFrame:
    """``(path, sheet, row, cells)``: the rows of the sheet of that name or number in each workbook of ``path`` (a file, folder or pattern). A task reads a
    workbook; its rows leave it in batches. A workbook without the sheet gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])
        for files_read in batches:
            for name, content in zip(files_read.column(0).to_pylist(), files_read.column(1).to_pylist()):
                found = [(s, m) for k, (s, m) in enumerate(sheets(content), 1) if sheet in (k, s)]
                for title, member in found[:1]:
                    held: list[list[str | None]] = []
                    at = 0
                    for cells in sheet_cells(content, member):
                        held.append(cells)
                        if len(held) == batch:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * batch), pa.array([title] * batch), pa.array(np.arange(at, at + batch)), pa.array(held, pa.list_(pa.string()))], schema=schema)
                            at, held = at + batch, []
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array([title] * len(held), pa.string()), pa.array(np.arange(at, at + len(held))), pa.array(held, pa.list_(pa.string()))], schema=schema)

    books = spark.read.format("binaryFile").load(path).select("path", "content")
    return books.mapInArrow(run, "path string, sheet string, row long, cells array<string>")


def spreadsheet(spark: SparkSession, path: str, sheet: str | int = 1) -> DataFrame:
    """The rows of a sheet under the names in its first row, all as text; rows without any value are left out, a name that is missing is
    ``_<k>``, and one that is there already gets its place behind it. Of several workbooks the names are those of the first by path."""
    rows = cut(workbook_rows(spark, path, sheet), "workbook")
    head = rows.where("row = 0").orderBy("path").select("cells").first()
    names: list[str] = []
    for k, cell in enumerate(head[0] if head else []):
        name = (cell or "").strip() or f"_{k}"
        names.append(f"{name}_{k + 1}" if name in names else name)
    body = rows.where("row > 0 and exists(cells, c -> c is not null and trim(c) <> '')")
    return body.select(*[F.get("cells", k).alias(name) for k, name in enumerate(names)])


def image_header(content: bytes) -> dict:
    """Format, size, channels, bit depth, and for JPEG the quality that its first quantisation table implies."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 33:
        width, height, depth, kind = struct.unpack(">IIBB", content[16:26])
        return {"format": "PNG", "width": width, "height": height, "channels": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind, 0), "depth": depth, "quality": None, "error": None}
    if content[:2] == b"\xff\xd8":
        at, quality, found = 2, None, None
        while at + 4 <= len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            body = content[at + 4 : at + 2 + size]
            if kind == 0xDB and quality is None and len(body) >= 65 and body[0] >> 4 == 0:
                scale = sum(body[1:65]) / 3685 * 100  # 3685: sum of the standard luminance table
                quality = int(round(100 - scale / 2 if scale <= 100 else 5000 / scale))
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
                depth, height, width, channels = struct.unpack(">BHHB", body[:6])
                found = {"format": "JPEG", "width": width, "height": height, "channels": channels, "depth": depth, "error": None}
                break
            at += 2 + size
        if found:
            return {**found, "quality": None if quality is None else max(1, min(100, quality))}
    return {"format": None, "width": None, "height": None, "channels": None, "depth": None, "quality": None, "error": "not a PNG or JPEG header"}


def image_headers(spark: SparkSession, root: str) -> DataFrame:
    """(path, format, width, height, channels, depth, quality, error); what cannot be read is recorded, not raised."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([{"path": p, **image_header(bytes(c))} for p, c in zip(pdf["path"], pdf["content"])], columns=["path", "format", "width", "height", "channels", "depth", "quality", "error"]).convert_dtypes()

    heads = files(spark, root, IMAGE_SUFFIXES).select("path", F.substring("content", 1, 262_144).alias("content"))
    return heads.mapInPandas(run, "path string, format string, width long, height long, channels long, depth long, quality long, error string")


def png_samples(content: bytes) -> np.ndarray:
    """Samples of a non-interlaced PNG of 8 or 16 bits a sample, height x width x channels."""
    head = image_header(content)
    if head["format"] != "PNG" or head["depth"] not in (8, 16) or content[28]:
        raise ValueError("only plain PNG of 8 or 16 bits is read")
    at, data = 8, b""
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        data += content[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    raw, pixel = zlib.decompress(data), head["channels"] * head["depth"] // 8
    line = head["width"] * pixel
    before, out = np.zeros(line, np.uint8), []
    for y in range(head["height"]):
        kind, row = raw[y * (line + 1)], np.frombuffer(raw, np.uint8, line, y * (line + 1) + 1)
        now = np.zeros(line, np.uint8)
        if kind in (0, 2):
            now = row + (before if kind == 2 else 0)
        else:
            values, above, current = row.tolist(), before.tolist(), [0] * line
            for x in range(line):
                a, b = (current[x - pixel] if x >= pixel else 0), above[x]
                c = above[x - pixel] if x >= pixel else 0
                nearest = min(((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c)))[2]
                current[x] = (values[x] + {1: a, 3: (a + b) // 2, 4: nearest}[kind]) % 256
            now = np.array(current, np.uint8)
        out.append(now)
        before = now
    flat = np.concatenate(out).tobytes()
    return np.frombuffer(flat, ">u2" if head["depth"] == 16 else np.uint8).reshape(head["height"], head["width"], head["channels"])


def linear_image(content: bytes, dark: float = 0.0, saturation: float = 65535.0) -> tuple[np.ndarray, np.ndarray]:
    """(values above the dark level, mask of saturated pixels) of a linear PNG."""
    samples = png_samples(content).astype(float)
    return np.maximum(samples - dark, 0), (samples >= saturation).any(axis=2)
