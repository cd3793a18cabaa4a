"""What leaves the engine: Parquet between stages; delimited files, JSON, images and archives at the end.

Single files are streamed through the driver row by row, never held there; they are for exports of bounded size.  Large tables, and
many files in folders that all executors see, are written by the executors.
"""

from __future__ import annotations

import csv
import io
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _open(spark: SparkSession, path: str, overwrite: bool = True):
    """A stream of Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, overwrite)


def _put(spark: SparkSession, path: str, parts: Iterator[bytes]) -> None:
    out = _open(spark, path)
    try:
        for p in parts:
            out.write(bytearray(p), 0, len(p))
    finally:
        out.close()


def _cell(v: object) -> str:
    return "" if v is None or v != v else str(v)


def write_table(df: DataFrame, path: str, fields: list[str], strict: bool = False, sep: str = ",") -> int:
    """One file with a byte-order mark and a header: the fields in order, absent ones empty.  Strict: other columns are an error."""
    extra = [c for c in df.columns if c not in fields]
    if strict and extra:
        raise ValueError(f"columns that the table does not have: {extra}")
    rows = df.select(*(F.col(f"`{f}`") if f in df.columns else F.lit("").alias(f) for f in fields))
    count = 0

    def parts() -> Iterator[bytes]:
        nonlocal count
        buffer = io.StringIO()
        writer = csv.writer(buffer, delimiter=sep)
        writer.writerow(fields)
        yield b"\xef\xbb\xbf" + buffer.getvalue().encode()
        for r in rows.toLocalIterator():
            buffer.seek(0)
            buffer.truncate()
            writer.writerow([_cell(v) for v in r])
            count += 1
            yield buffer.getvalue().encode()

    _put(df.sparkSession, path, parts())
    return count


def write_counts(df: DataFrame, path: str, fields: list[str], count: str = "count", label: str = "char") -> int:
    return write_table(df.orderBy(count, label), path, fields)


def write_wide(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """A large table, by the executors: Parquet, in folders by some columns."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_json(spark: SparkSession, path: str, summary: dict) -> None:
    _put(spark, path, iter([json.dumps(summary, ensure_ascii=False, indent=2).encode()]))


def summary_row(df: DataFrame) -> dict:
    """The only row of an aggregate, nested values included."""
    return json.loads(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])


def png(image: np.ndarray) -> bytes:
    """A PNG file of a gray, colour (blue, green, red) or colour and alpha image."""
    h, w = image.shape[:2]
    kind = {1: 0, 3: 2, 4: 6}[1 if image.ndim == 2 else image.shape[2]]
    x = image if image.ndim == 2 else image[..., [2, 1, 0, *([3] if image.shape[2] == 4 else [])]]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), x.reshape(h, -1).astype(np.uint8)], 1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def cutout(image: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return np.concatenate([image[..., :3], alpha[..., None]], 2)


def encoded(images: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and png of rows with height, width and data; made by the executors."""
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for data, h, w in zip(batch["data"], batch["height"], batch["width"], strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, -1)
                made.append(png(x[..., 0] if x.shape[2] == 1 else x))
            yield batch[keep].assign(png=made)

    return images.select(*keep, "height", "width", "data").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", png binary")


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme; a local one as its plain path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "/" + full[5:].lstrip("/") if full.startswith("file:") else full


def _reach(spark: SparkSession, root: str) -> bool:
    """Whether the executors' Python can write under ``root``, where all see it: a scheme that Arrow has; a local folder if there is one machine
    only, or if it lies in the shared one."""
    at, master = _qualified(spark, root), spark.sparkContext.master
    if not at.startswith("/"):
        try:
            return bool(fs.FileSystem.from_uri(at))
        except (ValueError, OSError, NotImplementedError):
            return False
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return (master.startswith("local") and not master.startswith("local-cluster")) or bool(shared) and f"{at}/".startswith(_qualified(spark, shared).rstrip("/") + "/")


def _bytes(content: object) -> bytes:
    return bytes(content) if isinstance(content, bytes | bytearray) else str(content or "").encode()


def _save_local(to: str, data: bytes) -> None:
    """A whole file or none: a task that runs twice or is killed leaves no part of one, and names that begin with a dot are no data."""
    own = os.path.join(os.path.dirname(to), f".{uuid.uuid4().hex}")
    try:
        out = open(own, "wb")
    except FileNotFoundError:
        os.makedirs(os.path.dirname(to), exist_ok=True)
        out = open(own, "wb")
    try:
        with out:
            out.write(data)
        os.replace(own, to)
    except BaseException:
        os.unlink(own)
        raise


def exported(files: DataFrame, root: str, path: str, content: str) -> DataFrame:
    """The rows without their content, which the executors write to each row's path under ``root`` as the rows are made; where they cannot, it is
    streamed through the driver first.  Paths are distinct: of rows with one path any content stays.
    """
    keep = [c for c in files.columns if c != content]
    if not _reach(files.sparkSession, root):
        for r in files.select(path, content).toLocalIterator():
            _put(files.sparkSession, f"{root.rstrip('/')}/{r[0]}", iter([_bytes(r[1])]))
        return files.select(*keep)
    at = _qualified(files.sparkSession, root).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far, base = (None, at) if at.startswith("/") else fs.FileSystem.from_uri(at)
        made: set[str] = set()
        for batch in batches:
            for name, data in zip(batch.column(path), batch.column(content), strict=True):
                to = f"{base}/{name.as_py()}"
                if far is None:
                    _save_local(to, _bytes(data.as_py()))
                    continue
                folder = to.rsplit("/", 1)[0]
                if folder not in made:
                    far.create_dir(folder, recursive=True)
                    made.add(folder)
                with far.open_output_stream(to) as out:
                    out.write(_bytes(data.as_py()))
            yield batch.select(keep)

    return files.mapInArrow(run, files.select(*keep).schema)


def export_files(files: DataFrame, root: str, path: str, content: str) -> int:
    """Writes each row's content to its path under ``root``: by the executors where they can, else through the driver."""
    return exported(files.select(path, content), root, path, content).count()


def copied(rows: DataFrame, listing: DataFrame, path: str, root: str, target: str) -> DataFrame:
    """Rows with whether their file is there; those that are, are copied to their target under ``root``, all in one pass over their contents."""
    spark = rows.sparkSession
    there = listing.select(F.col("path").alias("_p")).distinct().withColumn("_there", F.lit(True))
    out = rows.join(there, rows[path] == there["_p"], "left").withColumn("copied", F.col("_there").isNotNull()).drop("_p", "_there")
    wanted = out.where("copied").select(F.col(path).alias("_from"), F.col(target).alias("_to"))
    sources = sorted({r[0] for r in wanted.select("_from").distinct().toLocalIterator()})  # the samples of a report
    if sources:
        contents = spark.read.format("binaryFile").load(sources).select(F.regexp_replace("path", "^file:/+", "/").alias("_from"), "content")
        export_files(wanted.withColumn("_from", F.regexp_replace("_from", "^file:/+", "/")).join(contents, "_from"), root, "_to", "content")
    return out


def group_texts(rows: DataFrame, group: str, lines: list) -> DataFrame:
    """A text for each group, a line for each of its distinct rows, in order."""
    line = F.concat_ws("\t", *lines)
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("text"))


def kept_by_manifest(rows: DataFrame, manifest: str, ok: str) -> DataFrame:
    """Rows and kept rows of each manifest."""
    return rows.groupBy(manifest).agg(F.count("*").alias("total"), F.count_if(ok).alias("kept"))


def package(spark: SparkSession, roots: list[str], target: str) -> int:
    """A deflated archive of the files under some folders, named by folder and relative path, one after another."""
    out, count = _open(spark, target), 0

    class Stream(io.RawIOBase):
        at = 0

        def writable(self) -> bool:
            return True

        def write(self, data) -> int:
            out.write(bytearray(data), 0, len(data))
            Stream.at += len(data)
            return len(data)

        def tell(self) -> int:
            return Stream.at

    try:
        with zipfile.ZipFile(Stream(), "w", zipfile.ZIP_DEFLATED, compresslevel=6) as archive:
            for root in roots:
                base = root.rstrip("/").removeprefix("file:")
                found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content").orderBy("path")
                for r in found.toLocalIterator():
                    name = r.path.removeprefix("file:").replace("//", "/").removeprefix(base).lstrip("/")
                    archive.writestr(f"{base.rsplit('/', 1)[-1]}/{name}", bytes(r.content))
                    count += 1
    finally:
        out.close()
    return count
