"""Annotation files: tolerant decoding, tag-tolerant parsing, matching with images."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import boxes as bx
from quillspark.functions.text import stem
from quillspark.sources.listing import exists


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where they are valid, else GB18030, else UTF-8 without what is broken.  A leading mark stays."""

    @F.pandas_udf("string")
    def other(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(data: bytes | None) -> str | None:
            if data is None:
                return None
            try:
                return data.decode("gb18030")
            except UnicodeDecodeError:
                return data.decode("utf-8", "ignore")

        for batch in batches:
            yield batch.map(one)

    # Only what is no UTF-8 is sent to Python; a null goes through as null, which costs next to nothing.
    text = content.cast("string")
    good = F.is_valid_utf8(text)
    return F.coalesce(F.when(good, text), other(F.when(~good, content)))


def _tag(item: Column, name: str) -> Column:
    return F.regexp_extract(item, rf"(?is)<{name}>\s*(-?\d+)\s*</{name}>", 1).try_cast("int")


def parsed(rows: DataFrame, content: str) -> DataFrame:
    """``rows`` with filename and boxes: those with four whole coordinates and room inside."""
    items = F.regexp_extract_all(content, F.lit(r"(?is)<bndbox>(.*?)</bndbox>"), 1)
    found = F.transform(items, lambda x: bx.box(_tag(x, "xmin"), _tag(x, "ymin"), _tag(x, "xmax"), _tag(x, "ymax")))
    good = F.filter(found, lambda b: (b["xmax"] > b["xmin"]) & (b["ymax"] > b["ymin"]))
    name = F.trim(F.regexp_extract(content, r"(?is)<filename>(.*?)</filename>", 1))
    return rows.withColumn("filename", name).withColumn("boxes", good)


#: Folders of a source's annotations and of its images.
LABELS, IMAGES = "label", "img"


def read_annotations(spark: SparkSession, source: str, limit: int | None = None) -> DataFrame:
    """path, filename and boxes of the annotation files in a source's folder of labels, in path order; a limit counts files, with or without boxes.

    Folders within are not looked into; a source without such a folder is an error.
    """
    folder = f"{source.rstrip('/')}/{LABELS}"
    if not exists(spark, folder):
        raise FileNotFoundError(f"no folder of annotations: {folder}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder).select("path", "content")
    files = files.orderBy("path").limit(limit) if limit is not None else files
    return parsed(files.select("path", decoded(F.col("content")).alias("content")), "content").drop("content")


#: Extensions that an image may have beside its annotation, in order of preference.
EXTENSIONS = (".bmp", ".png", ".jpg")


def with_image(found: DataFrame, listing: DataFrame, path: str = "path") -> DataFrame:
    """Annotations with the image that belongs to them: the named file, else one of the same stem; without any, they go.

    ``listing`` has a column path; images lie in the source's folder of images, beside that of labels.
    """
    folder = F.concat(F.regexp_replace(path, "[^/]*/[^/]*$", ""), F.lit(f"{IMAGES}/"))
    names = F.array(F.col("filename"), *(F.concat(stem(F.col(path)), F.lit(e)) for e in EXTENSIONS))
    wanted = found.select(path, folder.alias("_folder"), F.posexplode(names).alias("_order", "_name")).where("_name <> ''")
    wanted = wanted.withColumn("_image", F.concat("_folder", "_name"))
    there = listing.select(F.col("path").alias("_image")).distinct()
    best = wanted.join(there, "_image").groupBy(path).agg(F.min_by("_image", "_order").alias("image"))
    return found.join(best, path)
