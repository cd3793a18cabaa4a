"""Delimited and JSON tables as they come: header-driven, all text, byte-order marks and quoted line ends allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import filled_or_empty, strip
from quillspark.sources.listing import exists


def read_delimited(spark: SparkSession, paths: str | list[str], sep: str = ",", schema: str | None = None) -> DataFrame:
    """All cells as stripped text, missing ones empty, with _manifest (the file) and _row (order in it).

    A row with more cells than the header fails.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("mode", "FAILFAST").option("escape", '"').option("enforceSchema", False)
    raw = (reader.schema(schema) if schema else reader).csv(paths)
    cells = [strip(F.col(f"`{c}`").cast("string")).alias(c) for c in raw.columns]
    # A multi-line file is one task's, so its rows' numbers grow in their order.
    return raw.select(*cells, F.col("_metadata.file_path").alias("_manifest"), F.monotonically_increasing_id().alias("_row"))


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    return read_delimited(spark, paths, ",", schema)


def read_tsv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    return read_delimited(spark, paths, "\t", schema)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def typed(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a table, empty cells null, absent columns null."""
    out = []
    for field in schema.split(", "):
        name, kind = field.split()
        cell = F.nullif(F.col(f"`{name}`"), F.lit("")) if name in rows.columns else F.lit(None)
        number = cell.cast("string").try_cast("double").cast("int") if kind == "INT" else cell.cast(kind.lower())
        out.append(number.alias(name))
    return rows.select(*out)


def first_rows(rows: DataFrame, n: int | None) -> DataFrame:
    """The first rows of each file."""
    if n is None:
        return rows
    own = Window.partitionBy("_manifest").orderBy("_row")
    return rows.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= n).drop("_r")


def samples(rows: DataFrame, root: str, label: str, path: str, origin: str) -> DataFrame:
    """Rows with a label and a path, the path under ``root``, and where they come from."""
    good = rows.where((filled_or_empty(F.col(label)) != "") & (filled_or_empty(F.col(path)) != ""))
    full = F.when(F.col(path).startswith("/"), F.col(path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(path)))
    return good.select(F.col(label).alias("char"), full.alias("path"), F.lit(origin).alias("origin"))


def row_count(spark: SparkSession, path: str) -> int | None:
    """Rows of a delimited file, or None if it is not there."""
    return read_csv(spark, path).count() if exists(spark, path) else None
