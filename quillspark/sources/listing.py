"""Files as tables: listings, manifests, packaging order.  All through Spark's file systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import normal_path

# Source names and their folders' codes, in the order in which backgrounds take turns.
SOURCES = {"天回": "tianhui", "张家山": "zhangjiashan", "武威": "wuwei", "马王堆": "mawangdui"}
#: Manifest that comes first, and prefixes of the folders of the others.
FIRST_METHOD, PREFIXES = "simple_fusion", "^(difficult_|preenhance_)"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def folders(spark: SparkSession, root: str) -> list[str]:
    """The folders right under ``root``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return sorted(x.getPath().toString() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at) if x.isDirectory())


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and length of the files under ``root``; their contents are not read.  A missing root is an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length")


def patches(spark: SparkSession, root: str) -> DataFrame:
    """Background patches: images in folders named patches, two levels down; any image, if there are none."""
    every = files(spark, root, "*.png")
    proper = every.where(F.element_at(F.split("path", "/"), -2) == "patches")
    some = proper.agg((F.count("*") > 0).alias("_some"))  # one row
    kept = every.crossJoin(F.broadcast(some)).where(~F.col("_some") | (F.element_at(F.split("path", "/"), -2) == "patches")).drop("_some")
    return kept.withColumn("source", background_source(F.col("path"), root))


def background_source(path, root: str):
    """The first folder under ``root``, or the folder above the file's, if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    inside = F.split(F.substring_index(path, base, -1), "/")
    return F.when(path.contains(base) & (F.size(inside) > 1), F.element_at(inside, 1)).otherwise(F.try_element_at(F.split(path, "/"), F.lit(-3)))


def distinct_paths(found: DataFrame, path: str, order: str) -> DataFrame:
    """Of paths that are one but for case or spelling, the first."""
    return found.withColumn("_r", F.row_number().over(Window.partitionBy(normal_path(F.col(path))).orderBy(order))).where("_r = 1").drop("_r")


def manifests(spark: SparkSession, experiment: str, more: list[str] = ()) -> list[str]:
    """Manifests given and those found in the experiment's augmentation folders, that are there, each once, in this order."""
    given = [m for m in more if exists(spark, m)]
    root = f"{experiment.rstrip('/')}/augment"
    found = sorted(r.path for r in files(spark, root, "generated_samples.csv").select("path").collect()) if exists(spark, root) else []
    once: dict[str, str] = {}
    for m in [*given, *found]:
        once.setdefault(m.removeprefix("file:").replace("//", "/").casefold(), m)
    return list(once.values())


def methods(paths: DataFrame, path: str, wanted: list[str] | None = None) -> DataFrame:
    """Manifests with method (their folder without its prefix) and place: simple fusion first, the others by name."""
    folder = F.element_at(F.split(path, "/"), -2)
    out = paths.withColumn("method", F.regexp_replace(folder, PREFIXES, ""))
    if wanted:
        out = out.where(F.col("method").isin(*wanted))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("method") != FIRST_METHOD, "method", path)) - 1)  # one row a manifest


def parsed_sources(values: list[str], known: dict[str, str]) -> dict[str, str]:
    """Options ``name=folder`` or a known name; all known ones, if none is given; others are an error."""
    out = {}
    for v in values:
        name, sep, folder = v.partition("=")
        if not sep and name not in known:
            raise ValueError(f"source {name!r}: one of {sorted(known)}, or name=folder")
        out[name] = folder if sep else known[name]
    return out or dict(known)


def first_option(*options, message: str):
    """The first that is given; without any, an error."""
    for o in options:
        if o is not None:
            return o
    raise ValueError(message)


def plain_path(path):
    """A listed path without its file scheme."""
    return F.regexp_replace(path, "^file:/+", "/")


def stage_models(spark: SparkSession, experiment: str, needed: tuple[str, ...] = ("metrics.json", "per_class_metrics.csv")) -> list[str]:
    """Folders under models that hold all the files needed, by name."""
    root = f"{experiment.rstrip('/')}/models"
    if not exists(spark, root):
        return []
    found = files(spark, root).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.regexp_replace(plain_path(F.col("path")), "/[^/]*$", "").alias("folder"))
    full = found.where(F.col("name").isin(*needed)).groupBy("folder").agg(F.countDistinct("name").alias("n")).where(F.col("n") == len(needed))
    return [r.folder for r in full.orderBy("folder").collect()]  # a few stages
