"""Image kernels over whole tables: an embedding's 64 components are a gray tile, enlarged to an image with a white rim.

SQL cannot express these; tests hold each query against the kernels applied to one tile after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import boxes
from quillspark.kernels import filters as fx
from quillspark.kernels import glyphs as gl
from quillspark.plans import pipelines
from quillspark.plans.base import Queries, table
from quillspark.sources import images as im

Q = Queries()
#: Pixels of a tile's component, and of the rim.
SCALE, RIM = 5, 4
SIDE = 8 * SCALE + 2 * RIM


def tile(values: np.ndarray) -> np.ndarray:
    """A colour image of 64 components: dark where they are small."""
    gray = np.clip(np.floor((values.astype(np.float64) + 1) * 127.5), 0, 255).astype(np.uint8).reshape(8, 8)
    big = np.kron(gray, np.ones((SCALE, SCALE), np.uint8))
    return gl.to_colour(np.pad(big, RIM, constant_values=255))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the number of the vector), label and embedding of every tile."""
    rows = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64)
    return rows.select(F.col("vec_id").cast("string").alias("path"), F.col("label").cast("string").alias("label"), "embedding")


def drawn(rows: DataFrame) -> DataFrame:
    """The rows with an image in place of their embedding."""
    keep = [c for c in rows.columns if c != "embedding"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, im.BATCH):
                part = batch.slice(at, im.BATCH)
                data = [tile(np.array(v)).tobytes() for v in part.column("embedding").to_pylist()]
                n = len(data)
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array([SIDE] * n, pa.int32()), pa.array([SIDE] * n, pa.int32()), pa.array([3] * n, pa.int32()), pa.array(data, pa.binary())], names=[*keep, "height", "width", "channels", "data"])

    return rows.mapInArrow(make, ", ".join([*(f"{c} string" for c in keep), "height int, width int, channels int, data binary"]))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the number of the vector), label and an image of every embedding."""
    return drawn(vectors(spark, sf_dir))


def first_of_label(rows: DataFrame) -> DataFrame:
    """The label's first tile, as a reference for the others."""
    return rows.groupBy("label").agg(F.min(F.col("path").cast("long")).cast("string").alias("reference"))


@Q.add("glyph_regions")
def glyph_regions(spark, sf_dir):
    """Mask area and share of the glyph in every tile."""
    return im.extracted(tiles(spark, sf_dir)).select("path", "area", F.round("ratio", 9).alias("ratio"), F.crc32("alpha").alias("alpha_crc32"))


@Q.add("image_measures")
def image_measures(spark, sf_dir):
    return im.measured(tiles(spark, sf_dir))


@Q.add("image_comparison")
def image_comparison(spark, sf_dir):
    rows = tiles(spark, sf_dir)
    return im.compared(rows.join(first_of_label(rows), "label"), rows, "reference", ["path", "reference"])


@Q.add("image_scores")
def image_scores(spark, sf_dir):
    """Measures, scores, reasons and verdicts of tiles as generated images of their label's first tile."""
    rows = tiles(spark, sf_dir)
    out = pipelines.scored_images(rows.join(first_of_label(rows), "label"), ["path", "label", "reference"], "generated", references=rows, reference="reference")
    return out.select("path", "label", "no_ref_score", "quality_score", "quality_ok", F.array_join("found", "+").alias("reasons"))


@Q.add("image_vectors")
def image_vectors(spark, sf_dir):
    return im.vectors(tiles(spark, sf_dir), 8, ["path", "label"])


@Q.add("enhanced_images")
def enhanced_images(spark, sf_dir):
    """Mean gray level of every tile after each enhancement mode."""
    modes = sorted(gl.MODES)

    def f(r: dict) -> Iterator[tuple]:
        image = im.pixels(r["data"], r["height"], r["width"], r["channels"])
        for m in modes:
            yield m, round(float(fx.gray(gl.enhanced(image, m)).mean()), 6)

    return im._mapped(tiles(spark, sf_dir), ["path"], "mode string, mean_gray double", f)


@Q.add("page_patches")
def page_patches(spark, sf_dir):
    """Background patches of tiles as pages with one box, the box filled."""
    box = F.array(boxes.box(F.lit(32), F.lit(32), F.lit(40), F.lit(40)))
    made = im.page_backgrounds(tiles(spark, sf_dir).withColumn("boxes", box), 2, 12)
    return made.select("path", "patch_no", "box_count", F.round("mask_ratio", 9).alias("mask_ratio"), "crop_box", F.crc32("data").alias("crc32"))


@Q.add("glyph_backgrounds")
def glyph_backgrounds(spark, sf_dir):
    """A background patch of every tile whose glyph can be filled."""
    return im.char_backgrounds(tiles(spark, sf_dir), 32).select("path", "mask_ratio", "white_ratio", "gray_std", F.crc32("data").alias("crc32"))


@Q.add("usable_glyphs")
def usable_glyphs(spark, sf_dir):
    return im.glyph_usable(tiles(spark, sf_dir))


@Q.add("generated_samples")
def generated_samples(spark, sf_dir):
    """A sample of every tile on its label's first tile as the ground, if a pose of it can be used."""
    rows, keep = vectors(spark, sf_dir), ["path", "reference"]
    head = first_of_label(rows)
    # Images are made where they are used, dealt anew as a small file is one task; only those that may give a sample meet their ground.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    slots = im.posable(drawn(rows.join(head, "label").repartition(tasks, "path")), keep=keep)
    ground = drawn(rows.join(head.select(F.col("reference").alias("path")), "path", "left_semi"))
    ground = ground.select(F.col("path").alias("reference"), *(F.col(c).alias(f"bg_{c}") for c in ("height", "width", "channels", "data")))
    made = im.generated(slots.join(ground, "reference"), keep=keep)
    return made.select("path", "reference", "angle", "scale", *(F.crc32(c).alias(f"{c}_crc32") for c in ("data", "alpha", "darkness")))


MEASURES = schemas.names(schemas.MEASURES)
QUERIES, ORACLES = Q.queries, Q.sql
