"""What is to be generated: deficits, slots, round-robin backgrounds, attempts and the first that pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import ranking
from quillspark.operators.splits import seeded


def slots(classes: DataFrame, label: str, count: str, target: int) -> DataFrame:
    """A row for each sample that a class is short of: label and slot from 0."""
    short = classes.withColumn("need", F.greatest(F.lit(0), F.lit(target) - F.col(count))).where("need > 0")
    return short.select(label, F.explode(F.sequence(F.lit(0), (F.col("need") - 1).cast("int"))).alias("slot"))


def missing_sources(required: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """Required sources without any background; with strict sources there must be none."""
    return required.join(available.select(key).distinct(), key, "left_anti")


def at_random(wanted: DataFrame, backgrounds: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Each slot with a seeded pick of all backgrounds, whatever their source."""
    picks = ranking.numbered(backgrounds, [F.col(key)]).withColumnRenamed("group_no", "pick")
    size = picks.agg(F.count("*").alias("size"))  # one row
    draw = F.conv(F.substring(seeded(seed, label, "slot"), 1, 8), 16, 10).cast("long") % F.col("size")
    return wanted.crossJoin(F.broadcast(size)).withColumn("pick", draw).join(picks, "pick").drop("size", "pick")


def round_robin(wanted: DataFrame, backgrounds: DataFrame, source: str, key: str, label: str, seed: int = 42, order: list | None = None) -> DataFrame:
    """Each slot with a background: sources in turn, by slot, and a seeded pick inside of the source.

    ``order``: the sources that take turns, in their order, as far as they have backgrounds; without any of them, all take turns by name.
    What is joined per slot is the number of the pick; the pick itself is an equi-join.
    """
    if order:
        place = F.array_position(F.array(*map(F.lit, order)), F.col(source))
        known = backgrounds.agg(F.coalesce(F.max(place > 0), F.lit(False)).alias("_known"))  # one row
        backgrounds = backgrounds.crossJoin(F.broadcast(known)).where(~F.col("_known") | (place > 0)).drop("_known")
    picks = backgrounds.withColumn("pick", F.row_number().over(Window.partitionBy(source).orderBy(key)) - 1)
    sources = backgrounds.groupBy(source).agg(F.count("*").alias("size"))
    sources = sources.withColumn("turn", F.row_number().over(Window.orderBy(*([place] if order else []), source)) - 1).withColumn("turns", F.count("*").over(Window.partitionBy(F.lit(1))))  # one row a source
    turns = sources.select(F.max("turns")).alias("t")
    placed = wanted.crossJoin(F.broadcast(turns.toDF("turns"))).withColumn("turn", F.col("slot") % F.col("turns")).drop("turns")
    placed = placed.join(sources.drop("turns"), "turn")
    draw = F.conv(F.substring(seeded(seed, label, "slot"), 1, 8), 16, 10).cast("long") % F.col("size")
    return placed.withColumn("pick", draw).join(picks, [source, "pick"]).drop("turn", "size", "pick")


def attempts(wanted: DataFrame, sources: DataFrame, label: str, key: str, tries: int, seed: int = 42) -> DataFrame:
    """For each class, as many seeded picks of its own sources (with replacement) as slots times ``tries``, numbered."""
    need = wanted.groupBy(label).agg(F.count("*").alias("need"))
    own = sources.withColumn("pick", F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1)
    size = own.groupBy(label).agg(F.count("*").alias("size"))
    tried = need.join(size, label).withColumn("attempt", F.explode(F.sequence(F.lit(0), (F.col("need") * tries - 1).cast("int"))))
    draw = F.conv(F.substring(seeded(seed, label, "attempt"), 1, 8), 16, 10).cast("long") % F.col("size")
    return tried.withColumn("pick", draw).join(own, [label, "pick"]).drop("pick", "size")


def accepted(tried: DataFrame, label: str, gate: Column) -> DataFrame:
    """Of each class's attempts, the first that pass the gate, as many as are needed, with their slot."""
    slot = F.row_number().over(Window.partitionBy(label).orderBy("attempt")) - 1
    return tried.where(gate).withColumn("slot", slot).where(F.col("slot") < F.col("need"))


def first_classes(made: DataFrame, label: str, limit: int) -> DataFrame:
    """Samples of the first ``limit`` classes that have any; the limit counts classes with success only."""
    return made.join(made.select(label).distinct().orderBy(label).limit(limit), label, "left_semi")


def first_of_group(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with is_first: whether a row is its group's first one, whose layers are kept for a look."""
    least = rows.groupBy(group).agg(F.min(F.struct(*order)).alias("_least"))
    return rows.join(least, group).withColumn("is_first", F.struct(*order) == F.col("_least")).drop("_least")
