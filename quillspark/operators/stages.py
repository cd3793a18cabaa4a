"""Tables of experiment stages: unions, deltas against one stage, distinct unions, first of duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stage_table(stages: dict[str, DataFrame]) -> DataFrame:
    """One row a stage, in one table; columns that a stage lacks are null."""
    named = [df.withColumn("stage", F.lit(name)) for name, df in stages.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def against(stages: DataFrame, base: str, measure: str = "accuracy") -> DataFrame:
    """The stages with their measure's difference to one stage's; zero stands for a stage that is not there."""
    one = stages.where(F.col("stage") == base).agg(F.coalesce(F.max(measure), F.lit(0.0)).alias("_base"))  # one row
    return stages.crossJoin(F.broadcast(one)).withColumn(f"{measure}_delta", F.round(F.col(measure) - F.col("_base"), 6)).drop("_base")


def distinct_of(parts: list[DataFrame], label: str, fallback: DataFrame | None = None) -> DataFrame:
    """The distinct values of some tables; those of ``fallback``, if there are none."""
    found = reduce(DataFrame.union, [p.select(label) for p in parts]).where(F.coalesce(F.col(label).cast("string"), F.lit("")) != "").distinct()
    if fallback is None:
        return found
    some = found.agg((F.count("*") > 0).alias("_some"))  # one row
    rest = fallback.select(label).distinct().crossJoin(F.broadcast(some)).where(~F.col("_some")).drop("_some")
    return found.union(rest)


def first_of(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of those with equal keys."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def without(rows: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    return rows.join(classes.select(label).distinct(), label, "left_anti")
