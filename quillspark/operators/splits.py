"""Seeded, class-wise orders and what is cut from them: splits, caps, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: int, *keys: str) -> Column:
    """A hash that orders rows at random, the same on every engine and for every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary"))


def split_sizes(n: Column, validation: float, test: float) -> tuple[Column, Column]:
    """Rows for validation and test out of ``n``: the rounded shares, one at least where a share is asked for, and always one left to train.

    Two rows are one for training and one for validation.  What is too much is taken from the larger part first, then
    from test and validation in turn.
    """

    def asked(share: float) -> Column:
        return F.greatest(F.lit(1), F.bround(n * share).cast("long")) if share > 0 else F.lit(0).cast("long")

    v, t = asked(validation), asked(test)
    excess = F.greatest(F.lit(0), v + t - (n - 1))
    uneven = F.least(excess, F.abs(v - t))
    rest = excess - uneven
    fit_v = v - F.when(v > t, uneven).otherwise(0) - F.floor(rest / 2)
    fit_t = t - F.when(t > v, uneven).otherwise(0) - F.ceil(rest / 2)
    return (
        F.when(n <= 1, 0).when(n == 2, 1).otherwise(fit_v).cast("long"),
        F.when(n <= 2, 0).otherwise(fit_t).cast("long"),
    )


def stratified_split(rows: DataFrame, label: str, key: str, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """``rows`` with split: train, val or test, drawn class by class in proportion."""
    own = Window.partitionBy(label)
    out = rows.withColumn("_r", F.row_number().over(own.orderBy(seeded(seed, key), key))).withColumn("_n", F.count("*").over(own))
    v, t = split_sizes(F.col("_n"), validation, test)
    train = F.col("_n") - v - t
    split = F.when(F.col("_r") <= train, "train").when(F.col("_r") <= train + v, "val").otherwise("test")
    return out.withColumn("split", split).drop("_r", "_n")


def capped(rows: DataFrame, groups: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def sampled(rows: DataFrame, groups: list[str], key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows of each group, drawn without replacement; all, if size is zero or less or the group has no more."""
    return rows if size <= 0 else capped(rows, groups, [seeded(seed, key), F.col(key)], size)
