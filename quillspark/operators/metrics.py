"""Nearest centroids, per-class metrics, hard classes by one model or by the gain between two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def closed_set(samples: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Samples whose class is known; the others go."""
    return samples.join(classes.select(label).distinct(), label, "left_semi")


def centroids(train: DataFrame, label: str, vector: str, size: int, classes: DataFrame | None = None) -> DataFrame:
    """label and centroid: the mean vector of each class, zeros for classes without rows."""
    means = train.groupBy(label).agg(F.array(*(F.avg(F.element_at(vector, i + 1).cast("double")) for i in range(size))).alias("centroid"))
    if classes is None:
        return means
    zero = F.array_repeat(F.lit(0.0), size)
    return classes.select(label).distinct().join(means, label, "left").withColumn("centroid", F.coalesce("centroid", zero))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


#: Classes that a prediction compares in one row at most: their centroids are one small array.
MOST_CLASSES = 10_000


def nearest(rows: DataFrame, cents: DataFrame, label: str, vector: str) -> DataFrame:
    """``rows`` with prediction: the class of the nearest centroid, ties to the smaller label.

    The centroids travel as one array in a single broadcast row, checked to be of at most MOST_CLASSES classes.
    """
    table = cents.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("k"), "centroid"))).alias("_all"))
    table = table.withColumn("_all", F.when(F.size("_all") <= MOST_CLASSES, F.col("_all")).otherwise(F.raise_error(F.lit("too many classes for one row")).cast(table.schema["_all"].dataType)))
    distances = F.transform("_all", lambda c: F.struct(F.round(squared_distance(F.col(vector), c["centroid"]), 9).alias("d"), c["k"].alias("k")))
    return rows.crossJoin(F.broadcast(table)).withColumn("prediction", F.array_min(distances)["k"]).drop("_all")


def per_class(predicted: DataFrame, label: str, train_counts: DataFrame) -> DataFrame:
    """label, support, correct, accuracy and train_count of each class that was tested."""
    got = predicted.groupBy(label).agg(F.count("*").alias("support"), F.count_if(F.col("prediction") == F.col(label)).alias("correct"))
    got = got.join(train_counts.select(label, F.col("count").alias("train_count")), label, "left")
    return got.select(label, "support", "correct", F.round(F.col("correct") / F.col("support"), 6).alias("accuracy"), F.coalesce("train_count", F.lit(0).cast("long")).alias("train_count"))


def overall(predicted: DataFrame, label: str) -> DataFrame:
    right = F.count_if(F.col("prediction") == F.col(label))
    return predicted.agg(F.count("*").alias("samples"), right.alias("correct"), F.round(F.coalesce(F.try_divide(right, F.count("*")), F.lit(0.0)), 6).alias("accuracy"), F.countDistinct(label).alias("classes"))


def hard_classes(metrics: DataFrame, label: str, target: int, threshold: float, k: int | None = None) -> DataFrame:
    """Tested classes short of ``target`` training rows: the k of lowest accuracy, or all up to the threshold."""
    short = metrics.where((F.col("support") > 0) & (F.col("train_count") < target))
    short = short.select(label, F.col("train_count").alias("count"), (F.lit(target) - F.col("train_count")).alias("need_to_min_count"), "accuracy", "support")
    order = [F.col("accuracy"), F.col("support").desc(), F.col(label)]
    return short.where(F.col("accuracy") <= threshold) if k is None else short.orderBy(*order).limit(k)


def last_of(rows: DataFrame, label: str, order: str = "_row") -> DataFrame:
    """One row of each label: the last by ``order``, if there is such a column, else the greatest."""
    row = F.struct(*rows.columns)
    return rows.groupBy(label).agg((F.max_by(row, order) if order in rows.columns else F.max(row)).alias("_one")).select("_one.*")


def hard_by_gain(baseline: DataFrame, simple: DataFrame, label: str, target: int, threshold: float, min_gain: float = 0.0, k: int | None = None) -> DataFrame:
    """Classes that the second model made worse, or left low without a clear gain, with the reasons; of baseline rows of one class the last counts."""
    first = last_of(baseline, label).select(label, F.col("accuracy").alias("b"), F.col("support").alias("baseline_support"))
    both = simple.join(first, label).where((F.col("train_count") < target) & (F.col("support") > 0) & (F.col("baseline_support") > 0))
    gain = F.col("accuracy") - F.col("b")
    worse, low, flat = gain < 0, F.col("accuracy") <= threshold, gain <= min_gain
    why = F.concat_ws("+", F.when(worse, "worse_after_simple_fusion"), F.when(low, "low_simple_fusion_accuracy"), F.when(flat, "no_clear_simple_fusion_gain"))
    out = both.where(worse | (low & flat)).select(
        label, F.col("train_count").alias("count"), F.greatest(F.lit(0), F.lit(target) - F.col("train_count")).alias("need_to_min_count"),
        F.round("b", 6).alias("baseline_accuracy"), F.round("accuracy", 6).alias("simple_accuracy"), F.round(gain, 6).alias("accuracy_delta"), "support", "baseline_support", why.alias("reason"),
    )
    order = [F.col("accuracy_delta"), F.col("simple_accuracy"), F.col("support").desc(), F.col(label)]
    return out if k is None else out.orderBy(*order).limit(k)


def subset(metrics: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """One row over the metrics of some classes: support, correct, and accuracy over rows and over classes (zero if there are none)."""
    own = metrics.join(classes.select(label).distinct(), label, "left_semi")
    return own.agg(
        F.coalesce(F.sum("support"), F.lit(0)).alias("support"), F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
        F.round(F.coalesce(F.try_divide(F.sum("correct"), F.sum("support")), F.lit(0.0)), 6).alias("accuracy"), F.round(F.coalesce(F.avg("accuracy"), F.lit(0.0)), 6).alias("macro_accuracy"),
    )
