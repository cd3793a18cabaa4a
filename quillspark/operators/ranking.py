"""Top and bottom rows of groups, groups ranked by a measure, lineage listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import or_unknown
from quillspark.operators.splits import seeded
from quillspark.scratch import written
from quillspark.sources.listing import FIRST_METHOD


def examples(rows: DataFrame, group: str, score: Column, tie: list[str], k: int) -> DataFrame:
    """The k highest and the k lowest rows of each group, with side and rank (from 0); equal scores go by ``tie``."""
    out = []
    for side, order in (("high", score.desc()), ("low", score.asc())):
        rank = F.row_number().over(Window.partitionBy(group).orderBy(order, *tie)) - 1
        out.append(rows.withColumn("side", F.lit(side)).withColumn("rank", rank).where(F.col("rank") < k))
    return reduce(DataFrame.unionByName, out)


MEASURES = ("avg_score", "min_score", "generated_count")


def ranked_groups(rows: DataFrame, key: str, score: str, measure: str = "avg_score", at_least: int = 1, limit: int = 0) -> DataFrame:
    """Groups with enough rows, with group_no from 0: by falling average or count, or by rising minimum; ties the same way by key."""
    if measure not in MEASURES:
        raise ValueError(f"measure {measure!r}: one of {MEASURES}")
    groups = rows.groupBy(key).agg(F.avg(score).alias("avg_score"), F.min(score).alias("min_score"), F.count("*").alias("generated_count"))
    groups = groups.where(F.col("generated_count") >= at_least)
    order = [F.col(measure).asc(), F.col(key).asc()] if measure == "min_score" else [F.round(measure, 9).desc(), F.col(key).desc()]
    if limit > 0:
        groups = groups.orderBy(*order).limit(limit)  # a top-k: no task sees more than its own rows and k
        return groups.withColumn("group_no", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered(groups, order)


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with group_no, their place in ``order``: counted within ranges of the order, which are written so that they stay fixed."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": place})
    ranged = written(ranged, "ranged")
    before = ranged.groupBy("_p").agg(F.count("*").alias("_c"))  # one row a partition
    before = before.withColumn("_from", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return ranged.join(F.broadcast(before), "_p").withColumn("group_no", (F.col("_from") + F.col("_i")).cast("long")).drop("_p", "_i", "_from")


def lineage(rows: DataFrame, groups: DataFrame, key: str, method: str, score: str, tie: list[str], per_method: int, background: str | None = None) -> DataFrame:
    """Rows of the chosen groups, the best ``per_method`` of each method (all, if zero or less), numbered within their group by method, then by
    background and falling score; a blank method or background counts as unknown."""
    own = rows.join(groups.select(key, "group_no"), key)
    of = or_unknown(F.col(method))
    if per_method > 0:
        best = F.row_number().over(Window.partitionBy(key, of).orderBy(F.col(score).desc(), *tie))
        own = own.withColumn("_r", best).where(F.col("_r") <= per_method).drop("_r")
    place = [of, *([or_unknown(F.col(background))] if background else []), F.col(score).desc(), *tie]
    return own.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*place)))


def report_samples(originals: DataFrame, made: DataFrame, label: str, path: str, k: int, seed: int = 42, first: str = FIRST_METHOD) -> DataFrame:
    """For each class, up to ``k`` drawn originals and as many drawn samples of each method: label, folder, method, path and place from 0.

    Folders are numbered: originals, the first method, the others.  Only classes with generated samples are reported, or all, if there are none.
    """
    of_method = F.concat(F.when(F.col("method") == first, "01_").otherwise("02_"), "method")
    rows = made.select(label, of_method.alias("folder"), "method", path)
    wanted = made.select(label).union(originals.select(label).join(made.select(F.lit(True).alias("_any")).limit(1), F.lit(True), "left_anti")).where(F.col(label).isNotNull()).distinct()
    real = originals.join(wanted, label, "left_semi").select(label, F.lit("00_original").alias("folder"), F.lit("real").alias("method"), path)
    draw = Window.partitionBy(label, "folder").orderBy(seeded(seed, label, "folder", path), path)
    return real.unionByName(rows).withColumn("place", F.row_number().over(draw) - 1).where(F.col("place") < k)


def label_text(rows: DataFrame, key: str, label: str, shown: int = 3) -> DataFrame:
    """For each group, its distinct labels in order, the first few written out and the rest counted."""
    labels = rows.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("l"))
    more = F.size("l") - shown
    text = F.concat(F.array_join(F.slice("l", 1, shown), ""), F.when(more > 0, F.format_string("_and_%d_more", more)).otherwise(""))
    return labels.select(key, text.alias("label_text"))
