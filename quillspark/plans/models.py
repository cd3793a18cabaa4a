"""Nearest centroids on embeddings, per-class metrics, hard classes, stage tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import metrics, stages
from quillspark.plans.base import Queries, table

Q = Queries()
TARGET = 60


def _vectors(spark, sf_dir, size=64):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, size).alias("v"), "label")
    return rows.where("vec_id % 5 <> 0"), rows.where("vec_id % 5 = 0")


def _model_sql(size: int, name: str) -> str:
    """Common table expressions of a model on the first ``size`` components: predictions and metrics."""
    return f"""{name}_c as (select label, i, avg(x) as m from (select label, unnest(range(1, {size} + 1)) as i, unnest(embedding[1:{size}])::double as x from embeddings where vec_id % 5 <> 0) group by all),
  {name}_cv as (select label, list(m order by i) as c from {name}_c group by label),
  {name}_p as (select vec_id, e.label, arg_min(k.label, (round(list_sum(list_transform(list_zip(e.embedding[1:{size}], k.c), lambda z: (z[1]::double - z[2]) * (z[1]::double - z[2]))), 9), k.label)) as prediction from embeddings e, {name}_cv k where vec_id % 5 = 0 group by vec_id, e.label),
  {name}_m as (select p.label, count(*) as support, count(*) filter (prediction = p.label) as correct, round(count(*) filter (prediction = p.label) / count(*), 6) as accuracy, coalesce(any_value(t.n), 0) as train_count
    from {name}_p p left join (select label, count(*) as n from embeddings where vec_id % 5 <> 0 group by label) t using (label) group by p.label)"""


_FULL = _model_sql(64, "f")
_SMALL = _model_sql(16, "s")


def predicted(spark, sf_dir, size=64):
    train, test = _vectors(spark, sf_dir, size)
    return metrics.nearest(test, metrics.centroids(train, "label", "v", size), "label", "v")


def per_class(spark, sf_dir, size=64):
    counts = _vectors(spark, sf_dir)[0].groupBy("label").agg(F.count("*").alias("count"))
    return metrics.per_class(predicted(spark, sf_dir, size), "label", counts)


@Q.add("class_centroids", f"with {_FULL} select label, i::int as pos, round(m, 6) as value from f_c")
def class_centroids(spark, sf_dir):
    cents = metrics.centroids(_vectors(spark, sf_dir)[0], "label", "v", 64)
    return cents.select("label", F.posexplode("centroid").alias("p", "c")).select("label", (F.col("p") + 1).alias("pos"), F.round("c", 6).alias("value"))


@Q.add("nearest_centroid", f"with {_FULL} select vec_id, label, prediction from f_p")
def nearest_centroid(spark, sf_dir):
    return predicted(spark, sf_dir).select("vec_id", "label", "prediction")


@Q.add("per_class_metrics", f"with {_FULL} select * from f_m")
def per_class_metrics(spark, sf_dir):
    return per_class(spark, sf_dir)


@Q.add("overall_metrics", f"with {_FULL} select count(*) as samples, count(*) filter (label = prediction) as correct, round(count(*) filter (label = prediction) / count(*), 6) as accuracy, count(distinct label) as classes from f_p")
def overall_metrics(spark, sf_dir):
    return metrics.overall(predicted(spark, sf_dir), "label")


@Q.add("closed_set_join", "select vec_id, label from embeddings where label in (select label from embeddings where vec_id < 8)")
def closed_set_join(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return metrics.closed_set(rows, rows.where("vec_id < 8"), "label")


@Q.add("zero_centroids", f"""with {_FULL}, l as (select distinct label from embeddings union select 99) select l.label, round(coalesce(list_sum(c), 0), 6) as total from l left join f_cv using (label)""")
def zero_centroids(spark, sf_dir):
    train, _ = _vectors(spark, sf_dir)
    classes = table(spark, sf_dir, "embeddings").select("label").union(spark.range(1).select(F.lit(99).alias("label")))
    cents = metrics.centroids(train, "label", "v", 64, classes)
    return cents.select("label", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@Q.add("difficult_topk", f"with {_FULL} select label, train_count as count, 1000000 - train_count as need_to_min_count, accuracy, support from f_m where support > 0 order by accuracy, support desc, label limit 4")
def difficult_topk(spark, sf_dir):
    return metrics.hard_classes(per_class(spark, sf_dir), "label", 1_000_000, 0.0, 4)


@Q.add("difficult_threshold", f"with {_FULL} select label, train_count as count, 1000000 - train_count as need_to_min_count, accuracy, support from f_m where accuracy <= 0.95")
def difficult_threshold(spark, sf_dir):
    return metrics.hard_classes(per_class(spark, sf_dir), "label", 1_000_000, 0.95)


_GAIN = f"""{_FULL}, {_SMALL}, gain as (select s.label, s.train_count as count, greatest(0, 1000000 - s.train_count) as need_to_min_count, f.accuracy as baseline_accuracy, s.accuracy as simple_accuracy, round(s.accuracy - f.accuracy, 6) as accuracy_delta, s.support, f.support as baseline_support,
    concat_ws('+', case when s.accuracy - f.accuracy < 0 then 'worse_after_simple_fusion' end, case when s.accuracy <= 0.9 then 'low_simple_fusion_accuracy' end, case when s.accuracy - f.accuracy <= 0 then 'no_clear_simple_fusion_gain' end) as reason
  from s_m s join f_m f using (label) where s.accuracy - f.accuracy < 0 or (s.accuracy <= 0.9 and s.accuracy - f.accuracy <= 0) order by accuracy_delta, simple_accuracy, s.support desc, s.label limit 5)"""


def by_gain(spark, sf_dir):
    return metrics.hard_by_gain(per_class(spark, sf_dir), per_class(spark, sf_dir, 16), "label", 1_000_000, 0.9, 0.0, 5)


@Q.add("difficult_by_gain", f"with {_GAIN} select * from gain")
def difficult_by_gain(spark, sf_dir):
    return by_gain(spark, sf_dir)


_SUBSET = "select coalesce(sum(support), 0)::bigint as support, coalesce(sum(correct), 0)::bigint as correct, round(coalesce(sum(correct) / sum(support), 0), 6) as accuracy, round(coalesce(avg(accuracy), 0), 6) as macro_accuracy from {0}_m where label in (select label from gain)"


@Q.add("subset_metrics", f"with {_GAIN} {_SUBSET.format('s')}")
def subset_metrics(spark, sf_dir):
    return metrics.subset(per_class(spark, sf_dir, 16), by_gain(spark, sf_dir), "label")


@Q.add("stage_summary", f"with {_GAIN}, st as ({_SUBSET.format('f').replace('select', 'select ' + chr(39) + 'baseline' + chr(39) + ' as stage,', 1)} union all {_SUBSET.format('s').replace('select', 'select ' + chr(39) + 'simple_fusion' + chr(39) + ' as stage,', 1)}) select *, round(accuracy - (select accuracy from st where stage = 'simple_fusion'), 6) as accuracy_delta from st")
def stage_summary(spark, sf_dir):
    hard = by_gain(spark, sf_dir)
    parts = {"baseline": metrics.subset(per_class(spark, sf_dir), hard, "label"), "simple_fusion": metrics.subset(per_class(spark, sf_dir, 16), hard, "label")}
    return stages.against(stages.stage_table(parts), "simple_fusion")


QUERIES, ORACLES = Q.queries, Q.sql
