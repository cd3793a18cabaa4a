"""Image measures and scores on tiles: an embedding's 64 components are an 8 by 8 gray image."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.operators import quality
from quillspark.plans.base import Queries, table

Q = Queries()

_PX = "px as (select vec_id, label, unnest(range(64))::int as i, least(greatest(floor((unnest(embedding)::double + 1) * 127.5), 0), 255)::int as v from embeddings)"
_LAP = """arr as (select vec_id, list(v order by i) as a from px group by vec_id),
  lap as (select vec_id, i // 8 as y, i % 8 as x, a[abs(i // 8 - 1) * 8 + i % 8 + 1] + a[(7 - abs(7 - (i // 8 + 1))) * 8 + i % 8 + 1] + a[i // 8 * 8 + abs(i % 8 - 1) + 1] + a[i // 8 * 8 + (7 - abs(7 - (i % 8 + 1))) + 1] - 4 * a[i + 1] as l from arr, unnest(range(64)) r(i))"""
_METRICS = f"""{_PX}, {_LAP}, h as (select vec_id, -sum(p * log2(p)) as entropy from (select vec_id, v, count(*) / 64.0::double as p from px group by all) group by vec_id),
  tm as (select vec_id, any_value(label) as label, round(any_value(h.entropy), 6) as entropy, round(stddev_pop(v), 6) as contrast_std, count(*) filter (v < 55) / 64.0::double as dark_ratio, count(*) filter (v > 145) / 64.0::double as white_ratio,
    count(*) filter (v < 110) / 64.0::double as alpha_ratio from px join h using (vec_id) group by vec_id),
  tl as (select vec_id, round(var_pop(l), 6) as laplacian_var, count(*) filter (abs(l) > 60) / 64.0::double as edge_density from lap group by vec_id),
  t as (select * from tm join tl using (vec_id))"""


def tiles(spark, sf_dir):
    px = F.transform("embedding", lambda x: F.least(F.greatest(F.floor((x.cast("double") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", px.alias("a"))


def _mean(a):
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def measures(spark, sf_dir):
    """Per tile, inside the row: entropy of the histogram, deviation, Laplacian with mirrored rim, shares of dark, white and ink."""
    t = tiles(spark, sf_dir)
    share = lambda f: F.size(F.filter("a", f)) / F.lit(64.0)
    steps = F.sequence(F.lit(0), F.lit(7))
    at = lambda y, x: F.element_at("a", (y * 8 + x + 1).cast("int"))
    mirror = lambda k: F.when(k < 0, -k).when(k > 7, 14 - k).otherwise(k)
    lap = F.flatten(F.transform(steps, lambda y: F.transform(steps, lambda x: (at(mirror(y - 1), x) + at(mirror(y + 1), x) + at(y, mirror(x - 1)) + at(y, mirror(x + 1)) - 4 * at(y, x)).cast("double"))))
    counts = F.transform(F.array_distinct("a"), lambda v: F.size(F.filter("a", lambda x: x == v)) / F.lit(64.0))
    t = t.withColumns({"lap": lap, "p": counts, "mean": _mean(F.col("a"))})
    t = t.withColumn("lm", _mean(F.col("lap")))
    return t.select(
        "vec_id", "label", F.round(-F.aggregate("p", F.lit(0.0), lambda s, p: s + p * F.log2(p)), 6).alias("entropy"), F.round(F.sqrt(_mean(F.transform("a", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))), 6).alias("contrast_std"),
        share(lambda x: x < 55).alias("dark_ratio"), share(lambda x: x > 145).alias("white_ratio"), share(lambda x: x < 110).alias("alpha_ratio"),
        F.round(_mean(F.transform("lap", lambda x: (x - F.col("lm")) * (x - F.col("lm")))), 6).alias("laplacian_var"), (F.size(F.filter("lap", lambda x: F.abs(x) > 60)) / F.lit(64.0)).alias("edge_density"),
    )


@Q.add("tile_metrics", f"with {_METRICS} select * from t")
def tile_metrics(spark, sf_dir):
    return measures(spark, sf_dir)


@Q.add("tile_psnr", f"""with {_PX}, r as (select label, min(vec_id) as ref from embeddings group by label),
  e as (select a.vec_id, avg((a.v - b.v) * (a.v - b.v))::double as mse from px a join r using (label) join px b on b.vec_id = r.ref and a.i = b.i group by a.vec_id)
  select vec_id, round(case when mse <= 1e-12 then 99.0 else 20 * log10(255 / sqrt(mse)) end, 6) as psnr from e""")
def tile_psnr(spark, sf_dir):
    t = tiles(spark, sf_dir)
    refs = t.groupBy("label").agg(F.min_by("a", "vec_id").alias("r"))
    mse = _mean(F.zip_with("a", "r", lambda x, y: ((x - y) * (x - y)).cast("double")))
    return t.join(refs, "label").select("vec_id", mse.alias("mse")).select("vec_id", F.round(F.when(F.col("mse") <= 1e-12, 99.0).otherwise(20 * F.log10(255 / F.sqrt("mse"))), 6).alias("psnr"))


# Columns that tiles lack are made from those that they have.
_SCORED = f"""{_METRICS}, q as (select *, entropy / 400 as darkness_mean, dark_ratio as bbox_fill_ratio, white_ratio as bbox_area_ratio, case when vec_id % 3 = 0 then null else 12 + vec_id % 25 end::double as psnr, case when vec_id % 3 = 0 then null else (vec_id % 100) / 100.0 end::double as ssim,
    case when vec_id % 3 = 0 then null when vec_id % 7 = 0 then 0.0 else 20.0 + vec_id % 9 end::double as foreground_psnr, case when vec_id % 3 = 0 then null else 0.0 end::double as foreground_ssim, case when vec_id % 3 = 0 then null else (vec_id % 50) / 10.0 - 2 end::double as entropy_delta, case when vec_id % 2 = 0 then 'source' else 'generated' end as kind from t),
  n as (select *, 0.16 * least(greatest((entropy - 3.0) / 5.0, 0), 1) + 0.16 * least(greatest((contrast_std - 7.0) / 57.0, 0), 1) + 0.16 * least(greatest((ln(1 + laplacian_var) - ln(4.0)) / (ln(1201.0) - ln(4.0)), 0), 1)
    + 0.12 * case when edge_density between 0.003 and 0.35 then 1.0 else least(greatest(1 - abs(edge_density - 0.08) / 0.08, 0), 1) end + 0.18 * case when alpha_ratio between 0.003 and 0.45 then 1 else 0 end
    + 0.12 * least(greatest((darkness_mean - 0.015) / (0.015 * 8 - 0.015), 0), 1) + 0.07 * case when bbox_fill_ratio > 0.72 and bbox_area_ratio > 0.08 then 0 else 1 end
    + 0.03 * least(1 - least(greatest((dark_ratio - 0.78) / (1.0 - 0.78), 0), 1), 1 - least(greatest((white_ratio - 0.92) / (1.0 - 0.92), 0), 1)) as no_ref_score from q),
  f as (select *, case when kind = 'source' or psnr is null then no_ref_score else 0.55 * no_ref_score + 0.15 * least(greatest((coalesce(nullif(foreground_psnr, 0), psnr) - 12) / 20, 0), 1) + 0.2 * least(greatest((coalesce(nullif(foreground_ssim, 0), ssim) - 0.45) / (0.98 - 0.45), 0), 1)
    + 0.1 * least(greatest(1 - abs(entropy_delta - 0.15) / 1.2, 0), 1) end as quality_score,
    concat_ws('+', case when not alpha_ratio between 0.003 and 0.45 then 'bad_alpha_area' end, case when bbox_fill_ratio > 0.72 and bbox_area_ratio > 0.08 then 'filled_rectangle_mask' end, case when contrast_std < 7 then 'low_contrast' end, case when laplacian_var < 3 then 'blurred' end,
      case when darkness_mean < 0.015 then 'weak_ink' end, case when dark_ratio > 0.78 then 'too_dark' end, case when white_ratio > 0.92 then 'too_white' end, case when kind = 'generated' and abs(entropy_delta) > 1.8 then 'entropy_shift_too_large' end) as quality_reasons from n),
  g as (select *, quality_reasons = '' and round(quality_score, 6) >= case when kind = 'source' then 0.38 else 0.36 end as quality_ok from f)"""


def scored(spark, sf_dir):
    v, third = F.col("vec_id"), F.col("vec_id") % 3 == 0
    unless = lambda c: F.when(~third, c.cast("double"))
    rows = measures(spark, sf_dir).withColumns({
        "darkness_mean": F.col("entropy") / 400, "bbox_fill_ratio": F.col("dark_ratio"), "bbox_area_ratio": F.col("white_ratio"), "psnr": unless(12 + v % 25), "ssim": unless((v % 100) / 100.0),
        "foreground_psnr": unless(F.when(v % 7 == 0, 0.0).otherwise(20.0 + v % 9)), "foreground_ssim": unless(F.lit(0.0)), "entropy_delta": unless((v % 50) / 10.0 - 2), "kind": F.when(v % 2 == 0, "source").otherwise("generated"),
    })
    kind = F.col("kind")
    rows = rows.withColumn("no_ref_score", scoring.no_reference_score())
    rows = rows.withColumn("quality_score", scoring.final_score(kind)).withColumn("found", scoring.reasons(kind))
    rows = rows.withColumn("quality_ok", scoring.passes(kind, F.round("quality_score", 6), F.col("found")))
    return rows.withColumn("quality_reasons", scoring.reason_text(F.col("found")))


@Q.add("quality_score_reasons", f"with {_SCORED} select vec_id, kind, round(no_ref_score, 6) as no_ref_score, round(quality_score, 6) as quality_score, quality_reasons, quality_ok from g")
def quality_score_reasons(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", "kind", F.round("no_ref_score", 6).alias("no_ref_score"), F.round("quality_score", 6).alias("quality_score"), "quality_reasons", "quality_ok")


@Q.add("quality_summary", f"""with {_SCORED} select label::varchar as grp, count(*) as total, count(*) filter (quality_ok) as quality_ok, round(count(*) filter (quality_ok) / count(*), 6) as quality_ok_rate, round(avg(quality_score), 6) as avg_quality_score, round(avg(entropy), 6) as avg_entropy,
  round(avg(ssim), 6) as avg_ssim, round(avg(psnr), 6) as avg_psnr, round(avg(foreground_ssim), 6) as avg_foreground_ssim, round(avg(foreground_psnr), 6) as avg_foreground_psnr from g group by label""")
def quality_summary(spark, sf_dir):
    return quality.summary(scored(spark, sf_dir).withColumn("grp", F.col("label").cast("string")), "grp")


@Q.add("run_summary", f"with {_SCORED} select kind, count(*) as rows, count(*) filter (quality_ok) as ok from g group by kind")
def run_summary(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("rows"), F.count_if("quality_ok").alias("ok"))


@Q.add("bad_source_suffix", f"with {_SCORED} select vec_id, case when label < 5 then quality_reasons else concat_ws('+', nullif(quality_reasons, ''), 'bad_source_image') end as reasons from g")
def bad_source_suffix(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", scoring.reason_text(F.col("found"), F.col("label") < 5).alias("reasons"))


@Q.add("patch_gate", f"with {_METRICS} select vec_id, alpha_ratio <= 0.5 and white_ratio <= 0.35 and contrast_std >= 4 as page_ok, alpha_ratio <= 0.65 and white_ratio <= 0.85 and contrast_std >= 2 as char_ok from t")
def patch_gate(spark, sf_dir):
    rows = measures(spark, sf_dir).withColumns({"mask_ratio": F.col("alpha_ratio"), "gray_std": F.col("contrast_std")})
    return rows.select("vec_id", scoring.patch_gate(max_mask=0.5).alias("page_ok"), scoring.patch_gate(0.65, 0.85, 2.0).alias("char_ok"))


QUERIES, ORACLES = Q.queries, Q.sql
