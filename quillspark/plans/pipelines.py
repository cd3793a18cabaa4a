"""Whole flows over tables: label index, training and evaluation, difficulty and quality experiments, lineage.

Each is one driver program of lazily composed tables; methods are a column, so that one plan handles them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.functions.text import code_label
from quillspark.kernels.fusion import Recipe
from quillspark.operators import generation, metrics, quality, ranking, routing, splits, stages
from quillspark.scratch import written
from quillspark.sources import images as im
from quillspark.sources.listing import SOURCES


# Names of the ways in which backgrounds are picked, and of the methods without and with the glyph's own surroundings.
POLICIES = ("cycle_all_sources", "random")
METHODS = ("preenhanced_opencv_grabcut_softmask_bg_fusion", "preenhanced_opencv_grabcut_softmask_source_bg_prefusion")


def label_index(labels: DataFrame, listing: DataFrame, exclude: list[str] = (), min_count: int = 20) -> dict[str, DataFrame]:
    """Kept, excluded and missing rows, class counts, rare classes and a summary, from label rows (char, image_path, ..)."""
    there = listing.select(F.col("path").alias("image_path"))
    rows = written(routing.routed(labels, "char", there, "image_path", exclude), "routed")
    kept = rows.where("route = 'kept'").drop("route")
    counts = routing.class_counts(kept, "char")
    return {
        "clean_samples": kept, "excluded_unknown_samples": rows.where("route = 'excluded'").drop("route"), "missing_image_samples": rows.where("route = 'missing'").drop("route"),
        "class_counts": counts.orderBy("count", "char"), "rare_chars": routing.rare_classes(counts, min_count).orderBy("count", "char"), "summary": routing.index_summary(rows, "char", min_count),
    }


def split_tables(samples: DataFrame, key: str = "image_path", validation: float = 0.15, test: float = 0.15, seed: int = 42, target: int = 20, limit: int | None = None) -> dict[str, DataFrame]:
    """train, val and test, drawn by class, and the classes that are rare in train."""
    rows = routing.filled(samples, "char")
    if limit is not None:
        rows = rows.join(rows.select("char").distinct().orderBy("char").limit(limit), "char", "left_semi")
    cut = written(splits.stratified_split(rows, "char", key, validation, test, seed), "split")
    out = {s: cut.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    return out | {"train_rare_chars": routing.rare_classes(routing.class_counts(out["train"], "char"), target).orderBy("count", "char")}


def trained(real: DataFrame, more: list[DataFrame], evaluation: DataFrame, size: int) -> dict[str, DataFrame]:
    """Per-class and overall metrics of nearest centroids: train rows (char, v) real and generated, classes those of the real rows."""
    classes = real.select("char").distinct()
    train = reduce(DataFrame.unionByName, [real.select("char", "v"), *(m.select("char", "v") for m in more)])
    train, test = metrics.closed_set(train, classes, "char"), metrics.closed_set(evaluation, classes, "char")
    for name, rows in (("train", train), ("evaluation", test)):
        if rows.isEmpty():
            raise ValueError(f"no readable {name} rows")
    cents = written(metrics.centroids(train, "char", "v", size, classes), "centroids")
    got = written(metrics.nearest(test, cents, "char", "v").select("char", "prediction"), "predicted")
    return {"per_class": metrics.per_class(got, "char", routing.class_counts(real, "char")), "overall": metrics.overall(got, "char")}


def generation_plan(train: DataFrame, rare: DataFrame, backgrounds: DataFrame, mode: str = "none", target: int | None = 20, tries: int = 20, seed: int = 42, strict: bool = True, limits: scoring.Limits = scoring.Limits(), recipe: Recipe = Recipe(), per_char: int = 20, size: int | None = None, policy: str = POLICIES[0]) -> DataFrame:
    """Generated samples for classes that are short of ``target`` (None: ``per_char`` for each class): attempts from usable sources, one sample a slot,
    backgrounds of the sources in turn or at random, samples as large as their sources or ``size`` squared.

    ``train``: char, path, height, width, channels, data; ``backgrounds``: source and the same.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy {policy!r}: one of {POLICIES}")
    required = train.sparkSession.createDataFrame([(s,) for s in SOURCES.values()], "source string")
    if strict and policy == POLICIES[0] and not (gone := generation.missing_sources(required, backgrounds, "source")).isEmpty():
        raise ValueError(f"sources without backgrounds: {sorted(r.source for r in gone.collect())}")
    rows = train.join(rare.select("char"), "char", "left_semi")
    counts = routing.class_counts(rows, "char")
    wanted = generation.slots(counts.withColumn("count", F.lit(0)) if target is None else counts, "char", "count", per_char if target is None else target)
    # Whether a glyph can be used does not depend on the attempt: it is found once for each source image.
    gate = im.glyph_usable(rows, mode, ["char", "path"]).withColumn("good", scoring.glyph_gate(limits)).select("char", "path", "good")
    picks = generation.accepted(generation.attempts(wanted, written(gate, "gate"), "char", "path", tries, seed), "char", F.col("good")).select("char", "slot", "path")
    grounds = backgrounds.select("source", F.col("path").alias("background"))
    if policy == POLICIES[0]:
        turns = generation.round_robin(picks.select("char", "slot"), grounds, "source", "background", "char", seed, list(SOURCES.values()))
    else:
        turns = generation.at_random(picks.select("char", "slot"), grounds, "background", "char", seed)
    slots = picks.join(turns.select("char", "slot", F.col("source").alias("background_source"), "background"), ["char", "slot"])
    slots = slots.join(rows.drop("char"), "path").join(backgrounds.select(F.col("path").alias("background"), *(F.col(c).alias(f"bg_{c}") for c in ("height", "width", "channels", "data"))), "background")
    made = im.generated(slots, mode, seed, recipe, ["char", "slot", "path", "background_source", "background"], size, tries, limits)
    name = F.concat(code_label(F.col("char")), F.format_string("_%04d.png", "slot"))
    return made.withColumnsRenamed({"path": "source_image"}).withColumns({"path": F.concat(F.lit("images/"), "char", F.lit("/"), name), "char_code": code_label(F.col("char")), "pre_extract_enhance": F.lit(mode), "method": F.lit(METHODS[recipe.mix > 0]), "channels": F.lit(3)})


def layer_images(made: DataFrame) -> DataFrame:
    """Alpha and darkness of each class's first sample, as gray images with a path, to be looked at."""
    rows = generation.first_of_group(made, "char", ["slot"]).where("is_first")
    layers = F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), F.col(n).alias("data")) for n in ("alpha", "darkness")))).alias("l")
    rows = rows.select("char", F.col("source_height").alias("height"), F.col("source_width").alias("width"), layers)
    return rows.select(F.concat(F.lit("debug/"), "char", F.lit("_"), "l.layer", F.lit(".png")).alias("path"), "height", "width", F.lit(1).alias("channels"), "l.data")


def difficulty_experiment(real: DataFrame, evaluation: DataFrame, simple: DataFrame, by_method: DataFrame, size: int, target: int = 20, threshold: float = 0.8, min_gain: float = 0.0, k: int | None = None) -> dict[str, DataFrame]:
    """Stages baseline, simple fusion and one for each method, whose samples replace the simple ones of hard classes.

    All tables have char and v; ``by_method`` has method as well.
    """
    base, plain = (trained(real, more, evaluation, size) for more in ([], [simple]))
    hard = written(metrics.hard_by_gain(base["per_class"], plain["per_class"], "char", target, threshold, min_gain, k), "hard")
    left = stages.without(simple, hard, "char")
    own = by_method.join(hard.select("char"), "char", "left_semi")
    runs = {"baseline": base, "simple_fusion": plain}
    for m in sorted(r.method for r in by_method.select("method").distinct().collect()):  # a few names
        runs[f"difficult_{m}"] = trained(real, [left, own.where(F.col("method") == m)], evaluation, size)
    table = stages.stage_table({n: r["overall"].crossJoin(metrics.subset(r["per_class"], hard, "char").toDF("difficult_support", "difficult_correct", "difficult_accuracy", "difficult_macro")) for n, r in runs.items()})
    return {"summary": stages.against(stages.against(table, "simple_fusion"), "simple_fusion", "difficult_accuracy"), "difficult_chars": hard, "retained": left}


def scored_images(images: DataFrame, keep: list[str], kind: str, limits: scoring.Limits = scoring.Limits(), references: DataFrame | None = None, reference: str | None = None) -> DataFrame:
    """Every image with its measures, score, reasons and verdict; unreadable ones score zero."""
    out = im.measured(images, keep)
    if references is not None:
        out = out.join(im.compared(images, references, reference, keep), keep)
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("psnr", "ssim", "foreground_psnr", "foreground_ssim", "entropy_delta")})
    what = F.lit(kind)
    out = out.withColumn("no_ref_score", F.round(scoring.no_reference_score(limits), 6))
    out = out.withColumn("quality_score", F.when(F.col("readable"), F.round(scoring.final_score(what), 6)).otherwise(0.0))
    out = out.withColumn("found", F.when(F.col("readable"), scoring.reasons(what, limits)).otherwise(F.array(F.lit("unreadable"))))
    out = out.withColumn("quality_ok", F.coalesce(scoring.passes(what, F.col("quality_score"), F.col("found"), limits), F.lit(False)))
    return out.withColumn("kind", what)


def quality_run(sources: DataFrame, made: DataFrame, limits: scoring.Limits = scoring.Limits(), require_source: bool = False) -> dict[str, DataFrame]:
    """Scores of source and generated images, summaries by source and by method, and the generated rows that are kept.

    ``sources``: path, source_label and an image; ``made``: path, source_image, method and an image.
    """
    scored = written(scored_images(sources, ["path", "source_label"], "source", limits), "scored")
    got = scored_images(made, ["path", "source_image", "method"], "generated", limits, sources, "source_image")
    got = _with_verdict(got, scored)
    got = written(got.withColumn("quality_reasons", scoring.reason_text(F.col("found"), F.col("source_quality_ok"))).withColumn("kept", quality.kept(F.col("quality_ok"), F.col("source_quality_ok"), require_source)), "scored")
    return {
        "sources": scored.withColumn("quality_reasons", scoring.reason_text(F.col("found"))), "generated": got, "kept": got.where("kept"), "source_summary": quality.summary(scored, "source_label"),
        "generated_summary": quality.summary(got, "method"), "clean": quality.only_good(sources.drop("data"), scored.select("path", "quality_ok"), "path", "quality_ok"),
    }


def _with_verdict(rows: DataFrame, scored: DataFrame) -> DataFrame:
    verdicts = scored.select(F.col("path").alias("source_image"), F.col("quality_ok").alias("_verdict"))
    return quality.source_verdict(rows, verdicts, "source_image", "_verdict")


def lineage_tables(scored: DataFrame, per_method: int = 3, measure: str = "avg_score", at_least: int = 1, limit: int = 80) -> dict[str, DataFrame]:
    """For the chosen source images: their generated samples by method, numbered, and a label for each group."""
    rows = routing.filled(scored, "source_image")
    groups = written(ranking.ranked_groups(rows, "source_image", "quality_score", measure, at_least, limit), "groups")
    return {"groups": groups, "lineage": ranking.lineage(rows, groups, "source_image", "method", "quality_score", ["path"], per_method), "labels": ranking.label_text(rows, "source_image", "char")}
