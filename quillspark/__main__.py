"""Commands over folders of tables and images: ``python -m quillspark COMMAND --help``.

Each command reads what the command before has written: label files, clean samples, splits, patches, manifests, quality tables.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.functions import text
from quillspark.kernels import glyphs
from quillspark.kernels.fusion import Recipe
from quillspark.operators import ranking, splits, stages
from quillspark.plans import pipelines
from quillspark.scratch import written
from quillspark.sources import annotations, delimited, images, listing, sinks

COMMANDS = {}


def command(*options: tuple):
    def register(f):
        COMMANDS[f.__name__.replace("_", "-")] = (f, options)
        return f

    return register


def opt(name: str, **kw) -> tuple:
    return f"--{name}", kw


OUT, SEED = opt("out", required=True), opt("seed", type=int, default=42)


def _pixels(spark: SparkSession, root: str) -> DataFrame:
    return images.read_images(spark, root).withColumn("path", listing.plain_path(F.col("path")))


def _samples(spark: SparkSession, table: str, root: str) -> DataFrame:
    """Rows of a table of samples with their full path and image."""
    rows = delimited.read_csv(spark, table).drop("_manifest", "_row")
    full = F.when(F.col("image_path").startswith("/"), F.col("image_path")).otherwise(F.concat(F.lit(os.path.abspath(root) + "/"), "image_path"))
    return rows.withColumn("path", full).join(_pixels(spark, root), "path")


def _backgrounds(spark: SparkSession, root: str) -> DataFrame:
    found = listing.patches(spark, root).select(listing.plain_path(F.col("path")).alias("path"), "source")
    return found.join(_pixels(spark, root), "path")


def _save(images_: DataFrame, out: str, path: str) -> int:
    return sinks.export_files(sinks.encoded(images_, [path]), out, path, "png")


@command(opt("data_root", required=True), opt("labels", action="append", required=True, help="label files (tab separated)"), opt("exclude", action="append", default=[]), opt("min_count", type=int, default=20), OUT)
def label_index(spark, a):
    """Kept, excluded and missing label rows; class counts and rare classes."""
    rows = None
    for path in a.labels:
        folder = os.path.dirname(os.path.abspath(path))
        own = delimited.read_tsv(spark, path).select(*(F.col(c) for c in ("path", "char", "book", "page", "index")))
        own = own.select(text.source_of_label_file(F.lit(os.path.abspath(path))).alias("source_label"), F.concat(F.lit(folder + "/"), "path").alias("image_path"), "char", "book", "page", "index")
        rows = own if rows is None else rows.unionByName(own)
    there = listing.files(spark, a.data_root).select(listing.plain_path(F.col("path")).alias("path"))
    made = pipelines.label_index(rows, there, a.exclude, a.min_count)
    fields = schemas.names(schemas.CLEAN_SAMPLES)
    for name in ("clean_samples", "excluded_unknown_samples", "missing_image_samples"):
        sinks.write_table(made[name].orderBy("source_label", "image_path"), f"{a.out}/{name}.csv", fields)
    sinks.write_counts(made["class_counts"], f"{a.out}/class_counts.csv", schemas.names(schemas.CLASS_COUNTS))
    sinks.write_counts(made["rare_chars"], f"{a.out}/rare_chars.csv", schemas.names(schemas.RARE_CHARS))
    return sinks.summary_row(made["summary"])


@command(opt("clean_samples", required=True), opt("val_ratio", type=float, default=0.15), opt("test_ratio", type=float, default=0.15), opt("target_count", type=int, default=20), opt("limit_classes", type=int), SEED, OUT)
def split(spark, a):
    """Train, validation and test tables, drawn class by class."""
    rows = delimited.read_csv(spark, a.clean_samples).drop("_manifest", "_row")
    made = pipelines.split_tables(rows, "image_path", a.val_ratio, a.test_ratio, a.seed, a.target_count, a.limit_classes)
    counts = {n: sinks.write_table(made[n].orderBy("char", "image_path"), f"{a.out}/{n}.csv", rows.columns) for n in ("train", "val", "test")}
    return counts | {"rare": sinks.write_counts(made["train_rare_chars"], f"{a.out}/train_rare_chars.csv", schemas.names(schemas.RARE_CHARS))}


@command(opt("images", required=True), opt("box", help="x1,y1,x2,y2"), opt("feather", type=int, default=5), OUT)
def extract(spark, a):
    """The glyph's mask of every image, with its area."""
    box = tuple(int(v) for v in a.box.split(",")) if a.box else None
    found = images.extracted(_pixels(spark, a.images), glyphs.MaskOptions(feather=a.feather), box)
    masks = found.withColumn("data", F.col("alpha")).withColumn("name", F.concat(F.lit("masks/"), text.stem(F.col("path")), F.lit(".png")))
    count = _save(masks, a.out, "name")
    sinks.write_table(found.select("path", "area", "ratio").orderBy("path"), f"{a.out}/regions.csv", ["path", "area", "ratio"])
    return {"images": count}


@command(opt("source", action="append", required=True, help="name=folder of annotations and images"), opt("patches", type=int, default=4), opt("size", type=int, default=128), opt("crop_method", default="white"), opt("limit", type=int), SEED, OUT)
def page_backgrounds(spark, a):
    """Background patches of annotated pages, the glyphs filled."""
    total = {}
    for name, folder in listing.parsed_sources(a.source, {}).items():
        pixels = _pixels(spark, f"{folder}/{annotations.IMAGES}")
        notes = annotations.read_annotations(spark, folder, a.limit).withColumn("path", listing.plain_path(F.col("path"))).where(F.size("boxes") > 0)
        pages = annotations.with_image(notes, pixels.select("path")).select(F.col("path").alias("xml"), F.col("image").alias("path"), "boxes").join(pixels, "path")
        made = images.page_backgrounds(pages, a.patches, a.size, a.seed, crop=a.crop_method)
        place = F.concat(F.lit(f"{name}/"), text.stem(F.col("path")), F.lit("/patches/"), F.format_string("%04d.png", "patch_no"))
        made = made.withColumn("name", place).withColumn("source", F.lit(name))
        made = written(made, "patches")
        total[name] = _save(made, a.out, "name")
        manifest = made.groupBy("source", F.col("path").alias("image")).agg(F.count("*").alias("patches"), F.max("box_count").alias("boxes"), F.max("mask_ratio").alias("mask_ratio"), F.max("crop_box").alias("crop_box"), F.min("name").alias("background"))
        sinks.write_table(manifest.orderBy("image"), f"{a.out}/{name}/manifest.csv", schemas.names(schemas.BACKGROUNDS))
    sinks.write_json(spark, f"{a.out}/summary.json", total)
    return total


@command(opt("clean_samples", required=True), opt("data_root", required=True), opt("max_per_char", type=int, default=3), opt("limit_per_source", type=int, default=0), opt("size", type=int, default=128), SEED, OUT)
def char_backgrounds(spark, a):
    """Background patches of single glyphs' images, some for each source and class."""
    codes = F.create_map(*(F.lit(x) for kv in listing.SOURCES.items() for x in kv))
    rows = _samples(spark, a.clean_samples, a.data_root).withColumn("source", F.try_element_at(codes, "source_label")).where("source is not null")
    rows = splits.capped(rows, ["source", "char"], [F.col("image_path")], a.max_per_char)
    rows = splits.sampled(rows, ["source"], "image_path", a.limit_per_source, a.seed)
    made = images.char_backgrounds(rows, a.size, keep=["source", "char", "path"])
    made = made.withColumn("char_code", text.code_label(F.col("char"))).withColumn("patch", F.concat("source", F.lit("/"), "char_code", F.lit("/patches/"), text.stem(F.col("path")), F.lit(".png")))
    made = written(made, "patches")
    count = _save(made, a.out, "patch")
    sinks.write_table(made.withColumn("image", F.col("path")).drop("data").orderBy("patch"), f"{a.out}/manifest.csv", schemas.names(schemas.CHAR_BACKGROUNDS))
    return {"patches": count}


@command(opt("train", required=True), opt("rare", required=True), opt("data_root", required=True), opt("backgrounds", required=True), opt("mode", default="none", choices=sorted(glyphs.MODES)), opt("per_char", type=int, default=20, help="samples of a class, unless a target is given"), opt("target_count", type=int, help="samples that a class is to reach"), opt("image_size", type=int, help="side of the samples (their sources' size)"),
    opt("background_source_policy", default=pipelines.POLICIES[0], choices=pipelines.POLICIES), opt("source_bg_strength", type=float, default=0.35), opt("no_prefuse", action="store_true"), opt("sample_attempts", type=int, default=20), opt("strict_sources", action="store_true"), SEED, OUT)
def generate(spark, a):
    """Samples for rare classes, on backgrounds of all sources in turn."""
    train = _samples(spark, a.train, a.data_root)
    rare = delimited.typed(delimited.read_csv(spark, a.rare), schemas.RARE_CHARS)
    label = train.select("path", "source_label").distinct()
    made = pipelines.generation_plan(train.select("char", "path", "height", "width", "channels", "data"), rare, _backgrounds(spark, a.backgrounds), a.mode, a.target_count, a.sample_attempts, a.seed, a.strict_sources, recipe=Recipe(mix=0.0 if a.no_prefuse else a.source_bg_strength), per_char=a.per_char, size=a.image_size, policy=a.background_source_policy)
    made = written(made, "generated")
    count = _save(made, a.out, "path")
    _save(pipelines.layer_images(made), a.out, "path")
    rows = made.drop("data").join(label.withColumnsRenamed({"path": "source_image"}), "source_image", "left").withColumns({"output_width": F.col("width"), "output_height": F.col("height")})
    sinks.write_table(rows.orderBy("path"), f"{a.out}/generated_samples.csv", schemas.names(schemas.GENERATED))
    return {"generated": count, "classes": made.select("char").distinct().count()}


@command(opt("clean_samples", required=True), opt("data_root", required=True), opt("experiment", help="folder with augmented manifests"), opt("manifest", action="append", default=[]), opt("require_source_ok", action="store_true"), OUT)
def score(spark, a):
    """Quality scores of source and generated images, summaries, and the rows that are kept."""
    sources = _samples(spark, a.clean_samples, a.data_root)
    made, columns = None, ["path", "source_image", "method", "char"]
    for m in listing.manifests(spark, a.experiment or a.out, a.manifest):
        root = os.path.dirname(m.removeprefix("file:"))
        rows = delimited.read_csv(spark, m).select(F.concat(F.lit(root + "/"), "path").alias("path"), "source_image", "method", "char").join(_pixels(spark, root), "path")
        made = rows if made is None else made.unionByName(rows)
    if made is None:
        made = sources.limit(0).select("path", F.col("path").alias("source_image"), F.lit("").alias("method"), "char", "height", "width", "channels", "data")
    run = pipelines.quality_run(sources, made, require_source=a.require_source_ok)
    chars = made.select("path", "char").distinct()
    names = ["kind", "path", *schemas.names(schemas.MEASURES), *schemas.names(schemas.COMPARISON), "no_ref_score", "quality_score", "quality_ok", "quality_reasons"]
    sinks.write_table(run["sources"].orderBy("path"), f"{a.out}/source_image_quality.csv", [*names, "source_label", "readable"])
    sinks.write_table(run["generated"].join(chars, "path", "left").orderBy("path"), f"{a.out}/generated_image_quality.csv", [*names, "char", "source_image", "method", "source_quality_ok", "kept"])
    fields = ["total", "quality_ok", "quality_ok_rate", "avg_quality_score", "avg_entropy", "avg_ssim", "avg_psnr", "avg_foreground_ssim", "avg_foreground_psnr"]
    sinks.write_table(run["source_summary"].orderBy("source_label"), f"{a.out}/source_quality_summary.csv", ["source_label", *fields])
    sinks.write_table(run["generated_summary"].orderBy("method"), f"{a.out}/generated_quality_summary.csv", ["method", *fields])
    kept = sinks.write_table(run["clean"].select(*(c for c in run["clean"].columns if c not in ("height", "width", "channels"))).orderBy("path"), f"{a.out}/clean_samples_quality_filtered.csv", schemas.names(schemas.CLEAN_SAMPLES))
    return {"sources": run["sources"].count(), "generated": run["generated"].count(), "kept_sources": kept, "kept_generated": run["kept"].count()}


@command(opt("clean_samples", required=True), opt("data_root", required=True), opt("backgrounds", required=True), opt("method", action="append", default=[]), opt("target_count", type=int, default=20), opt("side", type=int, default=64), opt("threshold", type=float, default=0.8), opt("min_gain", type=float, default=0.0), opt("top_k", type=int), opt("strict_sources", action="store_true"), SEED, OUT)
def difficulty(spark, a):
    """Split, baseline, simple fusion, and each method on the classes that are hard, all compared."""
    cut = pipelines.split_tables(_samples(spark, a.clean_samples, a.data_root), "image_path", seed=a.seed, target=a.target_count)
    ground, rare = _backgrounds(spark, a.backgrounds), cut["train_rare_chars"]
    plain = cut["train"].select("char", "path", "height", "width", "channels", "data")
    vec = lambda df, keep: images.vectors(df, a.side, ["char", *keep])
    parts = {m: pipelines.generation_plan(plain, rare, ground, m, a.target_count, seed=a.seed, strict=a.strict_sources).withColumn("method", F.lit(m)) for m in ("none", *a.method)}
    by_method = stages.stage_table({m: vec(parts[m], ["method"]) for m in (a.method or ["none"])}).drop("stage")
    out = pipelines.difficulty_experiment(vec(plain, []), vec(cut["val"], []), vec(parts["none"], []), by_method, a.side * a.side, a.target_count, a.threshold, a.min_gain, a.top_k)
    summary = out["summary"].orderBy("stage")
    sinks.write_table(summary, f"{a.out}/experiment_summary.csv", summary.columns)
    sinks.write_table(out["difficult_chars"].orderBy("accuracy_delta", "char"), f"{a.out}/difficult_chars_by_simple_gain.csv", out["difficult_chars"].columns)
    return {r["stage"]: r["accuracy"] for r in summary.collect()}  # a row a stage


@command(opt("quality", required=True, help="a table of scored images"), opt("group_by", default="method"), opt("k", type=int, default=10), OUT)
def examples(spark, a):
    """The best and the worst images of each group."""
    rows = delimited.read_csv(spark, a.quality).drop("_manifest", "_row").withColumn("grp", text.or_unknown(F.col(a.group_by))).withColumn("score", text.lenient_double(F.col("quality_score")))
    out = ranking.examples(rows, "grp", F.col("score"), ["path"], a.k).orderBy("grp", "side", "rank")
    return {"rows": sinks.write_table(out, f"{a.out}/quality_score_examples_manifest.csv", ["grp", "side", "rank", *(c for c in rows.columns if c not in ("grp", "score"))])}


@command(opt("quality", required=True), opt("order", default="avg_score", choices=ranking.MEASURES), opt("min_generated", type=int, default=1), opt("limit", type=int, default=80), opt("per_method", type=int, default=0), OUT)
def lineage(spark, a):
    """Generated samples by source image, for the source images that rank first."""
    rows = delimited.read_csv(spark, a.quality).drop("_manifest", "_row").withColumn("quality_score", text.lenient_double(F.col("quality_score")))
    made = pipelines.lineage_tables(rows, a.per_method, a.order, a.min_generated, a.limit)
    out = made["lineage"].join(made["labels"], "source_image").orderBy("group_no", "seq")
    return {"groups": made["groups"].count(), "rows": sinks.write_table(out, f"{a.out}/source_lineage_manifest.csv", ["group_no", "seq", "label_text", *rows.columns])}


@command(opt("root", action="append", required=True), OUT)
def package(spark, a):
    """An archive of some folders."""
    return {"files": sinks.package(spark, a.root, a.out)}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    subs = parser.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        sub = subs.add_parser(name, help=f.__doc__)
        for flag, kw in options:
            sub.add_argument(flag, **kw)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName(f"quillspark {a.command}").getOrCreate()
    out = COMMANDS[a.command][0](spark, a)
    print(out)
    return out


if __name__ == "__main__":
    main()
