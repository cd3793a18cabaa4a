import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.plans import pipelines
from quillspark.sources import images as im

IMAGE = "height int, width int, channels int, data binary"


def stroke(seed, size=96, arm=0):
    rng = np.random.default_rng(seed)
    x = np.clip(190 + rng.normal(0, 6, (size, size, 3)), 0, 255)
    x[20:76, 40 + 8 * arm : 49 + 8 * arm] = 40
    x[30 + 10 * arm : 39 + 10 * arm, 20:76] = 45
    return x.astype(np.uint8)


def ground(seed, size=128):
    return np.clip(np.random.default_rng(seed).normal(170, 14, (size, size, 3)), 0, 255).astype(np.uint8)


def row(x):
    return x.shape[0], x.shape[1], 3, x.tobytes()


@pytest.fixture(scope="module")
def samples(spark):
    sources = list(pipelines.SOURCES)
    rows = [(c, f"{c}/{k}.png", sources[k % 4], *row(stroke(1000 * i + k, arm=i))) for i, c in enumerate("甲乙丙") for k in range(6)]
    return spark.createDataFrame(rows, f"char string, path string, source_label string, {IMAGE}")


@pytest.fixture(scope="module")
def backgrounds(spark):
    rows = [(s, f"{s}/{k}.png", *row(ground(10 * i + k))) for i, s in enumerate(pipelines.SOURCES.values()) for k in range(2)]
    return spark.createDataFrame(rows, f"source string, path string, {IMAGE}")


def test_label_index(spark):
    labels = spark.createDataFrame([("s", "1.png", "一"), ("s", "2.png", "□"), ("s", "3.png", "一"), ("s", "4.png", "𠀀")], "source_label string, image_path string, char string")
    out = pipelines.label_index(labels, spark.createDataFrame([("1.png",), ("2.png",), ("4.png",)], "path string"), min_count=2)
    assert out["summary"].first().asDict() == {"kept": 2, "excluded": 1, "missing": 1, "classes": 2, "rare_classes": 2}
    assert [tuple(r) for r in out["rare_chars"].collect()] == [("一", 1, 1), ("𠀀", 1, 1)]


def test_split(samples):
    out = pipelines.split_tables(samples.select("char", F.col("path").alias("image_path")))
    assert [out[s].count() for s in ("train", "val", "test")] == [12, 3, 3]
    assert {r["char"]: r["need_to_min_count"] for r in out["train_rare_chars"].collect()} == {"甲": 16, "乙": 16, "丙": 16}
    assert pipelines.split_tables(samples.select("char", F.col("path").alias("image_path")), limit=1)["train"].select("char").distinct().count() == 1


def test_generation_and_experiments(spark, samples, backgrounds):
    cut = pipelines.split_tables(samples.withColumn("image_path", F.col("path")))
    train = cut["train"].select("char", "path", "height", "width", "channels", "data")
    rare = cut["train_rare_chars"]
    made = {m: pipelines.generation_plan(train, rare, backgrounds, m, target=6, seed=7).cache() for m in ("none", "gamma_usm")}
    plain = made["none"].collect()
    assert len(plain) == 6 and {(r.height, r.width) for r in plain} == {(96, 96)} and len({r.path for r in plain}) == 6
    assert {r.background_source for r in plain} <= set(pipelines.SOURCES.values()) and set(schemas.names("char STRING, char_code STRING, angle DOUBLE, scale DOUBLE")) <= set(made["none"].columns)
    again = pipelines.generation_plan(train, rare, backgrounds, "none", target=6, seed=7).collect()
    assert sorted(bytes(r.data) for r in again) == sorted(bytes(r.data) for r in plain)
    with pytest.raises(ValueError, match="without backgrounds"):
        pipelines.generation_plan(train, rare, backgrounds.where("source <> 'wuwei'"), target=6)

    vec = lambda df, *keep: im.vectors(df.withColumn("channels", F.lit(3)), 16, ["char", *keep]).cache()
    out = pipelines.difficulty_experiment(vec(train), vec(cut["val"].unionByName(cut["test"])), vec(made["none"]), vec(made["gamma_usm"].withColumn("method", F.lit("gamma_usm")), "method"), 256, target=6, threshold=1.0, k=1)
    stages = {r.stage: r for r in out["summary"].collect()}
    assert set(stages) == {"baseline", "simple_fusion", "difficult_gamma_usm"} and stages["simple_fusion"].accuracy_delta == 0
    assert stages["baseline"].samples == 6 and out["difficult_chars"].count() <= 1
    with pytest.raises(ValueError, match="no readable"):
        pipelines.trained(vec(train), [], vec(cut["val"]).where("false"), 256)

    sources = samples.unionByName(spark.createDataFrame([("丁", "broken.png", "武威", -1, -1, -1, b"")], samples.schema))
    run = pipelines.quality_run(sources, made["none"].withColumn("method", F.lit("simple")))
    scored = {r.path: r for r in run["sources"].collect()}
    assert len(scored) == 19 and scored["broken.png"].quality_reasons == "unreadable" and scored["broken.png"].quality_score == 0 and not scored["broken.png"].quality_ok
    got = run["generated"].collect()
    assert len(got) == 6 and all(r.psnr is not None and r.ssim is not None for r in got)
    totals = run["generated_summary"].first()
    assert totals.total == 6 and totals.avg_ssim is not None and run["source_summary"].agg(F.sum("total")).first()[0] == 19
    assert run["clean"].count() == sum(r.quality_ok for r in scored.values()) and run["kept"].count() == sum(r.quality_ok for r in got)

    lineage = pipelines.lineage_tables(run["generated"].withColumn("char", F.substring("path", 8, 1)), limit=3)
    assert 0 < lineage["groups"].count() <= 3 and lineage["lineage"].agg(F.min("seq")).first()[0] == 1


def test_page_and_char_backgrounds(spark, samples):
    page = np.clip(np.random.default_rng(3).normal(160, 20, (256, 256, 3)), 0, 255).astype(np.uint8)
    page[80:165, 100:112] = 30
    pages = spark.createDataFrame([("1.png", *row(page), [(80, 70, 165, 190)]), ("2.png", *row(page), [(-5, -5, -1, -1)]), ("3.png", -1, -1, -1, b"", [])], f"path string, {IMAGE}, boxes array<struct<xmin:int,ymin:int,xmax:int,ymax:int>>")
    got = im.page_backgrounds(pages, count=2, size=64, seed=7, crop="none").collect()
    assert [r.path for r in got] == ["1.png", "1.png"] and all(len(r.data) == 64 * 64 * 3 and 0 < r.mask_ratio < 0.5 and r.crop_box == "0,0,256,256" for r in got)
    with pytest.raises(ValueError):
        im.page_backgrounds(pages, crop="other")
    chars = im.char_backgrounds(samples, size=64, keep=["char", "path"])
    assert chars.count() >= 15 and chars.where("mask_ratio > 0.65 or gray_std < 2").count() == 0
    alpha = im.extracted(samples.limit(2)).collect()
    assert all(r.area >= 100 and len(r.alpha) == 96 * 96 for r in alpha)


def test_streaming_windows(spark, tmp_path):
    from quillspark.streaming.windows import tumbling

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = tumbling(stream, "1 hour", "1 day").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = {(r.window_start, r.event_type): r.events for r in tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour").collect()}
    assert {(r.window_start, r.event_type): r.events for r in spark.table("win").collect()} == want
