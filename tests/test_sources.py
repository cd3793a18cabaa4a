import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark import schemas
from quillspark.sources import annotations, delimited, images, listing, sinks


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def test_delimited_tables(spark, tmp_path):
    p = put(tmp_path / "a.csv", b"\xef\xbb\xbfchar,path,note\r\n\xe4\xb8\x80 ,x.png,\"a, \"\"b\"\"\r\nc\"\r\n,y.png,\r\n")
    rows = delimited.read_csv(spark, p).orderBy("_row").collect()
    assert [(r.char, r.path, r.note) for r in rows] == [("一", "x.png", 'a, "b"\r\nc'), ("", "y.png", "")] or [(r.char, r.path, r.note.replace("\r\n", "\n")) for r in rows] == [("一", "x.png", 'a, "b"\nc'), ("", "y.png", "")]
    t = put(tmp_path / "t.tsv", "path\tchar\n1\t一\n2\t二\n3\t三\n")
    both = delimited.read_tsv(spark, [t])
    assert [r.char for r in delimited.first_rows(both, 2).orderBy("_row").collect()] == ["一", "二"] and delimited.first_rows(both, None).count() == 3
    typed = delimited.typed(delimited.read_csv(spark, put(tmp_path / "r.csv", "char,count\na,3.0\nb,\n")), schemas.RARE_CHARS)
    assert [tuple(r) for r in typed.collect()] == [("a", 3, None), ("b", None, None)]
    with pytest.raises(Exception, match="MALFORMED"):
        delimited.read_csv(spark, put(tmp_path / "bad.csv", "a,b\n1,2,3\n")).collect()
    assert delimited.row_count(spark, str(tmp_path / "none.csv")) is None and delimited.row_count(spark, t) == 3
    got = delimited.samples(delimited.read_csv(spark, p), "/root", "char", "path", "real").collect()
    assert [tuple(r) for r in got] == [("一", "/root/x.png", "real")]


def test_written_tables_read_back(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5), ("c", 1, 1.0)], "char string, count int, x double")
    p = str(tmp_path / "out.csv")
    assert sinks.write_counts(df, p, ["char", "count", "absent", "x"]) == 3
    raw = (tmp_path / "out.csv").read_bytes()
    assert raw == b"\xef\xbb\xbfchar,count,absent,x\r\na,1,,0.5\r\nc,1,,1.0\r\nb,2,,\r\n"
    assert [r.char for r in delimited.read_csv(spark, p).orderBy("_row").collect()] == ["a", "c", "b"]
    with pytest.raises(ValueError):
        sinks.write_table(df, p, ["char"], strict=True)
    sinks.write_json(spark, str(tmp_path / "s.json"), sinks.summary_row(df.agg(F.count("*").alias("n"), F.collect_set("char").alias("l"))))
    assert json.loads((tmp_path / "s.json").read_text())["n"] == 3
    assert delimited.read_json(spark, str(tmp_path / "s.json")).first().n == 3
    sinks.write_wide(df, str(tmp_path / "wide"), ["char"])
    assert spark.read.parquet(str(tmp_path / "wide")).count() == 3


def test_images_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    shapes = {"gray": (9, 7), "colour": (9, 7, 3), "alpha": (9, 7, 4)}
    made = {n: rng.integers(0, 256, s).astype(np.uint8) for n, s in shapes.items()}
    for n, x in made.items():
        put(tmp_path / f"img/{n}.png", sinks.png(x))
    put(tmp_path / "img/broken.png", b"no image")
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in images.read_images(spark, str(tmp_path / "img")).collect()}
    assert got["broken"].height == -1 and images.readable(images.read_images(spark, str(tmp_path / "img"))).count() == 3
    for n in ("gray", "colour"):
        x = images.pixels(got[n].data, got[n].height, got[n].width, got[n].channels)
        assert (x == (made[n] if n == "colour" else np.repeat(made[n][..., None], 3, 2))).all()
    assert sinks.cutout(made["colour"], made["gray"]).shape == (9, 7, 4)
    out = images.measured(images.read_images(spark, str(tmp_path / "img"))).collect()
    assert {r.path.rsplit("/", 1)[1]: r.readable for r in out}["broken.png"] is False and sum(r.readable for r in out) == 3


def test_annotations(spark, tmp_path):
    good = "<annotation><filename>1.bmp</filename><OBJECT><bndbox><xmin>1</xmin><ymin> 2 </ymin><xmax>5</xmax><ymax>9</ymax></bndbox><bndbox><xmin>1.5</xmin><ymin>2</ymin><xmax>5</xmax><ymax>9</ymax></bndbox><BNDBOX><xmin>7</xmin><ymin>2</ymin><xmax>5</xmax><ymax>9</ymax></BNDBOX></OBJECT>"
    put(tmp_path / "x/label/1.xml", good)
    put(tmp_path / "x/label/2.xml", "<filename>竹简.png</filename>".encode("gb18030"))
    put(tmp_path / "x/label/3.xml", b"\xff\xfe<filename>z.png</filename>\x81")
    for n in ("1.png", "2.jpg", "竹简.png"):
        put(tmp_path / f"x/img/{n}", b"")
    put(tmp_path / "x/label/deeper/4.xml", good)
    with pytest.raises(FileNotFoundError):
        annotations.read_annotations(spark, str(tmp_path / "x/img"))
    found = annotations.read_annotations(spark, str(tmp_path / "x"))
    rows = {r.path[-5:]: r for r in found.collect()}
    assert [tuple(b) for b in rows["1.xml"].boxes] == [(1, 2, 5, 9)] and rows["2.xml"].filename == "竹简.png" and rows["3.xml"].filename == "z.png"
    assert annotations.read_annotations(spark, str(tmp_path / "x"), 1).count() == 1
    matched = {r.path[-5:]: r.image.rsplit("/", 1)[1] for r in annotations.with_image(found, spark.createDataFrame([(str(r.path).rsplit("/", 2)[0] + "/img/" + n,) for r in [rows["1.xml"]] for n in ("1.png", "2.jpg", "竹简.png")], "path string")).collect()}
    assert matched == {"1.xml": "1.png", "2.xml": "竹简.png"}


def test_listings(spark, tmp_path):
    for n in ("src1/page/patches/a.png", "src2/page/patches/b.png", "src2/loose.png"):
        put(tmp_path / f"lib/{n}", b"x")
    got = listing.patches(spark, str(tmp_path / "lib")).collect()
    assert sorted(r.source for r in got) == ["src1", "src2"]
    put(tmp_path / "other/q/only.png", b"x")
    assert listing.patches(spark, str(tmp_path / "other")).first().source == "q"
    for m in ("preenhance_usm", "simple_fusion", "difficult_gamma"):
        put(tmp_path / f"exp/augment/{m}/generated_samples.csv", "path\n")
    found = listing.manifests(spark, str(tmp_path / "exp"), [str(tmp_path / "exp/augment/preenhance_usm/generated_samples.csv"), "/none.csv"])
    assert len(found) == 3 and "preenhance_usm" in found[0]
    order = listing.methods(spark.createDataFrame([(m,) for m in found], "path string"), "path").orderBy("place").collect()
    assert [r.method for r in order] == ["simple_fusion", "gamma", "usm"]
    assert listing.distinct_paths(spark.createDataFrame([("A/b", 1), ("a/B", 0)], "p string, o int"), "p", "o").first().p == "a/B"
    assert listing.parsed_sources(["x=dir", "k"], {"k": "known"}) == {"x": "dir", "k": "known"} and listing.parsed_sources([], {"k": "v"}) == {"k": "v"}
    with pytest.raises(ValueError):
        listing.parsed_sources(["nope"], {})
    with pytest.raises(ValueError):
        listing.first_option(None, message="one is needed")


def test_exports_and_archives(spark, tmp_path):
    put(tmp_path / "in/a.txt", "one")
    put(tmp_path / "in/sub/b.txt", "two")
    rows = spark.createDataFrame([(f"file:{tmp_path}/in/a.txt", "g/1.txt"), (f"file:{tmp_path}/in/none.txt", "g/2.txt")], "path string, target string")
    told = sinks.copied(rows, listing.files(spark, str(tmp_path / "in")), "path", str(tmp_path / "out"), "target").collect()
    assert sorted((r.target, r.copied) for r in told) == [("g/1.txt", True), ("g/2.txt", False)] and (tmp_path / "out/g/1.txt").read_text() == "one"
    texts = sinks.group_texts(spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "a")], "k string, v string"), "k", ["v"])
    assert sinks.export_files(texts.withColumn("p", F.concat("k", F.lit("/label.txt"))), str(tmp_path / "out"), "p", "text") == 1 and (tmp_path / "out/g/label.txt").read_text() == "a\nb"
    assert sinks.package(spark, [str(tmp_path / "in")], str(tmp_path / "all.zip")) == 2
    with zipfile.ZipFile(io.BytesIO((tmp_path / "all.zip").read_bytes())) as z:
        assert sorted(z.namelist()) == ["in/a.txt", "in/sub/b.txt"] and z.read("in/sub/b.txt") == b"two"
    with pytest.raises(Exception):
        listing.files(spark, str(tmp_path / "missing")).collect()
    assert tuple(sinks.kept_by_manifest(spark.createDataFrame([("m", True), ("m", False)], "m string, ok boolean"), "m", "ok").first()) == ("m", 2, 1)


def test_executors_write_many_files(spark, tmp_path, monkeypatch):
    def through_driver(*_):
        raise AssertionError("a file went through the driver")

    monkeypatch.setattr(sinks, "_put", through_driver)
    rows = spark.range(500).select(F.concat(F.col("id") % 7, F.lit("/"), "id", F.lit(".txt")).alias("p"), F.col("id").cast("string").alias("t"))
    assert sinks.export_files(rows, str(tmp_path / "many"), "p", "t") == 500
    assert sorted(int(f.read_text()) for f in (tmp_path / "many").rglob("*") if f.is_file()) == list(range(500))
    from quillspark.plans import files

    monkeypatch.setattr(files, "FOLDER_FILES", 150)
    data = [(k, [((k * 31 + i) % 64) / 32 - 1 for i in range(64 if k % 10 else 63)], None if k == 1 else k % 3) for k in range(400)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = files.image_round_trip(spark, str(tmp_path)).collect()
    assert sorted(r.vec_id for r in got) == [k for k in range(400) if k % 10] and {tuple(r)[1:] for r in got} == {(48, 48, 3, True)}


def test_an_export_that_executors_cannot_reach_is_streamed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "_reach", lambda *_: False)
    rows = spark.createDataFrame([("a/1", b"x", 1), ("2", b"", 2)], "p string, c binary, k int")
    assert sorted(map(tuple, sinks.exported(rows, str(tmp_path), "p", "c").collect())) == [("2", 2), ("a/1", 1)]
    assert (tmp_path / "a/1").read_bytes() == b"x" and (tmp_path / "2").read_bytes() == b""


def test_decoded_against_the_image_source(spark, tmp_path):
    """Files of this engine, and rows of every filter."""
    import struct
    import zlib

    rng = np.random.default_rng(5)
    for name, shape in (("gray", (5, 7)), ("colour", (6, 4, 3)), ("alpha", (3, 9, 4))):
        put(tmp_path / f"{name}.png", sinks.png(rng.integers(0, 256, shape).astype(np.uint8)))
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    for kind in range(5):
        rows = b"".join(bytes([kind if i else min(kind, 4)]) + rng.integers(0, 256, 5 * 3).astype(np.uint8).tobytes() for i in range(6))
        put(tmp_path / f"filter{kind}.png", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 6, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    for r in images.read_images(spark, str(tmp_path)).collect():
        made = images.decoded((tmp_path / r.path.rsplit("/", 1)[1]).read_bytes())
        assert made == (r.height, r.width, r.channels, bytes(r.data)), r.path
    with pytest.raises(ValueError):
        images.decoded(b"no image")
    broken = bytearray((tmp_path / "gray.png").read_bytes())
    broken[45] ^= 1
    with pytest.raises(ValueError):
        images.decoded(bytes(broken))
