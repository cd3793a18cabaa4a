import numpy as np
import pytest

from quillspark.__main__ import main
from quillspark.plans.pipelines import METHODS, SOURCES
from quillspark.sources.delimited import read_csv
from quillspark.sources.sinks import png
from tests.test_pipelines import ground, stroke


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Three classes of six images from four sources, two backgrounds a source, a page with a box."""
    at = tmp_path_factory.mktemp("data")
    for s, source in enumerate(SOURCES):
        lines = ["path\tchar\tbook\tpage\tindex"]
        for i, c in enumerate("甲乙丙"):
            for k in range(6):
                if k % 4 == s:
                    (at / f"{source}/single/{c}").mkdir(parents=True, exist_ok=True)
                    (at / f"{source}/single/{c}/{k}.png").write_bytes(png(stroke(1000 * i + k, arm=i)))
                    lines.append(f"{c}/{k}.png\t{c}\tb\t1\t{k}")
        (at / f"{source}/single/label.tsv").write_text("\n".join([*lines, "none.png\t甲\tb\t1\t9", "x.png\t□\tb\t1\t9"]) + "\n")
        for k in range(2):
            (at / f"grounds/{SOURCES[source]}/page/patches").mkdir(parents=True, exist_ok=True)
            (at / f"grounds/{SOURCES[source]}/page/patches/{k}.png").write_bytes(png(ground(10 * s + k)))
    (at / "toy/img").mkdir(parents=True)
    (at / "toy/label").mkdir()
    page = np.clip(np.random.default_rng(3).normal(160, 20, (256, 256, 3)), 0, 255).astype(np.uint8)
    (at / "toy/img/1.png").write_bytes(png(page))
    (at / "toy/label/1.xml").write_text("<a><filename>1.png</filename><bndbox><xmin>80</xmin><ymin>70</ymin><xmax>165</xmax><ymax>190</ymax></bndbox></a>")
    return at


def test_from_labels_to_lineage(spark, root, tmp_path):
    run = lambda *a: main(list(map(str, a)), spark)
    labels = [x for s in SOURCES for x in ("--labels", root / s / "single/label.tsv")]
    got = run("label-index", "--data_root", root, *labels, "--out", tmp_path / "index")
    assert (got["kept"], got["excluded"], got["missing"], got["rare_classes"]) == (18, 4, 4, 3)
    clean = tmp_path / "index/clean_samples.csv"
    assert {r.source_label for r in read_csv(spark, str(clean)).collect()} == set(SOURCES)
    assert run("split", "--clean_samples", clean, "--out", tmp_path / "splits", "--target_count", 6) == {"train": 12, "val": 3, "test": 3, "rare": 3}
    got = run("generate", "--train", tmp_path / "splits/train.csv", "--rare", tmp_path / "splits/train_rare_chars.csv", "--data_root", root, "--backgrounds", root / "grounds", "--target_count", 5, "--strict_sources", "--out", tmp_path / "exp/augment/simple_fusion")
    assert got == {"generated": 3, "classes": 3}
    assert len(list((tmp_path / "exp/augment/simple_fusion/images/甲").glob("*.png"))) == 1
    assert len(list((tmp_path / "exp/augment/simple_fusion/debug").glob("*.png"))) == 6
    assert {r.method for r in read_csv(spark, str(tmp_path / "exp/augment/simple_fusion/generated_samples.csv")).collect()} == {METHODS[1]}
    got = run("score", "--clean_samples", clean, "--data_root", root, "--experiment", tmp_path / "exp", "--out", tmp_path / "quality")
    assert got["sources"] == 18 and got["generated"] == 3
    table = tmp_path / "quality/generated_image_quality.csv"
    assert run("examples", "--quality", table, "--k", 1, "--out", tmp_path / "x")["rows"] == 2
    assert run("lineage", "--quality", table, "--limit", 2, "--out", tmp_path / "l")["groups"] == 2
    assert run("package", "--root", tmp_path / "quality", "--out", tmp_path / "q.zip")["files"] >= 5


def test_difficulty(spark, root, tmp_path):
    run = lambda *a: main(list(map(str, a)), spark)
    labels = [x for s in SOURCES for x in ("--labels", root / s / "single/label.tsv")]
    run("label-index", "--data_root", root, *labels, "--out", tmp_path)
    got = run("difficulty", "--clean_samples", tmp_path / "clean_samples.csv", "--data_root", root, "--backgrounds", root / "grounds", "--method", "gamma_usm", "--target_count", 5, "--side", 16, "--top_k", 1, "--threshold", 1.0, "--strict_sources", "--seed", 7, "--out", tmp_path / "exp")
    assert set(got) == {"baseline", "simple_fusion", "difficult_gamma_usm"}
    assert {r.stage for r in read_csv(spark, str(tmp_path / "exp/experiment_summary.csv")).collect()} == set(got)


def test_backgrounds_and_masks(spark, root, tmp_path):
    run = lambda *a: main(list(map(str, a)), spark)
    assert run("page-backgrounds", "--source", f"toy={root}/toy", "--crop_method", "none", "--patches", 2, "--size", 64, "--seed", 7, "--out", tmp_path / "bg") == {"toy": 2}
    assert len(list((tmp_path / "bg/toy/1/patches").glob("*.png"))) == 2 and (tmp_path / "bg/toy/manifest.csv").exists() and (tmp_path / "bg/summary.json").exists()
    assert run("extract", "--images", root / "天回/single/甲", "--out", tmp_path / "masks")["images"] == 2
    with pytest.raises(SystemExit):
        run("no-such-command")
