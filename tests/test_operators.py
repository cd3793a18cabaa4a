import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import boxes, scoring, text
from quillspark.operators import generation, metrics, quality, ranking, routing, splits, stages


def values(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*(c.alias(n) for n, c in cols.items())).collect()


def test_split_sizes_follow_the_rule(spark):
    def rule(n, vr, tr):
        if n <= 1:
            return 0, 0
        if n == 2:
            return 1, 0
        v, t = (max(1, round(n * r)) if r > 0 else 0 for r in (vr, tr))
        while v + t >= n:
            if t >= v and t > 0:
                t -= 1
            else:
                v -= 1
        return v, t

    rows = spark.range(1, 201)
    for vr, tr in ((0.15, 0.15), (0.5, 0.5), (0.0, 0.3), (0.9, 0.9), (0.25, 0.0)):
        v, t = splits.split_sizes(F.col("id"), vr, tr)
        for n, a, b in rows.select("id", v, t).collect():
            assert (a, b) == rule(n, vr, tr), (n, vr, tr)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=6), min_size=1, max_size=20))
def test_code_labels(spark, words):
    rows = [(i, w.replace("\x00", "")) for i, w in enumerate(words) if not any(0xD800 <= ord(c) < 0xE000 for c in w)]
    if rows:
        for r in spark.createDataFrame(rows, "i int, w string").select("w", text.code_label(F.col("w")).alias("c")).collect():
            assert r.c == ("_".join(f"U{ord(c):04X}" for c in r.w) or "unknown")


def test_text_functions(spark):
    rows = [(" a　", "3.7", "TRUE", "x/y/z.tar.gz"), ("", "", "no", "label.tsv"), (None, "abc", None, "a/b"), ("　a:b. ", "-2.9", " yes ", "r/s/t/u")]
    got = values(spark, rows, "a string, b string, c string, d string", s=text.strip(F.col("a")), n=text.whole(F.col("b")), l=text.lenient_double(F.col("b")), t=text.truth(F.col("c")), f=text.not_false(F.col("c")), st=text.stem(F.col("d")), sx=text.suffix(F.col("d"), ".png"), src=text.source_of_label_file(F.col("d")), fl=text.file_label(F.col("a")), cn=text.clean_name(F.col("a"), "none"))
    assert [r.s for r in got] == ["a", "", "", "a:b."] and [r.n for r in got] == [3, 0, 0, -2] and [r.l for r in got] == [3.7, 0.0, 0.0, -2.9]
    assert [r.t for r in got] == [True, False, False, True] and [r.f for r in got] == [True] * 4
    assert [r.st for r in got] == ["z.tar", "label", "b", "u"] and [r.sx for r in got] == [".gz", ".tsv", ".png", ".png"]
    assert [r.src for r in got] == ["x", "label", "a", "s"]
    assert [r.fl for r in got][0] == "a" and got[1].fl == "unknown" and got[3].fl.startswith("U") and got[3].cn == "a_b"
    assert values(spark, [("x\\y//./z/",)], "p string", p=text.normal_path(F.col("p")))[0].p == "x/y/z"
    assert values(spark, [("4",), ("",), (None,)], "p string", p=text.strict_double(F.col("p"))) == [(4.0,), (0.0,), (0.0,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, [("x",)], "p string", p=text.strict_double(F.col("p")))
    assert values(spark, [(" a, ,b ,",)], "p string", p=text.words_of(F.col("p")))[0].p == ["a", "b"]


def test_scores(spark):
    cols = "entropy double, contrast_std double, laplacian_var double, edge_density double, dark_ratio double, white_ratio double, alpha_ratio double, darkness_mean double, bbox_fill_ratio double, bbox_area_ratio double, component_count int, psnr double, ssim double, foreground_psnr double, foreground_ssim double, entropy_delta double"
    good = (8.0, 64.0, 1200.0, 0.1, 0.0, 0.0, 0.1, 0.12, 0.1, 0.1, 2, 32.0, 0.98, 0.0, 0.0, 0.15)
    bad = (3.0, 1.0, 0.0, 0.9, 0.9, 0.95, 0.9, 0.0, 0.9, 0.5, 0, None, None, None, None, 2.0)
    kind = F.lit("generated")
    rows = spark.createDataFrame([good, bad], cols).withColumn("no_ref_score", scoring.no_reference_score())
    got = rows.select("no_ref_score", scoring.final_score(kind).alias("f"), scoring.reasons(kind).alias("r"), scoring.glyph_gate().alias("g")).collect()
    assert got[0].no_ref_score == pytest.approx(1.0) and got[0].f == pytest.approx(1.0) and got[0].r == [] and got[0].g
    assert got[1].r == ["bad_alpha_area", "filled_rectangle_mask", "low_contrast", "blurred", "weak_ink", "too_dark", "too_white", "entropy_shift_too_large"] and not got[1].g
    assert got[1].f == got[1].no_ref_score < 0.1
    empty = F.array().cast("array<string>")
    assert spark.range(1).select(scoring.reason_text(empty, F.lit(False)), scoring.reason_text(empty)).first() == ("bad_source_image", "")
    assert spark.range(1).select(scoring.ramp(F.lit(5.0), 3, 3), scoring.nearness(F.lit(1.0), 1.0, 0.0)).first() == (0.0, 1.0)


def test_boxes(spark):
    one = spark.range(1)
    box = lambda *v: boxes.box(*v)
    got = one.select(
        boxes.covered_area(F.array(box(0, 0, 4, 4), box(2, 2, 6, 6), box(0, 0, 1, 9))).alias("a"), boxes.covered_area(F.array().cast(f"array<{boxes.BOX}>")).alias("e"),
        boxes.inset(F.lit(96), F.lit(10)).alias("i"), boxes.around(F.struct(F.lit(1).alias("x"), F.lit(1).alias("y")), F.lit(20), F.lit(30)).alias("p"), boxes.prompt(box(50, 50, 60, 60), F.lit(20), F.lit(20)).alias("q"),
        boxes.parse_box(F.lit("1,2,3,4")).alias("b"), boxes.parse_box(F.lit("1,2,1,4")).alias("n"), boxes.parse_point(F.lit("1,2,3")).alias("pt"),
    ).first()
    assert got.a == 16 + 16 - 4 + 5 and got.e == 0 and tuple(got.i) == (3, 1, 93, 9) and tuple(got.p) == (0, 0, 9, 9) and tuple(got.q) == (19, 19, 20, 20) and tuple(got.b) == (1, 2, 3, 4) and got.n is None and got.pt is None


def test_routing_prefers_exclusion_to_missing(spark):
    rows = spark.createDataFrame([(1, "□"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "k int, char string")
    got = {r.k: r.route for r in routing.routed(rows, "char", spark.createDataFrame([(2,), (4,), (4,), (5,)], "k int"), "k", ["b"]).collect()}
    assert got == {1: "excluded", 2: "kept", 3: "missing", 4: "excluded", 5: "kept"}
    with pytest.raises(ValueError):
        routing.chosen(rows, "char", want_ok=True, want_failed=True, ok=F.lit(True))


def test_verdict_joins_differ_for_unscored_sources(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "s string")
    verdicts = spark.createDataFrame([("a", True), ("b", False)], "s string, ok boolean")
    assert {r.s: r.source_quality_ok for r in quality.source_verdict(rows, verdicts, "s", "ok").collect()} == {"a": True, "b": False, "c": True}
    assert [r.s for r in quality.only_good(rows, verdicts, "s", "ok").collect()] == ["a"]


def test_hard_classes(spark):
    m = spark.createDataFrame([("a", 5, 1, 0.2, 3), ("b", 9, 2, 0.2, 3), ("c", 4, 4, 1.0, 3), ("d", 4, 0, 0.0, 50), ("e", 0, 0, 0.0, 1)], "char string, support int, correct int, accuracy double, train_count int")
    assert [r.char for r in metrics.hard_classes(m, "char", 20, 0.5, 3).collect()] == ["b", "a", "c"]
    assert {r.char for r in metrics.hard_classes(m, "char", 20, 0.5).collect()} == {"a", "b"}
    better = m.withColumn("accuracy", F.when(F.col("char") == "a", 0.1).otherwise(F.col("accuracy")))
    got = metrics.hard_by_gain(m, better, "char", 20, 0.3).collect()
    assert {r.char: r.reason for r in got} == {"a": "worse_after_simple_fusion+low_simple_fusion_accuracy+no_clear_simple_fusion_gain", "b": "low_simple_fusion_accuracy+no_clear_simple_fusion_gain"}
    none = metrics.subset(m, m.where("false"), "char").first()
    assert tuple(none) == (0, 0, 0.0, 0.0)


def test_slots_turns_and_rejection(spark):
    wanted = generation.slots(spark.createDataFrame([("x", 3), ("y", 9)], "char string, count long"), "char", "count", 8)
    assert wanted.count() == 5
    grounds = spark.createDataFrame([("s1", "p"), ("s1", "q"), ("s2", "r")], "source string, path string")
    got = generation.round_robin(wanted, grounds, "source", "path", "char").orderBy("slot").collect()
    assert [r.source for r in got] == ["s1", "s2", "s1", "s2", "s1"]
    turns = generation.round_robin(wanted, grounds, "source", "path", "char", order=["s2", "none", "s1"]).orderBy("slot").collect()
    assert [r.source for r in turns] == ["s2", "s1", "s2", "s1", "s2"]
    assert {r.source for r in generation.round_robin(wanted, grounds, "source", "path", "char", order=["none"]).collect()} == {"s1", "s2"}
    assert {r.source for r in generation.round_robin(wanted, grounds, "source", "path", "char", order=["s2"]).collect()} == {"s2"}
    drawn = generation.at_random(wanted, grounds, "path", "char").collect()
    assert len(drawn) == 5 and {(r.source, r.path) for r in drawn} <= {("s1", "p"), ("s1", "q"), ("s2", "r")}
    tried = generation.attempts(wanted, spark.createDataFrame([("x", "i1", True), ("x", "i2", False)], "char string, path string, good boolean"), "char", "path", 20)
    made = generation.accepted(tried, "char", F.col("good"))
    assert tried.count() == 100 and [r.slot for r in made.orderBy("slot").collect()] == list(range(5)) and {r.path for r in made.collect()} == {"i1"}


def test_numbered_is_a_total_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    got = ranking.numbered(rows, [F.col("k").desc()]).collect()
    assert all(r.group_no == 4999 - r.k for r in got) and len(got) == 5000


def test_stage_tables(spark):
    one = lambda a: spark.createDataFrame([(a,)], "accuracy double")
    t = stages.stage_table({"baseline": one(0.5), "simple_fusion": one(0.75)})
    assert {r.stage: r.accuracy_delta for r in stages.against(t, "simple_fusion").collect()} == {"baseline": -0.25, "simple_fusion": 0.0}
    assert {r.stage: r.accuracy_delta for r in stages.against(t, "absent").collect()} == {"baseline": 0.5, "simple_fusion": 0.75}
