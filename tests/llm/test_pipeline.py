import re

import pandas as pd
from pyspark.sql import types as T

import corpus_pipeline
from quillspark.llm import mixing, queries
from tests.llm.test_paragraphs import brute as stretches
from tests.llm.test_quality_mixing import brute as quality
from tests.llm.test_quality_mixing import water
from tests.llm.test_setjoin import brute as near
from tests.llm.test_tokens import check_pieces

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df) -> pd.DataFrame:
    return df.toPandas().sort_values(["doc_id", "text"]).reset_index(drop=True)


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [rows_of(docs)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(rows_of(docs) if name != "packing" else docs.toPandas())
    raw, good, apart, stripped, mixed, packed = steps

    want = quality({r.doc_id: (r.text, r.lang, r.source) for r in raw.itertuples()})
    assert good["doc_id"].tolist() == [d for d in raw["doc_id"] if want[d]["kept"]]

    component = {d: c for d, _, c in near([(r.doc_id, r.text) for r in good.itertuples()])}
    assert apart["doc_id"].tolist() == sorted(set(component.values()))

    gone, texts, words = stretches([(r.doc_id, r.text) for r in apart.itertuples()]), {}, lambda t: WORD.findall(t)
    for r in apart.itertuples():
        left = [w for k, w in enumerate(words(r.text)) if not any(x <= k < y for x, y, _ in gone.get(r.doc_id, ()))]
        if r.doc_id not in gone or left:
            texts[r.doc_id] = left
    have = dict(zip(stripped["doc_id"], stripped["text"], strict=True))
    assert have.keys() == texts.keys() and sum(words(have[d]) != texts[d] for d in texts) <= 0.005 * len(texts)
    assert all(have[r.doc_id] == r.text for r in apart.itertuples() if r.doc_id not in gone)
    assert (stripped["n_chars"] == stripped["text"].str.len()).all()

    sizes = stripped.assign(size=stripped["text"].map(lambda t: len(WORD.findall(t)))).groupby("source")["size"].sum().sort_index()
    targets = water(sizes.tolist(), [k % 3 + 1 for k in range(len(sizes))])
    taken = mixed.assign(size=mixed["text"].map(lambda t: len(WORD.findall(t)))).groupby("source")["size"].sum()
    largest = stripped["text"].map(lambda t: len(WORD.findall(t))).groupby(stripped["source"]).max()
    for s, t in zip(sizes.index, targets, strict=True):
        assert abs(taken[s] - t) <= largest[s] + 0.1 * t
    assert mixed.groupby("doc_id").size().max() <= mixing.MOST

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.byte_bpe())
    once = mixed.groupby("doc_id").filter(lambda g: len(g) == 1)
    check_pieces(packed[packed["doc_id"].isin(once["doc_id"])].assign(sequence_id=range(int(packed["doc_id"].isin(once["doc_id"]).sum())), offset=0), once, lambda t: model.encode(t, add_special_tokens=False).ids)
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum()][:-1] and part["length"].sum() <= 2048
    assert packed.groupby("doc_id")["length"].sum().to_dict() == {d: sum(len(model.encode(t, add_special_tokens=False).ids) + 1 for t in g["text"]) for d, g in mixed.groupby("doc_id")}


def test_run_is_registered(spark):
    import __spark_entry__

    out = __spark_entry__.queries()["pipeline"](spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and "sequence_id" in out.columns


ODD = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("id", T.StringType()), ("gone", T.StringType()), ("_row", T.LongType()))])


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, columns with the stages' own names, and an empty table."""
    plain = lambda k, n: " ".join(f"{0x100000 + k * 0x10000 + i:x}" for i in range(n))
    rows = [(k, plain(k, 60 + k), "en", "s", 1, "a", "b", 7) for k in range(20)]
    rows += [(3, plain(3, 63), "en", "s", 1, "a", "b", 7)] * 2 + [(None, plain(40, 80), None, None, None, None, None, None), (41, None, "en", "s", 1, "a", "b", 7), (42, "", None, "s", 0, "", "", 0), (43, " \n\t", "en", None, 3, "a", "b", 7), (44, plain(44, 40000), "en", "s", 1, "a", "b", 7)]
    docs, some = spark.createDataFrame(rows, ODD), {}
    for table, path in ((docs, "odd"), (spark.createDataFrame([], ODD), "none")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert name == "packing" or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{path}-{name}")
            table = spark.read.parquet(f"{tmp_path}/{path}-{name}")
            some[path, name] = table.count()
    assert not any(n for (path, _), n in some.items() if path == "none")
    # Wordless texts fail the base rules; of the three rows alike one stays; nothing else is alike.
    assert some["odd", "quality_rules"] == 24 and some["odd", "near_duplicates"] == some["odd", "substring_dedup"] == 22
    left = spark.read.parquet(f"{tmp_path}/odd-substring_dedup").collect()
    assert {r.doc_id for r in left} == {*range(20), None, 44} and all(r.text in {x[1] for x in rows} for r in left)
