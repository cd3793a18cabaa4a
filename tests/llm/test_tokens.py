import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import types as T

from quillspark.llm import packing, queries, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries.byte_bpe())
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def test_every_common_character_in_context(library):
    encode = tokens.Encoder(queries.byte_bpe(), True)
    texts = [f"a{chr(c)} {chr(c)}b {chr(c)}{chr(c)}1 \n{chr(c)}'s  {chr(c)} 9" for c in [*range(0x460), *range(0x1FF0, 0x2130), 0x3000, 0x4E00, 0xFEFF, 0x1F600, 0x20000]]
    for t in texts:
        assert encode(t) == struct.pack(f"<{len(library(t))}I", *library(t)), ascii(t)


def test_special_strings_and_cache_overflow(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    count = tokens.Encoder(queries.byte_bpe(), False, {" the": 1, " of": 1})
    for t in ["x<|endoftext|>y", "a <|endoftext|><|endoftext|> b  <|endoftext|>", "語 <|endoftext|> 語\n ", "<|endoftext|>", "it's  we'll \n\n ok", " ".join(f"w{i}" for i in range(200)), *(f"k{i} the" for i in range(120))]:
        assert count(t) == len(library(t))
    assert count(None) == count("") == 0


def test_texts_of_all_scripts_go_through_the_table_and_the_cache(library):
    texts = ["Привет, мир! 123 語 ２３ ½", "مرحبا بالعالم  \n x", "こんにちは 世界。 don't", "नमस्ते दुनिया", "😀👍🏽 a\u200db", "\u3000 x\u2028y \u00a0z"]
    encode = tokens.Encoder(queries.byte_bpe(), True)
    encode.whole = None  # no text goes to the library whole
    for t in texts + ["".join(texts)] * 2:
        assert encode(t) == struct.pack(f"<{len(library(t))}I", *library(t))
    assert " мир" in encode.cache
    # What the table says is what counts.
    assert tokens.Encoder(queries.byte_bpe(), False, {" мир": 100})(" мир") == 100
    long = tokens.Encoder(queries.byte_bpe(), False)
    assert long("x" * 5000) == len(library("x" * 5000)) and not any(len(w) > tokens.CACHE_CHARS for w in long.cache)


def test_the_table_holds_lengths(spark, library):
    table = tokens.frequent_table(spark.read.parquet(f"{SF}/documents.parquet"), queries.byte_bpe(), False)
    assert 1000 < len(table) <= tokens.FREQUENT and all(n == len(library(w)) for w, n in list(table.items())[:2000])


def test_sentencepiece_model():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert tokens.Encoder(path, False)("Hello  world é") == len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello  world é"))


def test_counts_match_the_library(spark, library):
    got = queries.op2_token_counts(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    assert len(got) == len(docs)
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        assert got.loc[doc].tolist() == [len(text.encode()), n := len(library(text)), n > 512]


def test_counts_of_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "a b", None), (3, "word " * 30000, "z")]
    out = tokens.token_report(spark.createDataFrame(rows, SCHEMA), queries.byte_bpe()).toPandas()
    assert sorted(out["n_tokens"]) == [0, 0, 0, 2, 30001]
    assert tokens.token_report(spark.createDataFrame([], SCHEMA), queries.byte_bpe()).count() == 0


def check_pieces(got: pd.DataFrame, docs: pd.DataFrame, library, capacity: int = 2048) -> None:
    for doc, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array([*library(text), 1], "<u4")
        at = 0
        for row in got[got["doc_id"] == doc].sort_values("start").itertuples():
            assert row.start == at and row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(ids[at : at + row.length].tobytes())
            at += row.length
        assert at == len(ids)
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert (rows["offset"].to_numpy() == np.cumsum([0, *rows["length"]])[:-1]).all() and rows["length"].sum() <= capacity


def test_pieces_round_trip(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = queries.op8_packing(spark, SF).toPandas()
    check_pieces(got, docs, library)
    used = got.groupby("sequence_id")["length"].sum()
    assert used.sum() / (2048 * len(used)) > 0.95


def test_pieces_of_odd_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (4, "word " * 9000, "z"), (5, "a " * 2047, "q")]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), queries.byte_bpe()).toPandas()
    check_pieces(got, pd.DataFrame(rows, columns=["doc_id", "text", "n_tokens"]), library)
    twice = packing.pack(spark.createDataFrame([(7, "same", "x")] * 3, SCHEMA), queries.byte_bpe()).toPandas()
    big = 2**60 + 1
    ids = packing.pack(spark.createDataFrame([(None, "x", "x"), (big, "y", "x")], SCHEMA), queries.byte_bpe()).collect()
    assert {r.doc_id for r in ids} == {None, big}
    assert len(twice) == 3 and twice[["sequence_id", "offset"]].drop_duplicates().shape[0] == 3
    assert packing.pack(spark.createDataFrame([], SCHEMA), queries.byte_bpe()).count() == 0


def test_first_fit_decreasing_against_brute_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 100):
        sizes = rng.integers(1, 65, n).tolist()
        bins: list[int] = []
        want = {}
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            k = next((k for k, used in enumerate(bins) if used + sizes[i] <= 64), len(bins))
            bins += [0] * (k == len(bins))
            want[i] = (k, bins[k])
            bins[k] += sizes[i]
        assert packing.first_fit_decreasing(sizes, 64) == [want[i] for i in range(n)]
    assert packing.first_fit_decreasing([], 64) == []
