"""First-fit decreasing into sequences of fixed length, in randomised groups of documents.

A document's ids (its text's, then one end id) are cut every ``capacity`` ids; full pieces are sequences of their own, and the
rests of a group's documents are packed by decreasing length, each into the first sequence with room, found in a
tournament tree of the sequences' free room.  Groups are drawn by a hash over rows, have a fixed expected size, and are packed
apart from each other, so that no key and no run of copies makes one of them large.

Cases: a null or empty text is the end id alone; a null document id stays null; repeated rows are packed each; ties in length go by doc_id, then by
checksum; an empty table gives no piece.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import written
from quillspark.llm.tokens import encoder, frequent_table

CAPACITY = 2048
END_ID = 1
#: Documents of a group, as expected.
GROUP_DOCS = 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Free room of up to ``n`` bins; the first bin with enough room in a logarithm of steps."""

    def __init__(self, n: int, capacity: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts an item into the first bin with room for it: the bin, and the room it had."""
        room, at = self.room, 1
        if room[1] < size:
            raise ValueError("an item is larger than a bin")
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had = room[at]
        room[at] -= size
        k = at >> 1
        while k:
            best = max(room[2 * k], room[2 * k + 1])
            if room[k] == best:
                break
            room[k] = best
            k >>= 1
        return at - self.leaves, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each item of ``sizes``; the items come in the order in which equal ones are taken."""
    tree = TournamentTree(len(sizes), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        place, had = tree.place(sizes[i])
        out[i] = place, capacity - had
    return out


def _pack_group(capacity: int):
    def pack(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["doc_id", "doc_tokens", "first_crc"], kind="stable", na_position="first")
        rests, rows, full = [], [], 0
        for doc, tokens, crcs in zip(docs["doc_id"], docs["doc_tokens"], docs["crcs"], strict=True):
            for k, crc in enumerate(crcs):
                length = min(capacity, tokens - k * capacity)
                rows.append([doc, k * capacity, length, crc, tokens, full, 0])
                if length < capacity:
                    rests.append(rows[-1])
                else:
                    full += 1
        for row, (place, offset) in zip(rests, first_fit_decreasing([r[2] for r in rests], capacity), strict=True):
            row[5:] = full + place, offset
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        out["sequence_id"] += int(key[0]) << 32
        return out

    return pack


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, doc_tokens and the checksum of each piece of ``capacity`` ids of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, True))  # FREQUENT entries at most
    end = int(end_id).to_bytes(4, "little")

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType()))]))
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, True, shared.value)
        for batch in batches:
            n, crcs = [], []
            for text in batch:
                ids = memoryview(encode(text) + end)
                n.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[k : k + 4 * capacity]) for k in range(0, len(ids), 4 * capacity)])
            yield pd.DataFrame({"n": n, "crcs": crcs})
        encode.rest()

    return docs.select("doc_id", cut(F.col("text")).alias("t")).select("doc_id", F.col("t.n").alias("doc_tokens"), F.col("t.crcs").alias("crcs"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, group_docs: int = GROUP_DOCS, seed: int = 0) -> DataFrame:
    """The pieces of all documents with their places; ids are cut, never copied, and each lies in one piece."""
    cut = written(tokenised(docs, path, capacity, end_id), "tokenised")
    groups = max(1, math.ceil(cut.count() / group_docs))
    # The written table's rows have fixed places, so the draw is the same again when a task is run again.
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), "doc_id"), F.lit(groups)).cast("int")
    grouped = cut.select(F.col("doc_id").cast("string").alias("doc_id"), "doc_tokens", "crcs", F.get("crcs", F.lit(0)).alias("first_crc"), drawn.alias("group_no"))
    # Ids travel as text, as a null among them would make pandas round the others.
    packed = grouped.groupBy("group_no").applyInPandas(_pack_group(capacity), PIECES.replace("doc_id long", "doc_id string"))
    return packed.withColumn("doc_id", F.col("doc_id").cast("long"))
