"""From raw documents to packed training sequences: quality rules, near-duplicate join, substring dedup, source mix, packing.

Each stage takes all that its predecessor kept, as Parquet, and its decisions take effect in what it returns.  All stages but
the last return the columns of ``documents``.

Cases, for every stage: other columns stay, whatever their names; a null in them is kept; a very long text is read whole; the result does not
depend on the order of rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillspark import scratch
from quillspark.llm import mixing, packing, paragraphs, quality, setjoin
from quillspark.llm.common import table, written
from quillspark.llm.queries import byte_bpe


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables of the stage before; its result has been written and read again when the next one begins.
_before: list = []


def stage(f: Stage) -> Stage:
    """A stage that first removes what the stage before has left in the shared folder and in the driver's memory."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.drop(_before)
        scratch.give_back(spark)
        begin = scratch.mark()
        with scratch.small_pieces(spark):
            out = f(spark, docs, sf_dir)
        _before[:] = scratch.since(begin)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside of their language and source go.

    A null, empty or wordless text fails; a null language or source is one like others; rows alike get the same verdict; what lies at
    the limit stays.
    """
    return quality.keep_good(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id (null last, then by the text's hash).

    Texts without words are no copies of any; of rows alike one stays.
    """
    return setjoin.keep_one(docs)


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that were there before go from the texts; the first stays, by document id (null first), text hash and place.

    A text that loses every word goes with its document; one that had none stays; rows alike in id and text are one document.
    """
    return paragraphs.strip(docs)


@stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their source's target asks for, three times at most.

    A null source is a source; texts without words weigh nothing and are taken like others of their source; rows alike share their copies.
    """
    return mixing.mix(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids, packed into sequences.  Nothing follows, so its own table stays until the driver ends.

    A null or empty text is the end id alone; repeated rows are packed each; ties go by document id.
    """
    scratch.drop(_before)
    scratch.give_back(spark)
    _before.clear()
    return packing.pack(docs, byte_bpe())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("source_mix", source_mix),
    ("packing", sequence_packing),
]

#: Several stages (verified joins, components, packing) are not for SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = written(f(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
