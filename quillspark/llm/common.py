"""What the corpus operators share: reading tables, written intermediate tables, bounded semi-join filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.scratch import mark, scratch, settled, shared_dir, written

__all__ = ["BLANKS", "FILTER_WORDS", "WORD", "likely_in", "mark", "partitions", "scratch", "settled", "shared_dir", "table", "told_apart", "written"]

#: The characters between words, as SQL writes them in btrim and in patterns.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that a semi-join filter broadcasts at most, each with 64 slots.
FILTER_WORDS = 1 << 18
_TAKEN = "_word = _of and (shiftright(_mask, _bit) & 1L) = 1L"


def _slots(df: DataFrame, key: list[str]) -> DataFrame:
    slot = F.xxhash64(*key)
    return df.withColumns({"_word": F.pmod(slot, F.lit(FILTER_WORDS)).cast("int"), "_bit": F.shiftrightunsigned(slot, 58).cast("int")})


def _taken(ids: DataFrame, key: list[str]) -> DataFrame:
    """The slots that keys take, as bits of words; a key is hashed by its columns, of which a null adds nothing."""
    return F.broadcast(_slots(ids, key).groupBy(F.col("_word").alias("_of")).agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask")))


def likely_in(df: DataFrame, key: list[str], ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among those of ``ids``: it drops most others before a shuffle and never a wanted one.

    What is broadcast are the taken ones of a fixed number of hash slots, as FILTER_WORDS words of 64 bits at most.
    """
    return _slots(df, key).join(_taken(ids, key), F.expr(_TAKEN), "left_semi").drop("_word", "_bit")


def told_apart(df: DataFrame, key: list[str], ids: DataFrame) -> DataFrame:
    """``df`` with a column _in, which is null where ``likely_in`` would drop the row."""
    return _slots(df, key).join(_taken(ids, key), F.expr(_TAKEN), "left").withColumn("_in", F.when(F.col("_of").isNotNull(), True)).drop("_word", "_bit", "_of", "_mask")
