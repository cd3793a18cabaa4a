"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Targets are found by water filling over the table of sources.  Within a source each document is expected target/size
times; the expected copies are summed along an order of the source's documents, one random offset is added, and a document is emitted
once for each integer boundary that its stretch crosses.  The order goes by falling bands of size, then by hash: what a boundary takes too early
or too late is then made up for by documents of nearly the same size, and the words taken stay near the target.

All expected copies of a source are equal, so a prefix sum is a rank times that number.  Ranks are counted on three levels
(bands of a source, SALTS shares of a band, rows of a share): only counts are summed along a source, in windows of at most
a few thousand rows, and a source or a run of copies of any size is spread over all tasks.

Cases: a null, empty or wordless text has size zero and adds nothing to any target; a null source is a source, last; a
source without words gets none; repeated rows are taken each; ties go by document id, then by text hash; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import BLANKS, written

MOST = 3
WEIGHTS = 3
#: Bands of size to an octave, and shares of a band.
BANDS, SALTS = 16, 256


def n_words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, source: str = "source", size: str = "size", most: int = MOST, weights: int = WEIGHTS) -> DataFrame:
    """source, source_size and target of each source, from the sizes of all documents.

    Sources weigh 1 to ``weights`` in turn.  With caps at ``most`` times a source's size, the shares are the level of water times
    the weight, or the cap where that is less: sources fill up in the order of cap over weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    of = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    of = of.withColumn("w", (F.row_number().over(by_name) - 1) % weights + 1).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    of = of.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    of = of.withColumn("weight_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    # The first source that is not filled to its cap sets the level for it and all after it.
    of = of.withColumn("level", F.col("left").cast("double") / F.col("weight_left"))
    open_ = F.col("level") * F.col("w") <= F.col("cap")
    of = of.withColumn("final", F.min(F.when(open_, F.struct((F.col("cap") / F.col("w")).alias("at"), F.col("source").isNull(), "source", "level"))).over(everything)["level"])
    share = F.least(F.coalesce(F.col("final") * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return of.select("source", "source_size", share.alias("target"))


def _offset(source: Column, seed: int) -> Column:
    """One number from 0 to 1 for each source."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def _share(key: Column, tie: Column, seed: int) -> Column:
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")), tie).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    """_key, _tie, _source, _size and, never null, _from (the source as a join key) of every document, written once."""
    tie = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    of = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    return written(docs.select(F.col("doc_id").alias("_key"), tie.alias("_tie"), F.col("source").alias("_source"), of.alias("_from"), n_words(F.col("text")).alias("_size")), "sizes")


def copies(sized: DataFrame, seed: int = 0, most: int = MOST) -> DataFrame:
    """Of the rows of ``_sized``, once for all that are alike: _n (rows alike), _copies (of all of them), source_size and target."""
    goal = targets(sized, "_source", "_size", most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = written(goal.select(F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source"))).alias("_from"), "source_size", "target", rate.alias("_rate")), "targets")
    rows = sized.groupBy("_key", "_tie", "_source", "_from", "_size").agg(F.count("*").alias("_n"))
    draw = _share(F.col("_key"), F.col("_tie"), seed)
    rows = rows.withColumn("_band", -F.floor(BANDS * F.log2(F.col("_size") + 1.0)).cast("int")).withColumn("_draw", draw).withColumn("_salt", (F.col("_draw") % SALTS).cast("int"))
    rows = written(rows, "alike")
    cell = ("_from", "_band", "_salt")
    cells = written(rows.groupBy(*cell).agg(F.sum("_n").alias("n")), "cells")
    along = Window.partitionBy("_from").orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = cells.groupBy("_from", "_band").agg(F.sum("n").alias("n"))
    bands = bands.select("_from", "_band", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("_below"))
    inside = Window.partitionBy("_from", "_band").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_up", F.coalesce(F.sum("n").over(inside), F.lit(0))).drop("n").join(bands, ["_from", "_band"])
    own = Window.partitionBy(*cell).orderBy("_draw", "_size", "_key", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_rank", F.sum("_n").over(own)).join(starts, list(cell)).join(goal, "_from")
    end, offset = F.col("_below") + F.col("_up") + F.col("_rank"), _offset(F.col("_source"), seed)
    taken = F.floor(end * F.col("_rate") + offset) - F.floor((end - F.col("_n")) * F.col("_rate") + offset)
    return placed.withColumn("_copies", taken.cast("long")).drop("_band", "_draw", "_salt", "_rank", "_below", "_up", "_rate")


def report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; rows alike share their copies as evenly as can be."""
    out = copies(_sized(docs), seed).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    own = F.floor(F.col("_copies") / F.col("_n")) + (F.col("_i") <= F.col("_copies") % F.col("_n")).cast("long")
    return out.select(F.col("_key").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (own * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns.

    What is ranked are keys; the copies come back to the rows by document id, text hash and source.  Rows alike in these
    get the whole part of their share each, and by a draw one more.
    """
    alike = copies(_sized(docs), seed).where("_copies > 0").select("_key", "_tie", "_from", "_n", "_copies")
    tie = F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))
    of = F.when(docs["source"].isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), docs["source"]))
    whole = docs.select(F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("_row"), docs["doc_id"].alias("_id"), tie.alias("_tie"), of.alias("_from"), F.xxhash64(F.monotonically_increasing_id()).alias("_draw"))
    both = whole.join(alike, ["_tie", "_from"]).where(F.col("_id").eqNullSafe(F.col("_key")))
    times = F.floor(F.col("_copies") / F.col("_n")) + (F.pmod("_draw", "_n") < F.col("_copies") % F.col("_n")).cast("long")
    return both.withColumn("_times", times).where("_times > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).select("_row.*")


# The same in SQL, over a table documents.
ORACLE = f"""
with sized as (
  select doc_id, source, md5(coalesce(text, '')) as tie, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), of as (
  select source, sum(size)::bigint as source_size from sized group by source
), weighed as (
  select *, (row_number() over (order by source nulls last) - 1) % {WEIGHTS} + 1 as w, {MOST} * source_size as cap from of
), filled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level from weighed
), levelled as (
  select *, (select arg_min(level, row(cap / w, source is null, source)) from filled where level * w <= cap) as final from filled
), goal as (
  select source, source_size, least(coalesce(final * w, cap::double), cap::double) as target from levelled
), ranked as (
  select r.*, g.source_size, g.target, case when source_size > 0 then target / source_size else 0.0::double end as rate, ('0x' || substr(md5('0|' || coalesce(doc_id::varchar, '') || '|' || tie), 1, 8))::bigint as draw,
    -floor({BANDS} * log2(size + 1.0))::int as band, ('0x' || substr(md5('0|' || coalesce(r.source, chr(0))), 1, 8))::bigint / 4294967296.0::double as offs
  from sized r join goal g on r.source is not distinct from g.source
), placed as (
  select *, row_number() over (partition by source order by band, draw % {SALTS}, draw, size, doc_id nulls first, tie) as rank from ranked
)
select doc_id, size, source_size, target, ((floor(rank * rate + offs) - floor((rank - 1) * rate + offs)) * size)::bigint as taken from placed
"""
