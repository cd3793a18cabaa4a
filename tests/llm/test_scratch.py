"""What stays in the shared folder and among the shuffle files."""

import gc
import os
import time

from pyspark.sql import functions as F

import corpus_pipeline
from quillspark import scratch
from quillspark.llm import linking, paragraphs

WORDS = [f"w{i}" for i in range(400)]


def kept(begin):
    return [p.rsplit("/", 1)[1].split("-")[0] for _, p in scratch.since(begin)]


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(files) if f.getName().startswith("shuffle_")}


def test_substring_dedup_leaves_one_table(spark):
    texts = [(k, " ".join(WORDS[k % 3 * 100 : k % 3 * 100 + 60] + [f"own{k}x{i}" for i in range(30)])) for k in range(12)]
    begin = scratch.mark()
    got = paragraphs.gone(spark.createDataFrame(texts, "doc_id long, text string"))
    assert kept(begin) == ["gone"]
    assert sorted(r.doc_id for r in got.collect()) == list(range(3, 12))


def test_links_leave_their_labels(spark):
    sets = spark.createDataFrame([(i, bytearray(b"".join(int(t).to_bytes(8, "little") for t in range(10)))) for i in (1, 2, 3)], "id long, tokens binary")
    postings = spark.range(1, 4).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("gid"), F.lit(10).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.col("id").alias("far"))
    begin = scratch.mark()
    labels = linking.link(postings, None, lambda ids: sets.join(ids, "id"))
    assert kept(begin) == ["labels"] and sorted(map(tuple, labels.collect())) == [(1, 1), (2, 1), (3, 1)]
    assert all(os.path.exists(p.removeprefix("file:")) for _, p in scratch.since(begin))


def test_written_tables_leave_no_shuffle_files(spark):
    before = shuffles(spark)
    rows = scratch.written(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    for _ in range(50):
        if not shuffles(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffles(spark) - before and len(rows.collect()) == 7


def test_stages_begin_without_garbage_and_broadcast_in_small_pieces(spark):
    env, runtime = spark._jvm.org.apache.spark.SparkEnv.get(), spark._jvm.java.lang.Runtime.getRuntime()
    in_use = lambda: (runtime.totalMemory() - runtime.freeMemory()) >> 20
    made, used = [], []

    def sent():
        made.append(spark.sparkContext.broadcast(os.urandom(1 << 20)))
        return env.blockManager().getStatus(spark._jvm.org.apache.spark.storage.BlockId.apply(f"broadcast_{made[-1]._jbroadcast.id()}_piece1")).isDefined()

    @corpus_pipeline.stage
    def probe(spark, docs, sf_dir):
        used.append(in_use())
        return docs if sent() else None

    assert not sent()
    garbage = spark.sparkContext._gateway.new_array(spark._jvm.byte, 300 << 20)
    used.append(in_use())
    del garbage
    gc.collect()
    assert probe(spark, spark.range(1), "") is not None
    assert used[1] < used[0] - 200 and not sent()


def test_freed_memory_goes_back_where_the_jvm_can(spark):
    version = spark._jvm.java.lang.Runtime.Version
    able = os.uname().sysname == "Linux" and spark._jvm.java.lang.Runtime.version().compareTo(version.parse("17.0.9")) >= 0
    assert scratch.give_back(spark) == able
