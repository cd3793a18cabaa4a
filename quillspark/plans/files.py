"""Sources and sinks as round trips: tables written as files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import scoring
from quillspark.operators import routing
from quillspark.plans import kernels
from quillspark.plans.base import Queries, table
from quillspark.scratch import scratch, written
from quillspark.sources import delimited, images, listing, sinks

Q = Queries()
#: Files that lie in a folder, about.
FOLDER_FILES = 100_000


def _written(spark, sf_dir, name, fields, sep=","):
    path = f"{scratch(spark, name)}/{name}.txt"
    sinks.write_table(table(spark, sf_dir, name).select(*fields).orderBy(fields[0]), path, fields, strict=True, sep=sep)
    return path


@Q.add("csv_round_trip", "select p_partkey::int as p_partkey, trim(p_name) as p_name, p_size::int as p_size from part")
def csv_round_trip(spark, sf_dir):
    rows = delimited.read_csv(spark, _written(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"]))
    return delimited.typed(rows, "p_partkey INT, p_name STRING, p_size INT")


@Q.add("tsv_round_trip", "select s_suppkey::int as s_suppkey, trim(s_name) as s_name, s_nationkey::int as s_nationkey from supplier")
def tsv_round_trip(spark, sf_dir):
    rows = delimited.read_tsv(spark, _written(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"], "\t"))
    return delimited.typed(rows, "s_suppkey INT, s_name STRING, s_nationkey INT")


@Q.add("first_rows_of_files", "select n_nationkey::int as n_nationkey, trim(n_name) as n_name from nation order by n_nationkey limit 7")
def first_rows_of_files(spark, sf_dir):
    rows = delimited.first_rows(delimited.read_csv(spark, _written(spark, sf_dir, "nation", ["n_nationkey", "n_name"])), 7)
    return delimited.typed(rows, "n_nationkey INT, n_name STRING")


@Q.add("samples_of_manifest", "select trim(n_name) as char, '/data/' || n_nationkey as path, 'real' as origin from nation")
def samples_of_manifest(spark, sf_dir):
    rows = delimited.read_csv(spark, _written(spark, sf_dir, "nation", ["n_nationkey", "n_name"]))
    return delimited.samples(rows, "/data", "n_name", "n_nationkey", "real")


@Q.add("row_counts", "select 'region' as name, count(*) as rows from region union all select 'nation', count(*) from nation union all select 'absent', null")
def row_counts(spark, sf_dir):
    found = [(n, delimited.row_count(spark, _written(spark, sf_dir, n, [f"{n[0]}_{n}key", f"{n[0]}_name"]))) for n in ("region", "nation")]
    return spark.createDataFrame([*found, ("absent", delimited.row_count(spark, f"{scratch(spark, 'none')}/none.csv"))], "name string, rows long")


@Q.add("json_round_trip", "select count(*) as kept, count(distinct n_regionkey) as regions from nation")
def json_round_trip(spark, sf_dir):
    path = f"{scratch(spark, 'summary')}/summary.json"
    sinks.write_json(spark, path, sinks.summary_row(table(spark, sf_dir, "nation").agg(F.count("*").alias("kept"), F.countDistinct("n_regionkey").alias("regions"))))
    return delimited.read_json(spark, path).select("kept", "regions")


@Q.add("counts_round_trip", "select p_brand as char, count(*)::int as count from part group by p_brand")
def counts_round_trip(spark, sf_dir):
    path = f"{scratch(spark, 'counts')}/class_counts.csv"
    sinks.write_counts(routing.class_counts(table(spark, sf_dir, "part").select(F.col("p_brand").alias("char")), "char"), path, ["char", "count"])
    return delimited.typed(delimited.read_csv(spark, path), "char STRING, count INT")


@Q.add("wide_round_trip", "select o_orderkey, o_custkey, o_orderstatus from orders")
def wide_round_trip(spark, sf_dir):
    path = scratch(spark, "wide")
    sinks.write_wide(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@Q.add("image_round_trip", "select vec_id, 48::int as height, 48::int as width, 3::int as channels, true as alike from embeddings where len(embedding) = 64")
def image_round_trip(spark, sf_dir):
    """Every tile as a PNG file, listed and read back, against its pixels (by their SHA-256, so that no pixels are shuffled).

    Files lie in folders of some FOLDER_FILES, by hash, and folders are read one after another.
    """
    root = scratch(spark, "images")
    rows = kernels.vectors(spark, sf_dir)
    count = -(-rows.count() // FOLDER_FILES)
    # A file or row group may hold many tiles; they are dealt before they are drawn.
    tasks = max(spark.sparkContext.defaultParallelism, 4 * count)
    made = kernels.drawn(rows.repartition(tasks)).withColumn("path", F.concat(F.coalesce("label", F.lit("null")), F.lit("/"), "path", F.lit(".png")))
    folder = F.pmod(F.xxhash64("path"), F.lit(max(count, 1)))
    files = sinks.encoded(made.withColumn("want", F.sha2("data", 256)).withColumn("file", F.concat(folder, F.lit("/"), "path")), ["file", "want"])
    want = sinks.exported(files, root, "file", "png")
    want = written(want.select(F.substring_index("file", "/", -2).alias("path"), "want"), "wanted")
    if not count:
        return want.select(F.lit(0).cast("long").alias("vec_id"), *(F.lit(0).alias(c) for c in ("height", "width", "channels")), F.lit(True).alias("alike"))
    read = images.digests_of_folders(spark, listing.folders(spark, root), "read").withColumn("path", F.regexp_extract("path", "[^/]*/[^/]*$", 0))
    return read.join(want, "path").select(F.regexp_extract("path", r"/(\d+)\.png", 1).cast("long").alias("vec_id"), "height", "width", "channels", (F.col("digest") == F.col("want")).alias("alike"))


@Q.add("file_listing", "select n_regionkey as region, count(*) as files, sum(length(trim(n_name))) as bytes from nation group by 1")
def file_listing(spark, sf_dir):
    """A file for each nation in a folder for each region; the listing does not read them."""
    root = scratch(spark, "listing")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.col("n_regionkey"), F.lit("/"), "n_nationkey", F.lit(".txt")).alias("path"), F.trim("n_name").alias("text"))
    sinks.export_files(rows, root, "path", "text")
    found = listing.files(spark, root, "*.txt")
    return found.groupBy(F.regexp_extract("path", r"/(\d+)/[^/]*$", 1).cast("int").alias("region")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@Q.add("size_match", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 3 = l_suppkey % 3 and l_linenumber % 2 = l_orderkey % 2 and l_partkey % 3 > 0 and l_suppkey % 3 > 0 as same_size from lineitem")
def size_match(spark, sf_dir):
    c = F.col
    side = lambda x: F.when(x > 0, x)
    rows = table(spark, sf_dir, "lineitem")
    same = scoring.size_match(side(c("l_partkey") % 3), c("l_linenumber") % 2, side(c("l_suppkey") % 3), c("l_orderkey") % 2)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", same.alias("same_size"))


QUERIES, ORACLES = Q.queries, Q.sql
