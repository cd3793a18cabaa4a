"""Labels, names, paths, loosely typed cells, annotations and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import boxes, text
from quillspark.plans.base import Queries, table
from quillspark.sources import annotations

Q = Queries()

#: Neighbouring order keys that are numbered together.
KEY_STRETCH = 1 << 16

_CODE = "case when t = '' then 'unknown' else array_to_string(list_transform(string_split(t, ''), lambda c: 'U' || case when ord(c) < 65536 then printf('%04X', ord(c)) else printf('%X', ord(c)) end), '_') end"


@Q.add("char_code_label", f"select doc_id, {_CODE} as code from (select doc_id, text as t from documents)")
def char_code_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.code_label(F.col("text")).alias("code"))


@Q.add("file_label", f"""with s as (select doc_id, t, regexp_replace(t, '[ .]+$', '') as e from (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents))
  select doc_id, case when t = '' or regexp_matches(t, '[<>:"/\\\\|?*\\x00-\\x1f]') or e = '' then {_CODE} else e end as label from s""")
def file_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.file_label(text.strip(F.col("text"))).alias("label"))


@Q.add("clean_name", """with s as (select page_id, regexp_replace(regexp_replace(case when trim(url) = '' then 'none' else trim(url) end, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[ .]+$', '') as n from pages) select page_id, case when n = '' then 'none' else n end as name from s""")
def clean_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_name(F.col("url"), "none").alias("name"))


@Q.add("typed_cells", """select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0) as lenient, trunc(coalesce(try_cast(json_extract_string(props, '$.k') as double), 0))::bigint as whole,
  lower(trim(event_type)) in ('1', 'true', 'yes', 'y') as truth, lower(trim(event_type)) <> 'false' as not_false from events""")
def typed_cells(spark, sf_dir):
    cell = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", text.lenient_double(cell).alias("lenient"), text.whole(cell).alias("whole"), text.truth(F.col("event_type")).alias("truth"), text.not_false(F.col("event_type")).alias("not_false"))


@Q.add("path_parts", """with p as (select page_id, url, string_split(url, '/') as s from pages)
  select page_id, s[-1] as base, regexp_replace(s[-1], '(.)\\.[^.]*$', '\\1') as stem, regexp_extract(s[-1], '.(\\.[^.]+)$', 1) as suffix, s[-2] as parent, lower(regexp_replace(replace(url, '//', '/'), '(.)/$', '\\1')) as normal from p""")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.base_name(url).alias("base"), text.stem(url).alias("stem"), text.suffix(url).alias("suffix"), text.part(url, -2).alias("parent"), text.normal_path(url).alias("normal"))


@Q.add("group_key", "select coalesce(nullif(case when conv_id % 3 = 0 then '' else role end, ''), 'unknown') as grp, count(*) as rows from conversations group by 1")
def group_key(spark, sf_dir):
    key = F.when(F.col("conv_id") % 3 == 0, F.lit("")).otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").groupBy(text.or_unknown(key).alias("grp")).agg(F.count("*").alias("rows"))


@Q.add("serial_names", "select o_orderkey, o_orderstatus || '_' || printf('%04d', row_number() over (partition by o_orderstatus order by o_orderkey)) || '.png' as name from orders")
def serial_names(spark, sf_dir):
    """Orders named by status; a status is numbered by stretches of keys, so that no task holds all of its rows."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_orderkey") / KEY_STRETCH).alias("stretch"))
    sizes = rows.groupBy("o_orderstatus", "stretch").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy("o_orderstatus").orderBy("stretch")) - F.col("size")
    sizes = sizes.select(F.col("o_orderstatus").alias("of"), F.col("stretch").alias("in"), before.alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("o_orderstatus", "stretch").orderBy("o_orderkey"))
    numbered = rows.join(sizes, F.col("o_orderstatus").eqNullSafe(F.col("of")) & F.col("stretch").eqNullSafe(F.col("in")))
    return numbered.select("o_orderkey", text.serial_name(F.col("o_orderstatus"), number).alias("name"))


@Q.add("word_list", "select p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ','), ','), lambda x: trim(x)), lambda x: x <> '') as words from part")
def word_list(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.words_of(F.regexp_replace("p_name", " ", ",")).alias("words"))


@Q.add("annotation_extract", """with l as (select page_id, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) as link from pages) select page_id, count(*) as links, min(link) as first_link, count(distinct link) as distinct_links from l group by page_id""")
def annotation_extract(spark, sf_dir):
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), 1)).alias("link"))
    return links.groupBy("page_id").agg(F.count("*").alias("links"), F.min("link").alias("first_link"), F.countDistinct("link").alias("distinct_links"))


_BOX_ROWS = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 90)::int as x1, (l_suppkey % 70)::int as y1, (l_partkey % 90 + l_quantity - 10)::int as x2, (l_suppkey % 70 + l_linenumber * 9)::int as y2 from lineitem"


def _box_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 90).cast("int").alias("x1"), (F.col("l_suppkey") % 70).cast("int").alias("y1"),
        (F.col("l_partkey") % 90 + F.col("l_quantity") - 10).cast("int").alias("x2"), (F.col("l_suppkey") % 70 + F.col("l_linenumber") * 9).cast("int").alias("y2"),
    )
    return rows.withColumn("b", boxes.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


@Q.add("voc_annotations", f"""with b as ({_BOX_ROWS}) select l_orderkey, count(*) filter (x2 > x1 and y2 > y1) as boxes, l_orderkey || '.bmp' as filename, coalesce(sum(case when x2 > x1 and y2 > y1 then (x2 - x1) * (y2 - y1) end), 0)::bigint as total_area from b group by l_orderkey""")
def voc_annotations(spark, sf_dir):
    """Boxes written as annotation text and read back by the tolerant parser; inverted boxes are dropped there."""
    item = F.format_string("<BndBox>\n<xmin> %d </xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></BndBox>", "x1", "y1", "x2", "y2")
    texts = _box_rows(spark, sf_dir).groupBy("l_orderkey").agg(F.array_join(F.collect_list(item), "").alias("items"))
    texts = texts.select("l_orderkey", F.concat(F.lit("<annotation><filename>"), "l_orderkey", F.lit(".bmp</filename>"), "items", F.lit("</annotation>")).alias("content"))
    found = annotations.parsed(texts, "content")
    total = F.aggregate(F.transform("boxes", boxes.area), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("l_orderkey", F.size("boxes").cast("long").alias("boxes"), "filename", total.alias("total_area"))


@Q.add("box_clamp", f"""with b as ({_BOX_ROWS}) select l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0, least(x1 - 3, 64)) as px1, greatest(0, least(y2 + 3, 48)) as py2, least(greatest(x1, 0), 63) as qx1,
  least(greatest(x2, least(greatest(x1, 0), 63) + 1), 64) as qx2 from b""")
def box_clamp(spark, sf_dir):
    w, h = F.lit(64), F.lit(48)
    rows = _box_rows(spark, sf_dir).withColumn("p", boxes.padded(F.col("b"), 3, w, h)).withColumn("q", boxes.prompt(F.col("b"), w, h))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("p.xmin").alias("px1"), F.col("p.ymax").alias("py2"), F.col("q.xmin").alias("qx1"), F.col("q.xmax").alias("qx2"))


@Q.add("box_shift", f"""with b as (select l_orderkey, least(greatest(x1 - 20, 0), 50) as x1, least(greatest(y1 - 10, 0), 40) as y1, least(greatest(x2 - 20, 0), 50) as x2, least(greatest(y2 - 10, 0), 40) as y2 from ({_BOX_ROWS}))
  select l_orderkey, count(*) as boxes, sum((x2 - x1) * (y2 - y1))::bigint as total_area from b where x2 > x1 and y2 > y1 group by l_orderkey""")
def box_shift(spark, sf_dir):
    grouped = _box_rows(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("b").alias("boxes"))
    moved = grouped.select("l_orderkey", boxes.shifted(F.col("boxes"), boxes.box(20, 10, 70, 50)).alias("boxes")).where(F.size("boxes") > 0)
    return moved.select("l_orderkey", F.size("boxes").cast("long").alias("boxes"), F.aggregate(F.transform("boxes", boxes.area), F.lit(0).cast("long"), lambda s, x: s + x).alias("total_area"))


@Q.add("box_mask_ratio", f"""with b as (select l_orderkey, greatest(0, least(x1 - 2, 64)) as x1, greatest(0, least(y1 - 2, 48)) as y1, greatest(0, least(x2 + 2, 64)) as x2, greatest(0, least(y2 + 2, 48)) as y2 from ({_BOX_ROWS})),
  px as (select distinct l_orderkey, x, y from b, unnest(range(x1, x2)) a(x), unnest(range(y1, y2)) c(y)) select o.l_orderkey, round(count(px.x) / (64.0 * 48), 9) as mask_ratio from (select distinct l_orderkey from b) o left join px using (l_orderkey) group by 1""")
def box_mask_ratio(spark, sf_dir):
    """The share of a page that each order's boxes cover."""
    grouped = _box_rows(spark, sf_dir).select("l_orderkey", boxes.padded(F.col("b"), 2, F.lit(64), F.lit(48)).alias("b")).groupBy("l_orderkey").agg(F.collect_list("b").alias("boxes"))
    return grouped.select("l_orderkey", F.round(boxes.covered_area(F.col("boxes")) / (64.0 * 48), 9).alias("mask_ratio"))


@Q.add("prompt_parse", """with t as (select o_orderkey, o_custkey % 50 || ',' || o_orderkey % 40 || ',' || o_custkey % 60 || case when o_orderkey % 5 = 0 then '' else ',' || (o_orderkey % 40 + 5) end as t from orders)
  select o_orderkey, case when len(s) = 4 and s[3]::int > s[1]::int and s[4]::int > s[2]::int then (s[3]::int - s[1]::int) * (s[4]::int - s[2]::int) end::bigint as area from (select o_orderkey, string_split(t, ',') as s from t)""")
def prompt_parse(spark, sf_dir):
    tail = F.when(F.col("o_orderkey") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(","), F.col("o_orderkey") % 40 + 5))
    t = F.concat(F.concat_ws(",", F.col("o_custkey") % 50, F.col("o_orderkey") % 40, F.col("o_custkey") % 60), tail)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", boxes.parse_box(t).alias("b"))
    return rows.select("o_orderkey", F.when(F.col("b").isNotNull(), boxes.area(F.col("b"))).alias("area"))


@Q.add("point_box", """with s as (select o_orderkey, (o_custkey % 100)::int as x, (o_orderkey % 80)::int as y, greatest(16, floor(least(100, 80) * 0.7)::int) as side from orders)
  select o_orderkey, least(greatest(x - side // 2, 0), 99) as xmin, least(greatest(y - side // 2 + side, least(greatest(y - side // 2, 0), 79) + 1), 80) as ymax from s""")
def point_box(spark, sf_dir):
    p = F.struct((F.col("o_custkey") % 100).cast("int").alias("x"), (F.col("o_orderkey") % 80).cast("int").alias("y"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", boxes.around(F.col("p"), F.lit(100), F.lit(80)).alias("b"))
    return rows.select("o_orderkey", "b.xmin", "b.ymax")


QUERIES, ORACLES = Q.queries, Q.sql
