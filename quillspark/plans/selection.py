"""Examples, lineage, oversampling and backgrounds.  Line items stand for generated samples: order is the source image, flag and status the method."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import generation, ranking, routing
from quillspark.plans.base import Queries, table

Q = Queries()
TIE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_MADE = "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag || l_linestatus as method, round(l_quantity / 50 + l_discount, 6) as score from lineitem"


def made(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*TIE, F.concat("l_returnflag", "l_linestatus").alias("method"), F.round(F.col("l_quantity") / 50 + F.col("l_discount"), 6).alias("score"))


@Q.add("examples_high_low", f"""with m as ({_MADE}), r as (select *, row_number() over (partition by method order by score desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as hi, row_number() over (partition by method order by score, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 as lo from m)
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, method, score, 'high' as side, hi as rank from r where hi < 10 union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, method, score, 'low', lo from r where lo < 10""")
def examples_high_low(spark, sf_dir):
    return ranking.examples(made(spark, sf_dir), "method", F.col("score"), TIE, 10)


_GROUPS = f"""m as ({_MADE}), g as (select l_orderkey, avg(score) as avg_score, min(score) as min_score, count(*) as generated_count from m group by l_orderkey having count(*) >= 3),
  top as (select *, row_number() over (order by round(avg_score, 9) desc, l_orderkey desc) - 1 as group_no from g qualify group_no < 80)"""


def top_groups(spark, sf_dir):
    return ranking.ranked_groups(made(spark, sf_dir), "l_orderkey", "score", "avg_score", 3, 80)


@Q.add("lineage_top_groups", f"with {_GROUPS} select l_orderkey, round(avg_score, 6) as avg_score, min_score, generated_count, group_no from top")
def lineage_top_groups(spark, sf_dir):
    return top_groups(spark, sf_dir).withColumn("avg_score", F.round("avg_score", 6))


@Q.add("lineage_all_groups", f"with m as ({_MADE}) select l_orderkey, round(avg(score), 6) as avg_score, min(score) as min_score, count(*) as generated_count, row_number() over (order by min(score), l_orderkey) - 1 as group_no from m group by l_orderkey")
def lineage_all_groups(spark, sf_dir):
    return ranking.ranked_groups(made(spark, sf_dir), "l_orderkey", "score", "min_score").withColumn("avg_score", F.round("avg_score", 6))


_GROUND = "case when l_suppkey % 3 > 0 then 's' || l_suppkey % 3 else '' end"


@Q.add("lineage_rows", f"""with {_GROUPS}, b as (select m.*, {_GROUND} as ground, group_no from m join top using (l_orderkey) qualify row_number() over (partition by l_orderkey, method order by score desc, l_linenumber, l_partkey, l_suppkey) <= 2)
  select *, row_number() over (partition by l_orderkey order by method, coalesce(nullif(ground, ''), 'unknown'), score desc, l_linenumber, l_partkey, l_suppkey) as seq from b""")
def lineage_rows(spark, sf_dir):
    ground = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("s"), F.col("l_suppkey") % 3)).otherwise(F.lit(""))
    return ranking.lineage(made(spark, sf_dir).withColumn("ground", ground), top_groups(spark, sf_dir), "l_orderkey", "method", "score", TIE[1:], 2, "ground")


@Q.add("lineage_labels", f"""with l as (select l_orderkey, list_sort(list(distinct method)) as l from ({_MADE}) group by l_orderkey)
  select l_orderkey, array_to_string(l[1:3], '') || case when len(l) > 3 then '_and_' || (len(l) - 3) || '_more' else '' end as label_text from l""")
def lineage_labels(spark, sf_dir):
    return ranking.label_text(made(spark, sf_dir), "l_orderkey", "method")


_SHORT = "select p_brand, count(*) as count from part group by p_brand"


@Q.add("oversample_slots", f"with c as ({_SHORT}) select p_brand, unnest(range(1000 - count))::int as slot from c where count < 1000")
def oversample_slots(spark, sf_dir):
    return generation.slots(routing.class_counts(table(spark, sf_dir, "part"), "p_brand"), "p_brand", "count", 1000)


_RR = f"""w as (select p_brand, unnest(range(1000 - count))::int as slot from ({_SHORT}) where count < 1000), b as (select n_regionkey, n_nationkey, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as pick, count(*) over (partition by n_regionkey) as size from nation where n_regionkey in (3, 0, 4)),
  s as (select n_regionkey, row_number() over (order by list_position([3, 0, 4], n_regionkey)) - 1 as turn, count(*) over () as turns, any_value(size) as size from b group by n_regionkey)"""


@Q.add("round_robin_backgrounds", f"with {_RR} select w.p_brand, w.slot, s.n_regionkey, b.n_nationkey from w join s on w.slot % s.turns = s.turn join b on b.n_regionkey = s.n_regionkey and b.pick = ('0x' || substr(md5('42|' || p_brand || '|' || slot), 1, 8))::bigint % s.size")
def round_robin_backgrounds(spark, sf_dir):
    wanted = oversample_slots(spark, sf_dir)
    return generation.round_robin(wanted, table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), "n_regionkey", "n_nationkey", "p_brand", order=[3, 0, 4]).select("p_brand", "slot", "n_regionkey", "n_nationkey")


@Q.add("random_backgrounds", f"""with w as (select p_brand, unnest(range(1000 - count))::int as slot from ({_SHORT}) where count < 1000), b as (select n_regionkey, n_nationkey, row_number() over (order by n_nationkey) - 1 as pick, count(*) over () as size from nation)
  select w.p_brand, w.slot, b.n_regionkey, b.n_nationkey from w join b on b.pick = ('0x' || substr(md5('42|' || p_brand || '|' || slot), 1, 8))::bigint % b.size""")
def random_backgrounds(spark, sf_dir):
    return generation.at_random(oversample_slots(spark, sf_dir), table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey"), "n_nationkey", "p_brand").select("p_brand", "slot", "n_regionkey", "n_nationkey")


@Q.add("first_of_group", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey, row(l_linenumber, l_partkey, l_suppkey) = min(row(l_linenumber, l_partkey, l_suppkey)) over (partition by l_orderkey) as is_first from ({_MADE})")
def first_of_group(spark, sf_dir):
    return generation.first_of_group(made(spark, sf_dir), "l_orderkey", TIE[1:]).select(*TIE, "is_first")


@Q.add("report_samples", f"""with o as (select distinct l_orderkey % 40 as char, l_orderkey from lineitem), a as (select l_orderkey % 40 as char, l_orderkey, l_linenumber, l_partkey, l_suppkey, method from ({_MADE})),
  every as (select char, '00_original' as folder, 'real' as method, l_orderkey::varchar as path from o union all select char, case when method = 'A_F' then '01_' else '02_' end || method, method, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) from (select *, substr(method, 1, 1) || '_' || substr(method, 2) as m2 from a) s(char, l_orderkey, l_linenumber, l_partkey, l_suppkey, m1, method))
  select char, folder, method, path, row_number() over (partition by char, folder order by md5('42|' || char || '|' || folder || '|' || path), path) - 1 as place from every qualify place < 3""")
def report_samples(spark, sf_dir):
    rows = made(spark, sf_dir).withColumn("char", F.col("l_orderkey") % 40)
    originals = rows.select("char", F.col("l_orderkey").cast("string").alias("path")).distinct()
    named = F.concat_ws("_", F.substring("method", 1, 1), F.substring("method", 2, 9))
    more = rows.select("char", F.concat_ws("-", *TIE).alias("path"), named.alias("method"))
    return ranking.report_samples(originals, more, "char", "path", 3, 42, first="A_F")


@Q.add("rejection_loop", """with c as (select p_mfgr, count(*) as n from (select substr(p_brand, 1, 7) as p_mfgr from part) group by 1), need as (select p_mfgr, greatest(0, 120 - n % 120) as need, n as size from c),
  t as (select p_mfgr, need, size, unnest(range(need * 4))::int as attempt from need where need > 0), own as (select substr(p_brand, 1, 7) as p_mfgr, p_partkey, p_size, row_number() over (partition by substr(p_brand, 1, 7) order by p_partkey) - 1 as pick from part),
  d as (select t.*, p_partkey, p_size from t join own on own.p_mfgr = t.p_mfgr and own.pick = ('0x' || substr(md5('42|' || t.p_mfgr || '|' || attempt), 1, 8))::bigint % size where p_size > 20)
  select p_mfgr, p_partkey, attempt, slot::int as slot from (select *, row_number() over (partition by p_mfgr order by attempt) - 1 as slot from d) where slot < need""")
def rejection_loop(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.substring("p_brand", 1, 7).alias("p_mfgr"), "p_partkey", "p_size")
    need = own.groupBy("p_mfgr").agg(F.greatest(F.lit(0), 120 - F.count("*") % 120).alias("need")).where("need > 0")
    wanted = need.select("p_mfgr", F.explode(F.sequence(F.lit(0), (F.col("need") - 1).cast("int"))).alias("slot"))
    tried = generation.attempts(wanted, own, "p_mfgr", "p_partkey", 4)
    return generation.accepted(tried, "p_mfgr", F.col("p_size") > 20).select("p_mfgr", "p_partkey", "attempt", "slot")


@Q.add("successful_classes", "with m as (select p_brand, p_partkey from part where p_size > 45) select p_brand, p_partkey from m where p_brand in (select distinct p_brand from m order by p_brand limit 3)")
def successful_classes(spark, sf_dir):
    return generation.first_classes(table(spark, sf_dir, "part").where("p_size > 45").select("p_brand", "p_partkey"), "p_brand", 3)


@Q.add("manifest_counts", f"select method, count(*) as rows, count(*) filter (score > 0.5) as kept, count(distinct l_orderkey) as sources from ({_MADE}) group by method")
def manifest_counts(spark, sf_dir):
    return made(spark, sf_dir).groupBy("method").agg(F.count("*").alias("rows"), F.count_if(F.col("score") > 0.5).alias("kept"), F.countDistinct("l_orderkey").alias("sources"))


QUERIES, ORACLES = Q.queries, Q.sql
