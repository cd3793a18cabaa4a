"""Label index, counts, splits, caps, joins with verdicts.  Documents stand for label rows: source is the class, labels the listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import quality, routing, splits, stages
from quillspark.plans.base import Queries, table

Q = Queries()
EXCLUDED = "src0"

_ROUTED = f"""select d.doc_id, d.lang, d.source, case when d.source in ('{routing.UNKNOWN_LABEL}', '{EXCLUDED}') then 'excluded' when l.doc_id is null then 'missing' else 'kept' end as route
  from documents d left join (select distinct doc_id from labels) l on d.doc_id = l.doc_id"""


def routed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return routing.routed(docs, "source", table(spark, sf_dir, "labels"), "doc_id", [EXCLUDED])


@Q.add("label_index_route", _ROUTED)
def label_index_route(spark, sf_dir):
    return routed(spark, sf_dir)


@Q.add("label_index_summary", f"""with r as ({_ROUTED}), c as (select source, count(*) filter (route = 'kept') as k from r group by source)
  select (select count(*) from r where route = 'kept') as kept, (select count(*) from r where route = 'excluded') as excluded, (select count(*) from r where route = 'missing') as missing,
    (select count(*) from c where k > 0) as classes, (select count(*) from c where k > 0 and k < 20) as rare_classes""")
def label_index_summary(spark, sf_dir):
    return routing.index_summary(routed(spark, sf_dir), "source", 20)


@Q.add("label_index_rare", f"""select source, lang, count(*) as count, 20 - count(*) as need_to_min_count from ({_ROUTED}) where route = 'kept' group by all having count(*) < 20""")
def label_index_rare(spark, sf_dir):
    counts = routing.class_counts(routed(spark, sf_dir).where("route = 'kept'"), "source", "lang")
    return routing.rare_classes(counts, 20).orderBy("count", "source", "lang")


@Q.add("class_counts", "select lang, source, count(*) as count from documents group by all")
def class_counts(spark, sf_dir):
    return routing.class_counts(table(spark, sf_dir, "documents"), "lang", "source").orderBy("count", "lang", "source")


@Q.add("stratified_split", """with o as (select doc_id, lang, row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) as r, count(*) over (partition by lang) as n from documents),
  a as (select *, greatest(1, round_even(n * 0.15, 0)::bigint) as v0, greatest(1, round_even(n * 0.15, 0)::bigint) as t0 from o),
  e as (select *, greatest(0, v0 + t0 - (n - 1)) as x from a),
  s as (select *, case when n <= 1 then 0 when n = 2 then 1 else v0 - x // 2 end as v, case when n <= 2 then 0 else t0 - (x - x // 2) end as t from e)
  select doc_id, lang, case when r <= n - v - t then 'train' when r <= n - t then 'val' else 'test' end as split from s""")
def stratified_split(spark, sf_dir):
    return splits.stratified_split(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id")


@Q.add("source_gate_default_true", """select d.doc_id, d.lang, coalesce(l.quality = 1, true) as source_quality_ok from documents d left join labels l using (doc_id)""")
def source_gate_default_true(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return quality.source_verdict(table(spark, sf_dir, "documents").select("doc_id", "lang"), verdicts, "doc_id", "ok")


@Q.add("source_gate_semi", """select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)""")
def source_gate_semi(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return quality.only_good(table(spark, sf_dir, "documents").select("doc_id", "lang"), verdicts, "doc_id", "ok")


@Q.add("kept_row_gate", """select lang, count(*) as total, count(*) filter (n_chars >= 1000) as quality_kept, count(*) filter (n_chars >= 1000 and coalesce(l.quality = 1, true)) as kept
  from documents d left join labels l using (doc_id) group by lang""")
def kept_row_gate(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    rows = quality.source_verdict(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), verdicts, "doc_id", "ok")
    good = F.col("n_chars") >= 1000
    both = quality.kept(good, F.col("source_quality_ok"), True)
    return rows.groupBy("lang").agg(F.count("*").alias("total"), F.count_if(quality.kept(good, F.lit(True), False)).alias("quality_kept"), F.count_if(both).alias("kept"))


@Q.add("exists_flag", "select doc_id, doc_id in (select doc_id from labels) as copied from documents")
def exists_flag(spark, sf_dir):
    return routing.flagged(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@Q.add("cap_per_group", "select doc_id, source, lang from (select *, row_number() over (partition by source, lang order by doc_id) as r from documents) where r <= 3")
def cap_per_group(spark, sf_dir):
    return splits.capped(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source", "lang"], [F.col("doc_id")], 3)


@Q.add("shuffle_limit", """with c as (select doc_id, source, lang from (select *, row_number() over (partition by source, lang order by doc_id) as r from documents) where r <= 3)
  select doc_id, source, lang from (select *, row_number() over (partition by source order by md5('42|' || doc_id), doc_id) as r from c) where r <= 5""")
def shuffle_limit(spark, sf_dir):
    rows = cap_per_group(spark, sf_dir)
    return splits.capped(rows, ["source"], [splits.seeded(42, "doc_id"), F.col("doc_id")], 5)


@Q.add("sample_per_group", "select o_orderkey, o_orderstatus from (select *, row_number() over (partition by o_orderstatus order by md5('7|' || o_orderkey), o_orderkey) as r from orders) where r <= 25")
def sample_per_group(spark, sf_dir):
    return splits.sampled(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 25, 7)


@Q.add("limited_classes", "select lang, count(*) as rows from documents where lang in (select distinct lang from documents order by lang limit 2) group by lang")
def limited_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    some = docs.select("lang").distinct().orderBy("lang").limit(2)
    return docs.join(some, "lang", "left_semi").groupBy("lang").agg(F.count("*").alias("rows"))


@Q.add("semi_join_rare", """with r as (select source, lang from documents group by all having count(*) < 10) select doc_id, source, lang from documents semi join r using (source, lang)""")
def semi_join_rare(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    rare = routing.load_rare(routing.class_counts(docs, "source", "lang"), 10)
    return docs.join(rare, ["source", "lang"], "left_semi")


@Q.add("filter_rows", "select doc_id, lang, source from documents d join labels l using (doc_id) where lang in ('de', 'fr') and quality <> 1 and source <> ''")
def filter_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return routing.chosen(rows, "lang", ["de", "fr"], F.col("quality") == 1, want_failed=True, reference="source").select("doc_id", "lang", "source")


@Q.add("anti_subset", "select doc_id, source from documents where source not in (select source from documents group by source order by count(*) desc, source limit 5)")
def anti_subset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    hard = routing.class_counts(docs, "source").orderBy(F.desc("count"), "source").limit(5)
    return stages.without(docs, hard, "source")


@Q.add("union_distinct_classes", "select source from documents where lang = 'de' union select source from documents where lang = 'fr'")
def union_distinct_classes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return stages.distinct_of([docs.where("lang = 'de'"), docs.where("lang = 'fr'")], "source", docs)


@Q.add("union_distinct_fallback", "select distinct source from documents")
def union_distinct_fallback(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return stages.distinct_of([docs.where("lang = 'none'")], "source", docs)


@Q.add("dedupe_keep_first", """select page_id, host from (select page_id, lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) as host, row_number() over (partition by lower(regexp_extract(url, '^[a-z]+://([^/]+)', 1)) order by page_id) as r from pages) where r = 1""")
def dedupe_keep_first(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("host"))
    return stages.first_of(pages, ["host"], [F.col("page_id")])


@Q.add("missing_required", "select r_regionkey as region from region where r_regionkey not in (select n_regionkey from nation where n_nationkey < 5)")
def missing_required(spark, sf_dir):
    from quillspark.operators.generation import missing_sources

    need = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region"))
    return missing_sources(need, table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_regionkey").alias("region")), "region")


@Q.add("first_candidate_match", """with w as (select s_suppkey, unnest([s_suppkey * 7, s_suppkey * 3, s_suppkey]) as cand, unnest([0, 1, 2]) as ord from supplier)
  select s_suppkey, arg_min(cand, ord) as found from w where cand in (select p_partkey from part where p_size > 25) group by s_suppkey""")
def first_candidate_match(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select("s_suppkey", F.posexplode(F.array(F.col("s_suppkey") * 7, F.col("s_suppkey") * 3, F.col("s_suppkey"))).alias("ord", "cand"))
    return routing.first_candidate(wanted, table(spark, sf_dir, "part").where("p_size > 25"), "s_suppkey", "cand", "ord", "p_partkey")


@Q.add("lookup_map_join", "select lang, code, count(*) as rows from documents join (values ('de', 'german'), ('fr', 'french'), ('en', 'english')) m(lang, code) using (lang) group by all")
def lookup_map_join(spark, sf_dir):
    # Codes of three of the languages; others have none and go.
    codes = F.create_map(*(F.lit(x) for x in ("de", "german", "fr", "french", "en", "english")))
    rows = table(spark, sf_dir, "documents").select("lang", F.try_element_at(codes, "lang").alias("code")).where("code is not null")
    return rows.groupBy("lang", "code").agg(F.count("*").alias("rows"))


QUERIES, ORACLES = Q.queries, Q.sql
