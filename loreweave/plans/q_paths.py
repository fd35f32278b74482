"""Queries of paths, relation blocks, communities and the degree cap."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import communities, graph, paths
from loreweave.plans.registry import query
from loreweave.sources import table, views

# Suppliers and the parts they sent in large amounts, and the suppliers' nations; an edge's place is its first line's number.
GOODS = """goods as (
  select 'p' || l_partkey as head, 'related_to' as relation, 's' || l_suppkey as tail, min(l_orderkey * 10 + l_linenumber) as place from lineitem where l_quantity >= 45 group by all
  union all select 's' || s_suppkey, 'part_of', 'n' || s_nationkey, -s_suppkey from supplier),
edges as (select *, case place % 4 when 0 then 'llm' when 1 then 'derived' else 'manual' end as origin, case when place % 3 = 0 then '' else 'line  ' || place || ' ' end as evidence,
  case when place % 5 = 0 then '' else 'file-' || (place % 7) end as source from goods),
walk as (select here, next, min(place) as place from (select head as here, tail as next, place from goods union all select tail, head, place from goods where relation = 'related_to') group by 1, 2),
pairs as (select 's' || a.s_suppkey as source, 's' || b.s_suppkey as target from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey),
way as (select source, source as here, []::bigint[] as places, [source] as ids from (select distinct source from pairs)
  union all select source, w.next, list_append(places, w.place), list_append(ids, w.next) from way join walk w using (here) where len(places) < 4 and not list_contains(ids, w.next)),
path as (select source, target, arg_min(ids, {'n': len(places), 'p': places}) as ids from pairs join way using (source) where way.here = target group by 1, 2)"""


def goods(spark, sf_dir):
    """``head, relation, tail, place, origin, evidence, sources``: the twin's edges."""
    li, s = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45"), table(spark, sf_dir, "supplier")
    sent = li.groupBy(F.concat(F.lit("p"), "l_partkey").alias("head"), F.lit("related_to").alias("relation"), F.concat(F.lit("s"), "l_suppkey").alias("tail")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    home = s.select(F.concat(F.lit("s"), "s_suppkey").alias("head"), F.lit("part_of").alias("relation"), F.concat(F.lit("n"), "s_nationkey").alias("tail"), (-F.col("s_suppkey")).alias("place"))
    p = F.col("place")
    return sent.unionByName(home).select(
        "head", "relation", "tail", "place", F.when(p % 4 == 0, "llm").when(p % 4 == 1, "derived").otherwise("manual").alias("origin"), F.when(p % 3 == 0, "").otherwise(F.concat(F.lit("line  "), p, F.lit(" "))).alias("evidence"),
        F.when(p % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("file-"), p % 7))).alias("sources"),
    )


@query("pair_paths", f"with recursive {GOODS} select source, target, (len(ids) - 1)::int as length, array_to_string(ids, ' > ') as path from path")
def pair_paths(spark, sf_dir):
    """Paths of at most four edges between suppliers of one nation, over the parts they sent."""
    ends = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("group"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("place"))
    return paths.paths_among(goods(spark, sf_dir), ends, 4).select("source", "target", "length", F.array_join("ids", " > ").alias("path"))


@query("relation_block", f"""
with recursive {GOODS}, hit as (select * from (select s_nationkey as q, 's' || s_suppkey as id, 'the s' || s_suppkey as name, row_number() over (partition by s_nationkey order by s_suppkey) as k from supplier) where k <= 6),
asks as (select n_nationkey as q from nation where n_nationkey % 3 = 0 or (select count(*) from hit where q = n_nationkey) >= 2), h as (select * from hit where q in (select q from asks)),
fact as (select * from edges where not (origin = 'llm' and evidence = '')),
t as (select q, k, name as head, relation, 'the ' || tail as tail, origin, evidence, source, place, tail as other from h join fact on head = id union all select q, k, 'the ' || head, relation, name, origin, evidence, source, place, head from h join fact on tail = id where relation = 'related_to'),
one as (select * from (select t.*, (q, other) in (select q, id from h) as bridging, row_number() over (partition by q, head, relation, tail order by k, place) as n from t) where n = 1),
pair as (select *, row_number() over (partition by q, least(head, tail), greatest(head, tail) order by evidence = '', k, place) as m, min((k, place)) over (partition by q, least(head, tail), greatest(head, tail)) as first from one),
best as (select *, row_number() over (partition by q order by not bridging, origin = 'derived', relation <> 'part_of', first) as r from pair where m = 1),
said as (select q, 1 as part, r, r || '. ' || head || ' -' || case relation when 'part_of' then '属于' else '相关' end || '→ ' || tail || case when origin = 'derived' then '（推导）' else '' end
  || case when evidence = '' then '' else chr(10) || '   证据：' || trim(replace(evidence, '  ', ' ')) end || case when source = '' then '' else '　来源：' || source end || chr(10) as line from best where r <= 6
  union all select q, 0, 0, '【知识图谱里的概念关联】从你的问题里识别到这些概念：' || string_agg(name, '、' order by k) || '。三元组格式是「头实体 -关系→ 尾实体」，标着「推导」的是按本体规则推出来的（不是直接写着的）。' || chr(10) from h group by q),
fit as (select q, part, r, line from (select *, sum(length(line)) over (partition by q order by part, r) as total from said) where part = 0 or total <= 330),
ways as (select * from (select a.q, 2 as part, row_number() over (partition by a.q order by a.k, b.k) as r, '路径：' || array_to_string(list_transform(ids, lambda x: 'the ' || x), ' → ') || '（' || (len(ids) - 1) || ' 跳）' || chr(10) as line
  from h a join h b on a.q = b.q and a.k < b.k join path on source = a.id and target = b.id where len(ids) > 2) where r <= 3),
every as (select * from fit union all select * from ways)
select q as question_id, count(*) filter (part = 1) as triples, count(*) filter (part = 2) as paths, string_agg(line, '' order by part, r) || '以上只是该实体的**一跳邻域**。要按关系精确查用 graph_query，要展开更多跳用 graph_neighbors。' || chr(10) as block
from every where q in (select q from best union select q from ways) group by q
""")
def relation_block(spark, sf_dir):
    """A question for each nation about its suppliers, some with a relation word, within 330 characters."""
    s = table(spark, sf_dir, "supplier")
    concepts = s.select(F.col("s_nationkey").alias("question_id"), F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_suppkey").alias("place"))
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("question_id"), F.when(F.col("n_nationkey") % 3 == 0, F.concat("n_name", F.lit("的关系"))).otherwise(F.col("n_name")).alias("question"))
    rel = goods(spark, sf_dir)
    names = rel.select(F.explode(F.array("head", "tail")).alias("id")).distinct().select("id", F.concat(F.lit("the "), "id").alias("name"))
    return paths.relation_block(rel, concepts, names, asked, 330, 4)


def _brands(spark, sf_dir):
    return views.brand_pairs(spark, sf_dir).select("a", "b", F.col("n").cast("double").alias("w"))


@query("leiden_communities")
def leiden_communities(spark, sf_dir):
    """Communities of brands by the orders they share; a graph this small is finished by one task."""
    return communities.communities(_brands(spark, sf_dir))


@query("edge_degree_cap", f"""
with recursive {views.BRAND_PAIRS}, o as (select a, b, n, -n as ordinal, row_number() over (order by n desc, a, b) as i from brand_pairs),
g as (select 0::bigint as i, false as ok, []::varchar[] as ends
  union all select o.i, x.ok, case when x.ok then list_concat(ends, [a, b]) else ends end from g join o on o.i = g.i + 1,
  lateral (select len(ends) < 60 and len(list_filter(ends, lambda e: e = o.a)) < 3 and len(list_filter(ends, lambda e: e = o.b)) < 3 as ok) x)
select a, b, n, ordinal from o join g using (i) where ok
""")
def edge_degree_cap(spark, sf_dir):
    """Proposals are brands by the orders they share, most first."""
    return graph.degree_cap(views.brand_pairs(spark, sf_dir).withColumn("ordinal", -F.col("n")))
