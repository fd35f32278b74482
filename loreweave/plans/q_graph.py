"""Concept-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import graph
from loreweave.plans.registry import query
from loreweave.sources import table, views

R = views.RELATIONS


@query("edges_weighted", f"with {R} select head, tail, round(sum(case when relation = 'related_to' then weight * 0.35 else weight end), 6) as w from relations group by 1, 2")
def edges_weighted(spark, sf_dir):
    w = F.when(F.col("relation") == "related_to", F.col("weight") * graph.DERIVED_SHARE).otherwise(F.col("weight"))
    return views.relations(spark, sf_dir).groupBy("head", "tail").agg(F.round(F.sum(w), 6).alias("w"))


@query("node_degree", f"with {R} select id, count(*) as degree from (select head as id from relations union all select tail from relations) group by 1")
def node_degree(spark, sf_dir):
    return graph.degrees(views.relations(spark, sf_dir))


@query("symmetric_closure", f"with {R} select r.tail as head, r.relation, r.head as tail, r.weight from relations r where relation = 'related_to' and not exists (select 1 from relations x where x.head = r.tail and x.tail = r.head and x.relation = r.relation)")
def symmetric_closure(spark, sf_dir):
    return graph.symmetric_closure(views.relations(spark, sf_dir)).drop("via")


@query("transitive_closure_pairs", f"""
with {R}, e as (select distinct head, relation, tail, weight from relations where relation = 'part_of'),
one as (select distinct a.head, a.relation, b.tail, least(a.weight, b.weight) * 0.7 as weight from e a join e b on a.tail = b.head and a.relation = b.relation where a.head <> b.tail),
n1 as (select * from one where (head, tail) not in (select head, tail from e)), all1 as (select * from e union all select * from n1),
two as (select a.head, a.relation, b.tail, max(least(a.weight, b.weight) * 0.7) as weight from n1 a join all1 b on a.tail = b.head and a.relation = b.relation where a.head <> b.tail group by 1, 2, 3)
select head, relation, tail, round(weight, 6) as weight from n1 union all select head, relation, tail, round(weight, 6) from two where weight >= 0.25 and (head, tail) not in (select head, tail from all1)
""")
def transitive_closure_pairs(spark, sf_dir):
    d = graph.transitive_closure(views.relations(spark, sf_dir))
    return d.select("head", "relation", "tail", F.round("weight", 6).alias("weight"))


HOP = f"""
{R}, walk as (select head, relation, tail, head as at, tail as next from relations union all select head, relation, tail, tail, head from relations where relation = 'related_to'),
seeds as (select 's' || s_suppkey as id from supplier union all select distinct p_brand from part),
h1 as (select s.id as seed, 1 as hop, w.head, w.relation, w.tail, w.next from seeds s join walk w on w.at = s.id),
f1 as (select distinct seed, next as at from h1 where next <> seed),
h2 as (select f.seed, 2 as hop, w.head, w.relation, w.tail, w.next from f1 f join walk w on w.at = f.at)
"""


@query("khop_neighbors", f"with {HOP} select * from h1 union all select * from h2")
def khop_neighbors(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")))
    return graph.k_hop(views.relations(spark, sf_dir), seeds.distinct(), 2)


@query("shortest_path_len", f"""
with recursive {R}, walk as (select head as at, tail as next from relations where relation = 'part_of' union select tail, head from relations where relation = 'part_of'),
pairs as (select 's' || s_suppkey as source, 'r' || r_regionkey as target from supplier, region),
p as (select distinct source, source as at, 0 as n from pairs union select p.source, w.next, p.n + 1 from p join walk w on w.at = p.at where p.n < 2 or (p.n < 4 and not starts_with(w.next, 'c') and not starts_with(w.next, 's')))
select pairs.source, pairs.target, cast(min(n) as integer) as length from pairs join p on p.source = pairs.source and p.at = pairs.target group by 1, 2
""")
def shortest_path_len(spark, sf_dir):
    pairs = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(table(spark, sf_dir, "region"))).select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("r"), "r_regionkey").alias("target"))
    return graph.shortest_paths(views.relations(spark, sf_dir).filter("relation = 'part_of'"), pairs, 4)


@query("modularity", f"""
with {views.BRAND_PAIRS}, c as (select p_brand as id, cast(min(p_partkey) % 5 as integer) as community from part group by 1), e as (select a, b, n::double as w from brand_pairs),
m as (select sum(w) as m from e), x as (select e.*, ca.community as ca, cb.community as cb from e join c ca on ca.id = a join c cb on cb.id = b),
i as (select ca as community, sum(w) as inside from x where ca = cb group by 1), t as (select community, sum(w) as tot from (select ca as community, w from x union all select cb, w from x) group by 1)
select round(sum(coalesce(inside, 0) / m - tot * tot / (4 * m * m)), 9) as modularity from t left join i using (community), m
""")
def modularity(spark, sf_dir):
    e = views.brand_pairs(spark, sf_dir).select("a", "b", F.col("n").cast("double").alias("w"))
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg((F.min("p_partkey") % 5).cast("int").alias("community"))
    return graph.modularity(e, c)


@query("community_group", "select n_regionkey as community, string_agg(n_name, '|' order by n_name) as members, count(*) as size from nation group by 1")
def community_group(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("community")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), "|").alias("members"), F.count("*").alias("size"))


@query("community_stats", "with s as (select s_nationkey, count(*) as n from supplier group by 1) select count(*) as communities, count(*) filter (where n = 1) as singletons, max(n) as largest, 25 - count(*) as dangling from s")
def community_stats(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("communities"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), (25 - F.count("*")).alias("dangling"))


@query("community_overview", f"""
with {views.BRAND_PAIRS}, c as (select p_brand as id, cast(min(p_partkey) % 5 as integer) as community from part group by 1)
select least(x.community, y.community) as x, greatest(x.community, y.community) as y, count(*) as n, sum(case when x.community <= y.community then 1 else 0 end)::bigint as forward
from brand_pairs join c x on x.id = a join c y on y.id = b group by 1, 2
""")
def community_overview(spark, sf_dir):
    c = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg((F.min("p_partkey") % 5).cast("int").alias("community"))
    return graph.rollup_communities(views.brand_pairs(spark, sf_dir).select(F.col("a").alias("head"), F.col("b").alias("tail")), c)


@query("graph_filter", f"with {R} select head, relation, tail from relations where relation = 'related_to' and (head = (select min(p_brand) from part) or tail = (select min(p_brand) from part))")
def graph_filter(spark, sf_dir):
    focus = table(spark, sf_dir, "part").agg(F.min("p_brand").alias("f"))
    rel = views.relations(spark, sf_dir).filter("relation = 'related_to'").crossJoin(F.broadcast(focus))
    return rel.filter("head = f or tail = f").select("head", "relation", "tail")


@query("incident_relations", f"""
with {R}, s as (select distinct 's' || s_suppkey as id from supplier), d as (select distinct r.* from relations r where head in (select id from s) or tail in (select id from s))
select head, relation, tail, rank from (select *, row_number() over (order by relation <> 'part_of', weight desc, head, tail) as rank from d) where rank <= 60
""")
def incident_relations(spark, sf_dir):
    """Edges at either end of the seeds as a union of two equi-joins, ranked, sixty at most."""
    rel = views.relations(spark, sf_dir)
    seeds = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    hit = rel.join(seeds.withColumnRenamed("id", "head"), "head", "left_semi").select(rel.columns).unionByName(rel.join(seeds.withColumnRenamed("id", "tail"), "tail", "left_semi").select(rel.columns)).distinct()
    from pyspark.sql import Window

    order = [F.col("relation") != "part_of", F.desc("weight"), F.col("head"), F.col("tail")]
    first = hit.orderBy(*order).limit(60)
    return first.select("head", "relation", "tail", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


@query("inner_subgraph", f"with {views.BRAND_PAIRS} select a, b, n from brand_pairs where a in (select p_brand from part where p_size <= 3) and b in (select p_brand from part where p_size <= 3)")
def inner_subgraph(spark, sf_dir):
    chosen = table(spark, sf_dir, "part").filter("p_size <= 3").select("p_brand").distinct()
    pairs = views.brand_pairs(spark, sf_dir)
    return pairs.join(chosen.withColumnRenamed("p_brand", "a"), "a", "left_semi").join(chosen.withColumnRenamed("p_brand", "b"), "b", "left_semi").select("a", "b", "n")


@query("triple_merge", """
with t as (select l_orderkey * 10 + l_linenumber as id, 'p' || (l_partkey % 40) as head, 'related_to' as relation, 's' || (l_suppkey % 7) as tail, case when l_linenumber % 2 = 0 then ' ' else 'quote ' || l_orderkey end as evidence, 'file-' || (l_orderkey % 5) as source, l_discount * 20 - 0.2 as weight from lineitem),
n as (select *, row_number() over (partition by head, relation, tail order by id) as n from t)
select head, relation, tail, first(evidence order by id) filter (where trim(evidence) <> '') as evidence, string_agg(distinct source, '|' order by source) as sources,
 round(greatest(max(case when n = 1 then case when weight <= 0 or weight > 1 then 1.0 else weight end end), max(case when n > 1 then weight end)), 9)::double as weight from n group by 1, 2, 3
""")
def triple_merge(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("p"), F.col("l_partkey") % 40).alias("head"), F.lit("related_to").alias("relation"), F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("tail"),
        F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(F.concat(F.lit("quote "), "l_orderkey")).alias("evidence"), F.array(F.concat(F.lit("file-"), F.col("l_orderkey") % 5)).alias("sources"), (F.col("l_discount") * 20 - 0.2).alias("weight"),
    )
    return graph.merge_triples(t).withColumn("sources", F.array_join("sources", "|")).withColumn("weight", F.round("weight", 9))


@query("entity_link", """
with e as (select lower(regexp_replace(p_brand, '[_\\s·・-]', '', 'g')) as norm, count(distinct p_type) as spellings from part group by 1)
select 'e-' || substr(sha256(norm), 1, 10) as id, norm, spellings, length(norm) between 1 and 40 and regexp_matches(norm, '[A-Za-z]') and not regexp_matches(norm, '[，。、；：！？,.!?;:]') as plausible from e
""")
def entity_link(spark, sf_dir):
    """Entities by normalised name, with identifiers and plausibility."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit(" "), "p_brand", F.lit("（"), "p_type", F.lit("）")).alias("raw")).distinct()
    e = p.withColumn("norm", graph.normal_name_column(F.col("raw")))
    return e.groupBy("norm").agg(F.count("*").alias("spellings")).select(graph.entity_id(F.col("norm")).alias("id"), "norm", "spellings", graph.plausible_name(F.col("norm")).alias("plausible"))


@query("concept_names", "select distinct p_type as name, length(p_type) <= 24 or regexp_full_match(p_type, '[A-Za-z0-9_$.]+') as admissible from part")
def concept_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().select("name", graph.admissible_concept(F.col("name")).alias("admissible"))


@query("doc_graph_edges", """
with s as (select doc_id as a, doc_id + 20 as b from documents), m as (select vec_id as a, (vec_id * 7) % 300 as b from embeddings), e as (select a, b, 'structural' as kind from s union all select a, b, 'semantic' from m)
select distinct least(a, b) as x, greatest(a, b) as y, kind from e where a <> b and a in (select doc_id from documents) and b in (select doc_id from documents)
""")
def doc_graph_edges(spark, sf_dir):
    """The next document of a source, and stated semantic pairs."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    structural = d.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 20).alias("b"))
    return graph.document_edges(d.select(F.col("doc_id").alias("id")), structural, e.select(F.col("vec_id").alias("a"), ((F.col("vec_id") * 7) % 300).alias("b")))
