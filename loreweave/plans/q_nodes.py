"""Queries of concept nodes, relation ranking and graph views."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import graph, nodes
from loreweave.plans.registry import query
from loreweave.sources import table, views
from loreweave.sources.views import ORDER_FREE

R = views.RELATIONS
RICH = f"""{R}, rich as (select head, relation, tail, weight + (length(head) * 7 + length(tail) * 3 + ascii(right(tail, 1))) % 5 / 10.0 as weight,
 case when (ascii(right(head, 1)) + ascii(right(tail, 1))) % 3 = 0 then '' else 'quote of ' || head end as evidence, case when (ascii(right(head, 1)) + ascii(right(tail, 1))) % 4 = 0 then 0 else 1 end as n_sources,
 case when ascii(right(tail, 1)) % 5 = 0 then 'derived' else 'llm' end as origin from relations)"""


def rich(spark, sf_dir):
    """The stand-in relations with weights, quotes, sources and origins that follow from their ends' last characters."""
    last = lambda c: F.ascii(F.substring(c, -1, 1))
    w = F.col("weight") + (F.char_length("head") * 7 + F.char_length("tail") * 3 + last("tail")) % 5 / 10.0
    both = last("head") + last("tail")
    return views.relations(spark, sf_dir).select(
        "head", "relation", "tail", w.alias("weight"), F.when(both % 3 == 0, "").otherwise(F.concat(F.lit("quote of "), "head")).alias("evidence"),
        F.when(both % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("note-1"))).alias("sources"), F.when(last("tail") % 5 == 0, "derived").otherwise("llm").alias("origin"), F.lit("rule").alias("derived_from"),
    )


@query("node_upsert", """
with i as (select p_partkey as place, p_brand as name, lower(replace(replace(p_brand, '#', ''), ' ', '')) as norm, case when p_size % 3 = 0 then '' else p_type end as type, 'alias ' || (p_size % 4) as alias, 1 as n, case when p_size % 5 = 0 then 'brief ' || p_partkey else ' ' end as brief from part),
k as (select distinct -1 as place, upper(p_brand) as name, lower(replace(replace(p_brand, '#', ''), ' ', '')) as norm, 'known' as type, 'old' as alias, 10 as n, cast(null as varchar) as brief from part where p_brand < 'Brand#3'),
a as (select * from i union all select * from k), s as (select norm, unnest([name, alias]) as x, place from a),
f as (select norm, arg_min(name, place) as name, arg_min(type, place) filter (where trim(type) <> '') as type, cast(sum(n) as bigint) as source_count, arg_min(brief, place) filter (where trim(coalesce(brief, '')) <> '') as brief from a group by 1)
select 'e-' || substr(sha256(f.norm), 1, 10) as id, f.name, f.norm, f.type, (select string_agg(distinct s.x, '|' order by s.x) from s where s.norm = f.norm and s.x <> f.name) as aliases, source_count, brief from f
""")
def node_upsert(spark, sf_dir):
    """Brands of parts as incoming nodes, some of them known in capitals."""
    p = table(spark, sf_dir, "part")
    norm = F.lower(F.replace(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(" "), F.lit("")))
    incoming = p.select(F.col("p_partkey").alias("place"), F.col("p_brand").alias("name"), norm.alias("norm"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("type"), F.array(F.concat(F.lit("alias "), F.col("p_size") % 4)).alias("aliases"), F.lit(1).cast("long").alias("source_count"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("brief "), "p_partkey")).otherwise(" ").alias("brief"))
    known = p.filter("p_brand < 'Brand#3'").select(F.upper("p_brand").alias("name"), norm.alias("norm"), F.lit("known").alias("type"), F.array(F.lit("old")).alias("aliases"), F.lit(10).cast("long").alias("source_count"), F.lit(None).cast("string").alias("brief")).distinct()
    return nodes.upsert(known, incoming).withColumn("aliases", F.array_join("aliases", "|"))


@query("node_resolve", """
with n as (select 's' || s_suppkey as id, 'norm' || (s_suppkey % 50) as norm, ['old' || (s_suppkey % 30)] as al from supplier), q as (select distinct case p_size % 3 when 0 then 's' || p_size when 1 then 'zz' else 'other' end as name, case p_size % 4 when 0 then 'norm' || p_size else 'old' || p_size end as norm from part),
h as (select q.name, q.norm, 0 as p, n.id from q join n on q.name = n.id union all select q.name, q.norm, 1, n.id from q join n on q.norm = n.norm union all select q.name, q.norm, 2, n.id from q join n on q.norm = n.al[1])
select q.name, q.norm, (select id from h where h.name = q.name and h.norm = q.norm order by p, id limit 1) as id from q
""")
def node_resolve(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("norm"), F.col("s_suppkey") % 50).alias("norm"), F.array(F.concat(F.lit("old"), F.col("s_suppkey") % 30)).alias("alias_norms"))
    size = F.col("p_size")
    names = table(spark, sf_dir, "part").select(F.when(size % 3 == 0, F.concat(F.lit("s"), size)).when(size % 3 == 1, "zz").otherwise("other").alias("name"), F.when(size % 4 == 0, F.concat(F.lit("norm"), size)).otherwise(F.concat(F.lit("old"), size)).alias("norm"))
    return nodes.resolve(names.distinct(), n)


@query("triple_acceptance", """
with raw as (select l_orderkey * 10 + l_linenumber as id, 'brand ' || (l_partkey % 30) as head, ['is-a', 'vs', 'nonsense', 'depends on x', 'part_of'][l_linenumber % 5 + 1] as r, case when l_suppkey % 6 = 0 then 'Ends. here' else 'node ' || (l_suppkey % 8) end as tail, case when l_quantity > 40 then 'it requires that' else 'plain quote' end as q, l_discount * 10 as w from lineitem),
c as (select *, case r when 'is-a' then 'is_a' when 'vs' then 'contrast_with' when 'depends on x' then 'prerequisite' when 'part_of' then 'part_of' end as c from raw where tail <> 'Ends. here'),
k as (select id, replace(head, ' ', '') as head, case when c in ('is_a', 'part_of') and q = 'it requires that' then 'prerequisite' else c end as relation, replace(tail, ' ', '') as tail, q, w from c where c is not null and r <> 'nonsense'),
n as (select *, row_number() over (partition by head, relation, tail order by id) as n from k where head <> tail and replace(head, 'brand', '')::int < 20)
select head, relation, tail, arg_min(q, id) as evidence, round(greatest(max(case when n = 1 then case when w <= 0 or w > 1 then 1.0 else w end end), max(case when n > 1 then w end)), 9) as weight from n group by 1, 2, 3
""")
def triple_acceptance(spark, sf_dir):
    """N02 with H14, H15 and N04: model output over order lines; nodes are known up to brand 19."""
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("brand "), F.col("l_partkey") % 30).alias("head"), F.element_at(F.array(*map(F.lit, ["is-a", "vs", "nonsense", "depends on x", "part_of"])), F.col("l_linenumber") % 5 + 1).alias("relation"),
        F.when(F.col("l_suppkey") % 6 == 0, "Ends. here").otherwise(F.concat(F.lit("node "), F.col("l_suppkey") % 8)).alias("tail"), F.when(F.col("l_quantity") > 40, "it requires that").otherwise("plain quote").alias("evidence"), F.array(F.lit("note-1")).alias("sources"), (F.col("l_discount") * 10).alias("weight"),
    )
    squeeze = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    raw = raw.withColumn("head_norm", squeeze(F.col("head"))).withColumn("tail_norm", squeeze(F.col("tail")))
    ids = spark.range(20).select(F.concat(F.lit("brand"), "id").alias("norm")).unionByName(spark.range(8).select(F.concat(F.lit("node"), "id").alias("norm")))
    known = ids.select(F.col("norm").alias("id"), "norm", F.array().cast("array<string>").alias("alias_norms"))
    return nodes.accept_triples(raw, known).drop("sources").withColumn("weight", F.round("weight", 9))


@query("reasoning", f"""
with {RICH}, d as (select * from rich where origin <> 'derived'), e as (select head, relation, tail, max(weight) as weight from d where evidence <> '' group by 1, 2, 3),
sym as (select tail as head, relation, head as tail, weight from e where relation = 'related_to' and not exists (select 1 from e x where x.head = e.tail and x.tail = e.head and x.relation = e.relation)),
t as (select * from e where relation = 'part_of'), o as (select a.head, a.relation, b.tail, max(least(a.weight, b.weight) * 0.7) as weight from t a join t b on a.tail = b.head where a.head <> b.tail group by 1, 2, 3),
n1 as (select * from o where weight >= 0.25 and (head, tail) not in (select head, tail from t)), al as (select * from t union all select * from n1),
n2 as (select a.head, a.relation, b.tail, max(least(a.weight, b.weight) * 0.7) as weight from n1 a join al b on a.tail = b.head where a.head <> b.tail group by 1, 2, 3), m as (select * from sym union all select * from n1 union all select * from n2 where weight >= 0.25 and (head, tail) not in (select head, tail from al))
select head, relation, tail, round(weight, 6) as weight, origin from d union all select head, relation, tail, round(max(weight), 6), 'derived' from m where (head, relation, tail) not in (select head, relation, tail from d) group by 1, 2, 3
""")
def reasoning(spark, sf_dir):
    return nodes.reason(rich(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


ASKED = "asked as (select n_regionkey as question_id, 'n' || n_nationkey as id from nation union all select distinct p_size % 5, p_brand from part where p_size % 7 = 1)"
RANKED = f"""
with {RICH}, {ASKED}, known as (select * from rich where head <> tail and (origin = 'derived' or trim(evidence) <> '')),
x as (select question_id, known.*, 1 as s from known join asked on id = head union all select question_id, known.*, 2 from known join asked on id = tail),
t as (select question_id, head, relation, tail, weight, evidence, n_sources, origin, count(distinct s) as sides, case when relation = 'related_to' and head > tail then tail || '|' || relation || '|' || head else head || '|' || relation || '|' || tail end as key from x group by all),
u as (select *, row_number() over (partition by question_id, key order by sides desc, origin = 'derived', n_sources = 0, relation <> 'part_of', weight desc, head) as n from t),
ranked as (select *, row_number() over (partition by question_id order by sides desc, origin = 'derived', n_sources = 0, relation <> 'part_of', weight desc, key, head) as rank from u where n = 1)
"""


def asked(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("question_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"))
    return n.unionByName(table(spark, sf_dir, "part").filter("p_size % 7 = 1").select((F.col("p_size") % 5).alias("question_id"), F.col("p_brand").alias("id")).distinct())


@query("relation_ranking", RANKED + "select question_id, head, relation, tail, sides = 2 as bridging, rank from ranked where rank <= 60")
def relation_ranking(spark, sf_dir):
    """F02, F03, E10."""
    return nodes.ranked_edges(rich(spark, sf_dir), asked(spark, sf_dir)).filter("rank <= 60").select("question_id", "head", "relation", "tail", "bridging", F.col("rank").cast("long").alias("rank"))


@query("pair_best", f"with {RICH}, p as (select least(head, tail) as a, greatest(head, tail) as b, head, relation, tail, evidence, row_number() over (partition by least(head, tail), greatest(head, tail) order by trim(evidence) = '', weight, head, relation) as n from (select * from rich union all select tail, relation, head, weight + 0.01, 'back', n_sources, origin from rich where weight > 0.7)) select head, relation, tail, evidence from p where n = 1")
def pair_best(spark, sf_dir):
    """E09."""
    r = rich(spark, sf_dir)
    back = r.filter("weight > 0.7").select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"), (F.col("weight") + 0.01).alias("weight"), F.lit("back").alias("evidence"), "sources", "origin", "derived_from")
    both = r.unionByName(back).withColumn("place", F.struct("weight", "head", "relation"))
    return nodes.best_of_pair(both, []).select("head", "relation", "tail", "evidence")


@query("local_graph_block", "with recursive" + RANKED.split("with", 1)[1] + """,
ends as (select * from (select *, row_number() over (partition by question_id order by id) as k from (select distinct question_id, id from asked)) where k <= 8),
near as (select question_id, known.*, 1 as s from known join ends on id = head union all select question_id, known.*, 2 from known join ends on id = tail),
t2 as (select question_id, head, relation, tail, weight, n_sources, origin, count(distinct s) as sides, case when relation = 'related_to' and head > tail then tail || '|' || relation || '|' || head else head || '|' || relation || '|' || tail end as key from near group by all),
u2 as (select *, row_number() over (partition by question_id, key order by sides desc, origin = 'derived', n_sources = 0, relation <> 'part_of', weight desc, head) as n from t2),
r2 as (select *, row_number() over (partition by question_id order by sides desc, origin = 'derived', n_sources = 0, relation <> 'part_of', weight desc, key, head) as rank from u2 where n = 1),
lines as (select question_id, k as place, '- the ' || id || case when ascii(right(id, 1)) % 2 = 0 then '' else '：brief' end || chr(10) as line from ends union all select question_id, rank + 1000, '- the ' || head || ' —' || relation || '→ the ' || tail || case when origin = 'derived' then '（推导）' else '' end || chr(10) from r2 where rank <= 24),
o as (select question_id, line, row_number() over (partition by question_id order by place) as i from lines),
f as (select question_id, i, line, case when length(line) <= 300 then length(line) else 0 end as used, length(line) <= 300 as taken from o where i = 1 union all select o.question_id, o.i, o.line, case when f.used + length(o.line) <= 300 then f.used + length(o.line) else f.used end, f.used + length(o.line) <= 300 from f join o on o.question_id = f.question_id and o.i = f.i + 1)
select question_id, i as place, line from f where taken
""")
def local_graph_block(spark, sf_dir):
    """N13 within three hundred characters."""
    r = rich(spark, sf_dir)
    names = r.select(F.explode(F.array("head", "tail")).alias("id")).distinct().select("id", F.concat(F.lit("the "), "id").alias("name"), F.when(F.ascii(F.substring("id", -1, 1)) % 2 == 0, "").otherwise("brief").alias("brief"))
    return nodes.local_block(r, asked(spark, sf_dir), names, 300).withColumn("place", F.col("place").cast("long"))


@query("relation_questions", "select item_id as question_id, item_id % 4 >= 2 or contains(text, '关系') or contains(text, '依赖') as asks from (select item_id, case when item_id % 5 = 0 then text || '有什么关系' when item_id % 5 = 1 then text || '依赖' else text end as text from benchmark)")
def relation_questions(spark, sf_dir):
    """Questions with zero to three concepts, some with a relation word."""
    q = views.questions(spark, sf_dir)
    k = F.col("question_id") % 5
    text = F.concat("question", F.when(k == 0, "有什么关系").when(k == 1, "依赖").otherwise(""))
    return q.select("question_id", nodes.asks_relation(text, F.col("question_id") % 4).alias("asks"))


@query("undirected_hops", f"""
with {R}, walk as (select head as at, tail as id from relations union select tail, head from relations), s as (select distinct p_brand as id from part where p_size = 1), h0 as (select id as seed, id, 0 as hop from s),
h1 as (select distinct seed, w.id, 1 as hop from h0 join walk w on w.at = h0.id where (seed, w.id) not in (select seed, id from h0)), a1 as (select * from h0 union all select * from h1),
h2 as (select distinct seed, w.id, 2 as hop from h1 join walk w on w.at = h1.id where (seed, w.id) not in (select seed, id from a1)) select * from a1 union all select * from h2
""")
def undirected_hops(spark, sf_dir):
    """N31."""
    return nodes.undirected_hops(views.relations(spark, sf_dir), table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_brand").alias("id")), 2)


MEMBERS = "members as (select 's' || s_suppkey as id, s_nationkey % 7 as community from supplier union all select 'n' || n_nationkey, n_nationkey % 7 from nation union all select distinct p_brand, ascii(right(p_brand, 1)) % 7 from part)"


def members(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), (F.col("s_nationkey") % 7).alias("community"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), (F.col("n_nationkey") % 7).alias("community"))
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), (F.ascii(F.substring("p_brand", -1, 1)) % 7).cast("int").alias("community")).distinct()
    return s.select("id", F.col("community").cast("int")).unionByName(n.select("id", F.col("community").cast("int"))).unionByName(b)


@query("graph_view_filter", f"""
with {RICH}, {MEMBERS}, n as (select * from members where community = 3), e as (select head, relation, tail from rich where relation in ('related_to', 'part_of') and origin = 'llm' and head in (select id from n) and tail in (select id from n))
select 'edge' as kind, head as id, tail as other from e union all select 'node', id, '' from n where id in (select head from e union select tail from e)
""")
def graph_view_filter(spark, sf_dir):
    """N30."""
    n, e = nodes.filtered(members(spark, sf_dir), rich(spark, sf_dir), ["related_to", "part_of"], "llm", 3)
    return e.select(F.lit("edge").alias("kind"), F.col("head").alias("id"), F.col("tail").alias("other")).unionByName(n.select(F.lit("node").alias("kind"), "id", F.lit("").alias("other")))


@query("community_rollup", f"""
with {RICH}, {MEMBERS}, j as (select a.community as a, b.community as b, origin from rich join members a on a.id = head join members b on b.id = tail),
c as (select least(a, b) as x, greatest(a, b) as y, count(*) filter (where origin <> 'derived') as direct, count(*) filter (where origin = 'derived') as derived, count(*) filter (where a < b) as forward, count(*) filter (where a > b) as backward, count(*) as n from j group by 1, 2)
select x, y, direct, derived, forward, backward, x = y as internal from (select *, row_number() over (order by n desc, x, y) as k from c) where k <= 96
""")
def community_rollup(spark, sf_dir):
    """N29."""
    return nodes.overview(rich(spark, sf_dir), members(spark, sf_dir))


@query("community_titles", f"""
with {R}, {MEMBERS}, d as (select id, count(*) as n from (select head as id from relations union all select tail from relations) group by 1),
p as (select m.community, 'the ' || m.id as name, row_number() over (partition by m.community order by coalesce(n, 0) desc, 'the ' || m.id, m.id) as k from members m left join d using (id))
select community, count(*) as size, concat_ws(' · ', max(name) filter (where k = 1), max(name) filter (where k = 2)) as title from p group by 1
""")
def community_titles(spark, sf_dir):
    """D11, N29."""
    m = members(spark, sf_dir)
    return nodes.community_titles(views.relations(spark, sf_dir), m, m.select("id", F.concat(F.lit("the "), "id").alias("name")))


@query("partition_stats", f"with {R}, {MEMBERS}, s as (select community, count(*) as n from members group by 1), a as (select distinct id from (select head as id from relations union all select tail from relations)) select count(*) as communities, count(*) filter (where n = 1) as singletons, max(n) as largest, sum(n)::bigint as members, (select count(*) from a where id not in (select id from members)) as dangling from s")
def partition_stats(spark, sf_dir):
    """D12."""
    ids = views.relations(spark, sf_dir).select(F.explode(F.array("head", "tail")).alias("id")).distinct()
    return nodes.partition_stats(ids, members(spark, sf_dir))


@query("graph_stats", f"""
with {RICH}, e as (select distinct id from (select head as id from rich union all select tail from rich)), n as (select 'c' || vec_id as id, label as dim, embedding from embeddings)
select count(*) as nodes, count(*) filter (where embedding is not null) as embedded, count(*) filter (where len(embedding) <> case when dim = 3 then 32 else 64 end) as legacy, count(*) filter (where id not in (select id from e)) as isolated,
 (select count(*) from rich) as edges, (select count(*) from rich where origin = 'derived') as derived, (select count(*) from rich where trim(evidence) <> '') as evidenced from n
""")
def graph_stats(spark, sf_dir):
    """Vectors as nodes, some of another model's length."""
    n = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("c"), "vec_id").alias("id"), F.col("embedding").alias("vec"), F.when(F.col("label") == 3, 32).otherwise(64).alias("dim"))
    return nodes.stats(n, rich(spark, sf_dir))


@query("member_hashes", f"with {MEMBERS} select community, count(distinct id) as size, sha256(string_agg(distinct id, chr(10) order by id)) as hash from members group by 1")
def member_hashes(spark, sf_dir):
    """G05, N18."""
    return nodes.member_hashes(members(spark, sf_dir))


@query("summary_states", f"""
with {MEMBERS}, h as (select community, sha256(string_agg(distinct id, chr(10) order by id)) as hash from members group by 1), o as (select community + 1 as community, case when community % 2 = 0 then 'old' else (select hash from h x where x.community = h.community + 1) end as hash from h)
select coalesce(h.community, o.community) as community, case when o.hash is null then 'missing' when h.hash is null then 'orphan' when h.hash = o.hash then 'fresh' else 'stale' end as state from h full join (select * from o where hash is not null) o on o.community = h.community
""")
def summary_states(spark, sf_dir):
    """Summaries written for the next community, every other one with an old hash."""
    m = members(spark, sf_dir)
    h = nodes.member_hashes(m)
    nxt = h.select((F.col("community") - 1).alias("community"), F.col("hash").alias("next"))
    old = h.join(nxt, "community", "left").select((F.col("community") + 1).alias("community"), F.when(F.col("community") % 2 == 0, "old").otherwise(F.col("next")).alias("hash")).filter("hash is not null")
    return nodes.summary_states(m, old)


@query("summary_inputs", """
with e as (select 'c' || (doc_id % 50) as head, 's' || source as tail, case when doc_id % 10 = 0 then 'altered quote ' || doc_id else substr(text, 1, 40) end as q, text, doc_id % 7 / 10.0 as w from documents),
k as (select head, tail, max(w) as w from e where regexp_extract(head, '[0-9]+')::int % 3 = ascii(right(tail, 1)) % 3 and length(regexp_replace(lower(q), '[\\s*_`>#-]+', '', 'g')) >= 6 and contains(regexp_replace(lower(text), '[\\s*_`>#-]+', '', 'g'), regexp_replace(lower(q), '[\\s*_`>#-]+', '', 'g')) group by 1, 2)
select community, head, relation, tail, rank from (select ascii(right(tail, 1)) % 3 as community, head, 'related_to' as relation, tail, row_number() over (partition by ascii(right(tail, 1)) % 3 order by w desc, head, tail) as rank from k) where rank <= 20
""")
def summary_inputs(spark, sf_dir):
    """N18."""
    from loreweave.plans.q_evidence import _cited

    rel = _cited(spark, sf_dir).withColumn("weight", F.substring_index(F.element_at("sources", 1), "-", -1).cast("long") % 7 / 10.0)
    heads = rel.select(F.col("head").alias("id")).distinct().withColumn("community", (F.regexp_extract("id", "[0-9]+", 0).cast("int") % 3))
    tails = rel.select(F.col("tail").alias("id")).distinct().withColumn("community", (F.ascii(F.substring("id", -1, 1)) % 3))
    return nodes.summary_inputs(rel, heads.unionByName(tails), views.corpus(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("folder_explorer", """
with f as (select 'r' || r_regionkey as id, cast(null as varchar) as parent_id, r_name as name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation), i as (select 'd' || doc_id as id, case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'r1' else 'n2' end as folder_id, source as name from documents),
k as (select id, sum(n) as n from (select parent_id as id, count(*) as n from f group by 1 union all select folder_id, count(*) from i group by 1) group by 1)
select false as is_item, f.id, name, coalesce(n, 0)::bigint as children from f left join k on k.id = f.id where parent_id = 'r1' union all select true, id, name, 0 from i where folder_id = 'r1'
""")
def folder_explorer(spark, sf_dir):
    """The second region's children, and the documents filed there."""
    d = table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 3 == 1, "r1").when(F.col("doc_id") % 3 == 2, "n2")
    return nodes.explorer(views.tree(spark, sf_dir), d.select(F.concat(F.lit("d"), "doc_id").alias("id"), folder.alias("folder_id"), F.col("source").alias("name")), "r1")


SIMILAR = "case when a.name = b.name then 1.0 when contains(a.name, b.name) or contains(b.name, a.name) then 0.6 when 1.0 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::double >= 0.75 then 1.0 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))::double else 0 end"


@query("duplicate_names", f"""
with n as (select min(id) as id, name from (select p_partkey as id, lower(p_name) as name from part union all select 1000000 + n_nationkey, lower(n_name) from nation union all select 2000000 + p_partkey, lower(p_type) from part union all select 3000000 + r_regionkey, substr(lower(r_name), 1, r_regionkey::int) from region) group by name)
select * from (select least(a.id, b.id) as a, greatest(a.id, b.id) as b, round({SIMILAR}::double, 9) as score from n a join n b on a.id < b.id where a.name <> '' and b.name <> '') where score > 0
""")
def duplicate_names(spark, sf_dir):
    """N20 over all distinct names of parts, kinds and nations, blocked by shared grams."""
    p, n, r = (table(spark, sf_dir, t) for t in ("part", "nation", "region"))
    names = p.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("name")).unionByName(n.select((F.col("n_nationkey") + 1_000_000).alias("id"), F.lower("n_name").alias("name"))).unionByName(p.select((F.col("p_partkey") + 2_000_000).alias("id"), F.lower("p_type").alias("name")))
    names = names.unionByName(r.select((F.col("r_regionkey") + 3_000_000).alias("id"), F.substring(F.lower("r_name"), F.lit(1), F.col("r_regionkey").cast("int")).alias("name")))
    return nodes.duplicates(names.groupBy("name").agg(F.min("id").alias("id"))).withColumn("score", F.round("score", 9))


@query("vector_concepts", """
with v as (select vec_id, embedding::double[] as e from embeddings), s as (select q.vec_id as question_id, v.vec_id as id, list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))) as score from v q, v where q.vec_id % 100 = 0)
select question_id, id, round(score, 6) as score from (select *, row_number() over (partition by question_id order by score desc, id) as k from s where score >= 0.3) where k <= 8
""")
def vector_concepts(spark, sf_dir):
    """N11 with a threshold that these vectors reach."""
    e = table(spark, sf_dir, "embeddings")
    asked_ = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec"))
    return nodes.recognised_by_vector(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), asked_, 0.3).withColumn("score", F.round("score", 6))


@query("entity_texts", "select p_partkey, substr(concat_ws('。', nullif(trim(p_name), ''), case when p_size % 2 = 0 then p_type end, case when p_size % 3 = 0 then trim(repeat('wiki text ', p_size::int * 5)) end), 1, 1200) as described from (select p_partkey, p_name, p_type, p_size from part)")
def entity_texts(spark, sf_dir):
    """N28."""
    p = table(spark, sf_dir, "part")
    wiki = F.when(F.col("p_size") % 3 == 0, F.repeat(F.lit("wiki text "), F.col("p_size") * 5))
    return p.select("p_partkey", nodes.embedding_text(F.col("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")), wiki).alias("described"))


@query("partition_fingerprint", f"with {R}, h as (select sha256(head || '|' || tail || '|' || cast(round(weight, 6) as varchar)) as h from relations) select substr({ORDER_FREE}, 1, 16) as fingerprint from h")
def partition_fingerprint(spark, sf_dir):
    """N17."""
    return nodes.partition_fingerprint(views.relations(spark, sf_dir).select("head", "tail", F.col("weight").alias("w")))
