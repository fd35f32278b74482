"""Retrieval and rank-algebra queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.functions import text
from loreweave.operators import near, rank, search
from loreweave.plans.registry import query
from loreweave.sources import spread, table, views

TERMS = """
found as (select item_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.+#-]{1,23}')) as term, generate_subscripts(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_.+#-]{1,23}'), 1) as pos from benchmark),
firsts as (select item_id, term, min(pos) as pos from found group by 1, 2),
terms as (select distinct item_id as question_id, lower(term) as term from (select *, row_number() over (partition by item_id order by pos) as n from firsts) where n <= 40)
"""
KEYWORD = f"""
{views.CORPUS}, {TERMS},
hits as (select source_id, term, (case when contains(lower(title), term) and contains(lower(content), term) then 5 else 3 end) as w from corpus, (select distinct term from terms) where contains(lower(content), term) or contains(lower(title), term)),
scored as (select question_id, 'file' as source_type, source_id, sum(w)::bigint as score from hits join terms using (term) group by 1, 3),
ranked as (select *, row_number() over (partition by question_id order by score desc, source_type || ':' || source_id || ':0') as r from scored)
"""


def passages(spark, sf_dir):
    """Sources as passages: one for each document."""
    return spread(views.corpus(spark, sf_dir)).select("source_type", "source_id", F.lit(0).alias("seq"), "title", F.col("content").alias("body"), "category")


@query("terms_ascii", f"with {TERMS} select question_id, term from terms")
def terms_ascii(spark, sf_dir):
    return search.question_terms(views.questions(spark, sf_dir))


@query("kw_search_topk", f"with {KEYWORD} select question_id, source_type, source_id, score, r as rank from ranked where r <= 24")
def kw_search_topk(spark, sf_dir):
    hits = search.keyword_channel(passages(spark, sf_dir), views.questions(spark, sf_dir))
    return hits.select("question_id", "source_type", "source_id", "score", F.col("rank").cast("long").alias("rank"))


@query("lexical_score_pairs", """
with """ + TERMS + """, h as (select doc_id, term, case when contains(lower(source), term) then 3 else 1 end as w from documents, (select distinct term from terms) where contains(lower(source), term) or contains(lower(text), term))
select question_id, doc_id, cast(sum(w) as bigint) as score from h join terms using (term) group by 1, 2
""")
def lexical_score_pairs(spark, sf_dir):
    """H02 of every question and document with a term in common: one scan of titles and one of texts finds the terms."""
    d = table(spark, sf_dir, "documents")
    terms = search.question_terms(views.questions(spark, sf_dir))
    words = terms.select("term").distinct()
    place = [F.lit("file").alias("source_type"), F.col("doc_id").alias("source_id"), F.lit(0).alias("seq")]
    titles = search.term_hits(d.select(*place, F.col("source").alias("title"), F.lit("").alias("body")), words).select("source_id", "term", F.lit(3).alias("w"))
    bodies = search.term_hits(d.select(*place, F.lit("").alias("title"), F.col("text").alias("body")), words).select("source_id", "term", F.lit(1).alias("w"))
    best = titles.unionByName(bodies).groupBy("source_id", "term").agg(F.max("w").alias("w"))
    return best.join(terms, "term").groupBy("question_id", F.col("source_id").alias("doc_id")).agg(F.sum("w").alias("score"))


VECTORS = "v as (select vec_id, embedding::double[] as e from embeddings)"
COSINE = "list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e)))"


def _vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("file").alias("source_type"), F.floor(F.col("vec_id") / 3).alias("source_id"), (F.col("vec_id") % 3).cast("int").alias("seq"), F.col("embedding").alias("vec"), "vec_id")


def _queries(spark, sf_dir):
    """Stated query vectors: those with identifiers divisible by 100."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec"))


@query("cosine_pairs_topk", f"""
with {VECTORS}, s as (select q.vec_id as question_id, v.vec_id, round({COSINE}, 9) as score from v q, v where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id)
select question_id, vec_id, score, rank from (select *, row_number() over (partition by question_id order by score desc, vec_id) as rank from s) where rank <= 10
""")
def cosine_pairs_topk(spark, sf_dir):
    """every stated query against all vectors, in rounds of matrix products; one more than ten, as a query also meets itself."""
    met = near.scored(_vectors(spark, sf_dir).select("vec_id", "vec"), _queries(spark, sf_dir), 11, lengths=False, per_round=search.VECTORS_PER_ROUND)
    s = met.filter("vec_id <> question_id").select("question_id", "vec_id", F.round("score", 9).alias("score"))
    return rank.top(s, ["question_id"], [F.desc("score"), F.col("vec_id")], 10).withColumn("rank", F.col("rank").cast("long"))


BAND = f"""
{VECTORS}, s as (select q.vec_id as question_id, v.vec_id // 3 as source_id, cast(v.vec_id % 3 as integer) as seq, {COSINE} as score from v q, v where q.vec_id % 100 = 0),
t as (select * from s where score >= 0.2), b as (select *, max(score) over (partition by question_id) as best from t), c as (select * from b where score >= best - 0.8),
ranked as (select *, row_number() over (partition by question_id order by score desc, 'file:' || source_id || ':' || seq) as r from c),
placed as (select *, row_number() over (partition by question_id, source_id order by r) as k from ranked),
vec_hits as (select question_id, source_id, seq, score, row_number() over (partition by question_id order by cast(k > 1 as int), r) as rank from placed)
"""
BAND_CFG = Config(vector_min_score=0.2, vector_score_gap=0.8)


@query("vector_knn_band", f"with {BAND} select question_id, source_id, seq, round(score, 9) as score, rank from vec_hits where rank <= 24")
def vector_knn_band(spark, sf_dir):
    hits = search.vector_channel(_vectors(spark, sf_dir), _queries(spark, sf_dir), BAND_CFG)
    return hits.select("question_id", "source_id", "seq", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


ROUTES = """
routes as (
  select l_partkey % 50 as question_id, 'a' as route, l_orderkey % 40 as source_id, cast(l_linenumber % 2 as integer) as seq, row_number() over (partition by l_partkey % 50 order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) as rank from lineitem
  union all
  select l_partkey % 50, 'b', l_orderkey % 40, cast(l_linenumber % 2 as integer), row_number() over (partition by l_partkey % 50 order by l_quantity desc, l_orderkey, l_linenumber, l_partkey, l_suppkey) from lineitem)
"""


def _routes(spark, sf_dir):
    """Two ranked routes of fifty questions over sources with two passages each."""
    li = table(spark, sf_dir, "lineitem")

    def route(name, value):
        w = Window.partitionBy("question_id").orderBy(F.desc(value), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        part = li.withColumn("question_id", F.col("l_partkey") % 50)
        return part.select("question_id", F.lit(name).alias("route"), F.lit("file").alias("source_type"), (F.col("l_orderkey") % 40).alias("source_id"), (F.col("l_linenumber") % 2).alias("seq"), F.row_number().over(w).alias("rank"))

    return route("a", "l_extendedprice").unionByName(route("b", "l_quantity"))


DENSE = "firsts as (select question_id, route, source_id, seq, min(rank) as pos from routes group by all), dense as (select *, row_number() over (partition by question_id, route order by pos) as rank from firsts)"


@query("route_dense_ranks", f"with {ROUTES}, {DENSE} select question_id, route, source_id, seq, rank from dense")
def route_dense_ranks(spark, sf_dir):
    d = rank.dense_routes(_routes(spark, sf_dir), ["question_id"], search.PASSAGE)
    return d.select("question_id", "route", "source_id", "seq", F.col("rank").cast("long").alias("rank"))


FUSED = f"{ROUTES}, {DENSE}, fused as (select question_id, source_id, seq, round(sum(1.0::double / (60 + rank)), 12) as score, string_agg(route, '+' order by route) as channels from dense group by all)"


@query("rrf_fusion", f"with {FUSED} select question_id, source_id, seq, round(score, 9) as score, channels from fused")
def rrf_fusion(spark, sf_dir):
    f = rank.rrf(_routes(spark, sf_dir), ["question_id"], search.PASSAGE)
    return f.select("question_id", "source_id", "seq", F.round("score", 9).alias("score"), F.array_join("channels", "+").alias("channels"))


@query("fused_window", f"""
with {FUSED}, r as (select *, row_number() over (partition by question_id order by score desc, 'file:' || source_id || ':' || seq) as rr from fused),
k as (select *, row_number() over (partition by question_id, source_id order by rr) as k from r)
select question_id, source_id, seq, rank from (select *, row_number() over (partition by question_id order by cast(k > 2 as int), rr) as rank from k) where rank <= 20
""")
def fused_window(spark, sf_dir):
    return search.fuse(_routes(spark, sf_dir)).select("question_id", "source_id", "seq", F.col("rank").cast("long").alias("rank"))


@query("diversify_sources", f"""
with {ROUTES}, k as (select *, row_number() over (partition by question_id, source_id order by rank) as k from routes where route = 'a')
select question_id, source_id, seq, n as rank from (select *, row_number() over (partition by question_id order by cast(k > 2 as int), rank) as n from k) where n <= 30
""")
def diversify_sources(spark, sf_dir):
    a = _routes(spark, sf_dir).filter("route = 'a'")
    return rank.diversify(a, ["question_id"], search.SOURCE, 2, 30).select("question_id", "source_id", "seq", F.col("rank").cast("long").alias("rank"))


@query("interleave_routes", f"""
with {ROUTES}, f as (select *, row_number() over (partition by question_id, source_id, seq order by rank, route) as n from routes)
select question_id, route, source_id, seq, k as rank from (select *, row_number() over (partition by question_id order by rank, route) as k from f where n = 1) where k <= 12
""")
def interleave_routes(spark, sf_dir):
    return rank.interleave(_routes(spark, sf_dir), ["question_id"], search.PASSAGE, 12).select("question_id", "route", "source_id", "seq", F.col("rank").cast("long").alias("rank"))


@query("rerank_merge", f"""
with {ROUTES}, {DENSE}, a as (select * from dense where route = 'a'), o as (select question_id, source_id, seq, min(rank) as named from routes where route = 'b' and rank <= 6 group by all)
select a.question_id, a.source_id, a.seq, row_number() over (partition by a.question_id order by named is null, named, a.rank) as rank from a left join o using (question_id, source_id, seq)
""")
def rerank_merge(spark, sf_dir):
    routes = _routes(spark, sf_dir)
    ranked = rank.dense_routes(routes.filter("route = 'a'"), ["question_id"], search.PASSAGE)
    order = routes.filter("route = 'b' and rank <= 6").withColumnRenamed("rank", "position")
    return rank.rerank_merge(ranked, order, ["question_id"], search.PASSAGE).select("question_id", "source_id", "seq", F.col("rank").cast("long").alias("rank"))


@query("budget_prefix_stop", f"""
with {ROUTES}, c as (select question_id, source_id, rank, cast(100 + source_id * 13 as bigint) as cost from routes where route = 'a'),
u as (select *, cast(sum(cost) over (partition by question_id order by rank rows unbounded preceding) as bigint) as used from c) select question_id, source_id, rank, used from u where used <= 2400
""")
def budget_prefix_stop(spark, sf_dir):
    a = _routes(spark, sf_dir).filter("route = 'a'").withColumn("cost", 100 + F.col("source_id") * 13)
    return rank.budget_stop(a, ["question_id"], "cost", 2400).select("question_id", "source_id", F.col("rank").cast("long").alias("rank"), "used")


@query("budget_skip_pack", f"""
with recursive {ROUTES}, c as (select question_id, rank, cast(100 + source_id * 13 as bigint) as cost from routes where route = 'a'),
f as (select question_id, rank, case when cost <= 1500 then cost else 0 end as used, cost <= 1500 as taken from c where rank = 1
      union all select c.question_id, c.rank, case when f.used + c.cost <= 1500 then f.used + c.cost else f.used end, f.used + c.cost <= 1500 from f join c on c.question_id = f.question_id and c.rank = f.rank + 1)
select question_id, rank from f where taken
""")
def budget_skip_pack(spark, sf_dir):
    a = _routes(spark, sf_dir).filter("route = 'a'").withColumn("cost", 100 + F.col("source_id") * 13)
    return rank.budget_skip(a, ["question_id"], "cost", 1500).select("question_id", F.col("rank").cast("long").alias("rank"))


@query("percentile_nearest_rank", """
with v as (select l_suppkey, l_extendedprice as x, row_number() over (partition by l_suppkey order by l_extendedprice) as i, count(*) over (partition by l_suppkey) as n from lineitem)
select l_suppkey, min(x) as percentile from v where i = greatest(cast(ceil(n * 85 / 100.0) as bigint), 1) group by 1
""")
def percentile_nearest_rank(spark, sf_dir):
    return rank.nearest_rank(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", 85)


@query("mmr_order")
def mmr_order(spark, sf_dir):
    """Greedy diversity order of the ten nearest vectors of each stated query."""
    best = cosine_pairs_topk(spark, sf_dir).join(_vectors(spark, sf_dir).select("vec_id", "vec"), "vec_id")
    return rank.mmr(best.select("question_id", F.col("vec_id").alias("key"), "rank", "vec"), ["question_id"])


@query("source_cap_channels", f"with {FUSED} select channels, count(*) as n, round(max(score), 9) as best from fused group by 1")
def source_cap_channels(spark, sf_dir):
    f = rrf_fusion(spark, sf_dir)
    return f.groupBy("channels").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query("chunk_neighbors", """
select conv_id, turn, role, lag(text) over w as before, lead(text) over w as after from conversations window w as (partition by conv_id, role order by turn)
""")
def chunk_neighbors(spark, sf_dir):
    """Neighbours of a passage in its source and section."""
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("text").over(w).alias("before"), F.lead("text").over(w).alias("after"))


@query("needs_evidence", f"""
with {KEYWORD}, h as (select question_id, count(*) as hits from ranked where r <= 6 group by 1)
select b.item_id as question_id, coalesce(hits, 0) = 0 or contains(lower(text), 'detail') as check_needed from benchmark b left join h on h.question_id = b.item_id
""")
def needs_evidence(spark, sf_dir):
    hits = search.keyword_channel(passages(spark, sf_dir), views.questions(spark, sf_dir)).filter("rank <= 6").groupBy("question_id").agg(F.count("*").alias("hits"))
    q = views.questions(spark, sf_dir).join(hits, "question_id", "left")
    return q.select("question_id", ((F.coalesce("hits", F.lit(0)) == 0) | F.contains(F.lower("question"), F.lit("detail"))).alias("check_needed"))
