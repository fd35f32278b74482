"""Queries of context assembly, supplemental searches, rerankers and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.operators import assembly, chunk, rank, search
from loreweave.plans.q_retrieval import COSINE, KEYWORD, ROUTES, VECTORS, _queries, _routes, _vectors, passages
from loreweave.plans.registry import query
from loreweave.sources import spread, table, views
from loreweave.sources.staging import staged


def chunked(spark, sf_dir):
    """Structural chunks of documents as passages."""
    c = spread(views.corpus(spark, sf_dir))
    return chunk.chunk(c, keep=["title"]).select("source_type", "source_id", "seq", "heading", "title", F.col("chunk_text").alias("body"))


@query("context_with_neighbours")
def context_with_neighbours(spark, sf_dir):
    """M13 over chunks: keyword hits of all questions with neighbours of their sections; some questions have another block."""
    p, q = staged(chunked(spark, sf_dir), "chunks"), views.questions(spark, sf_dir)  # read five times, cut once
    hits = search.keyword_channel(p, q).join(q, "question_id").join(p.select(*search.PASSAGE, "title"), search.PASSAGE)
    other = q.filter("question_id % 3 = 0").select("question_id", F.lit(900).alias("chars"))
    made = assembly.build_context(hits.withColumn("channels", F.array(F.lit("keyword"))), p, auxiliary=other)
    return made.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ",")).withColumn("channels", F.array_join("channels", ","))


@query("final_selection", f"""
with {ROUTES}, f as (select question_id, source_id, seq, min(rank) as rank from routes where route = 'a' group by all), k as (select *, row_number() over (partition by question_id order by rank) as n from f)
select 'fused' as mode, question_id, source_id, seq, n as rank from k where n <= 24 union all
select 'keyword', question_id, source_id, seq, n from (select *, row_number() over (partition by question_id order by cast(k > 2 as int), rank) as n from (select *, row_number() over (partition by question_id, source_id order by rank) as k from routes where route = 'b')) where n <= 24
""")
def final_selection(spark, sf_dir):
    """M17."""
    r = _routes(spark, sf_dir)
    pick = lambda route, mode: assembly.final_selection(r.filter(F.col("route") == route).drop("route"), mode).select(F.lit(mode).alias("mode"), "question_id", "source_id", "seq", F.col("rank").cast("long").alias("rank"))
    return pick("a", "fused").unionByName(pick("b", "keyword"))


@query("supplemental_queries", "with " + KEYWORD.replace("found as (select item_id, unnest(regexp_extract_all(text,", "found as (select item_id, unnest(regexp_extract_all(text,").replace("from benchmark)", "from (select item_id * 16 + k as item_id, case k when 0 then text else 'tion ' || substr(text, 1, 60) end as text from benchmark, (select unnest([0, 1]) as k)))") + """,
d as (select *, row_number() over (partition by question_id, source_id order by r) as k from ranked), c as (select question_id, source_id, row_number() over (partition by question_id order by cast(k > 2 as int), r) as rank from d),
f as (select question_id, source_id, 1.0::double / (60 + rank) as s from c where rank <= 24), g as (select *, row_number() over (partition by question_id order by s desc, 'file:' || source_id || ':0') as rr from f),
h as (select question_id // 16 as question_id, question_id % 16 as route, source_id, rr as rank from g where rr <= 20), o as (select *, row_number() over (partition by question_id, source_id order by rank, route) as n from h)
select question_id, source_id, k as rank from (select *, row_number() over (partition by question_id order by rank, route) as k from o where n = 1) where k <= 24
""")
def supplemental_queries(spark, sf_dir):
    """Each question and a shorter form of it as further queries, in turns."""
    q = views.questions(spark, sf_dir).withColumn("place", F.explode(F.array(F.lit(0), F.lit(1))))
    extra = q.withColumn("question", F.when(F.col("place") == 0, F.col("question")).otherwise(F.concat(F.lit("tion "), F.substring("question", 1, 60))))
    return assembly.supplemental(extra, passages(spark, sf_dir)).select("question_id", "source_id", F.col("rank").cast("long").alias("rank"))


@query("lexical_rerank")
def lexical_rerank(spark, sf_dir):
    """Keyword hits in the order of the default reranker."""
    q = views.questions(spark, sf_dir)
    p = passages(spark, sf_dir)
    hits = search.keyword_channel(p, q).join(q, "question_id").join(p.select(*search.PASSAGE, "body"), search.PASSAGE)
    done, _ = assembly.rerank(hits, [assembly.LexicalReranker()])
    return done.select("question_id", "source_id", "rank")


@query("vector_probe", f"with {VECTORS}, s as (select q.vec_id as question_id, v.vec_id // 3 as source_id, cast(v.vec_id % 3 as integer) as seq, {COSINE} as score from v q, v where q.vec_id % 100 = 0) select question_id, source_id, seq, round(score, 6) as score, rank from (select *, row_number() over (partition by question_id order by score desc, 'file:' || source_id || ':' || seq) as rank from s) where rank <= 10")
def vector_probe(spark, sf_dir):
    """M15."""
    return assembly.probe(_vectors(spark, sf_dir), _queries(spark, sf_dir)).select("question_id", "source_id", "seq", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("mode_comparison", f"""
with {ROUTES}, d as (select question_id, route, source_id, seq, min(rank) as pos from routes group by all), r as (select *, row_number() over (partition by question_id, route order by pos) as rank from d),
a as (select * from r where route = 'a' and rank <= 10), b as (select * from r where route = 'b' and rank <= 10)
select coalesce(a.question_id, b.question_id) as question_id, coalesce(a.source_id, b.source_id) as source_id, coalesce(a.seq, b.seq) as seq, coalesce(a.rank, -1) as rank_a, coalesce(b.rank, -1) as rank_b from a full join b on a.question_id = b.question_id and a.source_id = b.source_id and a.seq = b.seq
""")
def mode_comparison(spark, sf_dir):
    """Two rankings side by side."""
    d = rank.dense_routes(_routes(spark, sf_dir), ["question_id"], search.PASSAGE).filter("rank <= 10")
    both = assembly.compared(d.filter("route = 'a'"), d.filter("route = 'b'"))
    return both.select("question_id", "source_id", "seq", F.coalesce("rank_a", F.lit(-1)).cast("long").alias("rank_a"), F.coalesce("rank_b", F.lit(-1)).cast("long").alias("rank_b"))


@query("fresh_vector_hits", f"""
with {VECTORS}, f as (select *, vec_id % 4 <> 1 as fresh from v), s as (select q.vec_id as question_id, f.vec_id // 3 as source_id, cast(f.vec_id % 3 as integer) as seq, {COSINE.replace('v.e', 'f.e')} as score from v q, f where q.vec_id % 100 = 0 and fresh),
t as (select * from s where score >= 0.2), b as (select *, max(score) over (partition by question_id) as best from t), c as (select * from b where score >= best - 0.8),
ranked as (select *, row_number() over (partition by question_id order by score desc, 'file:' || source_id || ':' || seq) as r from c), placed as (select *, row_number() over (partition by question_id, source_id order by r) as k from ranked)
select question_id, source_id, seq, rank from (select *, row_number() over (partition by question_id order by cast(k > 1 as int), r) as rank from placed) where rank <= 24
""")
def fresh_vector_hits(spark, sf_dir):
    """Vectors whose passage has changed leave before the band is taken."""
    v = _vectors(spark, sf_dir).withColumn("chunk_text", F.concat(F.lit("text "), "vec_id"))
    now = v.select(*search.PASSAGE, F.when(F.col("vec_id") % 4 == 1, "changed").otherwise(F.col("chunk_text")).alias("chunk_text"))
    hits = search.vector_channel(v, _queries(spark, sf_dir), Config(vector_min_score=0.2, vector_score_gap=0.8), now)
    return hits.select("question_id", "source_id", "seq", F.col("rank").cast("long").alias("rank"))


@query("search_diagnostics", "select * from (values (1, 1, 1, true), (2, 2, 2, true), (3, 3, 3, true), (4, 4, 4, true), (5, 5, 5, true)) t(case_id, expected, found, ok)")
def search_diagnostics(spark, sf_dir):
    """M16."""
    return assembly.diagnose(spark)


@query("stage_trace", "select 'keyword' as id, 'Keyword hits' as label, (with " + KEYWORD + " select count(*) from ranked where r <= 24) as count, 'ok' as status union all select 'broken', 'A failing stage', 0, 'failed'")
def stage_trace(spark, sf_dir):
    """One stage that answers and one that fails."""
    t = assembly.Trace()
    t.stage("keyword", "Keyword hits", lambda: search.keyword_channel(passages(spark, sf_dir), views.questions(spark, sf_dir)))
    t.stage("broken", "A failing stage", lambda: table(spark, sf_dir, "region").select("no_such_column"))
    return t.table(spark).select("id", "label", "count", "status")


@query("evidence_gate", """
with q as (select item_id as question_id, case item_id % 4 when 0 then 'Alpha and Beta' when 1 then '示例 of Alpha' when 2 then 'Alpha only' else 'Gamma Delta' end as question from benchmark),
h as (select question_id, case question_id % 3 when 0 then 'alpha text' when 1 then 'about alpha and beta' end as body from q)
select q.question_id, case when body is null then true when question like '%示例%' then true when question = 'Alpha and Beta' then not (contains(body, 'alpha') and contains(body, 'beta') and contains(body, 'and')) when question = 'Gamma Delta' then true else true end as check_needed from q join h using (question_id)
""")
def evidence_gate(spark, sf_dir):
    """B20 with its three conditions."""
    from loreweave.operators import library

    k = F.col("question_id")
    q = views.questions(spark, sf_dir).select(k, F.when(k % 4 == 0, "Alpha and Beta").when(k % 4 == 1, "示例 of Alpha").when(k % 4 == 2, "Alpha only").otherwise("Gamma Delta").alias("question"))
    hits = q.filter("question_id % 3 < 2").select("question_id", F.lit(1).alias("rank"), F.when(k % 3 == 0, "alpha text").otherwise("about alpha and beta").alias("text"))
    return library.needs_evidence(q, hits)


