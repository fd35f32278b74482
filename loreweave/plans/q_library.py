"""Queries of a knowledge base's records, code search, evaluation arms and table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import udtf
from loreweave.operators import chunk, code, evaluate, library, wiki
from loreweave.plans.registry import query
from loreweave.plans.q_wiki import FREE
from loreweave.sources import spread, table, views

ALL = """
notes as (select item_id as id, 'note ' || item_id as title, 'c' || (item_id % 3) as category, case when item_id % 7 = 0 then '' else text end as content, item_id as updated from benchmark),
refs as (select conv_id * 100 + turn as id, role as title, 'r' as category, text as content, turn as updated from conversations where role = 'system'),
files as (select doc_id as id, source as name, lang as category, case when doc_id % 2 = 0 then 'about ' || source else '' end as summary, text, case when doc_id % 5 = 0 then 'failed' else 'ok' end as text_status, n_chars as updated from documents),
sources as (select 'note' as source_type, id as source_id, title, category, content, updated from notes where content <> '' union all select 'quick_ref', id, title, category, content, updated from refs where content <> ''
 union all select 'file', id, name, category, summary || case when summary = '' then '' else chr(10) end || text, updated from files where text_status = 'ok' and summary || text <> '')
"""


def _files(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(k.alias("id"), F.col("source").alias("name"), F.col("lang").alias("category"), F.when(k % 2 == 0, F.concat(F.lit("about "), "source")).otherwise("").alias("summary"), "text", F.when(k % 5 == 0, "failed").otherwise("ok").alias("text_status"), F.col("n_chars").alias("updated"), F.char_length("text").alias("text_chars"))


def all_sources(spark, sf_dir):
    """Notes, quick references and files of the stand-in knowledge base."""
    b, c = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations").filter("role = 'system'")
    notes = b.select(F.col("item_id").alias("id"), F.concat(F.lit("note "), "item_id").alias("title"), F.concat(F.lit("c"), F.col("item_id") % 3).alias("category"), F.when(F.col("item_id") % 7 == 0, "").otherwise(F.col("text")).alias("content"), F.col("item_id").alias("updated"))
    refs = c.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("title"), F.lit("r").alias("category"), F.col("text").alias("content"), F.col("turn").alias("updated"))
    return library.union_sources(notes, refs, _files(spark, sf_dir))


@query("source_union", f"with {ALL} select source_type, source_id, title, category, length(content) as chars, updated from sources")
def source_union(spark, sf_dir):
    """A01-A03, G01."""
    return all_sources(spark, sf_dir).select("source_type", "source_id", "title", "category", F.char_length("content").cast("long").alias("chars"), "updated")


@query("source_fetch", f"with {ALL}, w as (select case doc_id % 4 when 0 then 'note' when 1 then 'file' when 2 then 'photo' else 'quick_ref' end as t, doc_id as i from documents) select source_type, source_id from sources where (source_type, source_id) in (select t, i from w)")
def source_fetch(spark, sf_dir):
    """Kinds that are not known give nothing."""
    k = F.col("doc_id") % 4
    w = table(spark, sf_dir, "documents").select(F.when(k == 0, "note").when(k == 1, "file").when(k == 2, "photo").otherwise("quick_ref").alias("source_type"), F.col("doc_id").alias("source_id"))
    return library.fetch(all_sources(spark, sf_dir), w).select("source_type", "source_id")


@query("source_versions", f"with {ALL} select source_type, source_id, sha256(content) as version, length(content) as chars, updated from sources")
def source_versions(spark, sf_dir):
    """A07 over the three kinds."""
    return library.versions(all_sources(spark, sf_dir)).withColumn("chars", F.col("chars").cast("long"))


@query("folder_views", "select 'all' as view, count(*) as n, sum(doc_id)::bigint as ids from documents union all select 'unfiled', count(*), sum(doc_id)::bigint from documents where doc_id % 3 = 0 union all select 'two', count(*), sum(doc_id)::bigint from documents where doc_id % 3 = 2 union all select 'two en', count(*), sum(doc_id)::bigint from documents where doc_id % 3 = 2 and lang = 'en'")
def folder_views(spark, sf_dir):
    """All, unfiled, one folder, one folder of a category."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 3).alias("folder_id"))
    one = lambda name, df: df.agg(F.lit(name).alias("view"), F.count("*").alias("n"), F.sum("doc_id").alias("ids"))
    return one("all", library.in_folder(d)).unionByName(one("unfiled", library.in_folder(d, 0))).unionByName(one("two", library.in_folder(d, 2))).unionByName(one("two en", library.in_folder(d, 2, "en")))


@query("longest_terms", "select doc_id from documents where contains(lower(source || chr(10) || text), 'license') or contains(lower(source || chr(10) || text), 'onwhichever') or contains(lower(source || chr(10) || text), 'ention')  or contains(lower(source || chr(10) || text), 'atheth') or contains(lower(source || chr(10) || text), 'tionon') or contains(lower(source || chr(10) || text), 'mail3') or contains(lower(source || chr(10) || text), 'token') or contains(lower(source || chr(10) || text), 'src12') or contains(lower(source || chr(10) || text), 'zzzzz') or contains(lower(source || chr(10) || text), 'yyyyy')")
def longest_terms(spark, sf_dir):
    """Twelve terms of which the ten longest count."""
    return library.any_term(table(spark, sf_dir, "documents"), ["source", "text"], ["a", "License", "onwhichever", "ention", "atheth", "tionon", "mail3", "token", "src12", "ZZZZZ", "yyyyy", "e"]).select("doc_id")


@query("file_search", f"with {ALL} select id, name, substr(text, 1, 1200) as text from (select * from files where contains(lower(name), 'tion') or contains(lower(summary), 'tion') or contains(lower(text), 'tion') order by updated desc, id desc limit 50)")
def file_search(spark, sf_dir):
    """B05."""
    return library.file_search(_files(spark, sf_dir), "Tion", 50).select("id", "name", "text")


@query("text_occurrences", r"""
with recursive d as (select doc_id, text, lower(text) as low from documents), p as (select doc_id, 1 as k, strpos(low, 'tion') as pos from d union all select p.doc_id, k + 1, case when strpos(substr(low, pos + 4), 'tion') > 0 then strpos(substr(low, pos + 4), 'tion') + pos + 3 else 0 end from p join d using (doc_id) where pos > 0 and k < 5),
w as (select p.doc_id, k, trim(regexp_replace(substr(text, greatest(pos - 220, 1), pos - greatest(pos - 220, 1) + 224), '\s+', ' ', 'g')) as w from p join d using (doc_id) where pos > 0)
select doc_id, cast(least(200, (length(low) - length(replace(low, 'tion', ''))) // 4) as integer) as hits, coalesce((select string_agg(w, ' … ' order by k) from w where w.doc_id = d.doc_id), '') as windows from d
""")
def text_occurrences(spark, sf_dir):
    """The first five hits with what stands around them."""
    d = table(spark, sf_dir, "documents").select("doc_id", library.occurrences(F.col("text"), "TION").alias("o"))
    return d.select("doc_id", "o.hits", F.array_join("o.windows", " … ").alias("windows"))


@query("text_reading", "select doc_id, substr(text, 501, 700) as part, case when length(text) > 1200 then 1200 end as next_offset from documents")
def text_reading(spark, sf_dir):
    """F10 at any offset."""
    return table(spark, sf_dir, "documents").select("doc_id", library.read_at(F.col("text"), 500, 700).alias("r")).select("doc_id", "r.*")


@query("file_fingerprint", f"with {ALL} select count(*) || ':' || max(id) || ':' || sum(case when text_status = 'ok' then 1 else 0 end) || ':' || sum(length(text)) as fingerprint from files")
def file_fingerprint(spark, sf_dir):
    """D05."""
    return library.file_fingerprint(_files(spark, sf_dir))


@query("vector_index_status", """
with c as (select vec_id // 2 as s, label as n, case when label % 3 = 0 then 'm1' else 'm2' end as model, case label % 4 when 0 then '' when 1 then 'old' else 'now' end as space, case when label = 7 then 32 else 64 end as dim, len(embedding) as l from embeddings),
k as (select count(*) as chunks, sum(n)::bigint as chars, count(distinct s) as sources, string_agg(distinct model, ',' order by model) as models, string_agg(distinct nullif(space, ''), ',' order by nullif(space, '')) as spaces, count(*) filter (where space = 'now' and dim = l) as compatible, count(*) filter (where space = '') as legacy from c),
n as (select distinct s, 'v' || (s % 11) as v from c where s % 13 <> 0), o as (select distinct s, case when s % 5 = 0 then 'v?' else 'v' || (s % 11) end as v, case when s % 8 = 0 then 'old' else 'now' end as space from c where s % 17 <> 0)
select k.*, (select count(*) from n full join o on n.s = o.s where n.v is distinct from o.v or o.space is distinct from 'now') as changed, true as stale from k
""")
def vector_index_status(spark, sf_dir):
    """Vectors of other spaces and lengths, sources that changed, came and went."""
    e, lab, s = table(spark, sf_dir, "embeddings"), F.col("label"), F.floor(F.col("vec_id") / 2)
    c = e.select(F.lit("file").alias("source_type"), s.alias("source_id"), lab.alias("char_len"), F.when(lab % 3 == 0, "m1").otherwise("m2").alias("model"), F.when(lab % 4 == 0, "").when(lab % 4 == 1, "old").otherwise("now").alias("embedding_space"), F.when(lab == 7, 32).otherwise(64).alias("dim"), F.col("embedding").alias("vec"))
    k = F.col("source_id")
    ids, v = c.select("source_type", "source_id").distinct(), F.concat(F.lit("v"), k % 11)
    now = ids.filter(k % 13 != 0).withColumn("version", v)
    old = ids.filter(k % 17 != 0).withColumn("version", F.when(k % 5 == 0, "v?").otherwise(v)).withColumn("embedding_space", F.when(k % 8 == 0, "old").otherwise("now"))
    return library.index_status(c, now, old, "now")


@query("queue_recent", "select * from (select o_orderkey as id, o_orderstatus as state from orders order by o_orderkey desc limit 100) union all select count(*), 'total ' || o_orderstatus from orders group by o_orderstatus")
def queue_recent(spark, sf_dir):
    """States, and the latest hundred rows."""
    counts, recent = library.queue_state(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")))
    return recent.unionByName(counts.select(F.col("n").alias("id"), F.concat(F.lit("total "), "state").alias("state")))


@query("import_plan", """
with f as (select source as repo, case doc_id % 5 when 0 then 'node_modules/x' || doc_id || '.js' when 1 then 'a.lock.png' || '' else 'src/f' || doc_id || '.py' end as path, doc_id, text from documents), g as (select * from f where not (doc_id % 5 = 1)),
k as (select *, case when doc_id % 5 = 0 then 'ignored directory' end as why from g), n as (select *, row_number() over (partition by repo, why is null order by path) as n, sum(strlen(text)) over (partition by repo, why is null order by path rows unbounded preceding) as b from k)
select repo, path, case when why is not null then why when n > 6 or b > 20000 then 'over the limit' when doc_id % 4 = 0 then 'added' when doc_id % 4 = 1 then 'updated' else 'unchanged' end as action from n
""")
def import_plan(spark, sf_dir):
    """Documents as files of the repository of their source; six files or twenty thousand bytes each."""
    d, k = table(spark, sf_dir, "documents").filter("doc_id % 5 <> 1"), F.col("doc_id")
    f = d.select("doc_id", F.col("source").alias("repo"), F.when(k % 5 == 0, F.concat(F.lit("node_modules/x"), k, F.lit(".js"))).otherwise(F.concat(F.lit("src/f"), k, F.lit(".py"))).alias("path"), "text")
    known = f.filter(k % 4 != 0).select("repo", "path", F.when(k % 4 == 1, "old").otherwise(F.sha2("text", 256)).alias("hash"))
    return library.import_plan(f.drop("doc_id"), known, 6, 20_000)


ROUTED = ["所有笔记的整体主题", "整个知识库有哪些方向", "Git 和 SVN 的区别", "我的笔记主要主题有什么区别", "give an overview", "how to merge the whole knowledge base", "all notes corpus", "plain question"]


@query("corpus_questions", "select * from (values (0, true), (1, true), (2, false), (3, true), (4, true), (5, false), (6, true), (7, false)) t(question_id, corpus)")
def corpus_questions(spark, sf_dir):
    """B18."""
    q = spark.createDataFrame(list(enumerate(ROUTED)), "question_id int, question string")
    return q.select("question_id", library.is_corpus_question(F.col("question")).alias("corpus"))


@query("topic_terms", "select * from (values (0, ''), (1, '整个'), (2, 'git,svn,区别'), (3, '区别'), (4, 'give,an'), (5, 'how,to,merge,whole'), (6, 'all,notes,corpus'), (7, 'plain,question')) t(question_id, terms)")
def topic_terms(spark, sf_dir):
    """H23."""
    q = spark.createDataFrame(list(enumerate(ROUTED)), "question_id int, question string")
    return q.select("question_id", F.array_join(library.topic_terms(F.col("question")), ",").alias("terms"))


@query("year_activity", "with d as (select cast(ts as date) as day, count(*) as n from events where ts >= timestamp '2024-01-01' and ts < timestamp '2025-01-01' group by 1) select cast(day as varchar) as day, n from d union all select 'active', count(*) from d union all select 'total', sum(n)::bigint from d union all select 'largest', max(n) from d")
def year_activity(spark, sf_dir):
    """A year out of range is the present one."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))
    counts, whole = library.activity_of_year(days, 99, 2024)
    rows = whole.select(F.explode(F.create_map(F.lit("active"), F.col("active_days"), F.lit("total"), F.col("total"), F.lit("largest"), F.col("largest"))).alias("day", "n"))
    return counts.select(F.col("day").cast("string").alias("day"), "n").unionByName(rows)


@query("activity_backfill", "select distinct source_id, cast(day as varchar) as day from (select o_orderkey as source_id, cast(o_orderdate as date) as day from orders union all select l_orderkey, cast(l_shipdate as date) from lineitem where l_linenumber = 1)")
def activity_backfill(spark, sf_dir):
    """Orders with their first line's date as the latest change."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").filter("l_linenumber = 1")
    s = o.join(li.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate"), "o_orderkey", "left").select(F.lit("note").alias("source_type"), F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").alias("created"), F.col("l_shipdate").alias("updated"))
    return library.backfill_activity(s).select("source_id", F.col("day").cast("string").alias("day"))


@query("code_search", """
with s as (select doc_id as id, doc_id % 3 as repo, 'f' || doc_id || '.py' as path, source as title, lang as explain, text, n_chars as updated from documents where doc_id % 3 = 1),
y as (select id, 'tionOf' || (id % 40) as name, id % 7 + 1 as line from s where id % 6 = 1 union all select id, 'makeTion' || (id % 9), 3 from s where id % 6 = 4),
h as (select id, name, line, case when lower(name) = 'tion' then 0 when starts_with(lower(name), 'tion') then 1 else 2 end as tier from y where contains(lower(name), 'tion')),
b as (select * from h where tier < 2 or (select min(tier) from h) = 2), c as (select * from (select b.*, s.path, row_number() over (order by tier, name, path, line) as n from b join s using (id)) where n <= 100),
f as (select id, min((tier, name, line)) as m from c group by 1), k as (select id, row_number() over (order by updated desc, id desc) as n from s where contains(lower(title || chr(10) || explain || chr(10) || path || chr(10) || text), 'tion')),
u as (select id, 'symbol' as match_by, m[2] as hit_symbol, m[3] as hit_line, 0 as k, m[1]::varchar as o1, m[2] as o2, id::varchar as o3 from f union all select id, 'keyword', null, null, 1, lpad(n::varchar, 6, '0'), '', '' from k where n <= 100 and id not in (select id from f))
select id, match_by, hit_symbol, cast(hit_line as integer) as hit_line, rank from (select *, row_number() over (order by k, o1, o2, o3) as rank from u) where rank <= 150
""")
def code_search(spark, sf_dir):
    """Documents as snippets of three repositories, one of which is searched."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    s = d.select(k.alias("id"), (k % 3).alias("repo"), F.lit("python").alias("lang"), F.concat(F.lit("f"), k, F.lit(".py")).alias("path"), F.col("source").alias("title"), F.col("lang").alias("explain"), F.lit("").alias("symbols"), "text", F.col("n_chars").alias("updated"))
    i = F.col("id")
    one = s.filter((i % 3 == 1) & (i % 6 == 1)).select("id", F.lit("function").alias("kind"), F.concat(F.lit("tionOf"), i % 40).alias("name"), (i % 7 + 1).cast("int").alias("line"))
    two = s.filter((i % 3 == 1) & (i % 6 == 4)).select("id", F.lit("function").alias("kind"), F.concat(F.lit("makeTion"), i % 9).alias("name"), F.lit(3).alias("line"))
    return code.search_code(s, one.unionByName(two), "Tion", most=150, repo=1).withColumn("rank", F.col("rank").cast("long"))


ARMS = """
r as (select l_orderkey as q, 'n' || (l_partkey % 5) as ref, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as rank, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) as other from lineitem),
c as (select o_orderkey as q, case when o_orderkey % 6 = 0 then [] else ['n' || (o_orderkey % 5)] end as refs, o_orderstatus as s from orders),
a as (select q, ref, min(rank) as pos from r group by 1, 2), b as (select q, ref, min(other) as pos from r group by 1, 2), pa as (select *, row_number() over (partition by q order by pos) as p from a), pb as (select *, row_number() over (partition by q order by pos) as p from b),
f as (select c.q, s, len(refs) = 0 as gap, (select min(p) from pa where pa.q = c.q and pa.ref = c.refs[1] and p <= 3) as a, (select min(p) from pb where pb.q = c.q and pb.ref = c.refs[1] and p <= 3) as b from c)
"""


def _arm_ranks(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey")
    rank, other = (F.row_number().over(order.orderBy(*c)) for c in (("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), (F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("n"), F.col("l_partkey") % 5).alias("ref"), rank.alias("a"), other.alias("b"))
    arms = {name: lambda q, c=c: li.select("question_id", "ref", F.col(c).alias("rank")).join(q, "question_id", "left_semi") for name, c in (("keyword", "a"), ("vector", "b"))}
    o = table(spark, sf_dir, "orders")
    cases = o.select(F.col("o_orderkey").alias("question_id"), F.lit("q").alias("question"), F.when(F.col("o_orderkey") % 6 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("n"), F.col("o_orderkey") % 5))).alias("refs"))
    return evaluate.retrieval_arms(cases, arms, 3)


@query("retrieval_arms", f"with {ARMS} select 'keyword' as arm, q as question_id, gap, coalesce(a, -1) as first from f union all select 'vector', q, gap, coalesce(b, -1) from f")
def retrieval_arms(spark, sf_dir):
    """Two orders of an order's lines as retrievers."""
    return _arm_ranks(spark, sf_dir).withColumn("first", F.coalesce("first", F.lit(-1)).cast("long"))


@query("paired_arm_report", f"""
with {ARMS} select s as subset, count(*) as cases, round(avg((a is not null)::int), 9) as hit_a, round(avg((b is not null)::int), 9) as hit_b, round(avg(coalesce(a = 1, false)::int), 9) as first_a, round(avg(coalesce(b = 1, false)::int), 9) as first_b,
 round(avg(coalesce(1.0::double / a, 0)), 9) as mrr_a, round(avg(coalesce(1.0::double / b, 0)), 9) as mrr_b, count(*) filter (where a is null and b is not null) as hit_gains, count(*) filter (where a is not null and b is null) as hit_losses,
 count(*) filter (where coalesce(1.0 / b, 0) > coalesce(1.0 / a, 0)) as rank_gains, count(*) filter (where coalesce(1.0 / b, 0) < coalesce(1.0 / a, 0)) as rank_losses from f where not gap group by 1
""")
def paired_arm_report(spark, sf_dir):
    """Q03 by subsets."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderstatus").alias("subset"))
    return evaluate.paired_arms(_arm_ranks(spark, sf_dir).join(s, "question_id"), "keyword", "vector", ["subset"])


@query("broken_blocks", "select 'quote' as type, count(distinct (doc_id, t)) as blocks, count(distinct (doc_id, t)) filter (where doc_id % 3 = 0) as broken from (select doc_id, trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g')) as t from documents)")
def broken_blocks(spark, sf_dir):
    """Q05: the beginnings of documents as protected blocks; in every third document the chunk is cut inside."""
    d = table(spark, sf_dir, "documents")
    b = d.select("doc_id", F.lit("quote").alias("type"), F.substring("text", 1, 60).alias("text"))
    return evaluate.broken_blocks(b, d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(F.col("text")).alias("chunk_text")))


@query("known_unknown", "select count(*) as total, count(*) filter (where quality = 1) as correct, round(count(*) filter (where quality = 1) / count(*)::double, 9) as accuracy, count(*) filter (where doc_id % 4 <> 0 and toxic = 1) as known_false_refusals, count(*) filter (where doc_id % 4 <> 0 and quality = 0 and toxic = 0) as known_wrong, count(*) filter (where doc_id % 4 = 0 and quality = 0 and toxic = 0) as unknown_wrong from labels")
def known_unknown(spark, sf_dir):
    """Q11."""
    lab = table(spark, sf_dir, "labels")
    return evaluate.known_and_unknown(lab.select(F.when(F.col("doc_id") % 4 == 0, "unknown").otherwise("known").alias("group"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("abstained")))


@query("answer_report", """
with a as (select doc_id % 3 = 0 as gap, case when doc_id % 4 = 0 then -1 else quality * 0.5 end as acc, case when doc_id % 5 = 0 then null else toxic = 0 end as sup, quality = 1 as cov, toxic = 1 as ref, doc_id % 100 as ms, doc_id % 1000 as ti, doc_id % 300 as t2 from labels)
select count(*) as cases, round(avg(acc) filter (where acc >= 0), 9) as accuracy, round(avg(sup::int) filter (where not gap and sup is not null), 9) as support, round(avg(cov::int) filter (where not gap), 9) as coverage, round(avg(ref::int) filter (where gap), 9) as no_answer_accuracy, count(*) filter (where not gap and ref) as false_refusals,
 round(avg(ms), 3) as latency_ms, sum(ti + t2)::bigint as tokens, round((sum(ti) * 2.0 + sum(t2) * 6.0) / 1e6, 9)::double as cost from a
""")
def answer_report(spark, sf_dir):
    """D20, J09."""
    k = F.col("doc_id")
    a = table(spark, sf_dir, "labels").select((k % 3 == 0).alias("gap"), F.when(k % 4 == 0, -1.0).otherwise(F.col("quality") * 0.5).alias("accuracy"), F.when(k % 5 != 0, F.col("toxic") == 0).alias("supported"), (F.col("quality") == 1).alias("covers_all"), (F.col("toxic") == 1).alias("refusal"), (k % 100).alias("latency_ms"), (k % 1000).alias("tokens_in"), (k % 300).alias("tokens_out"))
    return evaluate.answer_report(a, 2.0, 6.0)


@query("facet_coverage", "with h as (select distinct l_orderkey as q, l_suppkey % 4 as f from lineitem where l_linenumber <= 2), r as (select o_orderkey as q, unnest([0, 1, 2]) as f from orders where o_orderkey % 3 > 0), p as (select r.q, avg((h.f is not null)::int) as c from r left join h on h.q = r.q and h.f = r.f group by 1) select l.q as question_id, round(coalesce(c, 1.0), 9) as facet_coverage from (select distinct l_orderkey as q from lineitem) l left join p on p.q = l.q")
def facet_coverage(spark, sf_dir):
    """Suppliers as facets; a third of the questions requires none."""
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"), F.array(F.col("l_suppkey") % 4).alias("facets"))
    need = table(spark, sf_dir, "orders").filter("o_orderkey % 3 > 0").select(F.col("o_orderkey").alias("question_id"), F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 1, 2)])).alias("facet"))
    return evaluate.facet_coverage(ranked, need, 2)


@query("sql_table_functions", "select doc_id, 1::bigint as sections, 2::bigint as symbols from documents where trim(text) <> ''")
def sql_table_functions(spark, sf_dir):
    """The registered table functions in SQL."""
    udtf.register(spark)
    table(spark, sf_dir, "documents").filter("trim(text) <> ''").createOrReplaceTempView("loreweave_documents")
    sections = spark.sql("select doc_id, count(*) as sections from loreweave_documents d, lateral wiki_sections(concat('# Head\\n', replace(d.text, '\\n', ' '))) group by doc_id")
    found = spark.sql("select doc_id, count(*) as symbols from loreweave_documents d, lateral extract_symbols(concat('class A', d.doc_id, ':\\n    def f(self): pass'), 'python') group by doc_id")
    return sections.join(found, "doc_id")


@query("lossless_parts", "select doc_id, ceil(length(text) / 700.0)::integer as parts, sha256(text) as whole from documents where not contains(text, chr(10)) and not contains(text, chr(13)) and not contains(text, '$$') and trim(text) <> ''")
def lossless_parts(spark, sf_dir):
    """The parts of one-line texts without formulas join to the text again."""
    import pandas as pd

    @F.pandas_udf("array<string>")
    def parts(texts):
        return pd.Series([chunk.split_lossless(t, 700) for t in texts])

    d = spread(table(spark, sf_dir, "documents").filter("not contains(text, '\n') and not contains(text, '\r') and not contains(text, '$$') and trim(text) <> ''")).select("doc_id", parts("text").alias("p"))
    return d.select("doc_id", F.size("p").alias("parts"), F.sha2(F.array_join("p", ""), 256).alias("whole"))


@query("chunk_strategies", "select doc_id, case when doc_id % 3 > 0 and length(text) >= 4000 and doc_id % 5 >= 2 then 'semantic' else 'structure' end as strategy from documents")
def chunk_strategies(spark, sf_dir):
    """L05 with its three conditions."""
    from loreweave.config import Config

    k = F.col("doc_id")
    kind = F.when(k % 3 > 0, "file").otherwise("note")
    return table(spark, sf_dir, "documents").select("doc_id", chunk.strategy(kind, F.col("text"), k % 5, Config(chunk_strategy="semantic_long")).alias("strategy"))


@query("corpus_digest", f"with h as (select sha256('file:' || doc_id || ':' || sha256(text)) as h from documents where text <> '') select substr({FREE}, 1, 16) as digest from h")
def corpus_digest(spark, sf_dir):
    """Q09 as an order-free digest of all sources."""
    line = F.concat_ws(":", "source_type", F.col("source_id").cast("string"), F.sha2("content", 256))
    return views.corpus(spark, sf_dir).agg(F.substring(wiki.order_free_hash(line), 1, 16).alias("digest"))


@query("next_sources", "select * from (select 's' || lpad(s_suppkey::varchar, 9, '0') as source_key from supplier order by 's' || lpad(s_suppkey::varchar, 9, '0') <= 's000000007', 1 limit 8)")
def next_sources(spark, sf_dir):
    """Eight sources behind the seventh, from the beginning again where they end."""
    from loreweave.operators import maintain

    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("source_key"))
    return maintain.rotated(s, "s000000007", 8)


@query("layout_sizes", """
with l as (select l_suppkey as doc_id, cast(l_discount * 100 as integer) as size, l_partkey % 90 as chars, case when l_linenumber > 1 then l_quantity end as gap from lineitem),
s as (select doc_id, size, sum(chars) as n from l group by 1, 2), b as (select *, row_number() over (partition by doc_id order by n desc, size) as k from s),
g as (select doc_id, gap, row_number() over (partition by doc_id order by gap) as i, count(*) over (partition by doc_id) as n from l where gap is not null)
select b.doc_id, b.size as body_size, (select min(gap) from g where g.doc_id = b.doc_id and i = greatest(ceil(n * 40 / 100.0), 1)) as line_gap from b where k = 1
""")
def layout_sizes(spark, sf_dir):
    """Order lines as lines of a supplier's document."""
    from loreweave.operators import html

    li = table(spark, sf_dir, "lineitem")
    return html.layout_sizes(li.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_discount") * 100).cast("int").alias("size"), (F.col("l_partkey") % 90).alias("chars"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("gap")))


@query("title_stripping", "select doc_id, case when doc_id % 3 = 0 then text when doc_id % 3 = 1 then text else '# Other' || chr(10) || text end as body from documents")
def title_stripping(spark, sf_dir):
    """A heading that repeats the title goes, another stays."""
    from loreweave.functions import text

    k = F.col("doc_id") % 3
    content = F.when(k == 0, F.concat(F.lit("# "), "source", F.lit(": notes\n\n"), F.ltrim("text"))).when(k == 1, F.col("text")).otherwise(F.concat(F.lit("# Other\n"), "text"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.without_title(content, F.col("source")).alias("body"))


@query("canonical_json", "select event_id, '{\"a\":[1,2.5,{\"x\":null}],\"k\":' || (props->>'$.k') || ',\"z\":' || event_id || '}' as canonical from events")
def canonical_json(spark, sf_dir):
    """Keys in any order, numbers with needless zeros."""
    from loreweave.functions import text

    raw = F.concat(F.lit('{"z": '), "event_id", F.lit('.0, "k": '), F.get_json_object("props", "$.k"), F.lit('.00, "a": [1.0, 2.50, {"x": null}]}'))
    return table(spark, sf_dir, "events").select("event_id", text.canonical(raw).alias("canonical"))


@query("registered_step", "select o_orderkey, cents * 2 as doubled from (select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents from orders where o_orderstatus = 'F')")
def registered_step(spark, sf_dir):
    """A Python function as a step of a workflow."""
    from loreweave.operators import workflow

    o = table(spark, sf_dir, "orders").withColumn("ordinal", F.col("o_orderkey"))
    steps = [{"id": "a", "op": "filter", "input": "o", "field": "o_orderstatus", "test": "eq", "value": "F"}, {"id": "b", "op": "python", "input": "a", "function": "double"}]
    twice = lambda df: df.select("o_orderkey", (F.round(F.col("o_totalprice") * 100).cast("long") * 2).alias("doubled"), "ordinal")
    return workflow.compile_workflow({"steps": steps}, {"o": o}, functions={"double": twice}).drop("ordinal")


EVENT_SCHEMA = {
    "type": "object", "additionalProperties": False, "required": ["kind", "props"],
    "properties": {
        "kind": {"type": "string", "enum": ["click", "view", "purchase"], "maxLength": 20}, "amount": {"type": ["number", "null"], "minimum": 1, "exclusiveMaximum": 90},
        "props": {"type": "object", "properties": {"k": {"type": "integer", "maximum": 80}}, "required": ["k"]}, "tags": {"type": "array", "maxItems": 3, "items": {"type": "integer", "minimum": 2}},
    },
}


@query("schema_violations", """
select event_id, case when event_type not in ('click', 'view', 'purchase') then 'value.kind is not an allowed enum value' when value < 1 then 'value.amount violates minimum' when value >= 90 then 'value.amount violates exclusiveMaximum'
  when user_id % 7 = 0 then 'value.props.k is required' when (props->>'$.k')::int > 80 then 'value.props.k violates maximum' when event_id % 5 > 3 then 'value.tags exceeds maxItems'
  when event_id % 5 > 0 and user_id % 3 < 2 then 'value.tags[' || 0 || '] violates minimum' when event_id % 11 = 0 then 'value contains undeclared property: more' end as violation from events
""")
def schema_violations(spark, sf_dir):
    """Events written as JSON against a nested schema; the first violation of each."""
    from loreweave.operators import schemas

    tag = F.concat((F.col("user_id") % 3).cast("string"))
    tags = F.array_join(F.array_repeat(tag, (F.col("event_id") % 5).cast("int")), ",")
    props = F.when(F.col("user_id") % 7 == 0, F.replace("props", F.lit('"k"'), F.lit('"q"'))).otherwise(F.col("props"))
    amount = F.coalesce(F.col("value").cast("string"), F.lit("null"))
    body = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", "amount": '), amount, F.lit(', "props": '), props, F.lit(', "tags": ['), tags, F.lit("]"), F.when(F.col("event_id") % 11 == 0, ', "more": 1').otherwise(""), F.lit("}"))
    events = table(spark, sf_dir, "events").select("event_id", body.alias("body"))
    return schemas.violations(events, EVENT_SCHEMA, "body").select("event_id", "violation")


@query("eval_leakage", """
with d as (select distinct regexp_replace(lower(text), '[^\\pL\\pN]', '', 'g') as t from documents), e as (select item_id, text, regexp_replace(lower(text), '[^\\pL\\pN]', '', 'g') as t from benchmark),
o as (select item_id, d.t from e join d on d.t <> '' and e.t <> '' and (contains(d.t, e.t) or contains(e.t, d.t)))
select item_id as eval_id, count(o.t) as overlaps, md5(min(o.t)) as example, item_id % 2 = 0 as answer_inside from e left join o using (item_id) group by item_id
""")
def eval_leakage(spark, sf_dir):
    """Benchmark passages that stand in documents, and the other way round."""
    from loreweave.operators import leakage

    q = views.questions(spark, sf_dir)
    answer = F.when(F.col("question_id") % 2 == 0, F.substring("question", 3, 20)).otherwise("0zq0")
    e = q.select(F.col("question_id").alias("eval_id"), "question", F.array(answer).alias("answers"))
    found = leakage.leakage(table(spark, sf_dir, "documents").select(F.col("text").alias("question")), e)
    return found.withColumn("example", F.md5("example"))
