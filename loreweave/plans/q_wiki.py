"""Queries of derived pages: channels, snapshots, fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import chunk, wiki
from loreweave.plans.registry import query
from loreweave.sources import spread, table, views

LINES = r"lines as (select doc_id, source, lang, trim(unnest(string_split_regex(text, '\n+'))) as body, generate_subscripts(string_split_regex(text, '\n+'), 1) - 1 as section from documents)"


def _sections(spark, sf_dir):
    """Paragraph lines of documents as sections; every seventh is headed as a gap."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "source", "lang", F.posexplode(F.split("text", r"\n+")).alias("section", "body"))
    heading = F.when((F.col("page_id") + F.col("section")) % 7 == 0, "knowledge gaps").otherwise(F.concat(F.lit("about "), "source"))
    return d.select("page_id", F.concat(F.lit("k"), F.col("page_id") + 100_000).alias("topic_key"), "section", F.concat(F.col("lang"), F.lit(" Page"), F.col("page_id") % 5).alias("names"), heading.alias("heading"), F.trim("body").alias("body"))


def _questions(spark, sf_dir):
    """Five questions of different kinds."""
    r = table(spark, sf_dir, "region")
    texts = F.array(*map(F.lit, ["what is Page1", "compare Page2 and ofof", "which gaps are in src3", "explain onand theof", "Page4 system tion ble"]))
    return r.select(F.col("r_regionkey").alias("question_id"), F.element_at(texts, F.col("r_regionkey") + 1).alias("question"))


ASKED = """
q(question_id, terms, subjects, gap, definition) as (values (0, ['page1'], ['page1'], false, true), (1, ['page2', 'ofof'], ['page2', 'ofof'], false, false), (2, ['src3'], ['src3'], true, false), (3, ['onand', 'theof'], ['onand', 'theof'], false, true), (4, ['page4', 'system', 'tion', 'ble'], ['page4', 'tion', 'ble'], false, false)),
w as (select question_id, '(^|[^a-z0-9_])(' || array_to_string(subjects, '|') || ')($|[^a-z0-9_])' as pattern from q)
"""


@query("wiki_terms", "select * from (values (0, 'Page1', 'Page1', false, true), (1, 'Page2,ofof', 'Page2,ofof', false, false), (2, 'src3', 'src3', true, false), (3, 'onand,theof', 'onand,theof', false, true), (4, 'Page4,system,tion,ble', 'Page4,tion,ble', false, false)) t(question_id, terms, subjects, gap, definition)")
def wiki_terms(spark, sf_dir):
    """H24 and the gates of M05."""
    return wiki.asked(_questions(spark, sf_dir)).select("question_id", F.array_join("terms", ",").alias("terms"), F.array_join("subjects", ",").alias("subjects"), "gap", "definition")


@query("wiki_channel", f"""
with {LINES}, s as (select doc_id as page_id, 'k' || (doc_id + 100000) as topic_key, section, lower(lang || ' Page' || (doc_id % 5)) as names, case when (doc_id + section) % 7 = 0 then 'knowledge gaps' else 'about ' || source end as heading, lower(body) as body from lines where body <> ''),
{ASKED}, j as (select q.question_id, s.*, terms, regexp_matches(names, pattern) as named from s, q join w using (question_id)
 where (gap or heading <> 'knowledge gaps') and (not definition or regexp_matches(names, pattern) or regexp_matches(heading, pattern)) and regexp_matches(names || chr(10) || heading || chr(10) || body, pattern)),
c as (select question_id, page_id, topic_key, section, named, 3 * len([t for t in terms if contains(body, t)]) + 6 * len([t for t in terms if contains(heading, t)]) + 3 * len([t for t in terms if contains(names, t)]) as score from j),
k as (select *, case when named then score + 1000 else score end as s2 from c where score > 0), n as (select *, row_number() over (partition by question_id, page_id order by s2 desc, topic_key, section) as n from k)
select question_id, page_id, section, s2 as score, rank from (select *, row_number() over (partition by question_id order by n, s2 desc, topic_key, section) as rank from n where n <= 2) where rank <= 24
""")
def wiki_channel(spark, sf_dir):
    """M05 with its gates, E04."""
    hits = wiki.section_channel(_sections(spark, sf_dir), _questions(spark, sf_dir))
    return hits.select("question_id", "page_id", F.col("section").cast("long").alias("section"), F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("wiki_sources", f"""
with {ASKED}, f as (select doc_id % 5 as question_id, row_number() over (partition by doc_id % 5 order by doc_id) as rank, source as heading, 'Page' || (doc_id % 5) as title, ['file-' || doc_id, 'file-' || (doc_id + 20)] as refs from documents),
u as (select question_id, rank, heading, title, unnest(refs) as ref, generate_subscripts(refs, 1) as i from f),
g as (select question_id, ref, min(rank * 10 + i) as pos, string_agg(distinct heading, ' ' order by heading) as h, min(title) as t from u group by 1, 2),
p as (select *, row_number() over (partition by question_id order by pos, ref) as n from g),
b as (select p.question_id, d.doc_id as source_id, d.source as title, q.terms, q.subjects || [lower(p.t)] as subj, list_distinct(string_split(p.h || ' ' || lower(p.t), ' ')) as hterms, chr(10) || lower(d.text) as body from p join documents d on p.ref = 'file-' || d.doc_id join q on q.question_id = p.question_id where n <= 24),
k as (select question_id, source_id, 3 * len([t for t in terms if contains(body, t)]) + 2 * len([t for t in hterms if contains(body, t)]) + 3 * len([t for t in terms if contains(title, t)]) as score from b where regexp_matches(title || chr(10) || body, '(^|[^a-z0-9_])(' || array_to_string(list_distinct(subj), '|') || ')($|[^a-z0-9_])'))
select question_id, source_id, score, rank from (select *, row_number() over (partition by question_id order by score desc, 'file:' || source_id || ':0') as rank from k where score > 0) where rank <= 24
""")
def wiki_sources(spark, sf_dir):
    """Documents cited by pages that stand for documents."""
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 5
    order = Window.partitionBy("question_id").orderBy("doc_id")
    found = d.withColumn("question_id", k).select("question_id", F.row_number().over(order).alias("rank"), F.col("source").alias("heading"), F.concat(F.lit("Page"), k).alias("title"), F.array(F.concat(F.lit("file-"), "doc_id"), F.concat(F.lit("file-"), F.col("doc_id") + 20)).alias("refs"))
    passages = d.select(F.lit("file").alias("source_type"), F.col("doc_id").alias("source_id"), F.lit(0).alias("seq"), F.col("source").alias("title"), F.lit("").alias("heading"), F.col("text").alias("body"))
    hits = wiki.located_sources(found, _questions(spark, sf_dir), passages)
    return hits.select("question_id", "source_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("eligible_pages", "select doc_id from documents where doc_id % 4 <> 3 and doc_id % 5 <> 0 and doc_id % 6 <> 0 and trim(text) <> ''")
def eligible_pages(spark, sf_dir):
    """B09."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ["category", "tag", "entity", "index"])), (k % 4 + 1).cast("int"))
    p = d.select("doc_id", kind.alias("topic_type"), F.when(k % 5 == 0, "warn").otherwise("ok").alias("quality"), F.when(k % 6 == 0, " ").otherwise(F.concat(F.lit("k"), k)).alias("topic_key"), F.col("text").alias("content"))
    return wiki.eligible(p).select("doc_id")


@query("whole_sections", """
with recursive s as (select conv_id as reader, turn + 1 as rank, text as body from conversations), o as (select *, row_number() over (partition by reader order by rank) as i from s),
f as (select reader, rank, i, case when length(body) + 2 <= 402 then length(body) + 2 else 0 end as used, length(body) + 2 <= 402 as taken from o where i = 1
 union all select o.reader, o.rank, o.i, case when f.used + length(o.body) + 2 <= 402 then f.used + length(o.body) + 2 else f.used end, f.used + length(o.body) + 2 <= 402 from f join o on o.reader = f.reader and o.i = f.i + 1)
select reader, rank from f where taken
""")
def whole_sections(spark, sf_dir):
    """Turns of a conversation as sections, four hundred characters a reading."""
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("reader"), (F.col("turn") + 1).alias("rank"), F.col("text").alias("body"))
    return wiki.read_whole(s, 400).select("reader", "rank")


@query("legacy_block", """
with q(question_id, terms) as (values (0, ['what', 'is', 'page1']), (1, ['compare', 'page2', 'and', 'ofof']), (2, ['which', 'gaps', 'are', 'in', 'src3']), (3, ['explain', 'onand', 'theof']), (4, ['page4', 'system', 'tion', 'ble'])),
p as (select doc_id as page_id, lower(source || ' Page' || (doc_id % 5)) as title, lower(text) as content, length(text) as n from documents where trim(text) <> ''),
s as (select question_id, page_id, n, 3 * len([t for t in terms if contains(title, t)]) as t, list_sum([case when contains(title, x) then 3 when contains(content, x) then 1 else 0 end for x in terms]) as s from q, p),
r as (select *, row_number() over (partition by question_id order by t desc, s desc, n, page_id) as rank from s where s >= 3), u as (select *, sum(40 + page_id % 90) over (partition by question_id order by rank) as used from r where rank <= 2)
select question_id, page_id, rank from u where used <= 150
""")
def legacy_block(spark, sf_dir):
    """O10."""
    p = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.col("source"), F.lit(" Page"), F.col("doc_id") % 5).alias("title"), F.col("text").alias("content"), F.rpad(F.lit("x"), F.lit(40) + F.col("doc_id").cast("int") % 90, F.lit("x")).alias("entry"))
    return wiki.legacy_pages(p, _questions(spark, sf_dir), 350).withColumn("rank", F.col("rank").cast("long"))


SOURCE_ROWS = "select 'file' as source_type, o_orderkey as source_id, 't' || o_orderkey as title, o_orderpriority || ' of ' || o_custkey as content"


def _versions(spark, sf_dir, changed=False):
    """Orders as sources of two chunks; some change, vanish or get a new title."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    body = F.concat("o_orderpriority", F.lit(" of "), "o_custkey")
    if changed:
        o = o.filter(k % 17 != 0)
        body = F.when(k % 13 == 0, F.concat(body, F.lit(" changed"))).otherwise(body)
    title = F.concat(F.lit("t"), F.when(k % 11 == 0, -k).otherwise(k)) if changed else F.concat(F.lit("t"), k)
    s = o.select(F.lit("file").alias("source_type"), k.alias("source_id"), title.alias("title"), body.alias("content"))
    two = F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit("h").alias("heading"), F.concat(F.lit("a "), "content").alias("chunk_text")), F.struct(F.lit(1).alias("seq"), F.lit("h").alias("heading"), F.concat(F.lit("b "), "content").alias("chunk_text"))))
    return wiki.snapshot(s, s.select("source_type", "source_id", two.alias("c")).select("source_type", "source_id", "c.*"))


@query("snapshot_rows", "with s as (" + SOURCE_ROWS + " from orders), c as (select *, unnest([0, 1]) as seq from s) select source_id, seq, title, sha256(content) as content_hash, sha256(case seq when 0 then 'a ' else 'b ' end || content) as chunk_hash, 2::bigint as chunk_count, length(content) as source_chars from c")
def snapshot_rows(spark, sf_dir):
    """O01."""
    return _versions(spark, sf_dir).select("source_id", F.col("seq").cast("int").alias("seq"), "title", "content_hash", "chunk_hash", "chunk_count", F.col("source_chars").cast("long").alias("source_chars"))


@query("dependency_states", """
with w as (select o_custkey as page_id, o_orderkey as id from orders where o_custkey % 3 <> 0),
r as (select page_id, case when page_id % 19 = 0 then 'page_changed' when id % 17 = 0 then 'source_missing' when id % 13 = 0 or id % 11 = 0 then 'source_changed' end as why from w),
g as (select page_id, coalesce(string_agg(distinct why, ',' order by why), '') as why from r group by 1)
select c_custkey as page_id, case when g.page_id is null or c_custkey % 10 = 1 then 'unknown' when why = '' then 'current' else 'stale' end as state,
 case when g.page_id is null then case when c_custkey % 2 = 0 then 'dependency_record_missing' else 'legacy_no_dependencies' end when c_custkey % 10 = 1 then 'dependency_record_invalid' else why end as reasons from customer left join g on g.page_id = c_custkey
""")
def dependency_states(spark, sf_dir):
    """Customers as pages over the first chunks of their orders; every tenth record is damaged."""
    o = table(spark, sf_dir, "orders").filter("o_custkey % 3 <> 0")
    wanted = o.select(F.col("o_custkey").alias("page_id"), F.lit("file").alias("source_type"), F.col("o_orderkey").alias("source_id"), F.lit(0).alias("seq"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("page_hash"), F.when(F.col("c_custkey") % 2 == 0, 2).otherwise(1).alias("version"))
    deps = wiki.dependencies(_versions(spark, sf_dir), wanted, pages.select("page_id", "page_hash"))
    deps = deps.withColumn("chunk_text", F.when(F.col("page_id") % 10 == 1, "damaged").otherwise(F.col("chunk_text")))
    now = pages.withColumn("page_hash", F.when(F.col("page_id") % 19 == 0, "new").otherwise(F.col("page_hash")))
    return wiki.dependency_states(now, deps, _versions(spark, sf_dir, True))


@query("compact_source_hash", """
with recursive s as (select o_custkey as page_id, list_sort(list_distinct(list('n' || o_orderkey))) as c from orders group by 1),
f as (select page_id, c, 1 as i, 'src:' || c[1] as s, false as done from s union all select page_id, c, i + 1, case when length(s) + 1 + length(c[i + 1]) <= 64 and not done then s || ',' || c[i + 1] else s end, done or length(s) + 1 + length(c[i + 1]) > 64 from f where i < len(c))
select page_id, s as sources from f where i = len(c)
""")
def compact_source_hash(spark, sf_dir):
    """O06."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.collect_list(F.concat(F.lit("n"), "o_orderkey")).alias("codes"))
    return o.select("page_id", wiki.compact_sources(F.col("codes")).alias("sources"))


FREE = views.ORDER_FREE


@query("index_fingerprint", f"select 'index-' || substr({FREE}, 1, 16) as fingerprint from (select sha256(p_partkey || chr(1) || p_name) as h from part)")
def index_fingerprint(spark, sf_dir):
    """O07."""
    return wiki.index_fingerprint(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("topic_key"), F.col("p_name").alias("title")))


@query("wiki_lint", """
with p as (select 'doc ' || doc_id as title, case when doc_id % 9 = 0 then 'warn' else 'ok' end as quality, text || ' [[doc ' || (doc_id + 4) || ']]' as c from documents)
select count(*) as pages, count(*) filter (where quality = 'warn') as warned, count(*) filter (where length(trim(c)) < 200) as short, (select count(*) from documents where doc_id + 4 not in (select doc_id from documents)) as red_links from p
""")
def wiki_lint(spark, sf_dir):
    """O09."""
    d = table(spark, sf_dir, "documents")
    p = d.select(F.concat(F.lit("doc "), "doc_id").alias("title"), F.when(F.col("doc_id") % 9 == 0, "warn").otherwise("ok").alias("quality"), F.concat("text", F.lit(" [[doc "), F.col("doc_id") + 4, F.lit("]]")).alias("content"))
    return wiki.lint(p)


@query("snapshot_of_documents")
def snapshot_of_documents(spark, sf_dir):
    """O01 over structural chunks of all documents."""
    c = views.corpus(spark, sf_dir)
    s = wiki.snapshot(c, chunk.chunk(spread(c)))
    return s.select("source_id", "seq", "content_hash", "chunk_hash", "chunk_count")
