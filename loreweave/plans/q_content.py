"""Content queries: HTML, chunks, code, lineage, evaluation, workflows, context."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.operators import chunk, code, context, evaluate, html, lineage, search, workflow
from loreweave.plans.q_retrieval import KEYWORD, passages
from loreweave.plans.registry import query
from loreweave.sources import spread, table, views


@query("html_markdown")
def html_markdown(spark, sf_dir):
    return html.markdown(spread(table(spark, sf_dir, "pages")))


@query("html_dom_markdown")
def html_dom_markdown(spark, sf_dir):
    return html.markdown(spread(table(spark, sf_dir, "pages")), html.dom_markdown)


@query("html_title_links", r"select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, cast(len(regexp_extract_all(html, '<a href=')) as integer) as links, contains(html, '<pre') as has_code from pages")
def html_title_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a href=")).alias("links"), F.contains("html", F.lit("<pre")).alias("has_code"))


@query("page_furniture", """
with b as (select l_suppkey as doc_id, l_orderkey as page, l_linenumber as block_id, 'Page ' || case when l_linenumber <= 2 then 'head' else l_comment end as text, case when l_linenumber = 1 then 0.05 when l_linenumber = 2 then 0.95 else 0.5 end as top from (select *, cast(l_orderkey as varchar) as l_comment from lineitem)),
k as (select *, case when top <= 0.05 or top >= 0.9 then regexp_replace(lower(text), '[0-9]+', '#', 'g') end as key from b),
p as (select doc_id, count(distinct page) as pages from b group by 1), o as (select doc_id, key, count(distinct page) as n from k where key is not null group by 1, 2)
select k.doc_id, count(*) filter (where o.n >= greatest(3, ceil(pages * 0.6))) as furniture, count(*) as n from k join p using (doc_id) left join o on o.doc_id = k.doc_id and o.key = k.key group by 1
""")
def page_furniture(spark, sf_dir):
    """A14 on order lines as page blocks: the first two of a page are its margins."""
    li = table(spark, sf_dir, "lineitem")
    top = F.when(F.col("l_linenumber") == 1, 0.05).when(F.col("l_linenumber") == 2, 0.95).otherwise(0.5)
    b = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block_id"), F.concat(F.lit("Page "), F.when(F.col("l_linenumber") <= 2, "head").otherwise(F.col("l_orderkey").cast("string"))).alias("text"), top.alias("top"), (top + 0.04).alias("bottom"))
    return html.furniture(b).groupBy("doc_id").agg(F.count_if("furniture").alias("furniture"), F.count("*").alias("n"))


@query("chunk_structural")
def chunk_structural(spark, sf_dir):
    return chunk.chunk(spread(views.corpus(spark, sf_dir)))


@query("chunk_strategy", "select doc_id, case when length(text) >= 4000 then 'semantic' else 'structure' end as strategy from documents")
def chunk_strategy(spark, sf_dir):
    cfg = Config()
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.char_length("text") >= cfg.semantic_min_chars, "semantic").otherwise("structure").alias("strategy"))


@query("heading_paths", r"""
with l as (select doc_id, line, i from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
k as (select doc_id, i, case when i % 5 = 1 then 1 when i % 5 = 3 then 2 end as level, substr(line, 1, 12) as t from l),
w as (select doc_id, i, last_value(case when level = 1 then t end ignore nulls) over (partition by doc_id order by i) as h1, last_value(case when level = 1 then i end ignore nulls) over (partition by doc_id order by i) as p1,
 last_value(case when level = 2 then t end ignore nulls) over (partition by doc_id order by i) as h2, last_value(case when level = 2 then i end ignore nulls) over (partition by doc_id order by i) as p2 from k)
select doc_id, i as line_no, concat_ws(' > ', trim(h1), case when p2 > coalesce(p1, 0) then trim(h2) end) as heading_path from w
""")
def heading_paths(spark, sf_dir):
    """E14 over the lines of documents, every fifth line made a heading."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("line_no", F.col("p") + 1)
    t = F.concat(F.lit("x"), F.substring("line", 1, 12))
    marked = lines.withColumn("text", F.when(F.col("line_no") % 5 == 1, F.concat(F.lit("# "), t)).when(F.col("line_no") % 5 == 3, F.concat(F.lit("## "), t)).otherwise("-"))
    out = chunk.heading_paths(marked, ["doc_id"], "line_no", "text")
    parts = F.transform(F.split("heading_path", " > x"), lambda x: F.trim(x))
    clean = F.regexp_replace(F.array_join(parts, "\u0001"), "^x", "")
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.array_join(F.transform(F.split(clean, "\u0001"), lambda x: F.trim(x)), " > ").alias("heading_path"))


def _files(spark, sf_dir):
    """Stand-in source files: documents under paths that meet every import rule."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 9
    path = F.when(k == 0, "src/node_modules/a.js").when(k == 1, "yarn.lock").when(k == 2, "web/app.min.js").when(k == 3, "web/app.js.map").when(k == 4, "img/logo.png").when(k == 5, F.concat(F.lit("src/Main"), "doc_id", F.lit(".java"))).when(k == 6, F.concat(F.lit("tools/run"), "doc_id", F.lit(".py"))).when(k == 7, "src/app.go").otherwise("docs/a.md")
    return d.select("doc_id", path.alias("path"), "text")


@query("import_reject_hist", """
select case doc_id % 9 when 0 then 'ignored directory' when 1 then 'lock or system file' when 2 then 'minified' when 3 then 'source map' when 4 then 'binary' else 'imported' end as reason, count(*) as n from documents group by 1
""")
def import_reject_hist(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.groupBy(F.coalesce(code.reject_reason(F.col("path"), F.col("text")), F.lit("imported")).alias("reason")).agg(F.count("*").alias("n"))


@query("import_languages", "select case doc_id % 9 when 5 then 'java' when 6 then 'python' when 7 then 'go' else 'markdown' end as language, count(*) as n from documents where doc_id % 9 >= 5 group by 1")
def import_languages(spark, sf_dir):
    f = _files(spark, sf_dir).filter(code.reject_reason(F.col("path"), F.col("text")).isNull())
    return f.groupBy(code.language(F.col("path"), F.col("text")).alias("language")).agg(F.count("*").alias("n"))


@query("symbols", "select 'm' || doc_id || '.py' as path, unnest(['class', 'function', 'const']) as kind, unnest(['Doc' || doc_id, source, 'MOST']) as name, unnest([1, 2, 4]) as line from documents")
def symbols(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.concat(F.lit("m"), "doc_id", F.lit(".py")).alias("path"), F.lit("python").alias("lang"), F.concat(F.lit("class Doc"), "doc_id", F.lit(":\n    def "), "source", F.lit("(self):\n        pass\nMOST = 3\n")).alias("text"))
    return code.symbols(f)


@query("identifier_lists", """
with w as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{2,}')) as w, generate_subscripts(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{2,}'), 1) as i from documents),
f as (select doc_id, w, min(i) as i from w group by 1, 2), n as (select *, row_number() over (partition by doc_id order by i) as n from f where w is not null)
select doc_id, string_agg(w, ',' order by n) as identifiers from n where n <= 400 group by 1
""")
def identifier_lists(spark, sf_dir):
    """P02 over whole texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", code.identifiers(F.col("text")).alias("ids"))
    return d.filter(F.size("ids") > 0).select("doc_id", F.array_join("ids", ",").alias("identifiers"))


@query("line_window", """
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
r as (select *, sum(length(line) + 1) over (partition by doc_id order by i rows unbounded preceding) as run from l where i >= 2 and i < 82) select cast(doc_id as varchar) as path, i as line, line as text from r where run <= 4000
""")
def line_window(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return code.line_window(f, 2).withColumn("line", F.col("line").cast("long"))


@query("symbol_search", "with n as (select distinct p_brand as name from part) select name from n where starts_with(lower(name), 'brand#1')")
def symbol_search(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit("x").alias("path"), F.lit(1).alias("line")).distinct()
    return code.symbol_search(f, "Brand#1").select("name")


def _wiki(spark, sf_dir):
    """Stand-in pages: per source a page that cites some documents and links some others."""
    d = table(spark, sf_dir, "documents")
    body = F.concat(F.lit("## Part\n"), "text", F.lit("\n[资料#"), F.col("doc_id"), F.lit("] [note#"), F.col("doc_id") % 7, F.lit("] [[doc "), F.col("doc_id") + 4, F.lit("]]"))
    return d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("doc "), "doc_id").alias("title"), body.alias("markdown"), F.array(F.concat(F.lit("file-"), "doc_id"), F.lit("note-1")).alias("valid"))


@query("wiki_quality", """
with p as (select doc_id, '## Part' || chr(10) || text || chr(10) || '[资料#' || doc_id || '] [note#' || (doc_id % 7) || '] [[doc ' || (doc_id + 4) || ']]' as m from documents),
c as (select doc_id, length(m) as n, doc_id % 7 <> 1 as unknown from p)
select doc_id as page_id, not unknown and n >= 260 as ok, concat_ws('; ', case when unknown then 'unknown citations' end, case when n < 260 then 'too short' end) as hard, case when unknown then 'few citations' else '' end as soft from c
""")
def wiki_quality(spark, sf_dir):
    return lineage.quality(_wiki(spark, sf_dir))


@query("redlinks", "select 'doc ' || doc_id as title, 'doc ' || (doc_id + 4) as link from documents where doc_id + 4 not in (select doc_id from documents)")
def redlinks(spark, sf_dir):
    return lineage.red_links(_wiki(spark, sf_dir))


@query("freshness_check", """
with d as (select o_custkey as page_id, o_orderkey as id, o_orderkey % 5 as old, case when o_orderkey % 17 = 0 then null else case when o_orderkey % 13 = 0 then -1 else o_orderkey % 5 end end as now, o_custkey % 19 = 0 as page_changed from orders),
w as (select page_id, min(case when page_changed then 1 when now is null then 2 when now <> old then 3 end) as why from d group by 1)
select c_custkey as page_id, case when w.page_id is null then 'unknown' when why is null then 'fresh' else 'stale' end as state, case why when 1 then 'page changed' when 2 then 'source missing' when 3 then 'source changed' else '' end as reason from customer left join w on w.page_id = c_custkey
""")
def freshness_check(spark, sf_dir):
    """O03 on customers as pages and their orders as sources."""
    o = table(spark, sf_dir, "orders")
    key = [F.lit("note").alias("source_type"), F.col("o_orderkey").alias("source_id")]
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.lit("h").alias("hash"))
    deps = o.select(F.col("o_custkey").alias("page_id"), F.when(F.col("o_custkey") % 19 == 0, "old").otherwise("h").alias("page_hash"), *key, (F.col("o_orderkey") % 5).cast("string").alias("source_hash"), F.lit("t").alias("title"))
    now = o.filter("o_orderkey % 17 <> 0").select(*key, F.when(F.col("o_orderkey") % 13 == 0, "-1").otherwise((F.col("o_orderkey") % 5).cast("string")).alias("hash"), F.lit("t").alias("title"))
    return lineage.freshness(pages, deps, now)


@query("stale_by_sources", "select c_custkey, coalesce(max(o_orderdate) > timestamp '1998-01-01', true) as stale from customer left join orders on o_custkey = c_custkey group by 1")
def stale_by_sources(spark, sf_dir):
    newest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("newest"))
    c = table(spark, sf_dir, "customer").join(newest, "c_custkey", "left")
    return c.select("c_custkey", F.coalesce(F.col("newest") > F.lit("1998-01-01").cast("timestamp_ntz"), F.lit(True)).alias("stale"))


@query("material_fingerprint", "select o_custkey as page_id, sha256(string_agg('note ' || o_orderkey || '@' || o_orderstatus || ';', '' order by 'note ' || o_orderkey || '@' || o_orderstatus || ';')) as fingerprint from orders group by 1")
def material_fingerprint(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page_id"), F.lit("note").alias("source_type"), F.col("o_orderkey").alias("source_id"), F.col("o_orderstatus").alias("updated"))
    return lineage.material_fingerprint(o)


@query("summary_status", "select case when s.s_nationkey is null then 'missing' when n_nationkey % 2 = 0 then 'fresh' else 'stale' end as state, count(*) as n from nation left join (select distinct s_nationkey from supplier) s on s_nationkey = n_nationkey group by 1")
def summary_status(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(1).alias("has")).distinct()
    n = table(spark, sf_dir, "nation").join(s, "n_nationkey", "left")
    return n.groupBy(F.when(F.col("has").isNull(), "missing").when(F.col("n_nationkey") % 2 == 0, "fresh").otherwise("stale").alias("state")).agg(F.count("*").alias("n"))


GOLD = "gold as (select item_id as question_id, doc_id as source_id from benchmark b join documents d on contains(d.text, b.text))"


def _gold(spark, sf_dir):
    """Documents that hold a question's passage verbatim, by the term automaton."""
    q = views.questions(spark, sf_dir)
    p = views.corpus(spark, sf_dir).select("source_type", "source_id", F.lit(0).alias("seq"), F.lit("").alias("title"), F.col("content").alias("body"))
    hits = search.term_hits(p, q.select(F.lower("question").alias("term")).distinct())
    return hits.join(q.withColumn("term", F.lower("question")), "term").select("question_id", "source_id").distinct()


@query("recall_mrr", f"""
with {KEYWORD}, {GOLD}, f as (select g.question_id, min(r) as first from gold g join ranked r on r.question_id = g.question_id and r.source_id = g.source_id and r.r <= 5 group by 1),
c as (select item_id, item_id not in (select question_id from gold) as gap, first from benchmark left join f on f.question_id = item_id)
select count(*) as cases, count(*) filter (where gap) as gap_cases, count(*) filter (where not gap and first is not null) as hits,
 floor(coalesce(count(*) filter (where not gap and first is not null) / nullif(count(*) filter (where not gap), 0)::double, 0) * 1000 + 0.5) / 1000 as recall,
 floor(coalesce(sum(case when not gap then coalesce(1.0 / first, 0) else 0 end)::double / nullif(count(*) filter (where not gap), 0), 0) * 1000 + 0.5) / 1000 as mrr from c
""")
def recall_mrr(spark, sf_dir):
    """Q01: keyword retrieval against the documents that hold the passage."""
    refs = _gold(spark, sf_dir).groupBy("question_id").agg(F.collect_list(F.concat(F.lit("file-"), "source_id")).alias("refs"))
    cases = views.questions(spark, sf_dir).join(refs, "question_id", "left").select("question_id", F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    ranked = search.keyword_channel(passages(spark, sf_dir), views.questions(spark, sf_dir)).select("question_id", F.concat(F.lit("file-"), "source_id").alias("ref"), "rank")
    return evaluate.recall_mrr(cases, ranked, 5)


@query("paired_outcomes", """
with x as (select doc_id % 3 as cohort, doc_id, quality = 1 as a, toxic = 0 as b from labels)
select cohort, count(*) as n, count(*) filter (where a and b) as "both", count(*) filter (where not a and b) as wins, count(*) filter (where a and not b) as losses, count(*) filter (where not a and not b) as neither from x group by 1
""")
def paired_outcomes(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    a = lab.select((F.col("doc_id") % 3).alias("cohort"), F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("ok"))
    return evaluate.paired(a, lab.select(F.col("doc_id").alias("question_id"), (F.col("toxic") == 0).alias("ok")), ["cohort"])


@query("ndcg_at_8", """
with r as (select l_orderkey as q, l_linenumber as rank, cast(l_quantity as integer) % 3 as grade, row_number() over (partition by l_orderkey order by cast(l_quantity as integer) % 3 desc) as best from lineitem),
g as (select q, sum(case when rank <= 8 then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) as dcg, sum(case when best <= 8 then (pow(2, grade) - 1) / log2(best + 1) else 0 end) as ideal from r group by 1)
select q as question_id, round(coalesce(case when ideal = 0 then 0 else dcg / ideal end, 0), 9) as ndcg from g
""")
def ndcg_at_8(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity").cast("int") % 3).alias("grade"))
    return evaluate.ndcg(r)


@query("selection_metrics", """
with r as (select l_orderkey as q, l_linenumber as rank, cast(l_quantity as integer) % 3 as grade, l_suppkey % 3 as g from lineitem)
select q as question_id, round(count(*) filter (where rank <= 4 and grade > 0) / count(*) filter (where rank <= 4)::double, 9) as useful_rate,
 round(coalesce(count(*) filter (where rank <= 4 and grade = 2) / nullif(count(*) filter (where grade = 2), 0)::double, 0), 9) as grade2_recall,
 round(coalesce(1 - count(distinct case when rank <= 4 and grade > 0 then g end) / nullif(count(*) filter (where rank <= 4 and grade > 0), 0)::double, 0), 9) as redundancy from r group by 1 having min(rank) = 1
""")
def selection_metrics(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("rank"), (F.col("l_quantity").cast("int") % 3).alias("grade"), (F.col("l_suppkey") % 3).alias("dup_group"))
    first = r.groupBy("question_id").agg(F.min("rank").alias("m")).filter("m = 1").select("question_id")
    return evaluate.selection(r.join(first, "question_id", "left_semi"), 4)


@query("answer_accuracy", """
with a as (select conv_id * 100 + turn as question_id, lower(text) as t, ['the', 'and', 'zzz'] as words from conversations where role = 'assistant')
select question_id, round(len([w for w in words if contains(t, w)]) / 3.0::double, 9) as accuracy, question_id % 2 = 0 as covers_all, false as false_refusal from a
""")
def answer_accuracy(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    qid = F.col("conv_id") * 100 + F.col("turn")
    cases = c.select(qid.alias("question_id"), F.col("text").alias("answer"), F.array(*[F.lit(w) for w in ("the", "and", "zzz")]).alias("words"), F.array(F.lit("note-1"), F.lit("note-2")).alias("refs"), F.when(qid % 2 == 0, F.array(F.lit("note-2"), F.lit("note-1"))).otherwise(F.array(F.lit("note-1"))).alias("found"))
    return evaluate.answers(cases).select("question_id", "accuracy", "covers_all", "false_refusal")


@query("corpus_hash", f"with h as (select sha256('file:' || doc_id || ':' || sha256(text)) as h from documents where text <> '') select substr({views.ORDER_FREE}, 1, 16) as corpus_hash from h")
def corpus_hash(spark, sf_dir):
    return evaluate.corpus_hash(views.corpus(spark, sf_dir))


@query("evidence_coverage", """
with c as (select l_orderkey as q, l_partkey * 10 + l_linenumber as rank, l_suppkey as doc, (l_partkey % 10) * 100 as s, (l_partkey % 10) * 100 + 300 as e from lineitem),
t as (select *, sum(e - s) over (partition by q order by rank rows unbounded preceding) as run from c),
g as (select o_orderkey as q, l_suppkey as doc, l_linenumber as gid, 250 as s, 450 as e from orders join lineitem on l_orderkey = o_orderkey where l_linenumber = 1),
j as (select g.q, g.gid, t.rank, greatest(least(g.e, t.e) - greatest(g.s, t.s), 0) as o, 200 as n from g left join t on t.q = g.q and t.doc = g.doc and run <= 2400),
p as (select q, gid, min(case when o >= 24 and o >= 40 then rank end) as first, max(coalesce(o / 200.0::double, 0)) as share from j group by 1, 2)
select q as question_id, coalesce(min(first), -1) as first, round(avg(share), 9) as coverage, bool_and(share >= 1) as complete from p group by 1
""")
def evidence_coverage(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = (F.col("l_partkey") % 10) * 100
    chunks = li.select(F.col("l_orderkey").alias("question_id"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("rank"), F.col("l_suppkey").alias("doc_id"), s.alias("start"), (s + 300).alias("end"))
    gold = li.filter("l_linenumber = 1").select(F.col("l_orderkey").alias("question_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("gold_id"), F.lit(250).alias("start"), F.lit(450).alias("end"))
    return evaluate.evidence(chunks, gold).withColumn("first", F.coalesce("first", F.lit(-1)))


@query("workflow_sort_unique", """
with f as (select o_orderkey, o_custkey, o_totalprice, row_number() over (order by o_totalprice desc, o_orderkey) as n from orders where o_orderstatus = 'F'),
u as (select * from (select *, row_number() over (partition by o_custkey order by n) as k from f) where k = 1)
select o_orderkey, o_custkey, 'Order ' || o_orderkey || '!' as label from u
""")
def workflow_sort_unique(spark, sf_dir):
    """Filter, sort, unique and template compiled to one plan."""
    o = table(spark, sf_dir, "orders").withColumn("ordinal", F.col("o_orderkey"))
    steps = [
        {"id": "a", "op": "filter", "input": "orders", "field": "o_orderstatus", "test": "eq", "value": "F"},
        {"id": "b", "op": "sort", "input": "a", "field": "o_totalprice", "descending": True},
        {"id": "c", "op": "unique", "input": "b", "field": "o_custkey"},
        {"id": "d", "op": "template", "input": "c", "name": "label", "text": "Order {o_orderkey}!"},
        {"id": "e", "op": "pick", "input": "d", "fields": ["o_orderkey", "o_custkey", "label"]},
    ]
    return workflow.compile_workflow({"steps": steps}, {"orders": o}).drop("ordinal")


@query("json_pick_filter", "select event_id, cast(props->>'$.k' as bigint) as k, event_type from events where contains(event_type, 'c') and cast(props->>'$.k' as bigint) >= 20")
def json_pick_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_id").alias("ordinal"))
    steps = [
        {"id": "a", "op": "filter", "input": "events", "field": "event_type", "test": "contains", "value": "c"},
        {"id": "b", "op": "filter", "input": "a", "field": "k", "test": "gte", "value": 20},
        {"id": "c", "op": "pick", "input": "b", "fields": ["event_id", "k", "event_type"]},
    ]
    return workflow.compile_workflow({"steps": steps}, {"events": e}).drop("ordinal")


@query("context_pack")
def context_pack(spark, sf_dir):
    """Excerpts of the keyword hits of every question within the context budget."""
    hits = search.search(passages(spark, sf_dir), views.questions(spark, sf_dir), mode="keyword").join(views.questions(spark, sf_dir), "question_id")
    return context.assemble(hits.select("question_id", "question", "rank", "source_type", "source_id", "seq", "title", "body"))


@query("fused_search", f"""
with {KEYWORD}, v as (select vec_id, embedding::double[] as e from embeddings), s as (select q.vec_id as question_id, v.vec_id as source_id, list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))) as score from v q join benchmark on item_id = q.vec_id, v),
b as (select *, max(score) over (partition by question_id) as best from s where score >= 0.45), c as (select question_id, source_id, row_number() over (partition by question_id order by score desc, 'file:' || source_id || ':0') as r from b where score >= best - 0.08),
k as (select question_id, source_id, r, 'keyword' as route from ranked where r <= 24 union all select question_id, source_id, r, 'vector' from c where r <= 24),
f as (select question_id, source_id, sum(1.0::double / (60 + r)) as score, string_agg(route, '+' order by route) as channels from k group by 1, 2)
select question_id, rank, 'file' as source_type, source_id, round(score, 9) as score, channels from (select *, row_number() over (partition by question_id order by round(score, 12) desc, 'file:' || source_id || ':0') as rank from f) where rank <= 20
""")
def fused_search(spark, sf_dir):
    """Entry point 1 over all questions: keyword and vector routes fused; question and source vectors are paired by identifier."""
    v = table(spark, sf_dir, "embeddings")
    vectors = v.select(F.lit("file").alias("source_type"), F.col("vec_id").alias("source_id"), F.lit(0).alias("seq"), F.col("embedding").alias("vec"))
    asked = v.join(views.questions(spark, sf_dir), v.vec_id == F.col("question_id")).select("question_id", F.col("embedding").alias("vec"))
    hits = search.search(passages(spark, sf_dir), views.questions(spark, sf_dir), vectors, asked)
    return hits.select("question_id", F.col("rank").cast("long").alias("rank"), "source_type", "source_id", F.round("score", 9).alias("score"), F.array_join("channels", "+").alias("channels"))


@query("semantic_chunk")
def semantic_chunk(spark, sf_dir):
    """L04 on conversations: turns as units, paired with vectors by position."""
    import pyarrow as pa

    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    c = table(spark, sf_dir, "conversations")
    n = e.agg(F.max("k") + 1).first()[0]
    turns = c.withColumn("k", (F.col("conv_id") * 8 + F.col("turn")) % n).join(e, "k").select("conv_id", "turn", "text", "embedding")
    cfg = Config(chunk_target=400, chunk_max=600, chunk_overlap=60)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("turn")
        units = [chunk.Unit("", t) for t in group["text"].to_pylist()]
        found = chunk.semantic(units, group["embedding"].to_pylist(), cfg)
        return pa.table({"conv_id": pa.array([group["conv_id"][0].as_py()] * len(found), pa.int64()), "seq": pa.array(range(len(found)), pa.int32()), "chunk_text": pa.array([t for _, t in found], pa.string())})

    return turns.groupBy("conv_id").applyInArrow(run, "conv_id long, seq int, chunk_text string")


@query("page_text", r"""
select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)>', ' ', 'gis'), '<[^>]+>', ' ', 'g'),
 '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&mdash;', '—'), '&ndash;', '–'), '&hellip;', '…'), '&amp;', '&'), '\s+', ' ', 'g')) as plain from pages
""")
def page_text(spark, sf_dir):
    """Text of whole pages without markup, by built-in expressions."""
    return table(spark, sf_dir, "pages").select("page_id", html.plain_text(F.col("html")).alias("plain"))


@query("ocr_line_confidence", """
select l_orderkey as page, l_suppkey as line, string_agg('w' || l_partkey, ' ' order by l_linenumber, 'w' || l_partkey) as text, round(sum(l_quantity * length('w' || l_partkey)) / sum(length('w' || l_partkey)), 6) as confidence from lineitem group by 1, 2
""")
def ocr_line_confidence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    w = li.select(F.col("l_orderkey").alias("page"), F.col("l_suppkey").alias("line"), F.concat(F.lit("w"), "l_partkey").alias("word"), F.col("l_quantity").alias("conf"), F.col("l_linenumber").alias("place"))
    return html.ocr_lines(w)
