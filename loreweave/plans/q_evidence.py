"""Evidence, wiki and file-source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.operators import evidence, lineage
from loreweave.plans.registry import query
from loreweave.sources import files, table, views


@query("paragraph_blocks", r"select doc_id, cast(i - 1 as integer) as block, p as text from (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as i from (select doc_id, [trim(x, chr(10) || ' ') for x in string_split(text || chr(10) || chr(10) || source, chr(10) || chr(10)) if trim(x, chr(10) || ' ') <> ''] as ps from documents))")
def paragraph_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("body", F.concat("text", F.lit("\n\n"), "source"))
    return files.paragraphs(d, "doc_id", "body")


@query("block_offsets", """
with b as (select conv_id, turn as block, text from conversations), o as (select *, sum(length(text)) over w + (row_number() over w - 1) * 2 as e from b window w as (partition by conv_id order by block rows unbounded preceding))
select conv_id, block, cast(e - length(text) as bigint) as start, cast(e as bigint) as "end", max(e) over (partition by conv_id) > 2000 as partial from o qualify e <= 2000
""")
def block_offsets(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("block"), "text")
    return files.offsets(b, "conv_id", 2000).select("conv_id", "block", "start", "end", "partial")


@query("page_continuation", "with b as (select conv_id, turn as block, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as n from conversations) select conv_id, block, cast(floor(n / 1000) as integer) as page from b")
def page_continuation(spark, sf_dir):
    b = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("block"), "text")
    return files.pages_of(b, "conv_id", 1000).select("conv_id", "block", "page")


@query("region_assignment", """
with l as (select l_suppkey as doc_id, l_orderkey as page, l_partkey as line, l_quantity as x0, l_linenumber::double as y0, l_quantity + 10 as x1, l_linenumber + 1.0::double as y1 from lineitem),
r as (select 'left' as region, 0.0 as rx0, 25.0 as rx1 union all select 'right', 25.0, 100.0), s as (select l.*, region, (least(x1, rx1) - greatest(x0, rx0)) / 10 as share from l, r),
b as (select *, row_number() over (partition by doc_id, page, line, x0, y0 order by share desc, region) as n from s where share >= 0.5)
select coalesce(region, 'none') as region, count(*) as n from b where n = 1 group by 1
""")
def region_assignment(spark, sf_dir):
    """A13 on order lines as boxes: two regions on every page."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("line"), F.col("l_quantity").alias("x0"), F.col("l_linenumber").cast("double").alias("y0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_linenumber") + 1.0).alias("y1")).distinct()
    pages = li.select("doc_id", "page").distinct()
    sides = F.explode(F.array(F.struct(F.lit("left").alias("region"), F.lit(0.0).alias("x0"), F.lit(25.0).alias("x1")), F.struct(F.lit("right").alias("region"), F.lit(25.0).alias("x0"), F.lit(100.0).alias("x1"))))
    regions = pages.select("doc_id", "page", sides.alias("s")).select("doc_id", "page", "s.*", F.lit(0.0).alias("y0"), F.lit(100.0).alias("y1"))
    return files.assign_regions(li, regions).groupBy(F.coalesce("region", F.lit("none")).alias("region")).agg(F.count("*").alias("n"))


@query("global_questions", "select item_id as question_id, contains(lower(text), 'overview') or contains(lower(text), 'main themes') as global from benchmark")
def global_questions(spark, sf_dir):
    return views.questions(spark, sf_dir).select("question_id", evidence.is_global(F.col("question")).alias("global"))


@query("community_summaries", """
with s as (select n_regionkey as community, list(n_name) as members, string_agg(n_name, ' ' order by n_name) as summary, count(*) as size from nation group by 1), q as (select r_regionkey as question_id, r_name || ' ' || (select min(n_name) from nation) as question, [r_name, 'NATION'] as terms from region),
j as (select question_id, community, size, 10 * len([m for m in members if contains(lower(question), lower(m))]) + len([t for t in terms if contains(lower(summary), lower(t))]) as score from q, s)
select question_id, community, score, rank from (select *, row_number() over (partition by question_id order by score desc, size desc, community) as rank from j) where rank <= 6
""")
def community_summaries(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = n.groupBy(F.col("n_regionkey").alias("community")).agg(F.collect_list("n_name").alias("members"), F.array_join(F.array_sort(F.collect_list("n_name")), " ").alias("summary"), F.count("*").alias("size"))
    first = n.agg(F.min("n_name").alias("f"))
    q = table(spark, sf_dir, "region").join(F.broadcast(first)).select(F.col("r_regionkey").alias("question_id"), F.concat("r_name", F.lit(" "), "f").alias("question"), F.array("r_name", F.lit("NATION")).alias("terms"))
    return evidence.global_summaries(s, q).withColumn("rank", F.col("rank").cast("long"))


def _cited(spark, sf_dir):
    """Edges that cite documents: quotes of texts, one in ten of them altered."""
    d = table(spark, sf_dir, "documents")
    quote = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("altered quote "), "doc_id")).otherwise(F.substring("text", 1, 40))
    return d.select(F.concat(F.lit("c"), F.col("doc_id") % 50).alias("head"), F.lit("related_to").alias("relation"), F.concat(F.lit("s"), "source").alias("tail"), quote.alias("evidence"), F.array(F.concat(F.lit("file-"), "doc_id")).alias("sources"), F.lit(1.0).alias("weight"))


@query("evidence_support", """
with e as (select doc_id, text, regexp_replace(lower(case when doc_id % 10 = 0 then 'altered quote ' || doc_id else substr(text, 1, 40) end), '[\\s*_`>#-]+', '', 'g') as q from documents)
select doc_id from e where length(q) >= 6 and contains(regexp_replace(lower(text), '[\\s*_`>#-]+', '', 'g'), q)
""")
def evidence_support(spark, sf_dir):
    """C11: edges whose quote still stands in the document they cite."""
    ok = evidence.supported(_cited(spark, sf_dir), views.corpus(spark, sf_dir))
    return ok.select(F.substring_index("source_ref", "-", -1).cast("long").alias("doc_id"))


@query("graph_evidence")
def graph_evidence(spark, sf_dir):
    """Sources that hold evidence at a question's concepts."""
    concepts = views.questions(spark, sf_dir).select("question_id", F.explode(F.array(F.concat(F.lit("c"), F.col("question_id") % 50), F.lit("ssrc1"))).alias("id"))
    return evidence.graph_evidence(_cited(spark, sf_dir), concepts, views.corpus(spark, sf_dir))


PLAIN_MARKS = "`*_<[#>+~-"
LISTS = r"(?m)^[ \t]{0,3}(?:[0-9]+[.)][ \t]+)+"
_FORM = "replace(regexp_replace(regexp_replace(regexp_replace({}, '([\\pL\\p{{Nd}}])\\s+([\\pL\\p{{Nd}}])', '\\1¤\\2', 'g'), '([\\pL\\p{{Nd}}])\\s+([\\pL\\p{{Nd}}])', '\\1¤\\2', 'g'), '\\s+', '', 'g'), '¤', ' ')"


@query("graph_passages", rf"""
with c as (select doc_id, regexp_replace(translate(text, '{PLAIN_MARKS}', ''), '{LISTS}', '', 'g') as content from documents),
d as (select doc_id, content, {_FORM.format('content')} as nf, regexp_replace(content, '\s+', '', 'g') as lit, list_filter(list_transform(string_split(content, ''), lambda x, i: case when x in (' ', chr(10), chr(9), chr(13), chr(12)) then null else i end), lambda i: i is not null) as rv from c where trim(content) <> ''),
rel as (select 'c' || (doc_id % 50) as head, 't' || doc_id as tail, (doc_id % 7) / 10.0 as weight, doc_id, case when doc_id % 10 = 0 then 'altered quote' else substr(content, 30, 60) end as q from c),
ask as (select item_id as question_id, unnest(['c' || (item_id % 50), 't' || item_id]) as id from benchmark),
hit as (select question_id, head, tail, weight, doc_id, q, count(*) as sides from rel join ask on id = head or id = tail group by all),
top as (select *, {_FORM.format('q')} as quote, round(sides + 0.1 * weight, 6) as score from (select *, row_number() over (partition by question_id order by sides desc, weight desc, head, tail) as k from hit) where k <= 60),
n as (select *, row_number() over (partition by question_id order by score desc, least(head, tail) || ':related_to:' || greatest(head, tail)) as n from top where quote <> ''),
ok as materialized (select n.*, content, nf, lit, rv, position(quote in nf) - 1 as place from n join d using (doc_id) where n <= 24 and contains(nf, quote)),
line as (select doc_id, i - 1 as seq, x as text, regexp_replace(x, '\s+', '', 'g') as l from (select doc_id, unnest(string_split(content, chr(10))) as x, generate_subscripts(string_split(content, chr(10)), 1) as i from c)),
vis as (select doc_id, nf, lit, list_filter(list_transform(string_split(nf, ''), lambda x, i: case when x = ' ' then null else i end), lambda i: i is not null) as v from (select distinct doc_id, nf, lit from ok)),
part as (select doc_id, seq, text, l, nf, lit, substr(nf, v[position(l in lit)], v[position(l in lit) + length(l) - 1] - v[position(l in lit)] + 1) as s from line join vis using (doc_id) where l <> ''),
good as (select * from part where (length(lit) - length(replace(lit, l, ''))) / length(l) <= greatest(1.0, (length(nf) - length(replace(nf, s, ''))) / length(s))),
held as (select question_id, n, ok.doc_id, seq, text as passage, score from ok join good on good.doc_id = ok.doc_id and contains(s, quote)),
raws as (select *, rv[length(replace(substr(nf, 1, place), ' ', '')) + 1] - 1 as a, rv[length(replace(substr(nf, 1, place + length(quote)), ' ', ''))] - 1 as b from ok where (question_id, n) not in (select question_id, n from held)),
loose as (select question_id, n, doc_id, -1 as seq, regexp_replace(substr(content, greatest(a - 180, 0) + 1, b + 241 - greatest(a - 180, 0)), '^\s+|\s+$', '', 'g') as passage, score from raws)
select question_id, rank, doc_id as source_id, seq, passage, score from (select *, row_number() over (partition by question_id order by score desc, n, seq, passage) as rank from (select * from held union all select * from loose)) where rank <= 24
""")
def graph_passages(spark, sf_dir):
    """Lines of documents that prove a question's edges; quotes that run over lines come as windows."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.translate("text", PLAIN_MARKS, ""), LISTS, "").alias("content"))
    quote = F.when(F.col("doc_id") % 10 == 0, "altered quote").otherwise(F.substring("content", 30, 60))
    rel = d.select(F.concat(F.lit("c"), F.col("doc_id") % 50).alias("head"), F.lit("related_to").alias("relation"), F.concat(F.lit("t"), "doc_id").alias("tail"), (F.col("doc_id") % 7 / 10).alias("weight"), quote.alias("evidence"), F.array(F.concat(F.lit("file-"), "doc_id")).alias("sources"), F.lit("manual").alias("origin"))
    concepts = views.questions(spark, sf_dir).select("question_id", F.posexplode(F.array(F.concat(F.lit("c"), F.col("question_id") % 50), F.concat(F.lit("t"), "question_id"))).alias("place", "id"))
    sources = d.select(F.lit("file").alias("source_type"), F.col("doc_id").alias("source_id"), "content")
    lines = sources.select("source_type", "source_id", F.posexplode(F.split("content", "\n")).alias("seq", "text"))
    found = evidence.graph_passages(rel, concepts, sources, lines)
    return found.select("question_id", F.col("rank").cast("long").alias("rank"), "source_id", F.col("seq").cast("long").alias("seq"), "passage", "score")


@query("node_merge", """
with m as (select p_brand as old, 'Brand#0' as new from part where p_size = 1), b as (select distinct * from m), e as (select coalesce(x.new, p_brand) as head, coalesce(y.new, p_type) as tail from part left join b x on x.old = p_brand left join b y on y.old = p_type)
select head, tail, 1.0::double as weight from e where head <> tail group by 1, 2
""")
def node_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rel = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("head"), F.lit("is_a").alias("relation"), F.col("p_type").alias("tail"), F.lit("q").alias("evidence"), F.array(F.lit("n")).alias("sources"), F.lit(1.0).alias("weight"))
    same = p.filter("p_size = 1").select(F.col("p_brand").alias("old"), F.lit("Brand#0").alias("new")).distinct()
    return evidence.merge_nodes(rel, same).select("head", "tail", "weight")


@query("node_delete", f"with {views.RELATIONS} select head, relation, tail, weight from relations where head not in (select 's' || s_suppkey from supplier) and tail not in (select 's' || s_suppkey from supplier)")
def node_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return evidence.delete_nodes(views.relations(spark, sf_dir), gone)


@query("wiki_section_hits", """
with s as (select doc_id as page_id, i as section, unnest_line as body, source as heading, lang as name from (select doc_id, source, lang, unnest(string_split(text, chr(10))) as unnest_line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)),
q as (select r_regionkey as question_id, ['the', 'src' || r_regionkey, 'queue', 'en'] as terms from region),
h as (select question_id, page_id, section, 3 * len([t for t in terms if contains(lower(body), t)]) + 2 * len([t for t in terms if contains(lower(heading), t)]) + len([t for t in terms if contains(lower(name), t)]) as score from s, q),
n as (select *, row_number() over (partition by question_id, page_id order by score desc, section) as n from h where score > 0)
select question_id, page_id, section, score, rank from (select *, row_number() over (partition by question_id order by n, score desc, page_id, section) as rank from n where n <= 2) where rank <= 4
""")
def wiki_section_hits(spark, sf_dir):
    """Lines of documents as sections."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("heading"), F.col("lang").alias("name"), F.posexplode(F.split("text", "\n")).alias("section", "body"))
    q = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("question_id"), F.array(F.lit("the"), F.concat(F.lit("src"), "r_regionkey"), F.lit("queue"), F.lit("en")).alias("terms"))
    hits = evidence.wiki_sections_channel(d, q)
    return hits.select("question_id", "page_id", F.col("section").cast("long").alias("section"), F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("citation_lists", "select doc_id as page_id, 'file-' || doc_id || ',note-' || (doc_id % 7) as refs from documents")
def citation_lists(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("m", F.concat(F.lit("[资料#"), "doc_id", F.lit("] x [笔记 # "), F.col("doc_id") % 7, F.lit("]")))
    return d.select(F.col("doc_id").alias("page_id"), F.array_join(lineage.citations(F.col("m")), ",").alias("refs"))


def _summary_sql() -> str:
    """The chain of H09 in SQL: markup, entities, rules and prefixes of lines, links, inline marks, white space."""
    s = "text"
    for p in ("(?s)```.*?```", "(?s)~~~.*?~~~", "(?s)<!--.*?-->", "(?s)<[^<>]{0,300}>", r"(?s)<\s*/?\s*[a-zA-Z][^<>]{0,300}$"):
        s = f"regexp_replace({s}, '{p}', ' ', 'g')"
    for name, char in (("nbsp", "' '"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("apos", "chr(39)"), ("mdash", "'—'"), ("ndash", "'–'"), ("hellip", "'…'"), ("amp", "'&'")):
        s = f"replace({s}, '&{name};', {char})"
    for p, by in ((r"(?m)^\s*[-=*_]{3,}\s*$", " "), (r"(?m)^[\s|:-]+$", " "), (r"(?m)^\s*(?:#{1,6}|>|[-*+]|\d+\.)\s+", " "), (r"!?\[([^\]]*)\]\([^)]*\)", r"\1"), ("[#*_`~|]", ""), (r"\s+", " ")):
        s = f"regexp_replace({s}, '{p}', '{by}', 'g')"
    return f"select doc_id, trim({s}) as summary from documents"


@query("plain_summaries", _summary_sql())
def plain_summaries(spark, sf_dir):
    """H09 over all texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.plain_summary(F.col("text")).alias("summary"))
