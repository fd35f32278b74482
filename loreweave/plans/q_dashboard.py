"""Scans, filters, joins, aggregates, sets, paging and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loreweave.functions import text
from loreweave.plans.registry import query
from loreweave.sources import table, views


@query("file_scan", "select doc_id, source || case when source = '' then '' else chr(10) end || text as content from documents where lang = 'en' and text <> ''")
def file_scan(spark, sf_dir):
    """Summary, a line feed if there is one, and text of usable files."""
    d = table(spark, sf_dir, "documents").filter("lang = 'en' and text <> ''")
    return d.select("doc_id", F.concat("source", F.when(F.col("source") == "", "").otherwise("\n"), "text").alias("content"))


@query("passage_scan", "select item_id, length(text) as chars from benchmark")
def passage_scan(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.char_length("text").cast("long").alias("chars"))


@query("source_versions_sha", "select 'file' as source_type, doc_id as source_id, sha256(text) as version, length(text) as chars from documents union all select 'note', item_id, sha256(text), length(text) from benchmark union all select 'page', page_id, sha256(html), length(html) from pages")
def source_versions_sha(spark, sf_dir):
    def versions(name, kind, key, body):
        c = F.coalesce(F.col(body), F.lit(""))
        return table(spark, sf_dir, name).select(F.lit(kind).alias("source_type"), F.col(key).alias("source_id"), F.sha2(c, 256).alias("version"), F.char_length(c).cast("long").alias("chars"))

    return versions("documents", "file", "doc_id", "text").unionByName(versions("benchmark", "note", "item_id", "text")).unionByName(versions("pages", "page", "page_id", "html"))


@query("list_without_body", "select doc_id, lang, source, n_chars from documents")
def list_without_body(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("folder_filter", "select doc_id, source from documents where source = 'src3' and lang = 'en'")
def folder_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("source = 'src3' and lang = 'en'").select("doc_id", "source")


@query("tag_semi_join", "select doc_id, lang from documents where doc_id in (select doc_id from labels where toxic = 1)")
def tag_semi_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "lang")


@query("multi_term_prefilter", "select doc_id from documents where contains(lower(text), 'license') or contains(lower(text), 'mail3') or contains(lower(text), 'token')")
def multi_term_prefilter(spark, sf_dir):
    terms = F.array(*[F.lit(t) for t in ("license", "mail3", "token")])
    low = F.lower("text")
    return table(spark, sf_dir, "documents").filter(F.exists(terms, lambda t: F.contains(low, t))).select("doc_id")


@query("literal_like", r"select doc_id from documents where contains(text, '%%') or contains(text, '_')")
def literal_like(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("%%")) | F.contains("text", F.lit("_"))).select("doc_id")


@query("like_search_union", """
select * from (select 'file' as kind, doc_id as id, row_number() over (order by n_chars desc, doc_id) as rank from documents where contains(lower(text), 'the')) where rank <= 8
union all select * from (select 'note', item_id, row_number() over (order by item_id) as rank from benchmark where contains(lower(text), 'the')) where rank <= 8
union all select * from (select 'turn', conv_id * 100 + turn, row_number() over (order by conv_id, turn) as rank from conversations where contains(lower(text), 'the')) where rank <= 8
""")
def like_search_union(spark, sf_dir):
    """Hits of each kind in their own order, eight at most."""

    def branch(name, kind, key, body, order):
        hits = table(spark, sf_dir, name).filter(F.contains(F.lower(body), F.lit("the"))).orderBy(*order).limit(8)
        return hits.select(F.lit(kind).alias("kind"), key.alias("id"), F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))

    return branch("documents", "file", F.col("doc_id"), "text", [F.desc("n_chars"), F.col("doc_id")]).unionByName(branch("benchmark", "note", F.col("item_id"), "text", [F.col("item_id")])).unionByName(branch("conversations", "turn", F.col("conv_id") * 100 + F.col("turn"), "text", [F.col("conv_id"), F.col("turn")]))


@query("category_left_join", "select c_custkey, n_name, r_name from customer left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey")
def category_left_join(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("bridge_tags", "select l_orderkey, string_agg(distinct p_brand, '|' order by p_brand) as tags from lineitem join part on p_partkey = l_partkey group by 1")
def bridge_tags(spark, sf_dir):
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("tags"))


@query("tag_use_counts", "select p_brand, count(l_orderkey) as uses from part left join lineitem on l_partkey = p_partkey group by 1")
def tag_use_counts(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part")
    return p.join(uses, p.p_partkey == uses.l_partkey, "left").groupBy("p_brand").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("uses"))


@query("orphan_edges", "select l_orderkey, l_linenumber from lineitem where not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')")
def orphan_edges(spark, sf_dir):
    live = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(live, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("dashboard_counts", """
select s.source as category, coalesce(d.n, 0) as documents, coalesce(t.n, 0) as toxic from (select distinct source from documents) s
left join (select source, count(*) as n from documents where lang = 'fr' group by 1) d on d.source = s.source
left join (select source, count(*) as n from documents join labels using (doc_id) where toxic = 1 group by 1) t on t.source = s.source
""")
def dashboard_counts(spark, sf_dir):
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(1).alias("hit"))
    counts = d.join(lab, "doc_id", "left").groupBy(F.col("source").alias("category"))
    return counts.agg(F.count_if(F.col("lang") == "fr").alias("documents"), F.count("hit").alias("toxic"))


@query("activity_daily", "select cast(cast(ts as date) as varchar) as day, count(*) as n, count(distinct user_id) as users from events where ts >= timestamp '2024-01-01' and ts < timestamp '2025-01-01' group by 1")
def activity_daily(spark, sf_dir):
    year = table(spark, sf_dir, "events").filter("ts >= timestamp_ntz '2024-01-01' and ts < timestamp_ntz '2025-01-01'")
    return year.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("activity_calendar", """
with d as (select cast(range as date) as day from range(date '2024-01-01', date '2025-01-01', interval 1 day)), c as (select cast(ts as date) as day, count(*) as n from events group by 1), m as (select max(n) as most from c)
select cast(d.day as varchar) as day, coalesce(n, 0) as n, cast((isodow(d.day) - 1) as integer) as weekday, cast(floor((dayofyear(d.day) - 1 + isodow(date '2024-01-01') - 1) / 7) as integer) as week,
  cast(case when coalesce(n, 0) = 0 then 0 else greatest(1, least(4, ceil(n * 4.0 / most))) end as integer) as level from d left join c using (day), m
""")
def activity_calendar(spark, sf_dir):
    """Every day of a year with its place in a Monday-first grid and heat level 0 to 4."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-12-31").cast("date"))).alias("day"))
    c = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    most = c.agg(F.max("n").alias("most"))
    n = F.coalesce("n", F.lit(0))
    first = F.weekday(F.lit("2024-01-01").cast("date"))
    level = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), F.ceil(n * 4.0 / F.col("most")))))
    return days.join(c, "day", "left").crossJoin(F.broadcast(most)).select(F.col("day").cast("string").alias("day"), n.alias("n"), F.weekday("day").alias("weekday"), F.floor((F.dayofyear("day") - 1 + first) / 7).cast("int").alias("week"), level.cast("int").alias("level"))


@query("folder_counts", "select n_regionkey, count(*) as n from nation group by 1")
def folder_counts(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("table_fingerprint", "select count(*) || ':' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') || ':' || max(o_orderkey) as fingerprint, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as finished from orders")
def table_fingerprint(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.agg(F.concat_ws(":", F.count("*").cast("string"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd HH:mm:ss"), F.max("o_orderkey").cast("string")).alias("fingerprint"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("finished"))


@query("cache_fingerprint")
def cache_fingerprint(spark, sf_dir):
    """An order-free hash of all rows."""
    line = F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "text").cast("binary")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.bit_xor(F.crc32(line)).alias("fingerprint"))


@query("latest_change_union", "select max(t) as latest from (select max(ts) as t from events union all select max(o_orderdate) from orders union all select max(greatest(l_shipdate, l_shipdate)) from lineitem)")
def latest_change_union(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.max(c).alias("t")) for t, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.max("t").alias("latest"))


@query("recent_sources", "select event_type, event_id, ts from (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as n from events) where n <= 6")
def recent_sources(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 6").select("event_type", "event_id", "ts")


@query("distinct_sources", "select count(distinct source) as sources, count(distinct lang) as langs, count(*) as n from documents")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.count("*").alias("n"))


@query("lang_hist", "select lower(lang) as lang, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1")
def lang_hist(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.lower("lang").alias("lang")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("index_status", """
select count(*) as vectors, count(distinct label) as labels, count(*) filter (where len(embedding) = 64) as compatible, count(*) filter (where len(embedding) <> 64) as stale, bool_or(label = 3) as has_three from embeddings
""")
def index_status(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.agg(F.count("*").alias("vectors"), F.count_distinct("label").alias("labels"), F.count_if(F.size("embedding") == 64).alias("compatible"), F.count_if(F.size("embedding") != 64).alias("stale"), F.bool_or(F.col("label") == 3).alias("has_three"))


@query("unique_first_wins", "select l_partkey, min(l_orderkey * 10 + l_linenumber) as ordinal from lineitem group by 1")
def unique_first_wins(spark, sf_dir):
    """The first row of each value, by an explicit ordinal."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))


@query("page_offset_total", "select o_orderkey, o_totalprice, total from (select o_orderkey, o_totalprice, count(*) over () as total, row_number() over (order by o_totalprice desc, o_orderkey desc) as n from orders) where n > 200 and n <= 300")
def page_offset_total(spark, sf_dir):
    """the third page of a hundred and the total."""
    o = table(spark, sf_dir, "orders")
    page = o.orderBy(F.desc("o_totalprice"), F.desc("o_orderkey")).offset(200).limit(100)
    return page.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))


@query("tiered_name_search", """
select p_partkey, p_name, tier from (select p_partkey, p_name, case when lower(p_name) = 'large bolt' then 0 when starts_with(lower(p_name), 'large') then 1 else 2 end as tier,
row_number() over (order by case when lower(p_name) = 'large bolt' then 0 when starts_with(lower(p_name), 'large') then 1 else 2 end, p_size desc, p_partkey) as n from part where contains(lower(p_name), 'bolt')) where n <= 12
""")
def tiered_name_search(spark, sf_dir):
    low = F.lower("p_name")
    tier = F.when(low == "large bolt", 0).when(F.startswith(low, F.lit("large")), 1).otherwise(2)
    return table(spark, sf_dir, "part").filter(F.contains(low, F.lit("bolt"))).withColumn("tier", tier).orderBy("tier", F.desc("p_size"), "p_partkey").limit(12).select("p_partkey", "p_name", "tier")


@query("in_doc_search", """
select doc_id, cast(least(200, (length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4) as bigint) as hits, substr(text, greatest(1, strpos(lower(text), 'tion') - 220), 444) as first_window from documents where contains(lower(text), 'tion')
""")
def in_doc_search(spark, sf_dir):
    """Occurrences up to 200 and a window around the first."""
    low = F.lower("text")
    at = F.locate("tion", low)
    hits = F.floor((F.char_length(low) - F.char_length(F.replace(low, F.lit("tion"), F.lit("")))) / 4)
    d = table(spark, sf_dir, "documents").filter(at > 0)
    return d.select("doc_id", F.least(F.lit(200), hits).cast("long").alias("hits"), F.substring(F.col("text"), F.greatest(F.lit(1), at - 220), F.lit(444)).alias("first_window"))


@query("offset_read", "select doc_id, substr(text, 8001, 8000) as part, case when length(text) > 16000 then 16000 else -1 end as next_offset from documents where length(text) > 8000")
def offset_read(spark, sf_dir):
    n = F.char_length("text")
    return table(spark, sf_dir, "documents").filter(n > 8000).select("doc_id", F.substring("text", 8001, 8000).alias("part"), F.when(n > 16000, 16000).otherwise(-1).alias("next_offset"))


@query("change_diff", """
with live as (select doc_id, sha256(text) as h from documents), known as (select doc_id, sha256(case when toxic = 1 then text || '!' else text end) as h from documents join labels using (doc_id) union all select item_id + 1000000000, sha256(text) from benchmark)
select coalesce(l.doc_id, k.doc_id) as doc_id, case when k.doc_id is null then 'added' when l.doc_id is null then 'removed' when l.h = k.h then 'unchanged' else 'changed' end as state from live l full join known k on l.doc_id = k.doc_id
""")
def change_diff(spark, sf_dir):
    """Live sources against the known state, by content hash."""
    from loreweave.operators import maintain

    d = table(spark, sf_dir, "documents")
    live = d.select("doc_id", F.sha2("text", 256).alias("hash"))
    seen = d.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.sha2(F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    known = seen.unionByName(table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1_000_000_000).alias("doc_id"), F.sha2("text", 256).alias("hash")))
    return maintain.diff_sources(live, known, ["doc_id"])


@query("queue_due", "select o_orderkey from orders where o_orderstatus in ('O', 'P') and o_orderdate <= timestamp '1996-01-01' order by o_orderkey limit 1")
def queue_due(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus in ('O', 'P') and o_orderdate <= timestamp_ntz '1996-01-01'").orderBy("o_orderkey").limit(1).select("o_orderkey")


@query("queue_histogram", "select o_orderstatus as state, count(*) as n from orders group by 1")
def queue_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query("backoff_schedule", "select range as failures, cast(least(600, 30 * pow(2, least(range - 1, 5))) as bigint) as seconds from range(1, 12)")
def backoff_schedule(spark, sf_dir):
    from loreweave.operators import maintain

    return spark.range(1, 12).select(F.col("id").alias("failures"), maintain.backoff_seconds(F.col("id")).alias("seconds"))


@query("insert_ignore", "select doc_id, 'old' as lang from labels union all select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def insert_ignore(spark, sf_dir):
    from loreweave.operators import maintain

    known = table(spark, sf_dir, "labels").select("doc_id", F.lit("old").alias("lang"))
    return maintain.insert_ignore(known, table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"])


@query("upsert_rows", "select doc_id, lang from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'new' from labels")
def upsert_rows(spark, sf_dir):
    from loreweave.operators import maintain

    new = table(spark, sf_dir, "labels").select("doc_id", F.lit("new").alias("lang"))
    return maintain.upsert(table(spark, sf_dir, "documents").select("doc_id", "lang"), new, ["doc_id"])


@query("snippet_window", """
with c as (select doc_id, source, regexp_replace(regexp_replace(regexp_replace(text, '<[^<>]{0,300}>', ' ', 'gs'), '[`*_~\\[\\]]', '', 'g'), '\\s+', ' ', 'g') as p from documents where text not like '%#%'),
t as (select doc_id, source, trim(p) as p, strpos(lower(trim(p)), 'tion') as hit from c), w as (select *, greatest(hit - 1 - 40, 0) as s from t)
select doc_id, case when length(p) > 120 and hit > 0 then case when s > 0 then '…' else '' end || substr(p, s + 1, least(length(p), s + 120) - s) || case when least(length(p), s + 120) < length(p) then '…' else '' end else source end as snippet from w
""")
def snippet_window(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text not like '%#%'")
    return d.select("doc_id", text.snippet(F.col("source"), F.col("text"), "tion").alias("snippet"))


@query("multi_value_split", "select o_orderkey, array_to_string(list_filter([trim(x) for x in string_split_regex(o_orderpriority || ' | ,' || o_orderstatus, '[|,]')], lambda x: x <> ''), '/') as parts from orders")
def multi_value_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.split_values(F.concat("o_orderpriority", F.lit(" | ,"), "o_orderstatus")), "/").alias("parts"))


@query("json_props", "select event_id, cast(props->>'$.k' as bigint) as k from events where cast(props->>'$.k' as bigint) > 50")
def json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").filter(k > 50).select("event_id", k.alias("k"))


@query("version_digests", "select doc_id, 'sha256:' || substr(sha256(text), 1, 16) as digest, case when length(text) <= 1200 then length(text) else 1206 end as sample_chars from documents")
def version_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.version_digest(F.col("text")).alias("digest"), F.char_length(text.sample_ends(F.col("text"))).cast("long").alias("sample_chars"))


@query("embed_texts", "select doc_id, source || ' #' || doc_id || ' · ' || lang || chr(10) || text as embed from documents")
def embed_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.embed_text(F.concat("source", F.lit(" #"), "doc_id"), F.col("lang"), F.col("text")).alias("embed"))


@query("refusal_flags", "select conv_id, turn, contains(text, 'cannot answer') or contains(text, 'insufficient') or contains(substr(text, 1, 200), 'not found') or contains(substr(text, 1, 200), 'the') as refusal from conversations where role = 'assistant'")
def refusal_flags(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return c.select("conv_id", "turn", text.is_refusal(F.col("text"), ["cannot answer", "insufficient"], ["not found", "the"]).alias("refusal"))


@query("tree_recursive", f"with recursive {views.TREE}, t as (select id, name as path, 0 as depth from tree where parent_id is null union all select c.id, t.path || ' > ' || c.name, t.depth + 1 from t join tree c on c.parent_id = t.id) select id, path, depth from t")
def tree_recursive(spark, sf_dir):
    from loreweave.operators import graph

    return graph.tree_paths(views.tree(spark, sf_dir))
