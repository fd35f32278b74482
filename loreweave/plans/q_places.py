"""Queries of text files as blocks, their two texts, and the places of snippets."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import places
from loreweave.plans.registry import query
from loreweave.sources import table

CAP = 2000


@query("adapted_files", rf"""
with recursive f as (select doc_id, ['md', 'py', 'txt', 'txt'][1 + doc_id % 4] as ext, coalesce(text, '') as text from documents),
p as (select doc_id, 'paragraph' as kind, [x for x in [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\n[ \t]*\n')] if x <> ''] as parts from f where ext = 'txt'
  union all select doc_id, 'markdown', [text] from f where ext = 'md' and regexp_matches(text, '\S')
  union all select doc_id, 'code', [m || 'python' || chr(10) || text || chr(10) || m] from (select *, repeat('`', greatest(3, 1 + coalesce(list_max([len(x) for x in regexp_extract_all(text, '`+')]), 0))::bigint) as m from f) where ext = 'py' and regexp_matches(text, '\S')),
b as (select doc_id, kind, unnest(parts) as display, generate_subscripts(parts, 1) - 1 as block from p), n as (select *, len(display) as n from b),
r as (select doc_id, -1::bigint as block, 0::bigint as before, 0::bigint as used from (select distinct doc_id from n)
  union all select n.doc_id, n.block, used, case when used + n + 2 <= {CAP + 2} then used + n + 2 else used end from r join n on n.doc_id = r.doc_id and n.block = r.block + 1)
select n.doc_id, n.block::int as block, kind, coalesce(sum(n + 2) over (partition by n.doc_id order by n.block rows between unbounded preceding and 1 preceding), 0)::bigint as shown_start,
  case when used > before then before end as "start", case when used > before then before + n end as "end", bool_or(used = before) over (partition by n.doc_id) as partial, case when used > before then true end as same_text
from n join r on n.doc_id = r.doc_id and n.block = r.block
""")
def adapted_files(spark, sf_dir):
    """Documents as files of three extensions, a sentence a paragraph; an index text has at most 2,000 characters."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, ["md", "py", "txt", "txt"])), (F.col("doc_id") % 4 + 1).cast("int"))
    named = d.select("doc_id", F.concat(F.lit("a/f."), ext).alias("path"), F.when(ext == "txt", F.replace("text", F.lit(". "), F.lit(".\n\n"))).otherwise(F.col("text")).alias("text"))
    placed = places.written(places.adapted(named, "doc_id", "path", "text"), "doc_id", CAP)
    cut = placed.join(places.texts(placed, "doc_id").select("doc_id", "index_text"), "doc_id")
    same = F.substr("index_text", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("display")
    return cut.select("doc_id", "block", "kind", "shown_start", "start", "end", "partial", same.alias("same_text"))


@query("snippet_places", r"""
with p as (select doc_id, [x for x in [regexp_replace(y, '^\s+|\s+$', '', 'g') for y in regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\n[ \t]*\n')] if x <> ''] as parts from documents where text is not null),
q as (select doc_id, array_to_string(parts, chr(10) || chr(10)) as body, parts, trim(case when doc_id % 2 = 0 then parts[2] || chr(10) || chr(10) || parts[3] else '## ' || parts[2] || '…' || parts[4] end, chr(10) || chr(9) || ' ') as snip from p where len(parts) >= 4),
b as (select doc_id, block, sum(len(t) + 2) over (partition by doc_id order by block) - len(t) - 2 as s, len(t) as n from (select doc_id, unnest(parts) as t, generate_subscripts(parts, 1) - 1 as block from q)),
a as (select doc_id, body, 0 as i, snip as piece from q where contains(body, snip) union all
  select * from (select doc_id, body, i, regexp_replace(trim(x, chr(10) || chr(9) || ' '), '^#{1,6}\s+', '') as piece from (select doc_id, body, unnest(xs) as x, generate_subscripts(xs, 1) as i from (select *, regexp_split_to_array(snip, '(?:\r?\n|…|\.\.\.)+') as xs from q where not contains(body, snip)))) where len(regexp_replace(piece, '[^\pL\pN]', '', 'g')) >= 8),
o as (select doc_id, i, piece, unnest(cuts) as cut, generate_subscripts(cuts, 1) as k, len(cuts) as ks from (select *, string_split(body, piece) as cuts from a)),
e as (select doc_id, i, k, len(piece) as m, sum(len(cut) + len(piece)) over (partition by doc_id, i order by k) - len(piece) as pos from o qualify k < ks),
r as (select *, row_number() over (partition by doc_id order by i, k) as nth from e),
h as (select distinct doc_id, block from r join b using (doc_id) where nth <= 24 and s < pos + m and s + n > pos)
select doc_id, row_number() over (partition by doc_id order by block)::int as place, block::int as block from h qualify place <= 12
""")
def snippet_places(spark, sf_dir):
    """Where two neighbouring sentences of a document, or two apart under a heading, stand in it."""
    d = table(spark, sf_dir, "documents").filter("text is not null")
    named = d.select("doc_id", F.lit("f.txt").alias("path"), F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    placed = places.written(places.adapted(named, "doc_id", "path", "text"), "doc_id")
    bodies = places.texts(placed, "doc_id").select("doc_id", F.col("index_text").alias("body"))
    nth = [F.max(F.when(F.col("block") == i, F.col("display"))) for i in (1, 2, 3)]
    wanted = F.when(F.col("doc_id") % 2 == 0, F.concat(nth[0], F.lit("\n\n"), nth[1])).otherwise(F.concat(F.lit("## "), nth[0], F.lit("…"), nth[2]))
    snippets = placed.groupBy("doc_id").agg(F.when(F.max("block") >= 3, wanted).alias("snippet")).select("doc_id", F.col("doc_id").alias("snippet_id"), "snippet", F.lit(None).cast("string").alias("question"))
    return places.located(placed, bodies, snippets, "doc_id").select("doc_id", "place", "block")
