"""Queries of facts, page material, command pipelines, edits and vector stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from loreweave.operators import chunk, commands, edits, facts, material, vectors
from loreweave.plans.registry import query
from loreweave.sources import table, views


def _facts(spark, sf_dir):
    """Statements of documents, with their source and language stated as two more lines."""
    body = F.concat(F.col("text"), F.lit("\nsource name = "), F.col("source"), F.lit("\nlanguage code: "), F.col("lang"), F.lit("."))
    return table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))


@query("explicit_facts", r"""
with l as (select doc_id, trim(unnest(string_split_regex(text || chr(10) || 'source name = ' || source || chr(10) || 'language code: ' || lang || '.', '[\n。；;]')), ' ' || chr(9) || chr(10) || chr(13)) as line from documents),
m as (select doc_id, case when regexp_full_match(line, '[^=\n]{2,100}\s*[=＝]\s*[^=\n]{2,100}') then regexp_extract(line, '^([^=\n]{2,100})\s*[=＝]\s*([^=\n]{2,100})$', ['s', 'a']) when regexp_full_match(line, '.{2,80}?\s*(?:是|为|：|:)\s*.{2,80}') then regexp_extract(line, '^(.{2,80}?)\s*(?:是|为|：|:)\s*(.{2,80})$', ['s', 'a']) end as f from l),
t as (select doc_id, trim(f.s) as subject, regexp_replace(trim(f.a), '[.!！]+$', '') as answer from m where f is not null)
select distinct doc_id, subject, answer, substr(sha256(subject || '=' || answer), 1, 16) as fact_id from t where not regexp_matches(subject, '[?？{}<>`]') and regexp_replace(answer, '[^\pL\pN]', '', 'g') not in ('', '不知道')
""")
def explicit_facts(spark, sf_dir):
    """H28."""
    return facts.extract(_facts(spark, sf_dir), "doc_id", "body").select("doc_id", "subject", "answer", "fact_id")


@query("contrast_cases")
def contrast_cases(spark, sf_dir):
    """The subject of a fact stands in as its entity where the text binds none."""
    docs = _facts(spark, sf_dir)
    found = facts.questions(facts.extract(docs, "doc_id", "body")).withColumn("entity", F.coalesce("entity", "subject"))
    return facts.contrast_cases(found, docs, "doc_id", "body")


@query("material_sample")
def material_sample(spark, sf_dir):
    """For each source name as a concept, passages of the documents of that name."""
    c = views.corpus(spark, sf_dir)
    passages = chunk.chunk(c, keep=["title", "category"])
    given = passages.select(F.col("category").alias("concept_id"), F.array(F.lower("category"), F.lit("the")).alias("names"), F.col("source_id").alias("place"), "source_type", "source_id", "title", "seq", "heading", "chunk_text")
    return material.sample(given).drop("prompt")


@query("section_outline", r"""
with d as (select doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)) as parts from documents),
s as (select doc_id, len(parts) as n, unnest(range(len(parts))) as seq from d)
select doc_id, cast(seq as integer) as seq, cast(seq // 6 * 6 + 1 as integer) as parent_seq, (seq // 6 % 999 + 1) || '.1 Section of words' as parent_heading from s where seq % 6 in (2, 3) and seq // 6 * 6 + 3 < n
""")
def section_outline(spark, sf_dir):
    """All sentences of documents as passages under numbered headings made from their place, six to a root."""
    marked = F.regexp_replace(F.regexp_replace("text", r"([.!?。！？])[\t\n\f\r ]+", "$1\x01"), r"\n+", "\x01")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(marked, "\x01")).alias("seq", "sentence"))
    below = F.element_at(F.array(*map(F.lit, ["", ".1", ".1.1", ".1.2", ".2", ".2.1"])), F.col("seq") % 6 + 1)
    root = F.floor(F.col("seq") / 6) % 999 + 1  # headings have numbers of three digits at most
    quoted = F.regexp_replace("sentence", r"^|\r", "\n> ")  # a sentence that begins with a number is no heading
    body = F.concat(root.cast("string"), below, F.lit(" Section of words\n"), quoted)
    return material.outline(d.select("doc_id", "seq", F.lit("").alias("heading"), body.alias("chunk_text")), ["doc_id"])


@query("note_edits", """
select doc_id, case when doc_id % 5 = 0 then text else replace(text, 'the', 'THE') end as text, case when doc_id % 5 = 0 then 'stale' when contains(text, 'the') then 'edited' else 'rejected' end as status from documents
""")
def note_edits(spark, sf_dir):
    """One replacement in all documents, planned on another text for every fifth."""
    d = table(spark, sf_dir, "documents")
    op = F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in [("action", "replace", "string"), ("text", "the", "string"), ("value", "THE", "string"), ("occurrence", None, "int"), ("all", True, "boolean"), ("prefix", None, "string"), ("suffix", None, "string"), ("style", None, "string")]])
    planned = F.when(F.col("doc_id") % 5 == 0, F.lit("other")).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    todo = d.select("doc_id", planned.alias("expected_hash"), F.array(op).alias("operations"))
    return edits.apply_edits(d, todo, "doc_id", "text").drop("error")


@query("command_pipeline", "select n_regionkey as region, cast(count(*) as bigint) as customers, cast(sum(cast(round(c_acctbal * 100) as bigint)) as bigint) as cents from nation join customer on c_nationkey = n_nationkey where n_regionkey in (select r_regionkey from region) group by 1")
def command_pipeline(spark, sf_dir):
    """Regions by pages, then one call for each."""
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    known = {
        "region.page": commands.Command(lambda calls: table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")), page_size=2),
        "customers.of": commands.Command(lambda calls: calls.join(customers, F.col("region") == F.col("n_regionkey")).groupBy("call", "region").agg(F.count("*").alias("customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).alias("cents"))),
    }
    steps = [{"id": "all", "command": "region.page", "paginate": True}, {"id": "each", "command": "customers.of", "forEach": {"$ref": "all#"}, "input": {"region": {"$item": "/id"}}}]
    return commands.execute(spark, {"steps": steps}, known)[0].drop("call")


def _store(kind, spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return kind(e.select(F.lit("test").alias("space"), F.lit("file").alias("source_type"), F.col("vec_id").alias("source_id"), F.lit(0).alias("seq"), F.col("embedding").alias("vec")))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vec"))


NEAREST = """
with v as (select vec_id, embedding::double[] as e from embeddings), s as (select q.vec_id as question_id, v.vec_id as source_id, list_inner_product(q.e, v.e) / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(v.e, v.e))) as score from v q, v where q.vec_id % 100 = 0)
select question_id, source_id, round(score, 6) as score, rank from (select *, row_number() over (partition by question_id order by score desc, source_id) as rank from s) where rank <= 10
"""


@query("vector_store_exact", NEAREST)
def vector_store_exact(spark, sf_dir):
    """S04."""
    hits = _store(vectors.ExactStore, spark, sf_dir).search("test", _asked(spark, sf_dir), 10)
    return hits.select("question_id", "source_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vector_store_clustered", NEAREST)
def vector_store_clustered(spark, sf_dir):
    """S04, A23 by clusters: as exact, with fewer vectors read where they form clusters."""
    hits = _store(vectors.ClusteredStore, spark, sf_dir).search("test", _asked(spark, sf_dir), 10)
    return hits.select("question_id", "source_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
