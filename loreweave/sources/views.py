"""Logical views of a knowledge base over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.sources import table


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source_type, source_id, title, category, content``: current sources with content."""
    d = table(spark, sf_dir, "documents").filter("text is not null and text <> ''")
    return d.select(
        F.lit("file").alias("source_type"), F.col("doc_id").alias("source_id"),
        F.concat(F.col("source"), F.lit(" #"), F.col("doc_id")).alias("title"), F.col("source").alias("category"), F.col("text").alias("content"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``question_id, question``."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, parent_id, name``: regions over nations as a category tree."""
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    return regions.unionByName(nations)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``head, relation, tail, weight``: concept triples of the stand-in graph.

    Suppliers and customers are part of nations and nations of regions; brands
    bought together in one order are related.
    """
    s, c, n = (table(spark, sf_dir, t) for t in ("supplier", "customer", "nation"))
    part_of = [
        s.select(F.concat(F.lit("s"), "s_suppkey").alias("head"), F.concat(F.lit("n"), "s_nationkey").alias("tail")),
        c.select(F.concat(F.lit("c"), "c_custkey").alias("head"), F.concat(F.lit("n"), "c_nationkey").alias("tail")),
        n.select(F.concat(F.lit("n"), "n_nationkey").alias("head"), F.concat(F.lit("r"), "n_regionkey").alias("tail")),
    ]
    whole = part_of[0].unionByName(part_of[1]).unionByName(part_of[2])
    tree_edges = whole.select("head", F.lit("part_of").alias("relation"), "tail", F.lit(1.0).alias("weight"))
    return tree_edges.unionByName(brand_pairs(spark, sf_dir).select(F.col("a").alias("head"), F.lit("related_to").alias("relation"), F.col("b").alias("tail"), F.lit(0.5).alias("weight")))


def brand_pairs(spark: SparkSession, sf_dir: str, least: int = 1) -> DataFrame:
    """``a, b, n``: brands that share at least ``least`` orders, a before b.

    An order holds a handful of lines, so the self-join on the order key is
    bounded; its distinct pairs are counted per pair of brands.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    bought = lines.join(brands, "l_partkey").select("l_orderkey", "p_brand").distinct()
    pairs = bought.withColumnRenamed("p_brand", "a").join(bought.withColumnRenamed("p_brand", "b"), "l_orderkey").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


# SQL twins of the views, as common table expressions.
CORPUS = "corpus as (select 'file' as source_type, doc_id as source_id, source || ' #' || doc_id as title, source as category, text as content from documents where text is not null and text <> '')"
TREE = "tree as (select 'r' || r_regionkey as id, cast(null as varchar) as parent_id, r_name as name from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name from nation)"
BRAND_PAIRS = "bought as (select distinct l_orderkey, p_brand from lineitem join part on l_partkey = p_partkey), brand_pairs as (select x.p_brand as a, y.p_brand as b, count(*) as n from bought x join bought y on x.l_orderkey = y.l_orderkey and x.p_brand < y.p_brand group by 1, 2)"
RELATIONS = BRAND_PAIRS + ", relations as (select 's' || s_suppkey as head, 'part_of' as relation, 'n' || s_nationkey as tail, 1.0::double as weight from supplier union all select 'c' || c_custkey, 'part_of', 'n' || c_nationkey, 1.0 from customer union all select 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, 1.0 from nation union all select a, 'related_to', b, 0.5 from brand_pairs)"
# An order-free hash of hexadecimal digests ``h``.
ORDER_FREE = "sha256(concat_ws(':', sum(('0x' || h[1:8])::ubigint)::varchar, sum(('0x' || h[9:16])::ubigint)::varchar, sum(('0x' || h[17:24])::ubigint)::varchar, sum(('0x' || h[25:32])::ubigint)::varchar, count(*)::varchar))"
