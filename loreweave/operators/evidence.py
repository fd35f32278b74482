"""Graph evidence, wiki channels, global summaries and support maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import markdown
from loreweave.operators import rank
from loreweave.operators.graph import DERIVED_SHARE, SPELLINGS, SYMMETRIC, merge_triples
from loreweave.sources.staging import staged

#: Questions that meet all rows in one pass; the size of what is broadcast.
ROUND = 2_000

# Cues of questions about the whole corpus.
OVERVIEW_CUES = ["整体", "全局", "概览", "全貌", "脉络", "哪些方面", "学了什么", "学了哪些", "主要主题", "主要方向", "涵盖", "覆盖了", "overview", "main themes"]
SQUASH = r"[\s*_`>#\-]+"


def squash(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), SQUASH, ""))


def is_global(question: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    return F.exists(F.array(*[F.lit(c) for c in OVERVIEW_CUES]), lambda c: F.contains(low, c))


def admissible(rel: DataFrame, known: list[str]) -> DataFrame:
    """Edges of the vocabulary that are no loops; those of a model need evidence, derived ones their derivation."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    ok = F.col("relation").isin(known) & (F.col("head") != F.col("tail"))
    return rel.filter(ok & ~((F.col("origin") == "llm") & blank("evidence")) & ~((F.col("origin") == "derived") & blank("derived_from")))


def supported(rel: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges whose quote stands in the current text of a source they cite: ``source_ref`` is that source."""
    cited = rel.withColumn("source_ref", F.explode("sources"))
    body = sources.select(F.concat_ws("-", "source_type", F.col("source_id").cast("string")).alias("source_ref"), squash(F.col("content")).alias("_body"))
    return cited.join(body, "source_ref").filter((F.char_length(squash(F.col("evidence"))) >= 6) & F.contains("_body", squash(F.col("evidence")))).drop("_body")


# Concepts, edges and sources of a question that graph evidence takes.
MOST_CONCEPTS, MOST_EDGES, MOST_SOURCES = 12, 60, 24


def graph_evidence(rel: DataFrame, concepts: DataFrame, sources: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """``question_id, source_ref, score, rank``: cited sources of edges at a question's concepts, bridges first.

    An edge between two concepts counts 2, one at a single concept 1, plus a
    tenth of its weight. Of a question's concepts the first twelve by identifier
    count (by ``place`` where there is one), of their edges the best sixty.
    """
    touched = _edges_at(rel, concepts)
    scored = supported(touched, sources).withColumn("_s", F.col("_sides") + 0.1 * F.col("weight"))
    best = scored.groupBy("question_id", "source_ref").agg(F.round(F.max("_s"), 6).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "source_ref"))).filter(F.col("rank") <= most)


def _edges_at(rel: DataFrame, concepts: DataFrame) -> DataFrame:
    """``question_id, _sides`` and the edges at a question's first twelve concepts: the best sixty, bridges and heavy ones first."""
    place = F.col("place") if "place" in concepts.columns else F.lit(0)
    ends = concepts.groupBy("question_id", "id").agg(F.min(place).alias("_p"))
    ends = ends.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy("_p", "id"))).filter(F.col("_n") <= MOST_CONCEPTS).select("question_id", "id")
    sides = [rel.join(ends.withColumnRenamed("id", side), side).select("question_id", *rel.columns, F.lit(k).alias("_side")) for k, side in enumerate(("head", "tail"))]
    edge, rest = ["question_id", "head", "relation", "tail"], [c for c in rel.columns if c not in ("head", "relation", "tail")]
    touched = sides[0].unionByName(sides[1]).groupBy(*edge).agg(F.count_distinct("_side").alias("_sides"), F.max(F.struct("weight", *[c for c in rest if c != "weight"])).alias("_q"))
    order = Window.partitionBy("question_id").orderBy(F.desc("_sides"), F.desc("_q.weight"), "head", "relation", "tail")
    return touched.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MOST_EDGES).select(*edge, "_sides", "_q.*")


def graph_passages(rel: DataFrame, concepts: DataFrame, sources: DataFrame, chunks: DataFrame, most: int = MOST_SOURCES) -> DataFrame:
    """``question_id, rank, source_type, source_id, seq, passage, score, relations``: the passages that prove a question's edges.

    ``rel``: head, relation, tail, weight, evidence, sources, origin; ``sources``:
    source_type, source_id, content; ``chunks``: source_type, source_id, seq, text.
    An edge counts if it is of the vocabulary, no loop, not derived, and its quote
    stands in the current text of a source it cites, both in their normal form.
    The chunk that holds the quote is the passage; where none does, as the quote
    runs over a border or the chunk stands at several places of other meaning, the
    text around it, with seq -1. An edge between two concepts scores 2, at one 1,
    plus a tenth of its weight; a passage has the score of its best edge and names all.
    """
    kinds = F.col("relation").isin(list(SPELLINGS)) & (F.col("head") != F.col("tail")) & (F.lower(F.coalesce("origin", F.lit(""))) != "derived")
    edges = _edges_at(rel, concepts).filter(kinds)
    weight = F.when(F.isnan("weight") | F.col("weight").isNull() | F.abs("weight").isin(float("inf")), 0.0).otherwise(F.least(F.greatest("weight", F.lit(0.0)), F.lit(1.0)))
    turned = F.col("relation").isin(SYMMETRIC) & (F.col("head") > F.col("tail"))
    ends = F.when(turned, F.struct(F.col("tail").alias("x"), F.col("head").alias("y"))).otherwise(F.struct(F.col("head").alias("x"), F.col("tail").alias("y")))
    label = F.concat("head", F.lit(" —"), "relation", F.lit("→ "), "tail")
    edges = edges.select("question_id", F.concat_ws(":", ends["x"], "relation", ends["y"]).alias("edge"), label.alias("label"), F.round(F.col("_sides") + 0.1 * weight, 6).alias("score"), "evidence", F.slice(F.array_distinct("sources"), 1, MOST_SOURCES).alias("sources"))
    edges = markdown.normalised(edges.filter(F.size("sources") > 0), "evidence", "_e").withColumn("quote", F.col("_e.normal")).filter("quote <> ''").drop("_e", "evidence")
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "edge", "label")
    edges = edges.withColumn("n", F.row_number().over(order))
    cited = staged(edges.select("question_id", "edge", "label", "score", "quote", "n", F.posexplode("sources").alias("at", "source_ref")), "cited")
    first = cited.groupBy("question_id", "source_ref").agg(F.min(F.struct("n", "at")).alias("_f"))
    first = first.withColumn("_n", F.row_number().over(Window.partitionBy("question_id").orderBy("_f"))).filter(F.col("_n") <= MOST_SOURCES)
    cited = cited.join(first.select("question_id", "source_ref"), ["question_id", "source_ref"])
    ref = F.concat_ws("-", "source_type", F.col("source_id").cast("string"))
    documents = sources.withColumn("source_ref", ref).join(cited.select("source_ref").distinct(), "source_ref", "left_semi").filter(F.trim("content") != "")
    documents = staged(markdown.normalised(documents.select("source_ref", "source_type", "source_id", "content"), "content", "form"), "documents")
    proven = cited.join(documents.select("source_ref", F.col("form.normal").alias("_n")), "source_ref").withColumn("place", F.position(F.col("quote"), F.col("_n")) - 1).filter("place >= 0").drop("_n")
    proven = staged(proven, "proven")
    # the part of a document's normal form that each of its chunks stands for, found where the document is
    cut = chunks.withColumn("source_ref", ref).join(proven.select("source_ref").distinct(), "source_ref", "left_semi")
    cut = cut.groupBy("source_ref").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("chunks"))
    placed = markdown.scoped(cut.join(documents.select("source_ref", "content"), "source_ref").withColumn("texts", F.col("chunks.text")), "content", "texts", "scopes")
    parts = placed.select("source_ref", F.explode(F.arrays_zip("chunks", "scopes")).alias("c")).select("source_ref", "c.chunks.seq", "c.chunks.text", F.col("c.scopes").alias("scope"))
    held = proven.join(parts, "source_ref").filter(F.contains("scope", F.col("quote"))).select(*proven.columns, "seq", F.col("text").alias("passage"))
    held = staged(held, "held")
    loose = proven.join(held.select("question_id", "source_ref", "n").distinct(), ["question_id", "source_ref", "n"], "left_anti").join(documents.select("source_ref", "content", "form"), "source_ref")
    around = markdown.window(F.col("content"), F.col("form"), F.col("place"), F.char_length("quote"))
    found = held.unionByName(loose.select(*proven.columns, F.lit(-1).cast(dict(held.dtypes)["seq"]).alias("seq"), around.alias("passage")))
    per = found.groupBy("question_id", "source_ref", "seq", "passage").agg(F.max("score").alias("score"), F.min(F.struct("n", "at")).alias("_f"), F.array_sort(F.collect_set(F.struct("edge", "n", "label"))).alias("_all"))
    # one name for each edge: the first by order; symmetric ones have one key
    names = F.transform(F.array_sort(F.transform(F.filter("_all", lambda x, i: (i == 0) | (F.get(F.col("_all"), i - 1)["edge"] != x["edge"])), lambda x: F.struct(x["n"].alias("n"), x["label"].alias("label")))), lambda x: x["label"])
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "_f", "seq", "passage"))
    kind = F.split("source_ref", "-")
    return per.withColumn("rank", place).filter(F.col("rank") <= most).select("question_id", "rank", kind[0].alias("source_type"), kind[1].cast("long").alias("source_id"), "seq", "passage", "score", names.alias("relations"))


def expand_terms(rel: DataFrame, concepts: DataFrame, names: DataFrame, questions: DataFrame, most: int = 6) -> DataFrame:
    """``question_id, name``: names one hop away, of 2 to 24 characters, not in the question."""
    walk = rel.select(F.col("head").alias("id"), F.col("tail").alias("next"), "weight").unionByName(rel.select(F.col("tail").alias("id"), F.col("head").alias("next"), "weight"))
    near = concepts.join(walk, "id").groupBy("question_id", "next").agg(F.max("weight").alias("w")).join(names.select(F.col("id").alias("next"), "name"), "next").join(questions, "question_id")
    ok = near.filter(F.char_length("name").between(2, 24) & ~F.contains(F.lower("question"), F.lower("name")))
    return ok.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("w"), "name"))).filter(F.col("n") <= most).select("question_id", "name")


def global_summaries(summaries: DataFrame, questions: DataFrame, most: int = 6) -> DataFrame:
    """``question_id, community, score, rank``: ten for each named member, one for each term in the summary, then size.

    ``summaries``: community, members, summary, size; ``questions``: question_id,
    question, terms, a stated set that meets all summaries in rounds.
    """
    low = F.lower("question")
    member = F.size(F.filter("members", lambda m: F.contains(low, F.lower(m))))
    term = F.size(F.filter("terms", lambda t: F.contains(F.lower("summary"), F.lower(t))))
    met = lambda some: summaries.crossJoin(F.broadcast(some)).select("question_id", "community", "size", (10 * member + term).cast("long").alias("score"))
    s = rank.in_rounds(questions, "question_id", ROUND, met)
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("size"), "community"))).filter(F.col("rank") <= most).drop("size")


def replace_support(rel: DataFrame, ref: str, fresh: DataFrame) -> DataFrame:
    """Edges after one source was read again: its citation goes where it no longer holds, edges without support go.

    Manual edges stay as they are; an edge that only lost support weighs at most 0.4, a new one at least 0.9.
    """
    key = ["head", "relation", "tail"]
    now = fresh.select(*key, F.lit(True).alias("_now"), F.col("evidence").alias("_quote")).dropDuplicates(key)
    j = rel.join(now, key, "left")
    manual, cites = F.col("origin") == "manual", F.array_contains("sources", ref)
    left = F.when(manual | F.col("_now").isNotNull() | ~cites, F.col("sources")).otherwise(F.array_remove("sources", ref))
    lost = ~manual & cites & F.col("_now").isNull()
    kept = j.withColumns({"sources": left, "weight": F.when(lost, F.least("weight", F.lit(0.4))).otherwise(F.col("weight"))}).filter(manual | (F.size("sources") > 0)).select(rel.columns)
    new = fresh.join(rel.select(*key), key, "left_anti").withColumn("weight", F.greatest("weight", F.lit(0.9)))
    return kept.unionByName(new.select(rel.columns))


def merge_nodes(rel: DataFrame, same: DataFrame) -> DataFrame:
    """Edges with ends mapped by ``old, new``; loops go, equal edges merge. Their nodes: ``merge_names``."""
    h, t = same.select(F.col("old").alias("head"), F.col("new").alias("_h")), same.select(F.col("old").alias("tail"), F.col("new").alias("_t"))
    m = rel.join(h, "head", "left").join(t, "tail", "left").withColumn("head", F.coalesce("_h", "head")).withColumn("tail", F.coalesce("_t", "tail"))
    return merge_triples(m.filter("head <> tail"))


def merge_names(nodes: DataFrame, same: DataFrame) -> DataFrame:
    """Nodes (id, name, aliases, source_count) after those of ``same`` (old, new) went into others.

    A node that others went into keeps its name; their names and aliases become
    aliases of it, once each, and their source counts are added. Loops of
    ``same`` and nodes that are to go into unknown ones change nothing.
    """
    known = nodes.select(F.col("id").alias("new"))
    into = same.filter("old <> new").join(known, "new", "left_semi").select(F.col("old").alias("id"), "new")
    moved = nodes.join(into, "id", "left").withColumn("_own", F.col("new").isNull()).withColumn("_to", F.coalesce("new", "id"))
    rows = moved.groupBy("_to").agg(
        F.max(F.when(F.col("_own"), F.col("name"))).alias("name"), F.sum("source_count").alias("source_count"),
        F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct((~F.col("_own")).alias("later"), "id", F.concat(F.when(F.col("_own"), F.array().cast("array<string>")).otherwise(F.array("name")), F.coalesce("aliases", F.array().cast("array<string>"))).alias("all"))))["all"])).alias("_all"),
    )
    return rows.select(F.col("_to").alias("id"), "name", F.array_remove("_all", F.col("name")).alias("aliases"), "source_count")


def delete_nodes(rel: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those at a deleted node."""
    return rel.join(gone.select(F.col("id").alias("head")), "head", "left_anti").join(gone.select(F.col("id").alias("tail")), "tail", "left_anti").select(rel.columns)


def edge_weights(rel: DataFrame) -> DataFrame:
    """``head, tail, w``: weights summed over relations, derived edges at 0.35."""
    return rel.groupBy("head", "tail").agg(F.sum(F.when(F.col("origin") == "derived", F.col("weight") * DERIVED_SHARE).otherwise(F.col("weight"))).alias("w"))


def wiki_sections_channel(sections: DataFrame, questions: DataFrame, most: int = 4) -> DataFrame:
    """``question_id, page_id, section, score, rank``: three for each term in the body, two in the heading, one in the name.

    A plain scoring of stated terms; ``wiki.section_channel`` has the gates and weights of questions.

    The best section of each page comes first, then second ones. ``questions``
    carries ``terms``; it is a stated set that meets all sections in rounds.
    """
    count = lambda c: F.size(F.filter("terms", lambda t: F.contains(F.lower(c), F.lower(t))))
    met = lambda some: sections.crossJoin(F.broadcast(some)).withColumn("score", 3 * count("body") + 2 * count("heading") + count("name")).filter("score > 0")
    s = rank.in_rounds(questions, "question_id", ROUND, met)
    w = Window.partitionBy("question_id", "page_id").orderBy(F.desc("score"), "section")
    two = s.withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    order = Window.partitionBy("question_id").orderBy("_n", F.desc("score"), "page_id", "section")
    return two.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("question_id", "page_id", "section", "score", "rank")


def rerank_pool(first: DataFrame, extra: DataFrame, key: list[str], window: int, reserved: int = 4) -> DataFrame:
    """Candidates for a reranker: up to ``reserved`` supplemental hits keep a place, the rest is filled in order."""
    spare = extra.join(first.select("question_id", *key), ["question_id", *key], "left_anti").filter(F.col("rank") <= reserved).select("question_id", *key, "rank").withColumn("_extra", F.lit(1))
    n = spare.groupBy("question_id").agg(F.count("*").alias("_n"))
    kept = first.join(n, "question_id", "left").filter(F.col("rank") <= window - F.coalesce("_n", F.lit(0))).select("question_id", *key, "rank").withColumn("_extra", F.lit(0))
    order = Window.partitionBy("question_id").orderBy("_extra", "rank")
    return kept.unionByName(spare).withColumn("rank", F.row_number().over(order)).drop("_extra")


def verified_quotes(quotes: DataFrame, windows: DataFrame) -> DataFrame:
    """Quotes (path, line, text) that stand word for word in a window that was read."""
    return quotes.join(windows.select("path", "line", F.col("text").alias("_read")), ["path", "line"]).filter(F.trim("text") == F.trim("_read")).drop("_read")
