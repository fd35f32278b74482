"""Concept nodes: upserts, resolution, reasoning, relation ranking, overviews and duplicates, all as joins and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.operators import graph, near, rank

# Relations that say most, words that ask for a relation, edges of a local block at most.
VALUABLE = ["prerequisite", "contrast_with", "is_a", "part_of"]
RELATION_WORDS = ["关系", "区别", "不同", "差异", "易混", "混淆", "先学", "先掌握", "要先", "该先", "前置", "之前要", "之前先", "属于", "包含", "依赖"]
MOST_EDGES = 24
# Fixed value: words of a quote that make a composition or a kind a dependency instead.
DEPENDENCY = r"(?i)depends?\s+on|requires?|prerequisite|依赖|前提|先修|需要先"
KEY = ["head", "relation", "tail"]


def _blank(c) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


# --- nodes


def upsert(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """Nodes by the identifier of their normalised name, those that meet merged.

    Both: name, norm, type, aliases, source_count, brief; ``incoming`` also place,
    its order. The first name and the first type stay, aliases are united (with
    other spellings of the name), source counts added, the first brief that is
    not blank is kept. Rows without a norm make no node.
    """
    rows = known.select("name", "norm", "type", "aliases", "source_count", "brief", F.lit(-1).cast("long").alias("place")).unionByName(incoming.select("name", "norm", "type", "aliases", "source_count", "brief", F.col("place").cast("long")))
    rows = rows.filter(~_blank(F.col("norm"))).withColumn("aliases", F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name")))
    first = lambda c: F.min_by(F.when(~_blank(F.col(c)), F.col(c)), F.when(~_blank(F.col(c)), F.struct("place", c)))
    merged = rows.groupBy("norm").agg(first("name").alias("name"), first("type").alias("type"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("_all"), F.sum("source_count").alias("source_count"), first("brief").alias("brief"))
    return merged.select(graph.entity_id(F.col("norm")).alias("id"), "name", "norm", "type", F.array_remove("_all", F.col("name")).alias("aliases"), "source_count", "brief")


def resolved(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``name, norm, id`` of the names (name, norm) that are known: by identifier, else by norm, else by an alias's norm (``alias_norms``)."""
    table = reduce(DataFrame.unionByName, [nodes.select(F.lit(p).alias("p"), k.alias("k"), "id") for p, k in enumerate((F.col("id"), F.col("norm"), F.explode("alias_norms")))])
    keys = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).alias("k")) for p, c in enumerate(("name", "norm", "norm"))]))
    hits = names.select("name", "norm", keys.alias("_k")).select("name", "norm", "_k.*").join(table.filter("k <> ''"), ["p", "k"])
    return hits.groupBy("name", "norm").agg(F.min(F.struct("p", "id")).alias("_hit")).select("name", "norm", F.col("_hit.id").alias("id"))


def resolve(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``name, norm, id`` of every name (name, norm), null where none is known."""
    return names.select("name", "norm").distinct().join(resolved(names, nodes), ["name", "norm"], "left")


def corrected(relation: Column, quote: Column) -> Column:
    """A kind or a part whose quote speaks of a dependency is a prerequisite."""
    return F.when(relation.isin("is_a", "part_of") & F.coalesce(quote, F.lit("")).rlike(DEPENDENCY), "prerequisite").otherwise(relation)


def accept_triples(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """Triples of plausible, admissible names in the vocabulary, their ends resolved, loops dropped, equal ones merged.

    ``raw``: id, head, head_norm, relation, tail, tail_norm, evidence, sources, weight.
    """
    ok = reduce(lambda a, b: a & b, [graph.plausible_name(F.col(c)) & graph.admissible_concept(F.col(c)) for c in ("head", "tail")])
    spellings = raw.select("relation").distinct().withColumn("_kind", graph.canonical_relation(F.col("relation"))).filter("_kind is not null")  # few spellings, many rows
    named = raw.filter(ok).join(spellings, "relation").withColumn("relation", corrected(F.col("_kind"), F.col("evidence"))).drop("_kind")
    both = F.array(*[F.struct(F.col(c).alias("name"), F.col(f"{c}_norm").alias("norm")) for c in ("head", "tail")])
    known = resolved(named.select(F.explode(both).alias("e")).select("e.*").distinct(), nodes)
    for side in ("head", "tail"):
        named = named.join(known.select(F.col("name").alias(side), F.col("norm").alias(f"{side}_norm"), F.col("id").alias(f"_{side}")), [side, f"{side}_norm"])
    return graph.merge_triples(named.filter("_head <> _tail").select("id", F.col("_head").alias("head"), "relation", F.col("_tail").alias("tail"), "evidence", "sources", "weight"))


def reason(rel: DataFrame) -> DataFrame:
    """The direct edges, and those derived anew from the ones with evidence; edges derived before are dropped.

    ``rel``: head, relation, tail, weight, evidence, origin.
    """
    direct = rel.filter("origin <> 'derived'")
    proven = direct.filter(~_blank(F.col("evidence"))).groupBy(*KEY).agg(F.max("weight").alias("weight"))
    made = graph.symmetric_closure(proven).drop("via").unionByName(graph.transitive_closure(proven))
    new = made.groupBy(*KEY).agg(F.max("weight").alias("weight")).join(direct.select(*KEY).distinct(), KEY, "left_anti")
    return direct.select(*KEY, "weight", "origin").unionByName(new.withColumn("origin", F.lit("derived")).select(*KEY, "weight", "origin"))


def recognised_by_vector(nodes: DataFrame, asked: DataFrame, least: float = 0.62, most: int = 8, per_round: int = 2_000) -> DataFrame:
    """``question_id, id, score``: nodes (id, vec) whose cosine with a question (question_id, vec) is at least ``least``."""
    met = near.scored(nodes.select("id", "vec"), asked, most, least, lengths=False, per_round=per_round)
    return rank.top(met, ["question_id"], [F.desc("score"), F.col("id")], most).drop("rank")


def embedding_text(name: Column, brief: Column, wiki: Column, most: int = 1200) -> Column:
    """Name, brief and page text that are there, by full stops, cut."""
    parts = [F.when(~_blank(c), F.trim(c)) for c in (name, brief, wiki)]
    return F.substring(F.concat_ws("。", *parts), 1, most)


def stats(nodes: DataFrame, rel: DataFrame) -> DataFrame:
    """One row of counts: nodes, embedded and legacy ones, edges, derived and evidenced ones, isolated nodes."""
    ends = rel.select(F.explode(F.array("head", "tail")).alias("id")).distinct()
    n = nodes.join(ends.withColumn("_linked", F.lit(True)), "id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("vec").isNotNull()).alias("embedded"), F.count_if(F.col("vec").isNotNull() & (F.size("vec") != F.col("dim"))).alias("legacy"), F.count_if(F.col("_linked").isNull()).alias("isolated"))
    e = rel.agg(F.count("*").alias("edges"), F.count_if(F.col("origin") == "derived").alias("derived"), F.count_if(~_blank(F.col("evidence"))).alias("evidenced"))
    return n.crossJoin(F.broadcast(e))  # one row each


# --- relations of a question


def best_of_pair(rel: DataFrame, by: list[str]) -> DataFrame:
    """One edge for each unordered pair of ends: one with evidence first, then the first by ``place``."""
    pair = [*by, F.least("head", "tail"), F.greatest("head", "tail")]
    order = Window.partitionBy(*pair).orderBy(_blank(F.col("evidence")), "place")
    return rel.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def symmetric_key(rel_head: Column, relation: Column, rel_tail: Column) -> Column:
    """A key that is the same for both directions of a symmetric relation."""
    flipped = relation.isin(graph.SYMMETRIC) & (rel_head > rel_tail)
    return F.concat_ws("|", F.when(flipped, rel_tail).otherwise(rel_head), relation, F.when(flipped, rel_head).otherwise(rel_tail))


def ranked_edges(rel: DataFrame, concepts: DataFrame) -> DataFrame:
    """admissible edges at a question's concepts in order, one for each symmetric key, with ``rank``.

    ``rel``: head, relation, tail, weight, evidence, sources, origin, derived_from; ``concepts``: question_id, id.
    """
    from loreweave.operators import evidence

    known = evidence.admissible(rel, list(graph.SPELLINGS)).filter((F.col("origin") == "derived") | ~_blank(F.col("evidence")))
    ends = concepts.select("question_id", "id").distinct()
    sides = [known.join(ends.withColumnRenamed("id", side), side).select("question_id", *rel.columns) for side in ("head", "tail")]
    key = symmetric_key(F.col("head"), F.col("relation"), F.col("tail"))
    touched = sides[0].withColumn("_s", F.lit(1)).unionByName(sides[1].withColumn("_s", F.lit(2)))
    touched = touched.groupBy("question_id", *rel.columns).agg(F.count_distinct("_s").alias("_sides")).withColumn("_key", key)
    order = [F.desc("_sides"), F.col("origin") == "derived", F.size(F.coalesce("sources", F.array().cast("array<string>"))) == 0, ~F.col("relation").isin(VALUABLE), F.desc("weight"), F.col("_key"), F.col("head")]
    one = touched.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "_key").orderBy(*order))).filter("_n = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).withColumn("bridging", F.col("_sides") == 2).drop("_n", "_sides", "_key")


def local_block(rel: DataFrame, concepts: DataFrame, names: DataFrame, budget: int, most: int = 8) -> DataFrame:
    """``question_id, place, line``: a question's concepts and best edges as lines within a budget; what does not fit is skipped.

    ``names``: id, name, brief. At most min(24, max(3, 3 * most)) edges.
    """
    ends = rank.top(concepts.select("question_id", "id").distinct(), ["question_id"], [F.col("id")], most)
    own = ends.join(names, "id").select("question_id", F.col("rank").alias("place"), F.concat(F.lit("- "), "name", F.when(_blank(F.col("brief")), "").otherwise(F.concat(F.lit("："), "brief")), F.lit("\n")).alias("line"))
    edges = ranked_edges(rel, ends).filter(F.col("rank") <= min(MOST_EDGES, max(3, 3 * most)))
    for side in ("head", "tail"):
        edges = edges.join(names.select(F.col("id").alias(side), F.col("name").alias(f"_{side}")), side)
    mark = F.when(F.col("origin") == "derived", "（推导）").otherwise("")
    said = edges.select("question_id", (F.col("rank") + 1000).alias("place"), F.concat(F.lit("- "), "_head", F.lit(" —"), "relation", F.lit("→ "), "_tail", mark, F.lit("\n")).alias("line"))
    lines = own.unionByName(said).withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy("place"))).withColumn("_cost", F.char_length("line"))
    return rank.budget_skip(lines, ["question_id"], "_cost", budget).select("question_id", F.col("rank").alias("place"), "line")


def asks_relation(question: Column, concepts: Column) -> Column:
    """Two concepts or more, or a word that asks how things relate."""
    q = F.coalesce(question, F.lit(""))
    return (concepts >= 2) | F.exists(F.array(*map(F.lit, RELATION_WORDS)), lambda w: F.contains(q, w))


# --- views of a graph


def undirected_hops(rel: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``seed, id, hop``: nodes within ``hops`` steps of a seed in either direction, by the fewest."""
    walk = rel.select(F.col("head").alias("at"), F.col("tail").alias("id")).unionByName(rel.select(F.col("tail").alias("at"), F.col("head").alias("id"))).distinct()
    front = seeds.select(F.col("id").alias("seed"), "id").distinct()
    seen = front.withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        front = front.withColumnRenamed("id", "at").join(walk, "at").select("seed", "id").distinct().join(seen, ["seed", "id"], "left_anti")
        seen = seen.unionByName(front.withColumn("hop", F.lit(hop)))
    return seen


def filtered(nodes: DataFrame, rel: DataFrame, relations: list[str] | None = None, origin: str | None = None, community: int | None = None, focus: str | None = None, isolated: bool = False) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, community) and edges that pass the filters; nodes without an edge go unless asked for."""
    e = rel
    if relations is not None:
        e = e.filter(F.col("relation").isin(relations))
    if origin is not None:
        e = e.filter(F.col("origin") == origin)
    if focus is not None:
        e = e.filter((F.col("head") == focus) | (F.col("tail") == focus))
    n = nodes if community is None else nodes.filter(F.col("community") == community)
    for side in ("head", "tail"):
        e = e.join(n.select(F.col("id").alias(side)), side, "left_semi")
    ends = e.select(F.explode(F.array("head", "tail")).alias("id")).distinct()
    return (n if isolated else n.join(ends, "id", "left_semi")), e.select(rel.columns)


def overview(rel: DataFrame, members: DataFrame, most: int = 96) -> DataFrame:
    """``x, y, direct, derived, forward, backward, internal``: edges between communities, the most edges first.

    ``rel``: head, tail, origin; ``members``: id, community. Edges with an end in no community are ignored.
    """
    for side, name in (("head", "_a"), ("tail", "_b")):
        rel = rel.join(members.select(F.col("id").alias(side), F.col("community").alias(name)), side)
    g = rel.groupBy(F.least("_a", "_b").alias("x"), F.greatest("_a", "_b").alias("y"))
    counted = g.agg(F.count_if(F.col("origin") != "derived").alias("direct"), F.count_if(F.col("origin") == "derived").alias("derived"), F.count_if(F.col("_a") < F.col("_b")).alias("forward"), F.count_if(F.col("_a") > F.col("_b")).alias("backward"), F.count("*").alias("_n"))
    return counted.withColumn("internal", F.col("x") == F.col("y")).orderBy(F.desc("_n"), "x", "y").limit(most).drop("_n")


def community_titles(rel: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """``community, size, title``: the two members with most edges name a community, largest first."""
    degree = members.join(graph.degrees(rel), "id", "left").join(names.select("id", "name"), "id").withColumn("degree", F.coalesce("degree", F.lit(0)))
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "name", "id")
    placed = degree.withColumn("_n", F.row_number().over(order))
    best = lambda k: F.max(F.when(F.col("_n") == k, F.col("name")))
    return placed.groupBy("community").agg(F.count("*").alias("size"), F.concat_ws(" · ", best(1), best(2)).alias("title"))


def partition_stats(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Communities, singletons, the largest, members, and nodes in no community."""
    sizes = members.groupBy("community").agg(F.count("*").alias("n")).agg(F.count("*").alias("communities"), F.count_if(F.col("n") == 1).alias("singletons"), F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))
    dangling = nodes.join(members.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("dangling"))
    return sizes.crossJoin(F.broadcast(dangling))  # one row each


def partition_fingerprint(rel: DataFrame) -> DataFrame:
    """One hash of a partition's input, whatever its order; equal hashes mean that nothing has to be computed anew."""
    row = F.sha2(F.concat_ws("|", "head", "tail", F.round("w", 6).cast("string")), 256)
    parts = [F.sum(F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 9, 17, 25)]
    return rel.agg(F.substring(F.sha2(F.concat_ws(":", *[F.coalesce(p, F.lit("0")) for p in parts], F.count("*").cast("string")), 256), 1, 16).alias("fingerprint"))


def member_hashes(members: DataFrame) -> DataFrame:
    """``community, size, hash``: a hash over the sorted members, equal if and only if the sets are."""
    return members.groupBy("community").agg(F.count_distinct("id").alias("size"), F.sha2(F.array_join(F.array_sort(F.collect_set("id")), "\n"), 256).alias("hash"))


def summary_states(members: DataFrame, summaries: DataFrame) -> DataFrame:
    """``community, state``: fresh, stale (other members), missing, or orphan (of a community that is gone).

    ``summaries``: community, hash.
    """
    now, old = member_hashes(members).select("community", F.col("hash").alias("_now")), summaries.select("community", F.col("hash").alias("_old"))
    state = F.when(F.col("_old").isNull(), "missing").when(F.col("_now").isNull(), "orphan").when(F.col("_now") == F.col("_old"), "fresh").otherwise("stale")
    return now.join(old, "community", "full").select("community", state.alias("state"))


def summary_inputs(rel: DataFrame, members: DataFrame, sources: DataFrame, most: int = 20) -> DataFrame:
    """``community, rank, head, relation, tail``: the edges inside a community whose quote stands in a source they cite, heaviest first."""
    from loreweave.operators import evidence

    for side, name in (("head", "_a"), ("tail", "_b")):
        rel = rel.join(members.select(F.col("id").alias(side), F.col("community").alias(name)), side)
    inner = evidence.supported(rel.filter("_a = _b"), sources).groupBy(F.col("_a").alias("community"), *KEY).agg(F.max("weight").alias("weight"))
    return rank.top(inner, ["community"], [F.desc("weight"), F.col("head"), F.col("relation"), F.col("tail")], most).drop("weight")


def explorer(folders: DataFrame, items: DataFrame, parent, name: str = "") -> DataFrame:
    """``is_item, id, name, children``: child folders before items, both by name, with their numbers of children.

    ``folders``: id, parent_id, name; ``items``: id, folder_id, name.
    """
    here = lambda c: F.col(c).isNull() if parent is None else F.col(c) == parent
    match = lambda df: df.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    inside = folders.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n")).unionByName(items.groupBy(F.col("folder_id").alias("id")).agg(F.count("*").alias("n"))).groupBy("id").agg(F.sum("n").alias("children"))
    shown = match(folders.filter(here("parent_id"))).join(inside, "id", "left").select(F.lit(False).alias("is_item"), "id", "name", F.coalesce("children", F.lit(0)).alias("children"))
    return shown.unionByName(match(items.filter(here("folder_id"))).select(F.lit(True).alias("is_item"), "id", "name", F.lit(0).cast("long").alias("children")))


def duplicates(names: DataFrame) -> DataFrame:
    """``a, b, score`` of pairs of nodes (id, name) with similar names, a before b.

    Only pairs that share a gram meet. A pair within the edit bound shares one of
    the shorter name's rarer grams (q-gram lemma), a contained name all of its
    own, so nothing is missed: names are probed by the rarer half of their grams
    and one more, and found by all. Names of one character are grams themselves.
    """
    n = F.char_length("name")
    grams = F.array_distinct(F.concat(F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(2)))).otherwise(F.array().cast("array<string>")), F.filter(F.split("name", ""), lambda c: c != "")))
    long = names.filter(n > 0).select("id", "name", F.explode(grams).alias("gram"))
    counts = long.groupBy("gram").agg(F.count("*").alias("_df"))
    usable = long.filter((F.char_length("gram") == 2) | (n == 1)).join(counts, "gram")
    order = Window.partitionBy("id", "name").orderBy("_df", "gram")
    probes = usable.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy("id", "name"))).filter(F.col("_i") <= F.ceil(F.col("_n") / 2) + 1)
    met = probes.select(F.col("id").alias("x"), F.col("name").alias("xn"), "gram").join(long.select(F.col("id").alias("y"), F.col("name").alias("yn"), "gram"), "gram").filter("x <> y")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") < F.col("y"), F.col("xn")).otherwise(F.col("yn")).alias("an"), F.when(F.col("x") < F.col("y"), F.col("yn")).otherwise(F.col("xn")).alias("bn")).distinct()
    return pairs.select("a", "b", graph.name_similarity(F.col("an"), F.col("bn")).alias("score")).filter("score > 0")
