"""Concept graph: vocabulary, merging, closure, neighbourhoods, paths, communities."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.operators import rank
from loreweave.sources.staging import staged

# The closed vocabulary and its properties.
TRANSITIVE = ["is_a", "part_of", "prerequisite"]
SYMMETRIC = ["contrast_with", "related_to"]
# Spellings of each relation.
SPELLINGS = {
    "is_a": ["is_a", "isa", "instance_of", "subclass_of", "kind_of", "type_of", "belongs_to_type", "是一种", "属于一种", "是一类", "是某种", "子类", "继承"],
    "part_of": ["part_of", "partof", "component_of", "member_of", "belongs_to", "composed_of", "属于", "是…的一部分", "是一部分", "组成部分", "包含于", "环节"],
    "prerequisite": ["prerequisite", "prereq", "requires", "depends_on", "depends", "before", "need_first", "前置", "前置知识", "前提", "依赖", "先修", "需要先学"],
    "used_for": ["used_for", "use_for", "used_to", "purpose", "for", "用于", "用来", "用途", "作用"],
    "contrast_with": ["contrast_with", "contrast", "confusable_with", "confuse_with", "similar_but_different", "vs", "易混", "对比", "区别", "容易混淆"],
    "related_to": ["related_to", "related", "relates_to", "relevant_to", "see_also", "association", "相关", "有关", "关联", "参考"],
}
# The order in which contained spellings decide.
FALLBACK = ["contrast_with", "prerequisite", "part_of", "is_a", "used_for", "related_to"]
DECAY, LEAST_WEIGHT, DERIVED_SHARE = 0.7, 0.25, 0.35


def canonical_relation(raw: Column) -> Column:
    """The vocabulary's relation for a free spelling: exact after squeezing, else the first contained spelling; null if unknown."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    squeezed = F.regexp_replace(low, r"[\s_\-]+", "")
    spelled: dict[str, str] = {}
    for rel, names in SPELLINGS.items():
        for name in names:
            spelled.setdefault(name, rel)
    exact = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair])
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rel).alias("rel")) for rel in FALLBACK for name in SPELLINGS[rel]])
    contained = F.get(F.filter(ordered, lambda x: F.contains(low, x["name"])), F.lit(0))["rel"]
    return F.when(low != "", F.coalesce(F.try_element_at(exact, squeezed), contained))


_PAREN = re.compile(r"[（(\[【]([^（）()\[\]【】]*)[）)\]】]")
_WRAP = re.compile(r"^[\s\"'“”‘’《》「」`*]+|[\s\"'“”‘’《》「」`*]+$")


def display_name(raw: str | None) -> str:
    """Without parenthesised parts and wrapping marks, white space folded, case kept."""
    s = _WRAP.sub("", _PAREN.sub("", unicodedata.normalize("NFKC", raw or "")))
    return re.sub(r"\s+", " ", s).strip()


def normal_name(raw: str | None) -> str:
    """Identity of an entity: display form without white space and connectors, lower case."""
    s = _WRAP.sub("", _PAREN.sub("", unicodedata.normalize("NFKC", raw or "")))
    return re.sub(r"[_\-·・]", "", re.sub(r"\s+", "", s)).lower()


def alias_candidates(raw: str | None) -> list[str]:
    """Names in parentheses and the parts of a coordinated name."""
    base = unicodedata.normalize("NFKC", raw or "")
    main = display_name(base)
    if not main:
        return []
    found = [display_name(x) for x in _PAREN.findall(base)] + [display_name(x) for x in re.split(r"[/、]| 与 | 和 ", main)]
    return [x for x in dict.fromkeys(found) if x and x != main and len(x) <= 40]


def normal_name_column(name: Column) -> Column:
    """``normal_name`` as a column; NFKC has no built-in expression, so batches go through Arrow."""

    @F.pandas_udf("string")
    def convert(names):
        return names.map(normal_name)

    return convert(name)


def entity_id(norm: Column) -> Column:
    return F.when(norm != "", F.concat(F.lit("e-"), F.substring(F.sha2(norm, 256), 1, 10)))


def plausible_name(name: Column) -> Column:
    """A name, not a sentence: at most 40 characters, a letter or ideograph, no number, no punctuation."""
    return (F.char_length(name).between(1, 40)) & name.rlike("[\\p{IsHan}A-Za-z]") & ~name.rlike("^[0-9.]+$") & ~name.rlike("[，。、；：！？,.!?;:]")


def admissible_concept(name: Column) -> Column:
    """Concept names: no options, no commands or colloquial phrases, at most 24 characters unless one identifier."""
    n = F.trim(F.coalesce(name, F.lit("")))
    option = n.startswith("-") | F.contains(n, F.lit("--")) | n.rlike(r"\s-[A-Za-z]")
    phrase = n.rlike("^(修改|打印|生成|删除|查看|添加|获取|创建|使用|执行)") | n.rlike("一个|怎么|如何|重新")
    return n.rlike("[A-Za-z\\u4e00-\\u9fa5]") & ~option & ~phrase & (n.rlike(r"^[A-Za-z0-9_$.]+$") | (F.char_length(n) <= 24))


def name_similarity(a: Column, b: Column) -> Column:
    """1 if equal, 0.6 if one contains the other, else edit similarity from 0.75 on, else 0."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    sim = F.lit(1.0) - F.levenshtein(a, b) / longest
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.6).when(sim >= 0.75, sim).otherwise(0.0)


# Fixed value: characters of evidence that a triple keeps.
EVIDENCE_CHARS = 480


def normal_weight(weight: Column) -> Column:
    """The weight of a new triple: one where it is not positive or beyond one."""
    return F.when((weight <= 0) | (weight > 1), 1.0).otherwise(weight)


def merge_triples(rows: DataFrame) -> DataFrame:
    """One row per (head, relation, tail): first non-blank evidence by id, union of sources, weight.

    The row with the smallest id makes the triple, its weight normalised; a later
    row only raises it, and its weight counts as it is. Of rows with that id the
    lightest is the first and the others do not count.
    """
    key = ["head", "relation", "tail"]
    evidence = F.when(F.trim(F.coalesce("evidence", F.lit(""))) != "", F.substring("evidence", 1, EVIDENCE_CHARS))
    merged = rows.groupBy(*key).agg(
        F.min_by(evidence, F.when(evidence.isNotNull(), F.struct("id", evidence))).alias("evidence"), F.array_sort(F.flatten(F.collect_set(F.coalesce("sources", F.array().cast("array<string>"))))).alias("sources"), F.min(F.struct("id", "weight")).alias("_first")
    )
    later = rows.select(*key, "id", "weight").join(merged.select(*key, F.col("_first.id").alias("_id")), key).filter("id > _id").groupBy(*key).agg(F.max("weight").alias("_later"))
    weight = F.greatest(normal_weight(F.col("_first.weight")), "_later")
    return merged.join(later, key, "left").select(*key, "evidence", F.array_distinct("sources").alias("sources"), weight.alias("weight"))


def symmetric_closure(rel: DataFrame) -> DataFrame:
    """The missing reverses of symmetric relations: head, relation, tail, weight, via."""
    swapped = rel.filter(F.col("relation").isin(SYMMETRIC)).select(F.col("tail").alias("head"), "relation", F.col("head").alias("tail"), "weight")
    return swapped.join(rel, ["head", "relation", "tail"], "left_anti").dropDuplicates(["head", "relation", "tail"]).withColumn("via", F.lit("symmetric"))


def transitive_closure(rel: DataFrame, rounds: int = 2) -> DataFrame:
    """Derived edges of transitive relations after ``rounds`` joins of the newest edges with all known.

    A new edge weighs 0.7 of the weaker of its two; under 0.25 it is not made.
    Of several derivations in a round the heaviest counts, so that the result
    does not hang on row order. Relations of small diameter end early.
    """
    key = ["head", "relation", "tail"]
    edges = rel.filter(F.col("relation").isin(TRANSITIVE)).groupBy(*key).agg(F.max("weight").alias("weight"))
    known, front, derived = edges, edges, None
    for _ in range(rounds):
        step = front.select(F.col("head"), "relation", F.col("tail").alias("mid"), F.col("weight").alias("wa")).join(known.select(F.col("head").alias("mid"), "relation", "tail", F.col("weight").alias("wb")), ["relation", "mid"])
        made = step.filter("head <> tail").withColumn("weight", F.least("wa", "wb") * DECAY).filter(F.col("weight") >= LEAST_WEIGHT)
        front = made.groupBy(*key).agg(F.max("weight").alias("weight")).join(known, key, "left_anti")
        known = known.unionByName(front)
        derived = front if derived is None else derived.unionByName(front)
    return derived.select(*key, "weight")


def k_hop(rel: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """``seed, hop, head, relation, tail, next``: a row per edge walked, before the visited check.

    Edges run forward, symmetric ones both ways; an edge may appear at several hops.
    """
    out = rel.select("head", "relation", "tail", F.col("head").alias("at"), F.col("tail").alias("next"))
    back = rel.filter(F.col("relation").isin(SYMMETRIC)).select("head", "relation", "tail", F.col("tail").alias("at"), F.col("head").alias("next"))
    walk = out.unionByName(back)
    front = seeds.select(F.col("id").alias("seed"), F.col("id").alias("at")).distinct()
    visited, rows = front, None
    for hop in range(1, hops + 1):
        step = front.join(walk, "at").select("seed", F.lit(hop).alias("hop"), "head", "relation", "tail", "next")
        rows = step if rows is None else rows.unionByName(step)
        front = step.select("seed", F.col("next").alias("at")).distinct().join(visited, ["seed", "at"], "left_anti")
        visited = visited.unionByName(front)
    return rows


def shortest_paths(rel: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    """``source, target, length``: unweighted undirected distance of stated pairs, up to ``most`` steps.

    Both ends grow until their fronts meet. A step is taken at the end whose
    front has fewer edges, so a few targets behind a hub do not make every
    source walk through it. An end stops for roots whose pairs are all joined,
    and nothing is left to find where a front is empty.
    """
    walk = rel.select(F.col("head").alias("at"), F.col("tail").alias("next")).unionByName(rel.select(F.col("tail").alias("at"), F.col("head").alias("next")))
    walk = staged(walk.filter("at <> next").distinct(), "walk")
    degree = walk.groupBy("at").agg(F.count("*").alias("_n"))
    stated = staged(pairs.select("source", "target"), "pairs")
    open_, found, fronts, before, edges = stated.distinct(), None, {}, {}, {}

    def grown(end: str) -> DataFrame:
        """The open roots' nodes of the next level: neighbours that are not of the last two."""
        step = fronts[end].join(open_.select(end).distinct(), end, "left_semi").join(walk, "at").select(end, F.col("next").alias("at")).distinct()
        for met in filter(None, (fronts[end], before.get(end))):
            step = step.join(met, [end, "at"], "left_anti")
        return step

    def put(end: str, front: DataFrame) -> None:
        before[end], fronts[end] = fronts.get(end), staged(front, "front")
        edges[end] = fronts[end].join(degree, "at").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]

    for end in ("source", "target"):
        put(end, open_.select(end, F.col(end).alias("at")).distinct())
    for length in range(most + 1):
        if length:
            end = min(edges, key=edges.get)
            if not edges[end]:
                break
            put(end, grown(end))
        now = fronts["source"].join(fronts["target"], "at").select("source", "target").distinct()
        now = staged(now.join(open_, ["source", "target"], "left_semi").withColumn("length", F.lit(length)), "joined")
        open_ = open_.join(now, ["source", "target"], "left_anti")
        found = now if found is None else found.unionByName(now)
    return stated.join(found, ["source", "target"])


def degrees(rel: DataFrame) -> DataFrame:
    """``id, degree``: edges at either end."""
    return rel.select(F.explode(F.array("head", "tail")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def modularity(edges: DataFrame, communities: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``modularity`` of an undirected weighted graph ``a, b, w`` under ``id, community``."""
    c = communities
    ends = edges.join(c.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    total = edges.agg(F.sum("w").alias("m"))
    inside = ends.filter("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("w").alias("inside"))
    tot = ends.select(F.explode(F.array("ca", "cb")).alias("community"), "w").groupBy("community").agg(F.sum("w").alias("tot"))
    part = tot.join(inside, "community", "left").crossJoin(F.broadcast(total))  # one row
    term = F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * F.col("tot") * F.col("tot") / (4 * F.col("m") * F.col("m"))
    return part.agg(F.round(F.sum(term), 9).alias("modularity"))


def _local_move(n, nbrs, degree, gamma, rng, m2):
    """Communities by moving nodes while modularity rises; ``m2``: the degrees of the whole graph, of which this may be a part."""
    comm, total = list(range(n)), list(degree)
    if m2 <= 0:
        return comm
    for _ in range(64):
        moved = False
        for v in rng.permutation(n):
            near: dict[int, float] = {}
            for u, w in nbrs[v].items():
                if u != v:
                    near[comm[u]] = near.get(comm[u], 0.0) + w
            home = comm[v]
            total[home] -= degree[v]
            stay = near.get(home, 0.0) - gamma * total[home] * degree[v] / m2
            best, gain = home, stay
            for c in sorted(near):
                g = near[c] - gamma * total[c] * degree[v] / m2
                if g > gain + 1e-9:
                    best, gain = c, g
            total[best] += degree[v]
            if best != home:
                comm[v], moved = best, True
        if not moved:
            break
    return comm


def leiden(n: int, edges: list[tuple[int, int, float]], gamma: float = 1.0, seed: int = 42) -> list[int]:
    """Communities of a weighted undirected graph: move, refine within communities, aggregate, repeat.

    Refinement only joins adjacent nodes of one community, so every community
    is connected. Equal input and seed give equal output.
    """
    rng = np.random.default_rng(seed)
    nbrs: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        nbrs[a][b] = nbrs[a].get(b, 0.0) + w
        if a != b:
            nbrs[b][a] = nbrs[b].get(a, 0.0) + w
    of = list(range(n))
    for _ in range(24):
        k = len(nbrs)
        degree = [sum(x.values()) + x.get(v, 0.0) for v, x in enumerate(nbrs)]
        comm = _local_move(k, nbrs, degree, gamma, rng, sum(degree))
        groups: dict[int, list[int]] = {}
        for v, c in enumerate(comm):
            groups.setdefault(c, []).append(v)
        fine, count = [0] * k, 0
        for members in groups.values():
            at = {v: i for i, v in enumerate(members)}
            inner = [{at[u]: w for u, w in nbrs[v].items() if u in at} for v in members]
            sub = _local_move(len(members), inner, [degree[v] for v in members], gamma, rng, sum(degree))
            names: dict[int, int] = {}
            for v in members:
                fine[v] = count + names.setdefault(sub[at[v]], len(names))
            count += len(names)
        if count == k:
            break
        coarse: list[dict[int, float]] = [{} for _ in range(count)]
        for v in range(k):
            for u, w in nbrs[v].items():
                if u >= v:
                    a, b = fine[v], fine[u]
                    coarse[a][b] = coarse[a].get(b, 0.0) + w
                    if a != b:
                        coarse[b][a] = coarse[b].get(a, 0.0) + w
        of = [fine[c] for c in of]
        nbrs = coarse
    order: dict[int, int] = {}
    return [order.setdefault(c, len(order)) for c in of]


def rollup_communities(edges: DataFrame, member: DataFrame) -> DataFrame:
    """``x, y, n, derived``: edges counted between communities, unordered pairs."""
    ends = edges.join(member.select(F.col("id").alias("head"), F.col("community").alias("ca")), "head").join(member.select(F.col("id").alias("tail"), F.col("community").alias("cb")), "tail")
    return ends.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("ca") <= F.col("cb"), 1).otherwise(0)).alias("forward"))


def first_of_each_pair(proposals: DataFrame) -> DataFrame:
    """Of the proposals (a, b, ordinal, and relation if it is there) of one unordered pair the first; loops go."""
    kind = ["relation"] if "relation" in proposals.columns else []
    rest = [c for c in proposals.columns if c not in ("a", "b", "ordinal", *kind)]
    row = F.struct("ordinal", "a", "b", *rest)
    one = proposals.filter("a <> b").groupBy(F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y"), *kind).agg(F.min(row).alias("_r"))
    return one.select("_r.*", *kind).select(proposals.columns)


def degree_cap(proposals: DataFrame, per_node: int = 3, most: int = 30) -> DataFrame:
    """Edges in order of ``ordinal, a, b``, each accepted while both ends have fewer than ``per_node``; at most ``most``.

    The greedy choice, as rounds of joins. An edge that is among the first
    ``per_node`` of the edges not rejected, at both its ends, is accepted
    whatever becomes of the others; where a node's first ``per_node`` are all
    accepted, its later ones are rejected. The first open edge is always
    decided, and mostly a large share of all. Once ``most`` are accepted, what
    comes after the last of them cannot count and goes. The first ``per_node``
    of a node are taken where its edges are read, so that a node with very many
    does not gather them.
    """
    left = staged(first_of_each_pair(proposals).withColumn("_in", F.lit(False)), "proposals")
    place = ["ordinal", "a", "b"]
    key = [*place, *(["relation"] if "relation" in proposals.columns else [])]
    while True:
        ends = left.select(*key, "_in", F.explode(F.array("a", "b")).alias("_id"))
        first = rank.top(ends, ["_id"], [F.col(c) for c in key], per_node)
        first = staged(first, "first")
        taken = first.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n = 2").select(*key, F.lit(True).alias("_new"))
        marked = left.join(taken, key, "left").withColumn("_in", F.col("_in") | F.coalesce("_new", F.lit(False))).drop("_new")
        full = first.join(taken, key, "left").groupBy("_id").agg(F.count_if(F.col("_in") | F.coalesce("_new", F.lit(False))).alias("_n")).filter(F.col("_n") >= per_node)
        for side in ("a", "b"):
            at = full.select(F.col("_id").alias(side), F.lit(True).alias(f"_{side}"))
            marked = marked.join(at, side, "left")
        marked = staged(marked.filter("_in or (_a is null and _b is null)").select(left.columns), "proposals")
        accepted = marked.filter("_in")
        if accepted.count() >= most:
            last = accepted.select(F.struct(*place).alias("_p")).orderBy("_p").limit(most).agg(F.max("_p").alias("_last"))
            marked = marked.crossJoin(F.broadcast(last)).filter(F.struct(*place) <= F.col("_last")).drop("_last")  # one row
        left = marked
        if left.filter("not _in").isEmpty():
            return left.filter("_in").orderBy(*place).limit(most).select(proposals.columns)


def tree_paths(tree: DataFrame, most: int = 16) -> DataFrame:
    """``id, path, depth``: path of names from the root; cycles are cut."""
    level = tree.filter("parent_id is null").select("id", "name", F.array("name").alias("path"), F.array("id").alias("ids"), F.lit(0).alias("depth"))
    out = level
    for _ in range(most):
        nxt = tree.select(F.col("id"), F.col("name"), "parent_id").join(level.select(F.col("id").alias("parent_id"), "path", "ids", "depth"), "parent_id")
        level = nxt.filter(~F.array_contains("ids", F.col("id"))).select("id", "name", F.concat("path", F.array("name")).alias("path"), F.concat("ids", F.array("id")).alias("ids"), (F.col("depth") + 1).alias("depth"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("id", F.array_join("path", " > ").alias("path"), "depth")


def document_edges(docs: DataFrame, structural: DataFrame, semantic: DataFrame) -> DataFrame:
    """``x, y, kind``: structural and semantic edges of documents whose ends are both alive, a pair once for each kind, x before y.

    ``docs``: id; edges: a, b.
    """
    both = structural.select("a", "b", F.lit("structural").alias("kind")).unionByName(semantic.select("a", "b", F.lit("semantic").alias("kind")))
    pairs = both.filter("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "kind").distinct()
    alive = docs.select("id").distinct()
    return pairs.join(alive.withColumnRenamed("id", "x"), "x", "left_semi").join(alive.withColumnRenamed("id", "y"), "y", "left_semi").select("x", "y", "kind")
