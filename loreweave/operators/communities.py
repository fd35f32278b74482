"""Communities of weighted undirected graphs of any size, as rounds of joins.

A level moves nodes between communities while modularity rises, refines each
community into connected parts, and contracts the parts to the nodes of the next
level; it ends when nothing is contracted. Every step is a join or a group:

* A round sums each node's weights to the neighbouring communities and takes the
  best. A keyed coin for each community and round splits them into givers and
  takers; nodes of givers move to takers, so that no two communities swap nodes.
* Moves of one round can spoil each other where many meet in one community. The
  next round finds the modularity that they made; where it did not rise they are
  taken back, and only dominant moves are made: those with the largest gain at
  both communities they touch. Their gains add up exactly, so each round rises.
* In the refinement only single nodes move, into parts of their own community
  that hold still in the round, so every part is connected.

No task holds the graph. A level that has shrunk to ``few_edges`` edges, counted
first, can be finished by one task with the plain method; 0 never does so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.operators import graph
from loreweave.sources.staging import staged

#: Edges of a graph, or of a contracted one, that one task finishes.
FEW_EDGES = 20_000
#: Rounds of a level's moves and of its refinement at most (the next level goes on), levels at most, and the least gain of a move.
ROUNDS, REFINEMENTS, LEVELS, LEAST_GAIN = 16, 10, 24, 1e-9
#: A level's moves end when two rounds together raise modularity by less; the next levels go on from there.
ENOUGH = 1e-3


def _coin(community: Column, seed: int, level: int, turn: int) -> Column:
    return F.xxhash64(community, F.lit(seed), F.lit(level), F.lit(turn)) % 2 == 0


def _options(adjacent: DataFrame, nodes: DataFrame, gamma: float, m2: float, single: bool) -> DataFrame:
    """``u, home, target, gain, inner, square``: improving moves of each node, one row for each community that is better; also its own (``target`` null) with the inner weight.

    The own row also has the part of the node in the squares of the communities'
    weights. ``adjacent``: u, v, w without loops; ``nodes``: id, k, c. ``single``: only nodes alone in their community move.
    """
    at = nodes.select(F.col("id").alias("v"), F.col("c").alias("target"))
    near = adjacent.join(at, "v").groupBy("u", "target").agg(F.sum("w").alias("near"))
    totals = nodes.groupBy("c").agg(F.sum("k").alias("total"), F.count("*").alias("size"))
    own = nodes.select(F.col("id").alias("u"), "k", F.col("c").alias("home")).join(totals.select(F.col("c").alias("home"), F.col("total").alias("home_total"), "size"), "home")
    stay = near.select("u", F.col("target").alias("home"), F.col("near").alias("inner"))
    own = own.join(stay, ["u", "home"], "left").withColumn("inner", F.coalesce("inner", F.lit(0.0)))
    value = lambda w, total: w - gamma * total * F.col("k") / m2
    kept = value(F.col("inner"), F.col("home_total") - F.col("k"))
    moves = own.filter("size = 1") if single else own
    better = moves.join(near, "u").filter("target <> home").join(totals.select(F.col("c").alias("target"), "total"), "target")
    better = better.withColumn("gain", F.round(value(F.col("near"), F.col("total")) - kept, 12)).filter(F.col("gain") > LEAST_GAIN)
    none = F.lit(0.0)
    rows = better.select("u", "home", "target", "gain", none.alias("inner"), none.alias("square"))
    kind = dict(own.dtypes)["home"]
    return rows.unionByName(own.select("u", "home", F.lit(None).cast(kind).alias("target"), none.alias("gain"), "inner", (F.col("k") * F.col("home_total")).alias("square")))


def _quality(options: DataFrame, open_: Column, m2: float, gamma: float, loops: float) -> tuple[float, int, int]:
    """Modularity of the communities that ``options`` were found for, improving moves, and those that the coin lets go."""
    inner, square, moves, free = options.agg(F.sum("inner"), F.sum("square"), F.count("target"), F.count_if(open_)).first()
    return ((inner or 0.0) + loops) / m2 - gamma * (square or 0.0) / (m2 * m2), moves, free


def _best(options: DataFrame) -> DataFrame:
    """One move for each node: the largest gain, then the smallest community."""
    return options.groupBy("u").agg(F.min(F.struct((-F.col("gain")).alias("g"), "target", "home")).alias("b")).select("u", "b.home", "b.target", (-F.col("b.g")).alias("gain"))


def _dominant(options: DataFrame) -> DataFrame:
    """Moves that are the best at both communities they touch."""
    best = _best(options)
    rank = F.struct((-F.col("gain")).alias("g"), F.col("u").alias("who"))
    touched = best.select(F.explode(F.array("home", "target")).alias("c"), rank.alias("r")).groupBy("c").agg(F.min("r").alias("r"))
    at = lambda side: touched.select(F.col("c").alias(side), F.col("r.who").alias("u"))
    return best.join(at("home"), ["home", "u"], "left_semi").join(at("target"), ["target", "u"], "left_semi")


def _moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    """``nodes`` after ``moves`` (u, target)."""
    to = moves.select(F.col("u").alias("id"), F.col("target").alias("_to"))
    return nodes.join(to, "id", "left").select("id", "k", F.coalesce("_to", "c").alias("c"))


def move(adjacent: DataFrame, nodes: DataFrame, gamma: float, m2: float, seed: int, level: int, single: bool = False, loops: float = 0.0) -> DataFrame:
    """``id, k, c`` after rounds of moves from ``nodes`` until none improves modularity, or enough rounds."""
    before, at, calm, rises = None, None, False, []  # the last state known to be good, and how it came about
    most = REFINEMENTS if single else ROUNDS
    for turn in range(most + 1):
        options = staged(_options(adjacent, nodes, gamma, m2, single), "options")
        free = F.col("target").isNotNull() & _coin(F.col("home"), seed, level, turn) & ~_coin(F.col("target"), seed, level, turn)
        quality, moves, n_free = _quality(options, free, m2, gamma, loops)
        if before is not None and quality <= before + LEAST_GAIN:
            nodes, options = at  # taken back
            if calm or turn == most:
                break
            calm = True
        else:
            rises = [*rises[-1:], quality - before] if before is not None else []
            before, at, calm = quality, (nodes, options), False
            if not moves or turn == most or (not single and len(rises) == 2 and sum(rises) < ENOUGH):
                break
        chosen = _dominant(options.filter("target is not null")) if calm or not n_free else _best(options.filter(free))
        nodes = staged(_moved(nodes, chosen), "nodes")
    return nodes


def contracted(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """``a, b, w`` between the parts (id, c) of a level, weights summed, a before b; inner weight becomes a loop."""
    ends = edges.join(parts.select(F.col("id").alias("a"), F.col("c").alias("_a")), "a").join(parts.select(F.col("id").alias("b"), F.col("c").alias("_b")), "b")
    return ends.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.sum("w").alias("w"))


def _finished(edges: DataFrame, gamma: float, seed: int) -> DataFrame:
    """``id, c`` of a graph that one task can hold."""
    kind = dict(edges.dtypes)["a"]

    def run(table: pa.Table) -> pa.Table:
        a, b = table["a"].to_pylist(), table["b"].to_pylist()
        ids = sorted(set(a) | set(b))
        at = {x: i for i, x in enumerate(ids)}
        found = graph.leiden(len(ids), sorted((at[x], at[y], w) for x, y, w in zip(a, b, table["w"].to_pylist(), strict=True)), gamma, seed)
        first: dict[int, object] = {}
        for x, c in zip(ids, found, strict=True):
            first.setdefault(c, x)
        return pa.table({"id": pa.array(ids, table.schema.field("a").type), "c": pa.array([first[c] for c in found], table.schema.field("a").type)})

    return edges.select("a", "b", "w", F.lit(0).alias("_g")).groupBy("_g").applyInArrow(lambda t: run(t.select(["a", "b", "w"])), f"id {kind}, c {kind}")


def communities(edges: DataFrame, gamma: float = 1.0, seed: int = 42, few_edges: int = FEW_EDGES) -> DataFrame:
    """``id, community`` for every node of ``edges`` (a, b, w); a community's name is its smallest member.

    Equal edges add up; edges without weight, or with a null end, are ignored.
    Equal input and seed give equal output. Communities are connected.
    """
    given = edges.select("a", "b", F.col("w").cast("double").alias("w")).filter("a is not null and b is not null and w > 0")
    edges = staged(given.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w")), "edges")
    member = None  # original node -> node of the level
    for level in range(LEVELS):
        count, m = edges.agg(F.count("*"), F.sum("w")).first()
        if count <= few_edges or not count:
            parts = staged(_finished(edges, gamma, seed), "parts")
            member = parts if member is None else _followed(member, parts)
            break
        m2 = 2.0 * m
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(edges.filter("a <> b").select(F.col("b").alias("u"), F.col("a").alias("v"), "w"))
        weight = F.when(F.col("u") == F.col("v"), 2 * F.col("w")).otherwise(F.col("w"))
        nodes = staged(both.groupBy("u").agg(F.sum(weight).alias("k")).select(F.col("u").alias("id"), "k", F.col("u").alias("c")), "nodes")
        adjacent = staged(both.filter("u <> v"), "adjacent")
        loops = 2.0 * (edges.filter("a = b").agg(F.sum("w")).first()[0] or 0.0)
        found = move(adjacent, nodes, gamma, m2, seed, level, loops=loops)
        side = lambda s, n: found.select(F.col("id").alias(s), F.col("c").alias(n))  # noqa: E731, B023
        inner = staged(adjacent.join(side("u", "_a"), "u").join(side("v", "_b"), "v").filter("_a = _b").select("u", "v", "w"), "inner")
        parts = move(inner, nodes, gamma, m2, seed, level, single=True, loops=loops)
        member = parts.select("id", "c") if member is None else _followed(member, parts)
        if parts.filter("id <> c").isEmpty():
            break
        edges = staged(contracted(edges, parts), "edges")
    smallest = member.groupBy("c").agg(F.min("id").alias("community"))
    return member.join(smallest, "c").select("id", "community")


def _followed(member: DataFrame, parts: DataFrame) -> DataFrame:
    return staged(member.join(parts.select(F.col("id").alias("c"), F.col("c").alias("_c")), "c").select("id", F.col("_c").alias("c")), "member")
