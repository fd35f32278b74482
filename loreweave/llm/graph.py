"""Connected components of an edge table by alternating large and small stars.

A star's centre may have most of the edges. Minima are pre-aggregated where the
edges are, and go back to the edges of heavy nodes by a broadcast whose size the
definition of heavy bounds (``common.heavy_limit``); only the edges of other
nodes are shuffled for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import heavy_limit, staged


def _with_least(edges: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """``u, v, m`` of each edge: ``m`` of its node ``u`` in ``least(u, m, n)``."""
    limit = heavy_limit(rows)
    marked = edges.join(F.broadcast(least.filter(F.col("n") > limit).select("u", "m")), "u", "left")
    light = least.filter(F.col("n") <= limit).select("u", "m")
    return marked.filter("m is not null").unionByName(marked.filter("m is null").drop("m").join(light, "u"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node links its larger neighbours to the smallest node that it sees."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n")), "least-neighbours")
    return _with_least(both.filter("v > u"), least, 2 * rows).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least-neighbours")
    moved = _with_least(edges, least, rows).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    """Order-free digest of an edge table: equal digests mean no edge has moved."""
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of ``edges(u, v)``, ``root`` being its component's smallest node.

    Self links are ignored; nodes without a link to another are not returned.
    Each round is two joins on node keys, its results written tables; rounds
    grow with the logarithm of the diameter.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()
    now = staged(now, "components")
    state = _state(now)
    while state[0]:
        large = staged(_large_star(now, state[0]).distinct(), "large-stars")
        then = staged(_small_star(large, state[0]).distinct(), "components")
        known, state, now = state, _state(then), then
        if state == known:
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
