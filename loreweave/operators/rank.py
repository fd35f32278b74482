"""Rank algebra: relations of ranked hits, combined for many questions at once.

Every operator takes ``by``, the columns that separate questions; windows are
partitioned by them, so all questions are ranked in one distributed plan.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.config import Config


def in_rounds(asked: DataFrame, key: str, most: int, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The union of ``answer`` over rounds of at most about ``most`` rows of ``asked``, whose size may then be broadcast."""
    rounds = max(1, -(-asked.count() // most))
    parts = [asked.filter(F.pmod(F.xxhash64(key), F.lit(rounds)) == turn) if rounds > 1 else asked for turn in range(rounds)]
    return reduce(lambda a, b: a.unionByName(b), map(answer, parts))


def top(hits: DataFrame, by: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` hits of each question, numbered from 1."""
    return hits.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= limit)


def diversify(ranked: DataFrame, by: list[str], source: list[str], keep: int, limit: int, rank: str = "rank") -> DataFrame:
    """The first ``keep`` hits of each source in order, then all others in order, up to ``limit``."""
    place = F.row_number().over(Window.partitionBy(*by, *source).orderBy(rank))
    marked = ranked.withColumn("_later", (place > keep).cast("int"))
    return top(marked.withColumnRenamed(rank, "_rank"), by, [F.col("_later"), F.col("_rank")], limit, rank).drop("_later", "_rank")


def dense_routes(routes: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Ranks within each route after later mentions of a key are dropped: one vote per key and route."""
    first = routes.groupBy(*by, "route", *key).agg(F.min("rank").alias("_at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "route").orderBy("_at"))).drop("_at")


def rrf(routes: DataFrame, by: list[str], key: list[str], cfg: Config | None = None) -> DataFrame:
    """Reciprocal-rank fusion: sum over routes of 1 / (k + rank), with the routes that voted."""
    k = (cfg or Config()).rrf_k
    votes = dense_routes(routes, by, key)
    return votes.groupBy(*by, *key).agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("route")).alias("channels"))


def interleave(routes: DataFrame, by: list[str], key: list[str], limit: int) -> DataFrame:
    """Round robin over routes: first places of all routes, then second places; first mention of a key wins."""
    order = [F.col("rank"), F.col("route")]
    firsts = routes.withColumn("_n", F.row_number().over(Window.partitionBy(*by, *key).orderBy(*order))).filter("_n = 1")
    return top(firsts.withColumnRenamed("rank", "_rank"), by, [F.col("_rank"), F.col("route")], limit).drop("_n", "_rank")


def rerank_merge(ranked: DataFrame, order: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Hits in the order given (its first mention of a known key counts), those not named after them in their own."""
    named = order.groupBy(*by, *key).agg(F.min("position").alias("_pos"))
    joined = ranked.join(named, [*by, *key], "left").withColumnRenamed("rank", "_rank")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_pos").isNull(), "_pos", "_rank"))
    return joined.withColumn("rank", place).drop("_pos", "_rank")


def budget_stop(ranked: DataFrame, by: list[str], cost: str, budget: int, rank: str = "rank") -> DataFrame:
    """The longest prefix whose total cost stays within the budget."""
    run = F.sum(cost).over(Window.partitionBy(*by).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("used", run).filter(F.col("used") <= budget)


def budget_skip(ranked: DataFrame, by: list[str], cost: str, budget: int, rank: str = "rank", most: int | None = None) -> DataFrame:
    """Items in order, each taken if it still fits; one that does not is skipped.

    The items of a question stream in order past a running total, one pair of
    numbers a question, so its list is never gathered; what is taken is joined
    back by rank. An item without a cost fits nowhere.
    """
    types = dict(ranked.dtypes)
    ordered = ranked.select(*by, F.col(rank).cast("long").alias("_r"), F.col(cost).cast("long").alias("_c")).repartition(*by).sortWithinPartitions(*by, "_r")
    fields = ", ".join(f"`{c}` {types[c]}" for c in by)

    def run(batches):
        current, used, count = None, 0, 0
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(by))), strict=True))
            keep = np.zeros(batch.num_rows, bool)
            for i, (k, c) in enumerate(zip(keys, batch.column(len(by) + 1).to_pylist(), strict=True)):
                if k != current:
                    current, used, count = k, 0, 0
                if c is not None and used + c <= budget and (most is None or count < most):
                    keep[i], used, count = True, used + c, count + 1
            yield batch.filter(pa.array(keep)).select([*by, "_r"])

    taken = ordered.mapInArrow(run, f"{fields}, _r long")
    same = [ranked[c].eqNullSafe(taken[c]) for c in by] + [ranked[rank].cast("long") == taken["_r"]]
    return ranked.join(taken, same, "left_semi")


def nearest_rank(values: DataFrame, by: list[str], value: str, percent: int) -> DataFrame:
    """The nearest-rank percentile: the value at place ceil(n * percent / 100) of the sorted values."""
    w = Window.partitionBy(*by)
    placed = values.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(value)))
    at = F.greatest(F.ceil(F.col("_n") * percent / 100), F.lit(1))
    return placed.filter(F.col("_i") == at).select(*by, F.col(value).alias("percentile"))


def mmr(items: DataFrame, by: list[str], weight: float = 0.7) -> DataFrame:
    """Greedy maximal-marginal-relevance order of each question's candidates.

    ``items``: by, key, rank, vec. Relevance falls linearly with rank,
    redundancy is the largest clipped cosine to what is chosen; ties keep rank
    order. Candidate lists are short by contract (a reranking window).
    """
    fields = ", ".join(f"{c} {t}" for c, t in items.dtypes if c in [*by, "key"])

    def order(group: pa.Table) -> pa.Table:
        group = group.sort_by("rank")
        n = group.num_rows
        v = np.asarray(group["vec"].to_pylist(), float).reshape(n, -1)
        size = np.linalg.norm(v, axis=1)
        unit = v / np.where(size > 0, size, 1)[:, None]
        alike = np.clip(unit @ unit.T, 0, 1)
        relevance = np.ones(1) if n == 1 else 1 - np.arange(n) / (n - 1)
        left, worst, chosen = list(range(n)), np.zeros(n), []
        while left:
            best, best_score = None, 0.0
            for i in left:
                s = weight * relevance[i] - (1 - weight) * worst[i]
                if best is None or s > best_score + 1e-12:
                    best, best_score = i, s
            chosen.append(best)
            left.remove(best)
            worst = np.maximum(worst, alike[best])
        out = group.select([*by, "key"]).take(chosen)
        return out.append_column("position", pa.array(range(1, n + 1), pa.int32()))

    return items.select(*by, "key", "rank", "vec").groupBy(*by).applyInArrow(order, f"{fields}, position int")
