"""Vector stores behind one interface: one that reads all vectors, and one that opens clusters; both are exact."""

from __future__ import annotations

import math
from functools import reduce
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions import vector
from loreweave.operators import near, rank
from loreweave.sources.staging import staged

ITEM = ["source_type", "source_id", "seq"]
#: Query vectors of one round; what is broadcast is bounded by it.
QUERIES_PER_ROUND = 2_000


class VectorStore(Protocol):
    """Vectors (space, source_type, source_id, seq, vec) of many spaces; snapshots, so every change returns a new store."""

    items: DataFrame

    def search(self, space: str, queries: DataFrame, pool: int) -> DataFrame: ...

    def replace_source(self, space: str, source_type: str, source_id: int, rows: DataFrame) -> VectorStore: ...


class ExactStore:
    """Every vector of a space against a stated set of query vectors, in broadcast rounds."""

    def __init__(self, items: DataFrame):
        self.items = items

    def has_vectors(self, space: str) -> bool:
        return not self.items.filter(F.col("space") == space).isEmpty()

    def delete_source(self, space: str, source_type: str, source_id: int):
        gone = (F.col("space") == space) & (F.col("source_type") == source_type) & (F.col("source_id") == source_id)
        return type(self)(self.items.filter(~gone))

    def replace_source(self, space: str, source_type: str, source_id: int, rows: DataFrame):
        fresh = rows.select(F.lit(space).alias("space"), F.lit(source_type).alias("source_type"), F.lit(source_id).cast("long").alias("source_id"), "seq", "vec")
        return type(self)(self.delete_source(space, source_type, source_id).items.unionByName(fresh))

    def clear(self, space: str):
        return type(self)(self.items.filter(F.col("space") != space))

    def _valid(self, space: str) -> DataFrame:
        return self.items.filter((F.col("space") == space) & vector.is_valid(F.col("vec"))).select(*ITEM, "vec")

    def _best(self, scored: DataFrame, pool: int) -> DataFrame:
        order = Window.partitionBy("question_id").orderBy(F.desc("score"), *ITEM)
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool)

    def search(self, space: str, queries: DataFrame, pool: int) -> DataFrame:
        """``question_id, source_type, source_id, seq, score, rank``: the ``pool`` nearest by cosine of each (question_id, vec).

        A query that is no vector (null, zero, not finite) has none; only vectors of its length are candidates.
        """
        good = queries.filter(vector.is_valid(F.col("vec"))).select("question_id", "vec")
        return self._best(near.scored(self._valid(space), good, pool, per_round=QUERIES_PER_ROUND), pool)


class ClusteredStore(ExactStore):
    """Vectors by nearest centroid; a search opens the clusters that can still hold a result, so it is exact.

    Centroids come from spherical k-means over a bounded sample (``sample`` rows,
    the smallest hashes of their keys). By the triangle inequality of angles no
    vector of a cluster is nearer to a query than the angle to its centroid less
    the cluster's widest angle. The nearest ``probes`` clusters give each query a
    k-th best score; the others are opened only where their bound reaches it.
    """

    def __init__(self, items: DataFrame, clusters: int = 64, sample: int = 20_000, probes: int = 4, seed: int = 7):
        super().__init__(items)
        self.clusters, self.sample, self.probes, self.seed = clusters, sample, probes, seed

    def centroids(self, valid: DataFrame, dim: int) -> np.ndarray:
        rows = valid.filter(F.size("vec") == dim).orderBy(F.xxhash64(*ITEM), *ITEM).limit(self.sample).select("vec").collect()
        x = np.asarray([r.vec for r in rows], float).reshape(-1, dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rng = np.random.default_rng(self.seed)
        centers = x[rng.permutation(len(x))[: min(self.clusters, len(x))]]
        for _ in range(8):
            of = (x @ centers.T).argmax(1)
            sums = np.zeros_like(centers)
            np.add.at(sums, of, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers)
        return centers

    @staticmethod
    def assigned(valid: DataFrame, centers: np.ndarray) -> DataFrame:
        """``valid`` with its cluster and the cosine to the centroid."""
        dim = centers.shape[1]

        @F.pandas_udf("struct<cluster:int,near:double>")
        def run(vecs):
            import pandas as pd

            x = np.asarray([np.asarray(v, float) for v in vecs]).reshape(-1, dim)
            scores = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centers.T
            return pd.DataFrame({"cluster": scores.argmax(1).astype(np.int32), "near": scores.max(1)})

        return valid.filter(F.size("vec") == dim).withColumn("_c", run("vec")).select(*ITEM, "vec", "_c.*")

    def _met(self, items: DataFrame, cells: dict[int, list[int]], queries: DataFrame, pool: int, floor: dict[int, float] | None = None) -> DataFrame:
        """Scores of a round's queries in the clusters that each opens."""
        met = near.scored(items.drop("near"), queries.withColumnRenamed("_q", "vec"), pool, cells=("cluster", cells), floor=floor, per_round=QUERIES_PER_ROUND)
        return met.select("question_id", *ITEM, "score")

    def search(self, space: str, queries: DataFrame, pool: int) -> DataFrame:
        """As of the exact store; query identifiers are integers."""
        valid = self._valid(space)
        good = queries.filter(vector.is_valid(F.col("vec"))).select(F.col("question_id").cast("long").alias("question_id"), F.col("vec").alias("_q"))
        dims = [r.n for r in good.select(F.size("_q").alias("n")).distinct().collect()]  # one row a length
        parts = [self._search_dim(valid, good.filter(F.size("_q") == n), n, pool) for n in dims]
        if not parts:
            return ExactStore.search(self, space, queries.limit(0), pool)
        return reduce(DataFrame.unionByName, parts)

    def _search_dim(self, valid: DataFrame, queries: DataFrame, dim: int, pool: int) -> DataFrame:
        centers = self.centroids(valid, dim)
        if not len(centers):
            return self._best(valid.limit(0).crossJoin(queries.limit(0)).select("question_id", *ITEM, F.lit(0.0).alias("score")), pool)
        items = staged(self.assigned(valid, centers), "assigned")
        widest = {r.cluster: r.w for r in items.groupBy("cluster").agg(F.min("near").alias("w")).collect()}  # one row a cluster
        angle = np.asarray([math.acos(max(-1.0, min(1.0, widest.get(c, 1.0)))) for c in range(len(centers))])

        def answer(some: DataFrame) -> DataFrame:
            rows = some.collect()  # a round
            ids, q = [r.question_id for r in rows], np.asarray([r._q for r in rows], float).reshape(-1, dim)
            to_center = np.arccos(np.clip(q / np.linalg.norm(q, axis=1, keepdims=True) @ centers.T, -1, 1))
            bound = np.cos(np.maximum(0, to_center - angle[None, :]))
            order = np.argsort(to_center, axis=1)[:, : self.probes]
            first = {ids[i]: [int(c) for c in order[i] if int(c) in widest] for i in range(len(ids))}
            near_ = self._best(self._met(items, first, some, pool), pool)
            kth = {r.question_id: r.score for r in near_.filter(F.col("rank") == pool).select("question_id", "score").collect()}
            opened = {ids[i]: [c for c in range(len(centers)) if c in widest and (c in first[ids[i]] or bound[i, c] >= kth.get(ids[i], -2) - 1e-9)] for i in range(len(ids))}
            return self._best(self._met(items, opened, some, pool, kth) if opened != first else near_.drop("rank"), pool)

        return rank.in_rounds(queries, "question_id", QUERIES_PER_ROUND, answer)
