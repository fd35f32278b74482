"""Exact top-k inner products by columnar branch-and-bound.

Vectors are kept in blocks in vertical layout: one contiguous run for each
dimension, heaviest dimensions first, with the mass (norm) that remains after
each group of dimensions. A query adds up partial products group by group; by
Cauchy-Schwarz the rest of a product is at most the product of the remaining
masses, so a candidate whose partial product plus that bound is below the
query's k-th best score is dropped and the survivors are compacted. Thresholds
start from one bounded block of vectors, which goes to the tasks that hold the
queries, and tighten as a task goes through its blocks.

Queries go out in rounds of at most ``ROUND`` vectors: a round is broadcast
(bounded size, whatever the table) and meets every block once; a task returns k
rows a query at most. Rounds write to one table.

Defined cases: vectors that are null, or hold null or non-finite components, or
have no identifier take no part; vectors of another length than the query's are
no candidates of it; a query is a distinct identifier (of repeated rows the
smallest vector), and rows with its identifier are its own; repeated candidate
rows are listed each; ties go to the smaller identifier; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import staged, staging_path

#: Vectors in a block, dimensions in a group, queries scored together and in a round.
BLOCK = 16384
GROUP = 16
TOGETHER = 128
ROUND = 16384
SEEDED = 4

BLOCKS_DDL = "dims int, n int, ids binary, columns binary"


def quantized(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id, v``: components as floor(scale * x), unusable vectors left out."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    )
    return usable.select("vec_id", F.transform("x", lambda e: F.floor(e * float(scale)).cast("long")).alias("v"))


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length, in vertical layout; each task makes its own."""

    def run(batches):
        held: dict[int, list] = {}

        def cut(dims):
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dims), strict=True))
            for at in range(0, len(ids), size):
                part = rows[at : at + size]
                yield pa.RecordBatch.from_pylist([{"dims": dims, "n": len(part), "ids": ids[at : at + size].tobytes(), "columns": np.ascontiguousarray(part.T).tobytes()}], VERTICAL)

        for batch in batches:
            ids = np.asarray(batch.column(0))
            for dims, (at, rows) in _matrices(batch.column(1)).items():
                held.setdefault(dims, []).append((ids[at], rows))
                if sum(len(i) for i, _ in held[dims]) >= size:
                    yield from cut(dims)
        for dims in list(held):
            yield from cut(dims)

    return vectors.mapInArrow(run, BLOCKS_DDL)


VERTICAL = pa.schema([("dims", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("columns", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Block:
    """A block with its dimensions ordered by mass and the mass left after each group."""

    def __init__(self, dims: int, ids: bytes, columns: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        raw = np.frombuffer(columns, np.int64).reshape(dims, len(self.ids))
        self.peak = int(np.abs(raw).max(initial=0))
        self.order = np.argsort(-np.square(raw.astype(np.float64)).sum(1), kind="stable")
        self.columns = raw[self.order].astype(np.float64)
        self.groups = [(a, min(a + GROUP, dims)) for a in range(0, dims, GROUP)]
        self.raw = raw
        self.mass = [np.sqrt(np.square(self.columns[b:]).sum(0)) for _, b in self.groups]


class Search:
    """The best ``k`` of a set of queries (rows of equal length) over the blocks shown to it."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.queries, self.k = ids, queries.astype(np.float64), k
        self.exact = queries
        self.peak = int(np.abs(queries).max(initial=0))
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(ids)

    def _merge(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own = ids != self.ids[i]
        s, d = np.concatenate([self.best[i][0], scores[own]]), np.concatenate([self.best[i][1], ids[own]])
        if len(s) > self.k:
            kth = np.partition(s, len(s) - self.k)[len(s) - self.k]
            keep = s >= kth
            s, d = s[keep], d[keep]
        top = np.lexsort((d, -s))[: self.k]
        self.best[i] = s[top], d[top]
        if len(top) == self.k:
            self.least[i] = max(self.least[i], s[top[-1]])

    def show(self, block: Block) -> None:
        dims = self.queries.shape[1]
        if block.peak * self.peak * max(dims, 1) >= 1 << 52:  # beyond exact doubles
            for i, q in enumerate(self.exact):
                scores = q.astype(object) @ block.raw.astype(object)
                self._merge(i, block.ids, np.asarray([min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores], np.int64))
            return
        ordered = self.queries[:, block.order]
        left = [np.sqrt(np.square(ordered[:, b:]).sum(1)) * (1 + 1e-9) for _, b in block.groups]
        for at in range(0, len(self.ids), TOGETHER):
            q = ordered[at : at + TOGETHER]
            if not block.groups:
                partial = np.zeros((len(q), len(block.ids)))
                alive = np.ones(partial.shape, bool)
            else:
                a, b = block.groups[0]
                partial = q[:, a:b] @ block.columns[a:b]
                bound = np.multiply.outer(left[0][at : at + TOGETHER], block.mass[0])
                bound += partial
                alive = bound >= self.least[at : at + TOGETHER, None] - 1e-3
            for j in range(len(q)):
                i = at + j
                survivors = np.nonzero(alive[j])[0]
                sums = partial[j][survivors]
                for g in range(1, len(block.groups)):
                    if not len(survivors):
                        break
                    a, b = block.groups[g]
                    sums = sums + q[j, a:b] @ block.columns[a:b, survivors]
                    keep = sums + left[g][i] * block.mass[g][survivors] >= self.least[i] - 1e-3
                    if not keep.all():
                        survivors, sums = survivors[keep], sums[keep]
                if len(survivors):
                    self._merge(i, block.ids[survivors], np.rint(sums).astype(np.int64))

    def found(self) -> list[pa.RecordBatch]:
        out = []
        for at in range(0, len(self.ids), 512):
            part = self.best[at : at + 512]
            n = [len(s) for s, _ in part]
            out.append(pa.record_batch([pa.array(np.repeat(self.ids[at : at + 512], n)), pa.array(np.concatenate([d for _, d in part])), pa.array(np.concatenate([s for s, _ in part]))], schema=FOUND))
        return out


def _matrices(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length: their places and a matrix."""
    lengths = np.diff(np.asarray(lists.offsets))
    flat, ends = np.asarray(lists.flatten()).astype(np.int64), np.cumsum(lengths)
    out = {}
    for d in np.unique(lengths).tolist():
        at = np.nonzero(lengths == d)[0]
        out[d] = at, flat[(ends[at] - d)[:, None] + np.arange(d)]
    return out


def seeded(asked: DataFrame, seeds: dict[int, tuple], k: int) -> DataFrame:
    """``vec_id, v, least``: queries with the k-th best score that one block gives each."""

    def run(batches):
        for batch in batches:
            ids, least = np.asarray(batch.column(0)), np.full(batch.num_rows, -np.inf)
            for d, (at, matrix) in _matrices(batch.column(1)).items():
                if d in seeds:
                    search = Search(ids[at], matrix, k)
                    search.show(Block(*seeds[d]))
                    least[at] = search.least
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(least)], names=["vec_id", "v", "least"])

    return asked.mapInArrow(run, "vec_id long, v array<long>, least double")


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, size: int = BLOCK, per_round: int = ROUND) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best of ``vectors(vec_id, v)`` for each of ``queries(vec_id, v)``."""
    spark = vectors.sparkSession
    stored = staged(blocks(vectors, size), "vector-blocks")
    seeds = {}  # of at most SEEDED lengths; queries of others start without a threshold
    for dims in [r.dims for r in stored.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "dims").limit(SEEDED).collect()]:
        row = stored.filter(F.col("dims") == dims).orderBy(F.desc("n"), F.desc("ids")).limit(1).first()
        seeds[dims] = (row.dims, bytes(row.ids), bytes(row["columns"]))
    asked = staged(seeded(queries.groupBy("vec_id").agg(F.min("v").alias("v")), seeds, k), "queries")
    path = staging_path(spark, "top-k")
    n = asked.count()
    rounds = max(1, -(-n // per_round))
    for turn in range(rounds):
        part = asked if rounds == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == turn)
        rows = part.toArrow().combine_chunks()  # at most per_round queries, in the mean
        ids, least = rows["vec_id"].to_numpy(), rows["least"].to_numpy()
        lists = pa.concat_arrays(rows["v"].chunks) if rows.num_rows else pa.array([], pa.list_(pa.int64()))
        sent = {d: (ids[at], matrix, least[at]) for d, (at, matrix) in _matrices(lists).items()}
        shared = spark.sparkContext.broadcast(sent)

        def run(batches, shared=shared):
            searches: dict[int, Search] = {}
            for batch in batches:
                for dims, _, ids, columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if dims in shared.value:
                        if dims not in searches:
                            i, m, least = shared.value[dims]
                            searches[dims] = Search(i, m, k, least)
                        searches[dims].show(Block(dims, ids, columns))
            for search in searches.values():
                yield from search.found()

        stored.mapInArrow(run, "query_id long, vec_id long, score long").write.mode("append").parquet(path)
    found = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    best = found.selectExpr("query_id", "row_number() over (partition by query_id order by score desc, vec_id) as rank", "vec_id", "score")
    return best.filter(F.col("rank") <= k)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 20 best of all other vectors for every vector whose id is divisible by 20."""
    vectors = quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return exact_top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


ORACLE = """
with v as (
  select cast(vec_id as bigint) as vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
  where q.vec_id % 20 = 0
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
