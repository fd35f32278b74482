"""SimHash near-duplicate components by covering locality-sensitive hashing.

Fingerprints: 64 majority bits over the XXH64 values of word shingles.

Links: for radius r every bit place gets a non-zero vector of r + 1 bits; the
table of each non-zero v keeps the places whose vector has odd overlap with v.
The vectors of r differing places cannot span r + 1 dimensions, so some v is
orthogonal to all of them and the pair agrees on everything that table keeps:
no pair within the radius is missed. With r = 3 that makes 15 tables of about
32 places each.

Skew: equal fingerprints are one node, so exact copies add nothing. A bucket
with more than ``HOT`` fingerprints is split again without loss: its free
places are cut into r + 1 blocks, a pair within the radius agrees on one of
them, and each block is a table of its own inside the bucket. Splits repeat
until 2^(free places) is at most ``HOT``, so that every bucket ends within that
bound. A bucket emits a spanning forest, never its pairs; each link in it is
verified. Components then come from distributed stars (``graph``). Fingerprints
and roots that a large share of the rows have are joined where those rows are
(``spread_join``).

Defined cases: no words (null, empty, blank) gives fingerprint zero, linked
like any other; one or two words give one shingle; a null identifier takes part
and is never a component's smallest (a component of such rows only has a null
component_id); repeated rows return once each; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import fresh_name, slices, spread_join, staged, texts_of
from loreweave.llm.graph import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints in a bucket beyond which it is split.
HOT = 8192


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """Majority bits over all shingles of a text, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only 20 and 09-0D part
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for part in slices(batches):
            fps = np.asarray([fingerprint(t, width) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([part.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return texts_of(docs).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask for each non-zero v: the bit places whose vector has odd overlap with v."""
    vectors = [1 + i % ((1 << radius + 1) - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def split_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """The mask with, in turn, each of radius + 1 blocks of its free places added."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[b :: radius + 1]) for b in range(radius + 1)]


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _bucketed(fps: DataFrame, masks: list[int], where) -> DataFrame:
    """``t, key, fp``: a row for each table ``where`` chooses."""
    rows = F.array(*[F.struct(F.lit(signed(m)).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for m in masks])
    return fps.select(F.explode(rows).alias("b"), "fp").select("b.t", "b.key", "fp") if where is None else where(rows)


def buckets(fps: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Rows ``t, key, fp`` of the covering tables, hot buckets split; the mask itself names a table."""
    masks = covering_masks(radius)
    rows, parts = _bucketed(fps, masks, None), []
    while True:
        large = staged(rows.groupBy("t", "key").count().filter(F.col("count") > hot).select("t", "key", F.lit(True).alias("hot")), "hot-buckets")
        masks = [m for m in masks if 1 << (BITS - m.bit_count()) > hot]
        if not masks or large.isEmpty():
            return _union([*parts, rows])
        marked = staged(rows.join(large, ["t", "key"], "left"), "buckets")
        parts.append(marked.filter("hot is null").select("t", "key", "fp"))
        tables = {m: split_masks(m, radius) for m in masks}
        named = F.create_map(*[x for m, subs in tables.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(s)) for s in subs]))])
        rows = marked.filter("hot").select(F.explode(named[F.col("t")]).alias("t"), "fp").select("t", F.col("fp").bitwiseAND(F.col("t")).alias("key"), "fp").distinct()
        masks = [s for subs in tables.values() for s in subs]


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def forest(fps: np.ndarray, radius: int = RADIUS):
    """Links ``(member, first)`` that join a bucket's fingerprints to the components they form in it."""
    left = np.unique(fps)
    while len(left) > 1:
        root, queue, left = left[0], [left[0]], left[1:]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                found = left[near]
                left = left[~near]
                queue.extend(found)
                for x in found:
                    yield x, root


def links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``u, v``: a spanning forest of every bucket, by a stream over sorted rows."""

    def joined(fps, cuts):
        """Links of the buckets of ``fps`` between consecutive ``cuts``."""
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        a, b = fps[two], fps[two + 1]
        near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        u, v = [a[near]], [b[near]]
        for i in np.nonzero(sizes > 2)[0]:
            pairs = list(forest(fps[cuts[i] : cuts[i + 1]], radius))
            if pairs:
                x, y = zip(*pairs, strict=True)
                u.append(np.asarray(x, np.uint64))
                v.append(np.asarray(y, np.uint64))
        return pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    def run(batches):
        held = None
        for batch in batches:
            t, key, fp = (np.asarray(c) for c in batch.columns)
            if not len(t):
                continue
            now = [t, key, fp.astype(np.int64).view(np.uint64)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            t, key, fp = now
            new = np.nonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1]))[0] + 1
            if not len(new):
                held = now
                continue
            yield joined(fp, np.concatenate([[0], new]))
            held = [x[new[-1] :] for x in now]  # the last bucket may go on
        if held is not None:
            yield joined(held[2], np.asarray([0, len(held[2])]))

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "t", "key").sortWithinPartitions("t", "key").mapInArrow(run, "u long, v long")


def _linked(docs: DataFrame, radius: int, width: int, hot: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` of every row, and ``fp, root, component_id`` of every fingerprint."""
    docs_fp = staged(fingerprints(docs, width), "fingerprints")
    reps = staged(docs_fp.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    rooted = components(links(buckets(reps.select("fp"), radius, hot), radius))
    roots = staged(reps.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    return docs_fp, staged(spread_join(roots.select("fp", "root"), least, "root").select("fp", "root", "component_id"), "components-of-fingerprints")


def near_components(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """``doc_id, fp, component_id`` for every row."""
    docs_fp, of_fp = _linked(docs, radius, width, hot)
    return spread_join(docs_fp, of_fp, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One row of each component, all columns kept: the one with the smallest identifier.

    Rows without an identifier stay only where their component has none; where
    identifiers repeat, one row of the smallest stays.
    """
    docs_fp, of_fp = _linked(docs, radius, width, hot)
    found = staged(spread_join(docs_fp, of_fp, "fp").select("doc_id", "component_id"), "near-copies")
    odd = staged(found.groupBy("doc_id").count().filter("doc_id is null or count > 1").select("doc_id"), "odd-identifiers")
    key, fp, root, least = (fresh_name(docs, c) for c in ("key_id", "fp", "root_fp", "least_id"))
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    gone = found.filter("doc_id != component_id").select(F.col("doc_id").alias(key))
    if odd.isEmpty():
        return keyed.join(gone.hint("shuffle_hash"), key, "left_anti").drop(key).select(docs.columns)
    odd = odd.select(F.col("doc_id").alias(key))
    plain = keyed.filter(F.col(key).isNotNull()).join(gone.unionByName(odd).distinct().hint("shuffle_hash"), key, "left_anti")

    @F.pandas_udf("long")
    def fp_of(texts):
        import pandas as pd

        return pd.Series([signed(fingerprint(t or "", width)) for t in texts], dtype="int64")

    rest = keyed.join(odd.withColumnRenamed(key, key + "_odd"), F.col(key).eqNullSafe(F.col(key + "_odd")), "left_semi").withColumn(fp, fp_of(F.col("text").cast("string")))
    rest = rest.join(of_fp.select(F.col("fp").alias(fp), F.col("root").alias(root), F.col("component_id").alias(least)), fp)
    rest = rest.filter(F.col(key).eqNullSafe(F.col(least))).dropDuplicates([root])
    return plain.select(docs.columns).unionByName(rest.select(docs.columns))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the fingerprint and component of every document."""
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
