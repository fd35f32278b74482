"""Shared helpers: staging tables, batch slicing and small hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at a time inside a Python worker; bounds the Python copies of texts.
SLICE_ROWS = 512
#: Characters of text handled at a time; a slice ends early when it is reached.
SLICE_CHARS = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, the context's checkpoint folder is used; a session
    on one machine (tests) that has none gets a temporary one, any other is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loreweave-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage for good."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty; other columns go."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = SLICE_ROWS, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of bounded rows and, roughly, bounded characters."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        per_row = max(1, column.nbytes // n)
        step = max(1, min(rows, chars // per_row))
        while at < n:
            yield batch.slice(at, step)
            at += step


#: A key is heavy if it has more than this share of the rows, and more rows than this.
HEAVY_SHARE = 1 / 1000
HEAVY_ROWS = 64


def heavy_limit(rows: int) -> int:
    """Rows beyond which a key is heavy: a table has at most 1 / HEAVY_SHARE such keys, whatever its size."""
    return max(HEAVY_ROWS, int(rows * HEAVY_SHARE))


def spread_join(rows: DataFrame, one_each: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` to a table with one row for each key.

    The few heavy keys (``heavy_limit``) are joined where their rows are, by a
    broadcast of at most 1 / HEAVY_SHARE rows; only the others are shuffled.
    """
    counts = rows.groupBy(key).count().filter(F.col("count") > heavy_limit(rows.count()))
    heavy = [r[0] for r in counts.filter(F.col(key).isNotNull()).select(key).collect()]
    if not heavy:
        return rows.join(one_each, key)
    hot = F.col(key).isin(heavy)
    return rows.filter(~hot).join(one_each, key).unionByName(rows.filter(hot).join(F.broadcast(one_each.filter(hot)), key))


def one_text_each(rows: DataFrame) -> DataFrame:
    """One row for each ``doc_id``: that whose ``text`` has the smallest hash."""
    rest = [c for c in rows.columns if c != "doc_id"]
    least = F.min_by(F.struct(*rest), F.struct(F.xxhash64("text"), F.col("text")))
    return rows.groupBy("doc_id").agg(least.alias("kept")).select("doc_id", "kept.*")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name
