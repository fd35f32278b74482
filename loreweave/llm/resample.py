"""Importance resampling towards a target distribution.

Features are hashed runs of one to ``longest`` words. The corpus and the target
are counted by bucket, a bucket's gain is the scaled logarithm of its smoothed
ratio of shares, and a document's weight is the sum of its features' gains: one
array of ``buckets`` integers scores whole texts where they are read. A run's
checksum continues that of the run one word shorter, so each costs one call.

Weight plus keyed Gumbel noise is an integer score, and the highest scores are
a draw without replacement. Ranks come without a sort of all rows: an exact
histogram of the scores, its counts summed from the top (within blocks of
``BLOCK`` scores, and over the totals of the blocks), gives every score's rank
offset; the last score whose offset is below the number to draw is the cutoff.
Only rows that reach it are dealt by score, and ``row_number`` by identifier
within a score adds to the offset. Noise spreads even equal weights: no score
holds more than about one in 2,700 distinct identifiers.

Defined cases: a null text has no words (weight 0) and takes no part in the
draw, as any with fewer words than asked; a null identifier's noise is that of
the empty string; repeated rows are scored alike and drawn each on its own; an
empty table gives no rows, an empty target gains for an empty target; other
columns are ignored.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.llm.common import slices, staged, texts_of
from loreweave.llm.licenses import WORDS

#: Scores in one block of the histogram.
BLOCK = 65_536
#: Bytes of a text whose words are held at a time.
TEXT_BLOCK = 1 << 20


def hashed_runs(text: str, buckets: int, longest: int):
    """``(words, array of buckets)`` for each part of a text: all runs that end in the part."""
    raw = text.encode().translate(WORDS)
    at, tail = 0, []
    while at < len(raw):
        end = raw.find(b" ", at + TEXT_BLOCK)
        end = len(raw) if end < 0 else end
        new = raw[at:end].split()
        at, words = end, tail + new
        later, parts, sums = [b" " + w for w in words], [], None
        for size in range(1, longest + 1):
            sums = list(map(crc32, words)) if size == 1 else list(map(crc32, later[size - 1 :], sums))
            parts += sums[max(0, len(tail) - size + 1) :]
        tail = words[len(words) - longest + 1 :] if len(words) >= longest else words
        if longest == 1:
            tail = []
        yield len(new), np.array(parts, np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``bucket, n``: features in each bucket over all texts; one row a bucket leaves a task."""

    def run(batches):
        total, held, size = np.zeros(buckets, np.int64), [], 0
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                for _, found in hashed_runs(text, buckets, longest):
                    held.append(found)
                    size += len(found)
                    if size > TEXT_BLOCK:
                        total, held, size = total + np.bincount(np.concatenate(held), minlength=buckets), [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """The gain of each bucket, from its features in the corpus and in the target."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)) for s, t in zip(corpus, target, strict=True)]
    return np.array([math.floor(scale * math.log(r)) for r in ratio], np.int64)


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    found = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        found[bucket] = n
    return found


def weighed(texts: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""
    buckets = len(gain)

    def run(batches):
        for part in slices(batches):
            rows = []
            for text in part.column(1).to_pylist():
                words = features = weight = 0
                for new, found in hashed_runs(text, buckets, longest):
                    words, features, weight = words + new, features + len(found), weight + int(gain[found].sum())
                rows.append((words, features, weight))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], ["doc_id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weights: DataFrame, seed: int) -> DataFrame:
    """``weights`` with ``score``: weight plus scaled Gumbel noise keyed by seed and identifier."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return weights.withColumn("score", F.col("weight") + noise)


def rank_offsets(scores: DataFrame, most: int) -> DataFrame:
    """``score, offset``: rows with a higher score, for every score whose offset is below ``most``."""
    block = F.floor(F.col("score") / BLOCK) if BLOCK & (BLOCK - 1) else F.shiftright("score", BLOCK.bit_length() - 1)
    histogram = scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("block", block)
    totals = histogram.groupBy("block").agg(F.sum("n").alias("n"))
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = totals.select("block", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("above")).filter(F.col("above") < most)
    within = Window.partitionBy("block").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("above") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return histogram.join(above, "block").select("score", offset.alias("offset")).filter(F.col("offset") < most)


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``scored`` (a written table) with ``rank``: the highest ``percent`` of the rows with enough words, null for the rest."""
    enough = F.col("n_words") >= least_words
    most = scored.filter(enough).count() * percent // 100
    if not most:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    offsets = staged(rank_offsets(scored.filter(enough).select("score"), most), "offsets")
    cutoff = offsets.agg(F.min("score")).first()[0]
    reach = enough & (F.col("score") >= cutoff)
    within = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    place = (F.col("offset") + F.row_number().over(within)).cast("long")
    ranked = scored.filter(reach).join(offsets, "score").withColumn("rank", F.when(place <= most, place)).select(*scored.columns, "rank")
    return ranked.unionByName(scored.filter(~reach).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, longest: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``target`` has a ``text``."""
    texts = texts_of(docs)
    wanted = target.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gain = gains(_array(bucket_counts(texts, buckets, longest), buckets), _array(bucket_counts(wanted, buckets, longest), buckets))
    return drawn(staged(with_scores(weighed(texts, gain, longest), seed), "weighed"), percent, least_words)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: weights, scores and ranks of every document against the benchmark's texts."""
    found = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: Table of the byte-wise CRC-32, from its polynomial, and the checksum of ``f``; for the twins.
CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY b) AS tab FROM (
    WITH RECURSIVE s AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) r(b)
      UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM s WHERE k < 8)
    SELECT b, c FROM s WHERE k = 8))"""
CRC = """xor(4294967295, list_reduce(list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT),
  lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295::BIGINT))"""

ORACLE = rf"""
WITH RECURSIVE {CRC_TABLE},
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
worded AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
  || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM worded),
grouped AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT f, {CRC} % 10000 AS bucket FROM (SELECT DISTINCT f FROM grouped), crc_table),
counted AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0) AS s, coalesce(sum(n) FILTER (side = 1), 0) AS t FROM grouped JOIN hashed USING (f) GROUP BY bucket),
gained AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counted) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counted) + 10000)::DOUBLE)))::BIGINT AS gain FROM counted),
weights AS (SELECT id, sum(n) AS n_features, sum(n * gain) AS weight FROM grouped JOIN hashed USING (f) JOIN gained USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT d.id AS doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM worded d LEFT JOIN weights USING (id) WHERE d.side = 0),
ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, o.rank AS rank FROM scored LEFT JOIN (
  SELECT * FROM ordered WHERE rank <= (SELECT 5 * count(*) // 100 FROM ordered)) o USING (doc_id)
"""
