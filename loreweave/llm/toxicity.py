"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words and, so that inflected or
compounded forms of a stem meet, the words' prefixes of a few lengths; each is
hashed into 2^24 places. Beside a weight, every kept term has a short latent
vector, and a pair of terms adds the inner product of their vectors: an insult
next to a group's name can weigh more than the two apart.

Fitting: labelled rows whose crc32 of the identifier as text is not divisible by
five, at most ``ROWS_PER_CLASS`` for each label (a documented bound: the rows with
the smallest hashes of their identifiers; of rows that repeat an identifier one).
Terms are screened by counts made in Spark: kept are those that separate the
classes alone (log-odds z-score of ``SINGLE_Z``, at most ``KEPT``), and of the
``COMMON`` most frequent others those that do so in a pair (``PAIR_Z``, at most
``PAIRED``). Only the kept terms' places reach the driver. The machine is fitted by
full-batch Adam, classes weighted back to their share in all learnable labels.
Scoring goes over whole texts of every row with the fitted machine, a few hundred kB.

Defined cases: null and empty texts score what the machine gives no terms; a null
identifier is held out; without any learnable label the score is 0, with labels of
one class their share; repeated rows score alike; conflicting labels of an
identifier count as toxic; other columns are never inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import fresh_name, one_text_each, slices, staged, texts_of
from loreweave.llm.tokens import MARKS, Memory

SPACE = 1 << 24
PREFIXES = (4, 5, 6)
ROWS_PER_CLASS = 3000
KEPT = 2048
SINGLE_Z = 2.5
#: Frequent terms whose pairs are looked at, those kept of them at most, the least rows and z-score of a pair.
COMMON, PAIRED, LEAST_PAIRS, PAIR_Z = 512, 256, 8, 7.0
LATENT = 8
STEPS = 200
#: Words in one generation of a worker's memory.
WORDS = 150_000
EDGES = MARKS + "'«»“”„¡¿…"


def terms_of(chunk: str) -> tuple[int, ...]:
    """Hashed terms of one word: the word and its prefixes."""
    word = chunk.strip(EDGES)
    if not word:
        return ()
    found = [word, *(word[:n] + "~" for n in PREFIXES if len(word) > n)]
    return tuple(xxhash.xxh32_intdigest(t.encode(), 7) & SPACE - 1 for t in found)


def terms(text: str, memory) -> set[int]:
    """Distinct hashed terms of a whole text."""
    return set().union(*map(memory.__getitem__, set(text.lower().split())))


class Machine:
    """Kept terms (sorted), their weights and latent vectors, and the bias."""

    def __init__(self, kept, weights, vectors, bias):
        self.kept, self.weights, self.vectors, self.bias = kept, weights, vectors, bias

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of the toxic label from rows of places in ``kept``."""
        raw = np.asarray([self.bias + self.weights[r].sum() + 0.5 * (np.square(self.vectors[r].sum(0)).sum() - np.square(self.vectors[r]).sum()) for r in rows])
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))

    def places(self) -> Memory:
        """A memory of chunk -> places in ``kept``; most words have none."""
        index = {int(t): i for i, t in enumerate(self.kept)}
        return Memory(lambda chunk: tuple(index[t] for t in terms_of(chunk) if t in index), WORDS)


def constant(share: float) -> Machine:
    bias = np.inf if share >= 1 else -np.inf if share <= 0 else np.log(share / (1 - share))
    return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, LATENT)), bias)


def log_odds_z(c1, c0, n1: float, n0: float):
    """z-score of the log-odds with which something in c1 of n1 toxic and c0 of n0 other rows separates the classes."""
    return np.log((c1 + 0.5) / (n1 + 1) * (n0 + 1) / (c0 + 0.5)) / np.sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))


def paired(rows: list[np.ndarray], toxic: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Of ``candidates`` (places), those in a pair that separates the classes."""
    column = np.full(candidates.max(initial=-1) + 2, -1)
    column[candidates] = np.arange(len(candidates))
    inside = np.zeros((len(rows), len(candidates)), np.float32)
    for i, r in enumerate(rows):
        c = column[np.minimum(r, len(column) - 1)]
        inside[i, c[c >= 0]] = 1
    c1, c0 = (inside[rows].T @ inside[rows] for rows in (toxic, ~toxic))
    n1, n0 = toxic.sum(), (~toxic).sum()
    share = (c1 + c0) / (n1 + n0)
    z = np.abs(c1 / n1 - c0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))  # of two proportions
    z[c1 + c0 < LEAST_PAIRS] = 0
    np.fill_diagonal(z, 0)
    best = z.max(1, initial=0)
    return candidates[best >= PAIR_Z][np.argsort(-best[best >= PAIR_Z], kind="stable")][:PAIRED]


def fit(kept: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, share: float, seed: int = 11) -> Machine:
    """Fit on rows of places in ``kept``; ``share``: of the toxic label among all learnable rows."""
    labels = np.asarray(labels, float)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    if not n1 or not n0 or not len(kept):
        return constant(share)
    # one term more, in every row, is the bias and keeps rows from being empty
    at, sizes = np.concatenate([np.append(r, len(kept)) for r in rows]), np.asarray([len(r) + 1 for r in rows])
    start, row = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(rows)), sizes)
    weight = np.where(labels == 1, share / n1, (1 - share) / n0)
    m = len(kept) + 1
    rng = np.random.default_rng(seed)
    w, v = np.zeros(m), rng.normal(0, 0.05, (m, LATENT))
    v[-1] = 0
    state = [np.zeros_like(x) for x in (w, w, v, v)]
    for step in range(1, STEPS + 1):
        picked = v[at]
        sums = np.add.reduceat(picked, start)
        raw = np.add.reduceat(w[at], start) + 0.5 * (np.square(sums).sum(1) - np.add.reduceat(np.square(picked).sum(1), start))
        err = (1 / (1 + np.exp(-np.clip(raw, -60, 60))) - labels) * weight
        spread = err[row]
        gw = np.bincount(at, spread, m) + 1e-5 * w
        inner = spread[:, None] * (sums[row] - picked)
        gv = np.stack([np.bincount(at, inner[:, k], m) for k in range(LATENT)], 1) + 1e-4 * v
        gw[-1] -= 1e-5 * w[-1]
        gv[-1] = 0
        for x, g, i in ((w, gw, 0), (v, gv, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * np.square(g)
            x -= 0.05 * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.999**step)) + 1e-9)
    return Machine(kept, w[:-1], v[:-1], w[-1])


def remainder(doc_id):
    """crc32 of the identifier as text, modulo five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, per_class: int = ROWS_PER_CLASS) -> Machine:
    """The machine from the learnable labels and their texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.filter(remainder(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n1 = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n1 or n1 == n:
        return constant(n1 / n if n else 0.0)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(per_class).unionByName(known.filter("toxic = 0").orderBy(*order).limit(per_class))
    labelled = texts_of(docs).join(F.broadcast(chosen), "doc_id")  # at most two times per_class rows are broadcast

    def hashed(batches):
        memory = Memory(terms_of, WORDS)
        Memory.only(memory)
        for part in slices(batches):
            found = [np.sort(np.fromiter(terms(t, memory), np.int32)) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(2), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "terms"])

    rows = staged(one_text_each(labelled.select("doc_id", "text", "toxic")).select("doc_id", "text", "toxic").mapInArrow(hashed, "doc_id long, toxic int, terms array<int>"), "toxic-terms")
    s, s1 = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not s1 or s1 == s:
        return constant(n1 / n)
    counts = rows.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("toxic").alias("c1"))
    c1, c0 = F.col("c1") + 0.5, F.col("df") - F.col("c1") + 0.5
    z = F.log(c1 / float(s1 + 1) * float(s - s1 + 1) / c0) / F.sqrt(1 / c1 + 1 / c0)
    scored = staged(counts.filter("df >= 3").withColumn("z", F.abs(z)), "toxic-counts")
    single = [r.term for r in scored.filter(F.col("z") >= SINGLE_Z).orderBy(F.desc("z"), "term").limit(KEPT).collect()]
    common = [r.term for r in scored.filter(F.col("z") < SINGLE_Z).orderBy(F.desc("df"), "term").limit(COMMON).collect()]
    kept = np.sort(np.asarray(single + common, np.int64))

    def placed(batches):
        for batch in batches:
            found = []
            for t in batch.column(2).to_pylist():
                at = np.searchsorted(kept, t)
                found.append(at[(at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == t)].astype(np.int32) if len(kept) else [])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "places"])

    table = rows.mapInArrow(placed, "doc_id long, toxic int, places array<int>").toArrow().sort_by("doc_id")  # at most two times per_class rows of KEPT + COMMON places
    labels_of, places = table["toxic"].to_numpy(), [np.asarray(p, np.int64) for p in table["places"].to_pylist()]
    chosen = np.union1d(np.searchsorted(kept, sorted(single)), paired(places, labels_of == 1, np.searchsorted(kept, sorted(common)))).astype(np.int64)
    new = np.full(len(kept), -1)
    new[chosen] = np.arange(len(chosen))
    return fit(kept[chosen], [x[x >= 0] for x in (new[p] for p in places)], labels_of, n1 / n)


def _scores(texts: list[str], machine: Machine, memory) -> np.ndarray:
    return machine.scores([np.fromiter(terms(t, memory), np.int64) for t in texts])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of every row's whole text."""

    def run(batches):
        memory = machine.places()
        Memory.only(memory)
        for part in slices(batches):
            yield pa.record_batch([part.column(0), pa.array(_scores(part.column(1).to_pylist(), machine, memory))], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``limit``, all columns kept."""
    machine = learn(docs, labels)

    @F.pandas_udf("double")
    def toxic(texts):
        import pandas as pd

        memory = _memory(machine)
        return pd.Series(_scores([t or "" for t in texts], machine, memory))

    name = fresh_name(docs, "toxic_score")
    return docs.withColumn(name, toxic(F.col("text").cast("string"))).filter(F.col(name) < limit).drop(name)


_MEMORIES: dict = {}


def _memory(machine: Machine) -> Memory:
    """The worker's memory for the machine in use."""
    key = xxhash.xxh64_intdigest(machine.kept.tobytes() + machine.weights.tobytes())
    if key not in _MEMORIES:
        _MEMORIES.clear()
        _MEMORIES[key] = machine.places()
    Memory.only(_MEMORIES[key])
    return _MEMORIES[key]


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a toxicity score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, learn(docs, labels))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(True))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
