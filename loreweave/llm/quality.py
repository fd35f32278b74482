"""Quality by a weak-label model and a hashed linear scorer.

Heuristic labellers look at different signs of junk (symbol noise, shouting,
repetition, table debris, ...) and vote good, bad or unsure on every text, or abstain
from one too short to tell. Only
the number of rows for each pattern of votes reaches the driver (at most
4^labellers numbers, whatever the table): expectation-maximisation over these
counts estimates every labeller's accuracies (probability of each vote, if it
casts one, given the class) and the share of good rows, and gives each pattern its posterior.

The posteriors label a bounded sample (``ROWS_PER_CLASS`` rows for each side, the
smallest identifier hashes, one row for each identifier) on which a logistic scorer over hashed word shapes
is fitted; it scores every whole text. No human label is used.

Defined cases: null and empty texts score what the scorer gives no words; repeated
rows score alike; if all rows fall on one side, the score is the posterior of the
text's votes; an empty table gives no rows; other columns are never inputs.
"""

from __future__ import annotations

import re
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import fresh_name, one_text_each, slices, staged, texts_of
from loreweave.llm.tokens import Memory

BAD, GOOD, UNSURE, ABSTAIN = range(4)
ROWS_PER_CLASS = 3000
SPACE = 1 << 14
ROUNDS = 100
#: Words in one generation of a worker's memory.
WORDS = 100_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_MARK = np.asarray([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_RARE = np.asarray([chr(b) in "#$%&*+/<=>@\\^_`{|}~" for b in range(256)])
_ENDS = np.asarray([chr(b) in ".!?" for b in range(256)])


def stats(text: str, words: list[str]) -> dict[str, float]:
    """Shares that the labellers look at."""
    n = len(words)
    bytes_ = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    solid = max(1, int(bytes_[33:].sum()))
    ascii_letters = max(1, int(bytes_[_UPPER].sum() + bytes_[_LOWER].sum()))
    return {
        "n": n,
        "upper": bytes_[_UPPER].sum() / ascii_letters,
        "marks": bytes_[_MARK].sum() / solid,
        "rare": bytes_[_RARE].sum() / max(1, n),
        "ends": bytes_[_ENDS].sum() / max(1, n),
        "pipes": bytes_[124] / max(1, n),
        "shouts": text.count("!!") / max(1, n),
        "repeats": sum(map(eq, words, words[1:])) / max(1, n),
        "distinct": len(set(words)) / max(1, n),
        "length": solid / max(1, n),
    }


#: Texts with fewer words are too short for most labellers.
LEAST_WORDS = 12


def _between(s: dict, name: str, good: float, bad: float) -> int:
    if s["n"] < LEAST_WORDS:
        return ABSTAIN
    return GOOD if s[name] <= good else BAD if s[name] >= bad else UNSURE


#: The labellers, each from the shares of a text to a vote; fixed thresholds.
LABELLERS = (
    lambda s: _between(s, "upper", 0.3, 0.5),
    lambda s: _between(s, "marks", 0.12, 0.2),
    lambda s: _between(s, "rare", 0.1, 0.5),
    lambda s: _between(s, "pipes", 0.02, 0.2),
    lambda s: _between(s, "shouts", 0.05, 0.3),
    lambda s: _between(s, "repeats", 0.05, 0.2),
    lambda s: ABSTAIN if s["n"] < 60 else BAD if s["distinct"] < 0.15 else GOOD if s["distinct"] > 0.3 else UNSURE,
    lambda s: ABSTAIN if s["n"] < 30 else BAD if s["ends"] < 0.005 or s["ends"] > 1 else GOOD,
)


def pattern(s: dict) -> int:
    """All votes as one number in base four."""
    code = 0
    for labeller in LABELLERS:
        code = 4 * code + labeller(s)
    return code


def votes_of(code: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        code, v = divmod(code, 4)
        out.append(v)
    return out[::-1]


def estimate(counts: dict[int, int]) -> tuple[dict[int, float], np.ndarray, float]:
    """EM over counted patterns: posterior of good for each, accuracies [class, labeller, vote], share of good."""
    codes = sorted(counts)
    votes = np.asarray([votes_of(c) for c in codes]).reshape(len(codes), len(LABELLERS))
    n = np.asarray([counts[c] for c in codes], float)
    one_hot = np.stack([votes == v for v in (BAD, GOOD, UNSURE)], 2).astype(float)  # abstaining says nothing
    good = np.where((votes == BAD).any(1), 0.1, 0.9)  # a labeller seldom cries bad without cause
    accuracies, share = np.zeros((2, len(LABELLERS), 3)), 0.5
    for _ in range(ROUNDS):
        for c, weight in ((GOOD, good * n), (BAD, (1 - good) * n)):
            cast = np.einsum("p,plv->lv", weight, one_hot) + 0.5
            accuracies[c] = cast / cast.sum(1, keepdims=True)
        share = (good @ n + 1) / (n.sum() + 2)
        log = np.einsum("plv,clv->cp", one_hot, np.log(accuracies)) + np.log([[1 - share], [share]])
        before, good = good, 1 / (1 + np.exp(np.clip(log[BAD] - log[GOOD], -500, 500)))
        if np.abs(before - good).max(initial=0) < 1e-9:
            break
    return dict(zip(codes, good.tolist(), strict=True)), accuracies, share


_RUNS = re.compile(r"(.)\1+")


def shape(chunk: str) -> int:
    """Hashed shape of a word: letters, capitals, digits and marks with runs shortened."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c for c in chunk)
    return xxhash.xxh32_intdigest(_RUNS.sub(r"\1\1", kinds).encode(), 5) & SPACE - 1


REPEAT, BIAS = SPACE, SPACE + 1


def vector(text: str, memory) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: square roots of the (shrunk) shares of word shapes and repeats, and the bias."""
    words = text.split()
    n = len(words) + LEAST_WORDS  # few words are weak evidence
    places, counts = np.unique(np.fromiter(map(memory.__getitem__, words), np.int64, len(words)), return_counts=True)
    repeats = sum(map(eq, words, words[1:]))
    return np.append(places, (REPEAT, BIAS)), np.append(np.sqrt(counts / n), (np.sqrt(repeats / n), 1.0))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer, by full-batch Adam; both sides weigh the same."""
    at, value = (np.concatenate(x) for x in zip(*rows, strict=True))
    sizes = np.asarray([len(p) for p, _ in rows])
    start, row = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.repeat(np.arange(len(rows)), sizes)
    weight = target / target.sum() / 2 + (1 - target) / (1 - target).sum() / 2
    w, m, v = (np.zeros(SPACE + 2) for _ in range(3))
    for step in range(1, 301):
        raw = np.add.reduceat(w[at] * value, start)
        err = (1 / (1 + np.exp(-raw)) - target) * weight
        g = np.bincount(at, err[row] * value, SPACE + 2) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


class Scorer:
    """The fitted scorer, or where all rows fell on one side, the posteriors of patterns."""

    def __init__(self, weights: np.ndarray | None, posterior: dict[int, float], share: float):
        if weights is not None:
            self.places = np.nonzero(weights)[0]
            self.values = weights[self.places]
        self.linear, self.posterior, self.share = weights is not None, posterior, share

    def __call__(self, texts: list[str], memory) -> np.ndarray:
        if not self.linear:
            return np.asarray([self.posterior.get(pattern(stats(t, t.split())), self.share) for t in texts])
        w = memory.weights
        raw = np.asarray([w[p] @ x for p, x in (vector(t, memory) for t in texts)])
        return 1 / (1 + np.exp(-np.clip(raw, -60, 60)))

    def memory(self) -> Memory:
        found = Memory(shape, WORDS)
        if self.linear:
            found.weights = np.zeros(SPACE + 2)
            found.weights[self.places] = self.values
        return found


def votes(docs: DataFrame) -> DataFrame:
    """``doc_id, pattern`` of every row."""

    def run(batches):
        for part in slices(batches):
            codes = [pattern(stats(t, t.split())) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(codes, pa.int32())], names=["doc_id", "pattern"])

    return texts_of(docs).mapInArrow(run, "doc_id long, pattern int")


def learn(docs: DataFrame, per_class: int = ROWS_PER_CLASS) -> Scorer:
    """Votes over all rows, EM over their counts, then the scorer on a bounded sample."""
    voted = staged(votes(docs), "quality-votes")
    counts = {r.pattern: r["count"] for r in voted.groupBy("pattern").count().collect()}  # at most 4^labellers rows
    posterior, _, share = estimate(counts) if counts else ({}, None, 1.0)
    good = [c for c, p in posterior.items() if p >= 0.5]
    bad = [c for c, p in posterior.items() if p < 0.5]
    if not good or not bad:
        return Scorer(None, posterior, share)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = voted.filter("doc_id is not null").select("doc_id", F.col("pattern").isin(good).alias("good"))
    chosen = known.filter("good").orderBy(*order).limit(per_class).unionByName(known.filter("not good").orderBy(*order).limit(per_class))
    texts = texts_of(docs).join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").select("doc_id", "text")  # bounded: two times per_class
    texts = one_text_each(texts)

    def run(batches):
        memory = Memory(shape, WORDS)
        Memory.only(memory)
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                places, values = vector(text, memory)
                rows.append({"doc_id": doc_id, "pattern": pattern(stats(text, text.split())), "places": places, "values": values})
            yield pa.RecordBatch.from_pylist(rows, SAMPLE)

    # one row for each identifier, of at most SPACE + 2 places
    rows = texts.mapInArrow(run, "doc_id long, pattern int, places array<int>, values array<float>").toArrow().sort_by("doc_id")
    target = np.asarray([posterior[c] for c in rows["pattern"].to_pylist()])
    if not len(target) or not 0 < target.sum() < len(target):
        return Scorer(None, posterior, share)
    pairs = list(zip(map(np.asarray, rows["places"].to_pylist()), map(np.asarray, rows["values"].to_pylist()), strict=True))
    return Scorer(fit(pairs, target), posterior, share)


SAMPLE = pa.schema([("doc_id", pa.int64()), ("pattern", pa.int32()), ("places", pa.list_(pa.int32())), ("values", pa.list_(pa.float32()))])


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``doc_id, score, keep``: probability of good and the decision for every row."""

    def run(batches):
        memory = scorer.memory()
        Memory.only(memory)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            p = scorer(texts, memory)
            yield pa.record_batch([part.column(0), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "score", "keep"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double, keep boolean")


def good_only(docs: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``limit``, all columns kept."""
    scorer = learn(docs)

    @F.pandas_udf("double")
    def quality(texts):
        import pandas as pd

        return pd.Series(scorer([t or "" for t in texts], _memory(scorer)))

    name = fresh_name(docs, "quality_score")
    return docs.withColumn(name, quality(F.col("text").cast("string"))).filter(F.col(name) >= limit).drop(name)


_MEMORIES: dict = {}


def _memory(scorer: Scorer) -> Memory:
    """The worker's memory for the scorer in use."""
    key = xxhash.xxh64_intdigest(scorer.values.tobytes()) if scorer.linear else 0
    if key not in _MEMORIES:
        _MEMORIES.clear()
        _MEMORIES[key] = scorer.memory()
    Memory.only(_MEMORIES[key])
    return _MEMORIES[key]


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: quality score and decision of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score(docs, learn(docs))
    return found.select("doc_id", "score", F.col("keep").cast("int").alias("predicted"))
