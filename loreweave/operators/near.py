"""Cosine of many vectors with a stated set of query vectors, by matrix products where the vectors are read.

A product tells which pairs can still be among a query's best; only those get
their score, by the sums of ``vector.cosine`` in the same order, so that scores
and ties are the ones of that expression. What is left to rank is a few times
the stated number of hits for each query and batch of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions import vector
from loreweave.operators import rank

#: Query vectors that meet the vectors in one pass; the size of what is broadcast.
PER_ROUND = 2_000
#: Scores of one matrix product, and how far such a score may be from the exact one, rounding to nine digits included.
BLOCK, MARGIN = 2_000_000, 1e-8


def _plain(v: Column) -> Column:
    """A vector for matrix products: valid, and neither its norm nor a product of two overflows or vanishes."""
    return vector.is_valid(v) & vector.norm(v).between(1e-100, 1e100)


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length the places of its vectors, their components as columns and their norms."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(float), column.value_lengths().to_numpy(zero_copy_only=False)
    starts, out = np.cumsum(sizes) - sizes, {}
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        x = np.ascontiguousarray(values[starts[at][None, :] + np.arange(n)[:, None]])
        total = np.zeros(len(at))
        for row in x:
            total += row * row
        out[int(n)] = at, x, np.sqrt(total)
    return out


def _exact(v, q, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of vectors ``i`` and queries ``j``, summed in component order."""
    out = np.empty(len(i))
    for a in range(0, len(i), 65_536):
        x, y = i[a : a + 65_536], j[a : a + 65_536]
        total = np.zeros(len(x))
        for left, right in zip(v[1], q[1], strict=True):
            total += left[x] * right[y]
        out[a : a + 65_536] = total / (v[2][x] * q[2][y])
    return out


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` best of each row, in no order; filled up where there are fewer."""
    if scores.shape[1] > k:
        return np.partition(scores, -k, axis=1)[:, -k:]
    return np.pad(scores, ((0, 0), (0, k - scores.shape[1])), constant_values=-np.inf)


def scored(
    vectors: DataFrame, queries: DataFrame, most: int, least: float | None = None, source: list[str] | None = None, same: list[str] | None = None, lengths: bool = True,
    cells: tuple[str, dict] | None = None, floor: dict | None = None, per_round: int = PER_ROUND,
) -> DataFrame:
    """``question_id``, the columns of ``vectors`` but vec, and ``score``: all pairs that can be among a question's ``most`` best, and others.

    ``queries``: question_id, vec. Scores are those of ``vector.cosine``, from
    ``least`` on if it is given; pairs that are left out score lower than
    ``most`` pairs of the question, or with ``source`` lower than pairs of
    ``most`` different sources. ``same``: columns of both that must be equal.
    ``lengths``: only vectors of the query's length count, else others score 0.
    ``cells``: a column and the values of it that each question meets;
    ``floor``: a score for each question below which none is needed.
    """
    same, kept = same or [], [c for c in vectors.columns if c != "vec"]
    types = dict(vectors.dtypes)
    fields = ", ".join(f"`{c}` {t}" for c, t in [("question_id", dict(queries.dtypes)["question_id"]), *((c, types[c]) for c in kept), ("score", "double")])
    q = queries.select("question_id", F.col("vec").alias("_q"), *[F.col(c).alias(f"_{c}") for c in same])
    plain = vectors.filter(_plain(F.col("vec")))

    def by_expression(v: DataFrame, some: DataFrame) -> DataFrame:
        """The few vectors that no matrix product takes, one pair at a time."""
        met = v.crossJoin(F.broadcast(some))
        for c in same:
            met = met.filter(F.col(c) == F.col(f"_{c}"))
        if lengths:
            met = met.filter(F.size("vec") == F.size("_q"))
        if cells:
            met = met.join(F.broadcast(v.sparkSession.createDataFrame([(i, c) for i, cs in cells[1].items() for c in cs], f"question_id {dict(q.dtypes)['question_id']}, `{cells[0]}` {types[cells[0]]}")), ["question_id", cells[0]], "left_semi")
        met = met.select("question_id", *kept, vector.cosine(F.col("vec"), F.col("_q")).alias("score"))
        return met if least is None else met.filter(F.col("score") >= least)

    def answer(some: DataFrame) -> DataFrame:
        stated = some.filter(_plain(F.col("_q"))).toArrow()  # a round
        ids, asked = stated["question_id"].combine_chunks(), _matrices(stated["_q"])
        names = ids.to_pylist()
        wanted = [stated[f"_{c}"].to_pylist() for c in same]
        start = np.asarray([(floor or {}).get(x, -np.inf) for x in names], float)
        start = start if least is None else np.maximum(start, least)
        by_cell: dict = {}
        for place, x in enumerate(names):
            for c in cells[1].get(x, ()) if cells else ():
                by_cell.setdefault(c, []).append(place)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floor_, best = start.copy(), np.full((len(names), most), -np.inf)
            of_length = {n: {int(p): k for k, p in enumerate(m[0])} for n, m in asked.items()}
            for batch in batches:
                groups = None
                if source:
                    seen: dict = {}
                    groups = np.asarray([seen.setdefault(s, len(seen)) for s in zip(*(batch.column(c).to_pylist() for c in source), strict=True)])
                held = [batch.column(c).to_pylist() for c in same]
                cell = np.asarray(batch.column(cells[0]).to_pylist()) if cells else None
                for n, v in _matrices(batch.column("vec")).items():
                    unit = v[1] / v[2]
                    for m, known in asked.items():
                        if m != n and lengths:
                            continue
                        for rows, places in _met(cell, v[0], known[0], by_cell, of_length[m]):
                            yield from block(batch, n == m, v, unit, known, rows, places, groups, held, floor_, best)

        def _met(cell, at, places, by_cell, numbers):
            """Blocks of vectors and queries, both by their places in their matrices."""
            parts = [(np.arange(len(at)), np.arange(len(places)))]
            if cell is not None:
                parts = [(np.flatnonzero(cell[at] == c), np.asarray([numbers[p] for p in by_cell.get(c, ()) if p in numbers], int)) for c in np.unique(cell[at])]
            for rows, some in parts:
                step = max(1, BLOCK // max(1, len(rows)))
                for a in range(0, len(some), step):
                    yield rows, some[a : a + step]

        def block(batch, alike, v, unit, known, rows, some, groups, held, floor_, best):
            at, asked_at = v[0][rows], known[0][some]
            scores = (known[1][:, some] / known[2][some]).T @ unit[:, rows] if alike else np.zeros((len(some), len(rows)))
            for left, right in zip(wanted, held, strict=True):
                x, y = np.asarray([left[p] for p in asked_at], object), np.asarray([right[p] for p in at], object)
                scores[(x[:, None] != y[None, :]) | np.equal(x, None)[:, None]] = -np.inf
            if groups is None:
                best[asked_at] = _kth(np.concatenate([best[asked_at], _kth(scores, most)], axis=1), most)
                now = best[asked_at].min(axis=1)
            else:
                order = np.argsort(groups[at], kind="stable")
                firsts = np.flatnonzero(np.diff(groups[at][order], prepend=-1))
                now = _kth(np.maximum.reduceat(scores[:, order], firsts, axis=1), most).min(axis=1)
            floor_[asked_at] = np.maximum(floor_[asked_at], now)
            j, i = np.nonzero((scores >= floor_[asked_at][:, None] - MARGIN) & (scores > -np.inf))
            if len(i):
                exact = _exact(v, known, rows[i], some[j]) if alike else np.zeros(len(i))
                if least is not None:
                    i, j, exact = i[exact >= least], j[exact >= least], exact[exact >= least]
                taken = batch.take(pa.array(at[i]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(asked_at[j])), *(taken.column(c) for c in kept), pa.array(exact)], names=["question_id", *kept, "score"])

        odd = by_expression(vectors.filter(~_plain(F.col("vec"))), some).unionByName(by_expression(plain, some.filter(~_plain(F.col("_q")))))
        return plain.mapInArrow(run, fields).unionByName(odd) if names else odd

    return rank.in_rounds(q, "question_id", per_round, answer)
