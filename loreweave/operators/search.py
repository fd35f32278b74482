"""Retrieval channels and their fusion, for all questions in one plan."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.functions import text, vector
from loreweave.operators import near, rank

#: Distinct terms that one automaton holds and one broadcast carries.
TERMS_PER_PASS = 200_000
#: Characters of terms: what a term can lie in is a run of one of these kinds.
RUN = re.compile("[a-z0-9_.+#-]+|[\u4e00-\u9fa5]+")
#: Runs that a task remembers with the terms in them.
RUNS_KEPT = 200_000
#: Query vectors that meet the vectors in one pass; the size of what is broadcast.
VECTORS_PER_ROUND = 2_000
#: Questions scored in one pass over the passages.
QUESTIONS_PER_ROUND = 5_000
SOURCE = ["source_type", "source_id"]
PASSAGE = ["source_type", "source_id", "seq"]


def passage_key() -> F.Column:
    """The string key that breaks ties: ``type:id:seq``."""
    return F.concat_ws(":", "source_type", F.col("source_id").cast("string"), F.col("seq").cast("string"))


def question_terms(questions: DataFrame) -> DataFrame:
    """``question_id, term``: up to 40 lower-case terms of each question."""
    return questions.select("question_id", F.explode(F.array_distinct(F.transform(text.retrieval_terms(F.col("question")), F.lower))).alias("term"))


def term_hits(passages: DataFrame, terms: DataFrame) -> DataFrame:
    """``source_type, source_id, seq, term, weight``: terms contained in passages, as substrings.

    All terms go into one Aho-Corasick automaton, so a passage is read once
    whatever the number of questions; the term set is bounded by
    ``TERMS_PER_PASS`` and handled in several passes beyond it. A passage is
    worth 5 for a term in title and body, 3 for either of title and body alone.
    """
    n = terms.count()
    passes = max(1, -(-n // TERMS_PER_PASS))
    hits = None
    schema = "source_type string, source_id long, seq int, term string, weight int"
    for turn in range(passes):
        part = terms if passes == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == turn)
        words = [r.term for r in part.collect()]  # bounded by TERMS_PER_PASS
        if not words:
            continue
        found = _scan(passages, words, schema)
        hits = found if hits is None else hits.unionByName(found)
    return passages.sparkSession.createDataFrame([], schema) if hits is None else hits


def _scan(passages: DataFrame, words: list[str], schema: str) -> DataFrame:
    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            out = {"source_type": [], "source_id": [], "seq": [], "term": [], "weight": []}
            for kind, source, seq, title, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                in_title = {w for _, w in automaton.iter(title)}
                in_body = {w for _, w in automaton.iter(body)}
                for w in in_title | in_body:
                    out["source_type"].append(kind)
                    out["source_id"].append(source)
                    out["seq"].append(seq)
                    out["term"].append(w)
                    out["weight"].append(5 if w in in_title and w in in_body else 3)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("source_type", pa.string()), ("source_id", pa.int64()), ("seq", pa.int32()), ("term", pa.string()), ("weight", pa.int32())]))

    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return passages.select("source_type", F.col("source_id").cast("long"), F.col("seq").cast("int"), low("title"), low("body")).mapInArrow(run, schema)


def keyword_scores(passages: DataFrame, questions: DataFrame, cfg: Config | None = None) -> DataFrame:
    """``question_id, source_type, source_id, seq, score`` of the passages that hold a term.

    ``passages``: source_type, source_id, seq, title, body. Per term 5 for title
    and body, 3 for the title only, 3 for the body only. The terms of all
    questions go into one automaton, so a passage is read once and scored for
    every question where it is read. With ``cfg`` a task only keeps hits that
    can still be among the diversified candidates of a question: its best
    ``source_priority * candidates`` first hits of a source, and its best
    ``candidates`` of all. Questions are a stated set, in rounds of
    ``QUESTIONS_PER_ROUND``.
    """
    n = questions.count()
    rounds = max(1, -(-n // QUESTIONS_PER_ROUND))
    found = None
    for turn in range(rounds):
        part = questions if rounds == 1 else questions.filter(F.pmod(F.xxhash64("question_id"), F.lit(rounds)) == turn)
        asked = part.select("question_id", F.array_distinct(F.transform(text.retrieval_terms(F.col("question")), lambda x: F.lower(x))).alias("terms")).collect()  # bounded by the round
        scored = _scored(passages, [(r.question_id, r.terms) for r in asked], cfg)
        found = scored if found is None else found.unionByName(scored)
    return found


def _scored(passages: DataFrame, asked: list, cfg: Config | None) -> DataFrame:
    ids = np.asarray([q for q, _ in asked], np.int64)
    of_term: dict[str, list[int]] = {}
    for i, (_, terms) in enumerate(asked):
        for t in terms:
            of_term.setdefault(t, []).append(i)
    words = list(of_term)
    members = [np.asarray(of_term[w], np.int32) for w in words]
    schema = pa.schema([("question_id", pa.int64()), ("source_type", pa.string()), ("source_id", pa.int64()), ("seq", pa.int32()), ("score", pa.int64())])

    def kept(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.Series]:
        """Rows that can still count, by the order of the channel, and the least score that can join them, where it is known."""
        key = rows.source_type + ":" + rows.source_id.astype(str) + ":" + rows.seq.astype(str)
        rows = rows.assign(_key=key).sort_values(["question_id", "score", "_key"], ascending=[True, False, True], kind="stable").drop(columns="_key").reset_index(drop=True)
        first = rows.groupby(["question_id", "source_type", "source_id"]).cumcount() < cfg.source_priority
        among, most = first.groupby(rows.question_id).cumsum(), cfg.source_priority * cfg.candidates
        rows = rows[(first & (among <= most)) | (rows.groupby("question_id").cumcount() < cfg.candidates)]
        enough = rows.score[first.loc[rows.index] & (among.loc[rows.index] == most)]
        return rows.reset_index(drop=True), enough.groupby(rows.question_id.loc[enough.index]).min()

    def run(batches):
        if not words:
            return
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, w in enumerate(words):
            automaton.add_word(w, i)
        automaton.make_automaton()
        known: dict[str, frozenset] = {}

        def terms_in(body: str) -> set:
            """Places of the terms in a text; no term spans two runs, and runs repeat."""
            found = set()
            for r in set(RUN.findall(body)):
                hit = known.get(r)
                if hit is None:
                    if len(known) >= RUNS_KEPT:
                        known.clear()
                    hit = known[r] = frozenset(i for _, i in automaton.iter(r))
                found |= hit
            return found

        least = np.ones(len(ids), np.int64)  # a lower score can no longer count for a question
        held = None
        rows: list[tuple] = []

        def frame() -> pd.DataFrame:
            some, scores, keys = (list(x) for x in zip(*rows, strict=True))
            n = [len(x) for x in some]
            kinds, sources, seqs = (np.repeat(np.asarray(x, dtype=object if i == 0 else None), n) for i, x in enumerate(zip(*keys, strict=True)))
            rows.clear()
            return pd.DataFrame({"question_id": ids[np.concatenate(some)], "source_type": kinds, "source_id": sources, "seq": seqs, "score": np.concatenate(scores)})

        def prune() -> None:
            nonlocal held
            held, best = kept(frame() if held is None else pd.concat([held, frame()]))
            least[order[np.searchsorted(ids[order], best.index.to_numpy())]] = np.maximum(best.to_numpy(), 1)

        order, every = np.argsort(ids), np.arange(len(ids))
        waiting = 0
        for batch in batches:
            for kind, source, seq, title, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                in_title, in_body = terms_in(title), terms_in(body)
                hit = in_title | in_body
                if not hit:
                    continue
                touched = np.concatenate([members[i] for i in hit])
                both = in_title & in_body
                if len(touched) * 4 < len(ids):  # few questions of many: only those of matched terms are touched
                    worth = np.repeat([5 if i in both else 3 for i in hit], [len(members[i]) for i in hit])
                    some, place = np.unique(touched, return_inverse=True)
                    score = np.bincount(place, worth).astype(np.int64)
                else:
                    some, score = every, np.bincount(touched, minlength=len(ids)) * 3
                    if both:
                        score = score + 2 * np.bincount(np.concatenate([members[i] for i in both]), minlength=len(ids))
                can = np.nonzero(score >= least[some])[0]
                if len(can):
                    rows.append((some[can], score[can], (kind, source, seq)))
                    waiting += len(can)
                if cfg and waiting >= 50_000:
                    prune()
                    waiting = 0
            if rows and not cfg:
                yield pa.RecordBatch.from_pandas(frame(), schema, preserve_index=False)
        if rows and cfg:
            prune()
        if held is not None:
            yield pa.RecordBatch.from_pandas(held, schema, preserve_index=False)

    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    source = passages.select("source_type", F.col("source_id").cast("long"), F.col("seq").cast("int"), low("title"), low("body"))
    return source.mapInArrow(run, "question_id long, source_type string, source_id long, seq int, score long")


def keyword_channel(passages: DataFrame, questions: DataFrame, cfg: Config | None = None) -> DataFrame:
    """The ranked keyword hits of every question: score, then key; diversified by source."""
    cfg = cfg or Config()
    scored = keyword_scores(passages, questions, cfg)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), passage_key())))
    return rank.diversify(ranked, ["question_id"], SOURCE, cfg.source_priority, cfg.candidates)


def vector_channel(vectors: DataFrame, queries: DataFrame, cfg: Config | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """Ranked vector hits: same space and dimension, cosine threshold, band below the best, diversified.

    ``vectors``: source_type, source_id, seq, vec (and embedding_space);
    ``queries``: question_id, vec (and embedding_space), a stated query set that
    meets all vectors. Stale rows (not in ``fresh`` by key and text) leave
    before the band is taken, or they would use it up.
    """
    cfg = cfg or Config()
    if fresh is not None:
        vectors = vectors.join(fresh.select(*PASSAGE, "chunk_text"), [*PASSAGE, "chunk_text"], "left_semi")
    spaces = ["embedding_space"] if "embedding_space" in queries.columns else []
    v, q = (t.filter(vector.is_valid(F.col("vec"))).select(*key, *spaces, "vec") for t, key in ((vectors, PASSAGE), (queries, ["question_id"])))
    # A hit below the best hits of as many sources as there are places cannot have one, so only the others are shuffled.
    found = near.scored(v, q, cfg.candidates, cfg.vector_min_score, SOURCE, spaces, per_round=VECTORS_PER_ROUND).select("question_id", *PASSAGE, "score")
    best = F.max("score").over(Window.partitionBy("question_id"))
    banded = found.withColumn("_best", best).filter(F.col("score") >= F.col("_best") - cfg.vector_score_gap).drop("_best")
    ranked = banded.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), passage_key())))
    return rank.diversify(ranked, ["question_id"], SOURCE, cfg.vector_source_priority, cfg.candidates)


def fuse(routes: DataFrame, cfg: Config | None = None) -> DataFrame:
    """RRF over ``question_id, route, rank`` and a passage key, diversified to the window."""
    cfg = cfg or Config()
    scored = rank.rrf(routes, ["question_id"], PASSAGE, cfg)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), passage_key())))
    return rank.diversify(ranked, ["question_id"], SOURCE, cfg.source_priority, cfg.fused_window)


MODES = ("fused", "keyword", "vector")


def search(passages: DataFrame, questions: DataFrame, vectors: DataFrame | None = None, queries: DataFrame | None = None, extra: DataFrame | None = None, mode: str = "fused", cfg: Config | None = None, order: DataFrame | None = None) -> DataFrame:
    """Ranked passages of every question: channels, fusion, an optional rerank order.

    ``extra``: further routes (graph evidence, wiki sources) as question_id,
    route, rank and key; ``order``: question_id, key columns and position, the
    result of a reranker.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "vector" and (vectors is None or queries is None):
        raise ValueError("vector mode needs vectors and query vectors")
    cfg = cfg or Config()
    if mode == "keyword":
        hits = keyword_channel(passages, questions, cfg).withColumn("channels", F.array(F.lit("keyword")))
    elif mode == "vector":
        hits = vector_channel(vectors, queries, cfg).withColumn("channels", F.array(F.lit("vector")))
    else:
        cols = ["question_id", "rank", *PASSAGE]
        routes = keyword_channel(passages, questions, cfg).select(*cols).withColumn("route", F.lit("keyword"))
        if vectors is not None and queries is not None:
            routes = routes.unionByName(vector_channel(vectors, queries, cfg).select(*cols).withColumn("route", F.lit("vector")))
        if extra is not None:
            routes = routes.unionByName(extra.select(*cols, "route"))
        hits = fuse(routes, cfg)
    if order is not None:
        hits = rank.rerank_merge(hits, order, ["question_id"], PASSAGE)
    return hits.join(passages.select(*PASSAGE, "title", "body"), PASSAGE, "left")
