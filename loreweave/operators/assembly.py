"""Context assembly around ranked passages, supplemental queries, rerankers, retrievers, probes and traces."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.operators import context, near, rank, search
from loreweave.sources.staging import staged

# The least characters of a neighbour's excerpt, passages that a reranker sees, extra queries of a question.
LEAST_EXCERPT, RERANK_WINDOW, MOST_EXTRA = 160, 60, 16
#: Characters of the notice, header and footer around the passages, and of the separator of blocks.
FRAME, SEPARATOR = 120, 2
PASSAGE = search.PASSAGE


def related(hits: DataFrame, passages: DataFrame, openings: DataFrame | None = None) -> DataFrame:
    """Hits with the passages beside them and the opening of their section: ``question_id, rank`` of the hit, ``role``, and the passage.

    ``passages``: source_type, source_id, seq, heading, title, body; ``openings``
    (``material.outline``): source_type, source_id, seq, parent_seq, parent_heading.
    Roles: seed, next, previous (same heading), parent. A hit has at most four rows.
    """
    own = ["source_type", "source_id"]
    p = passages.select(*own, "seq", "heading", "body")
    seeds = hits.select("question_id", "question", "rank", *own, F.col("seq").alias("at"), "title", "channels").join(p.withColumnRenamed("seq", "at"), [*own, "at"])
    out = seeds.select("question_id", "question", "rank", *own, "title", "channels", "heading", F.lit("seed").alias("role"), F.col("at").alias("seq"), "body")
    for role, step in (("next", 1), ("previous", -1)):
        beside = p.select(*own, (F.col("seq") - step).alias("at"), F.col("heading").alias("_h"), F.col("body").alias("_b"))
        j = seeds.join(beside, [*own, "at"]).filter(F.coalesce("heading", F.lit("")) == F.coalesce("_h", F.lit("")))
        out = out.unionByName(j.select("question_id", "question", "rank", *own, "title", "channels", "heading", F.lit(role).alias("role"), (F.col("at") + step).alias("seq"), F.col("_b").alias("body")))
    if openings is not None:
        up = openings.select(*own, F.col("seq").alias("at"), "parent_seq", "parent_heading").join(p.select(*own, F.col("seq").alias("parent_seq"), F.col("body").alias("_b")), [*own, "parent_seq"])
        j = seeds.join(up, [*own, "at"]).filter("parent_seq < at")
        out = out.unionByName(j.select("question_id", "question", "rank", *own, "title", "channels", F.col("parent_heading").alias("heading"), F.lit("parent").alias("role"), F.col("parent_seq").alias("seq"), F.col("_b").alias("body")))
    return out


class _Entry:
    """A passage of the context: its seed and what was added around it, by place in the source."""

    def __init__(self, row: dict):
        self.row, self.bodies, self.heading = row, {}, ""

    def size(self) -> int:
        label = len(f"[{self.row['source_type']}#{self.row['source_id']}] {self.row['title'] or ''}\n") + 2
        parts = [len(b) + (len(f"[seq={s}]\n") if len(self.bodies) > 1 else 0) for s, b in self.bodies.items()]
        return label + sum(parts) + 2 * (len(parts) - 1) + len(self.heading)

    def text(self) -> str:
        ordered = sorted(self.bodies.items())
        return ordered[0][1] if len(ordered) == 1 else "\n\n".join(f"[seq={s}]\n{b}" for s, b in ordered)

    def put(self, seq: int, body: str, heading: str, room: int) -> int | None:
        """Take a body in if that costs at most ``room``: the cost, else null and no change."""
        before, old = self.size() if self.bodies else 0, self.heading
        self.bodies[seq], self.heading = body, heading or old
        cost = self.size() - before
        if cost <= room:
            return cost
        del self.bodies[seq]
        self.heading = old
        return None


class _Context:
    """The entries of one question's context; every offer of text is answered against the room that is left."""

    def __init__(self, cfg: Config, reserved: int):
        self.cfg, self.room = cfg, cfg.total_chars - reserved - FRAME
        self.entries: dict[int, _Entry] = {}  # by the seed's rank
        self.taken: set[tuple] = set()

    def offer(self, row: dict, body: str, heading: str = "", shorten: bool = False) -> bool:
        """Put a row's body into the entry of its rank; with ``shorten`` an excerpt of it where all of it is too long."""
        key = row["source_type"], row["source_id"], row["seq"]
        if not body or key in self.taken:
            return False
        entry = self.entries.get(row["rank"]) or _Entry(row)
        cost = entry.put(row["seq"], body, heading, self.room)
        if cost is None and shorten:
            excess = (entry.put(row["seq"], body, heading, 1 << 60) or 0) - self.room
            del entry.bodies[row["seq"]]
            left = len(body) - excess
            short = context.structure_excerpt(row["question"], body, min(left, self.cfg.passage_chars)) if left >= min(len(body), LEAST_EXCERPT) else ""
            cost = entry.put(row["seq"], short, heading, self.room) if short else None
        if cost is None:
            return False
        self.room -= cost
        self.entries[row["rank"]] = entry
        self.taken.add(key)
        return True


def arranged(rows: list[dict], cfg: Config, reserved: int) -> list[_Entry]:
    """The entries of one question's context: a list of offers of text, made in order to one budget.

    Seeds by rank, excerpted to a passage's length; then openings of the sections
    of files, whole, until one is taken; then neighbours, in turns over the entries,
    of each entry those first that add most to what it covers. Graph passages
    take nothing beside them.
    """
    made = _Context(cfg, reserved)
    clean = {id(r): (r["body"] or "").strip() for r in rows}
    ordered = sorted(rows, key=lambda r: (r["rank"], r["role"] == "previous", r["seq"]))
    cut = lambda r: context.structure_excerpt(r["question"], clean[id(r)], cfg.passage_chars)
    for seed in (r for r in ordered if r["role"] == "seed"):
        if len(made.entries) < cfg.max_passages:
            made.offer(seed, cut(seed))
    grows = {rank: e for rank, e in made.entries.items() if e.row["seq"] >= 0 and "graph" not in (e.row["channels"] or [])}
    around = [r for r in ordered if r["rank"] in grows and cfg.neighbor_count > 0]
    speaks = lambda r: len(clean[id(r)]) <= cfg.passage_chars and context.relevance(r["question"], f"{r['heading']}\n{clean[id(r)]}")[0] > 0
    any(made.offer(r, clean[id(r)], r["heading"]) for r in around if r["role"] == "parent" and r["source_type"] == "file" and (r["heading"] or "").strip() and speaks(r))
    ranked: dict[int, list[tuple]] = {}
    for place, r in enumerate(r for r in around if r["role"] in ("next", "previous")):
        total, more = context.relevance(r["question"], body := cut(r), "\n".join(grows[r["rank"]].bodies.values()))
        if body and (total > 0 or (r["heading"] or "").strip()):
            ranked.setdefault(r["rank"], []).append((-more, -total, place, r, body))
    turns = sorted((turn, rank, *best[3:]) for rank, all_ in ranked.items() for turn, best in enumerate(sorted(all_, key=lambda x: x[:3])[: cfg.neighbor_count]))
    for _, rank, r, body in turns:
        if len(grows[rank].bodies) <= cfg.neighbor_count:
            made.offer(r, body, shorten=True)
    return list(made.entries.values())


CONTEXT = pa.schema([("question_id", pa.int64()), ("position", pa.int32()), ("source_type", pa.string()), ("source_id", pa.int64()), ("seq", pa.int32()), ("members", pa.list_(pa.int32())), ("channels", pa.list_(pa.string())), ("excerpt", pa.string()), ("chars", pa.int32())])


def build_context(hits: DataFrame, passages: DataFrame, openings: DataFrame | None = None, auxiliary: DataFrame | None = None, cfg: Config | None = None) -> DataFrame:
    """``question_id, position, source_type, source_id, seq, members, channels, excerpt, chars`` of every question's context.

    ``hits``: question_id, question, rank, source key, title, channels;
    ``auxiliary``: question_id, chars of the other blocks that were found, which
    are reserved. An entry with more than its seed has seq -1 and names its
    members. Joins bring each hit what stands beside it; a question's window,
    at most ``candidates`` hits, is arranged in one group.
    """
    cfg = cfg or Config()
    rows = related(hits.filter(F.col("rank") <= cfg.candidates), passages, openings)
    reserve = F.lit(0)
    if auxiliary is not None:
        blocks = auxiliary.groupBy("question_id").agg(F.sum(F.col("chars") + SEPARATOR).alias("_reserved"))
        rows = rows.join(blocks, "question_id", "left")
        reserve = F.coalesce("_reserved", F.lit(0))
    given = rows.select(F.col("question_id").cast("long"), "question", F.col("rank").cast("int"), "source_type", F.col("source_id").cast("long"), "title", "channels", "heading", "role", F.col("seq").cast("int"), "body", reserve.cast("int").alias("reserved"))

    def run(group: pa.Table) -> pa.Table:
        items = group.to_pylist()
        made = arranged(items, cfg, items[0]["reserved"])
        out = []
        for i, e in enumerate(made):
            r, members = e.row, sorted(e.bodies)
            channels = [*(r["channels"] or []), *(["section-neighbour"] if len(members) > 1 else [])]
            out.append({"question_id": r["question_id"], "position": i + 1, "source_type": r["source_type"], "source_id": r["source_id"], "seq": r["seq"] if len(members) == 1 else -1, "members": members, "channels": channels, "excerpt": e.text(), "chars": e.size()})
        return pa.Table.from_pylist(out, CONTEXT)

    return given.groupBy("question_id").applyInArrow(run, "question_id long, position int, source_type string, source_id long, seq int, members array<int>, channels array<string>, excerpt string, chars int")


# --- supplemental queries and final selection


def supplemental(extra: DataFrame, passages: DataFrame, vectors: DataFrame | None = None, cfg: Config | None = None) -> DataFrame:
    """``question_id, rank`` and passage key: hits of further queries of a question, one from each in turns.

    ``extra``: question_id, place (0 to 15), question (and vec for the vector route).
    """
    cfg = cfg or Config()
    one = extra.filter(F.col("place") < MOST_EXTRA).withColumn("question_id", F.col("question_id") * MOST_EXTRA + F.col("place"))
    routes = search.keyword_channel(passages, one.select("question_id", "question"), cfg).select("question_id", *PASSAGE, "rank", F.lit("keyword").alias("route"))
    if vectors is not None:
        routes = routes.unionByName(search.vector_channel(vectors, one.select("question_id", "vec"), cfg).select("question_id", *PASSAGE, "rank", F.lit("vector").alias("route")))
    fused = search.fuse(routes, cfg)
    back = fused.select(F.expr(f"question_id div {MOST_EXTRA}").alias("question_id"), F.pmod("question_id", F.lit(MOST_EXTRA)).cast("int").alias("route"), *PASSAGE, "rank")
    return rank.interleave(back, ["question_id"], PASSAGE, cfg.candidates).drop("route")


def final_selection(hits: DataFrame, mode: str, cfg: Config | None = None) -> DataFrame:
    """Fused hits once each in order; those of one channel diversified by source."""
    cfg = cfg or Config()
    if mode == "fused":
        first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", *PASSAGE).orderBy("rank"))).filter("_n = 1").drop("_n")
        return rank.top(first.withColumnRenamed("rank", "_rank"), ["question_id"], [F.col("_rank")], cfg.candidates).drop("_rank")
    return rank.diversify(hits, ["question_id"], search.SOURCE, cfg.source_priority, cfg.candidates)


# --- protocols


class Reranker(Protocol):
    """The order of each question's hits; ``hits``: question_id, question, rank, passage key, body."""

    name: str

    def order(self, hits: DataFrame) -> DataFrame: ...


class Retriever(Protocol):
    """Ranked passages of questions (question_id, question)."""

    def __call__(self, questions: DataFrame) -> DataFrame: ...


class LexicalReranker:
    """The deterministic default: by the weight of the question's terms in the passage, then as they were."""

    name = "lexical"

    def order(self, hits: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def worth(question, body):
            import pandas as pd

            return pd.Series([context.relevance(q, b or "")[0] for q, b in zip(question, body, strict=True)], dtype="float64")

        scored = hits.withColumn("_w", worth("question", "body"))
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("_w"), "rank"))
        return scored.withColumn("position", place).select("question_id", *PASSAGE, "position")


#: What a backend may fail with, while it plans or while it runs, for the next one to be tried.
BACKEND_ERRORS = (PySparkException, Py4JError, OSError, ValueError, RuntimeError, TypeError, KeyError)


def rerank(hits: DataFrame, backends: list[Reranker]) -> tuple[DataFrame, str]:
    """Hits in the order of the first backend that answers, its name; in their own order (``none``) if none does.

    The first sixty hits of a question are shown; a question with two hits or fewer keeps its order.
    A backend's order is written as a table here, so one that fails while it runs is passed over too.
    """
    n = F.count("*").over(Window.partitionBy("question_id"))
    shown = hits.withColumn("_n", n).filter((F.col("_n") > 2) & (F.col("rank") <= RERANK_WINDOW)).drop("_n")
    for backend in backends:
        try:
            order = staged(backend.order(shown).select("question_id", *PASSAGE, "position"), "order")
            return rank.rerank_merge(hits, order, ["question_id"], PASSAGE), backend.name
        except BACKEND_ERRORS:
            continue
    return hits, "none"


# --- probes and traces


def probe(vectors: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """The nearest vectors of each query with their scores, without threshold or band."""
    from loreweave.functions import vector

    v = vectors.filter(vector.is_valid(F.col("vec")))
    met = near.scored(v.select(*PASSAGE, "vec"), queries, most, lengths=False, per_round=search.VECTORS_PER_ROUND)
    return rank.top(met, ["question_id"], [F.desc("score"), search.passage_key()], most)


def compared(one: DataFrame, two: DataFrame) -> DataFrame:
    """Passages of two rankings side by side: ``question_id``, key, ``rank_a``, ``rank_b`` (null where it is not ranked)."""
    key = ["question_id", *PASSAGE]
    return one.select(*key, F.col("rank").alias("rank_a")).join(two.select(*key, F.col("rank").alias("rank_b")), key, "full")


class Trace:
    """Rows of what each stage did: id, label, milliseconds, count, status, reason."""

    def __init__(self):
        self.rows: list[tuple] = []

    def stage(self, name: str, label: str, made: Callable[[], DataFrame], empty: DataFrame | None = None) -> DataFrame | None:
        """The stage's table, counted; an error becomes a row and ``empty`` the result."""
        began = time.monotonic()
        try:
            out = staged(made(), "stage")  # run once: counted here, read by the next stage
            n, status, why = out.count(), "ok", ""
        except Exception as error:  # noqa: BLE001 - a failed stage is a row
            out, n, status, why = empty, 0, "failed", f"{type(error).__name__}: {error}"[:300]
        self.rows.append((name, label, int((time.monotonic() - began) * 1000), n, status if n or status == "failed" else "empty", why))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "id string, label string, elapsed_ms long, count long, status string, reason string")


#: A corpus and cases that the whole path must solve.
DIAGNOSTIC_DOCS = [("note", 1, "Git rebase", "Rebase moves commits onto another base. Use it before merging."), ("note", 2, "Docker volumes", "Volumes keep data of containers after they stop."), ("ref", 3, "HTTP caching", "ETag and Cache-Control decide whether a response is fresh."), ("file", 4, "MQTT levels", "Quality of service has three levels: at most once, at least once, exactly once."), ("file", 5, "B-tree index", "A B-tree keeps keys sorted and balanced for range scans.")]
DIAGNOSTIC_CASES = [(1, "how does git rebase work", 1), (2, "docker volumes after stop", 2), (3, "etag cache-control fresh", 3), (4, "mqtt quality of service levels", 4), (5, "b-tree range scans", 5)]


def diagnose(spark: SparkSession, cfg: Config | None = None) -> DataFrame:
    """``case_id, expected, found, ok``: the first hit of each case over the built-in corpus; nothing is written."""
    docs = spark.createDataFrame(DIAGNOSTIC_DOCS, "source_type string, source_id long, title string, body string").withColumn("seq", F.lit(0))
    cases = spark.createDataFrame(DIAGNOSTIC_CASES, "question_id long, question string, expected long")
    first = search.keyword_channel(docs, cases.select("question_id", "question"), cfg).filter("rank = 1").select("question_id", F.col("source_id").alias("found"))
    return cases.join(first, "question_id", "left").select(F.col("question_id").alias("case_id"), "expected", "found", (F.col("found").eqNullSafe(F.col("expected"))).alias("ok"))
