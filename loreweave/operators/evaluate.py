"""Retrieval and answer evaluation over many questions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreweave.functions import text, vector

# References that mean "nothing expected".
NONE_REFS = ["", "none", "无", "-", "n/a"]


def is_gap(refs: F.Column) -> F.Column:
    """A case that expects no source."""
    return (F.size(refs) <= 0) | F.forall(refs, lambda r: F.lower(F.trim(r)).isin(NONE_REFS))


def first_ranks(cases: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """``question_id, gap, first``: rank of the first expected source among the first k distinct sources.

    ``cases``: question_id, refs; ``ranked``: question_id, ref, rank (passages; several may be of one source).
    """
    from pyspark.sql import Window

    sources = ranked.groupBy("question_id", "ref").agg(F.min("rank").alias("_at"))
    placed = sources.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy("_at"))).filter(F.col("place") <= k)
    wanted = cases.select("question_id", F.explode("refs").alias("ref")).distinct()
    first = placed.join(wanted, ["question_id", "ref"]).groupBy("question_id").agg(F.min("place").alias("first"))
    return cases.select("question_id", is_gap(F.col("refs")).alias("gap")).join(first, "question_id", "left")


def recall_mrr(cases: DataFrame, ranked: DataFrame, k: int = 5) -> DataFrame:
    """One row: cases, gap_cases, hits, recall, mrr; gap cases are in no denominator."""
    f = first_ranks(cases, ranked, k).withColumn("scored", ~F.col("gap"))
    n = F.count_if("scored")
    hits = F.count_if(F.col("scored") & F.col("first").isNotNull())
    rr = F.sum(F.when(F.col("scored"), F.coalesce(1.0 / F.col("first"), F.lit(0.0))).otherwise(0.0))
    safe = lambda x: vector.half_up(F.coalesce(F.try_divide(x, n), F.lit(0.0)))
    return f.agg(F.count("*").alias("cases"), F.count_if("gap").alias("gap_cases"), hits.alias("hits"), safe(hits.cast("double")).alias("recall"), safe(rr).alias("mrr"))


def paired(a: DataFrame, b: DataFrame, cohort: list[str] | None = None) -> DataFrame:
    """Outcomes of two arms (question_id, ok) per cohort: both, wins of b, losses, neither."""
    keys = cohort or []
    j = a.withColumnRenamed("ok", "x").join(b.select("question_id", F.col("ok").alias("y")), "question_id")
    return j.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.expr("x and y")).alias("both"), F.count_if(F.expr("not x and y")).alias("wins"), F.count_if(F.expr("x and not y")).alias("losses"), F.count_if(F.expr("not x and not y")).alias("neither"))


def ndcg(ranked: DataFrame, k: int = 8) -> DataFrame:
    """``question_id, ndcg``: gains 2^grade - 1 over log2(rank + 1), against the best order of the grades."""
    from pyspark.sql import Window

    ideal = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("grade")))
    gain = lambda place: F.when(place <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(place + 1)).otherwise(0.0)
    g = ranked.withColumn("_best", ideal).groupBy("question_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"), F.sum(gain(F.col("_best"))).alias("best"))
    return g.select("question_id", F.round(F.coalesce(F.try_divide("dcg", "best"), F.lit(0.0)), 9).alias("ndcg"))


def selection(ranked: DataFrame, k: int = 8) -> DataFrame:
    """Useful rate, grade-2 recall and redundancy (duplicate groups among useful items) of the first k."""
    top = F.col("rank") <= k
    useful = top & (F.col("grade") > 0)
    n = F.count_if(useful)
    return ranked.groupBy("question_id").agg(
        F.round(F.try_divide(n, F.count_if(top)), 9).alias("useful_rate"), F.round(F.coalesce(F.try_divide(F.count_if(top & (F.col("grade") == 2)), F.count_if(F.col("grade") == 2)), F.lit(0.0)), 9).alias("grade2_recall"),
        F.round(F.coalesce(1 - F.try_divide(F.count_distinct(F.when(useful, F.col("dup_group"))), n), F.lit(0.0)), 9).alias("redundancy"),
    )


def answers(cases: DataFrame) -> DataFrame:
    """Accuracy (share of expected words in the answer, -1 if none are stated), refusal, coverage of all refs.

    ``cases``: question_id, answer, words, refs, found (arrays).
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    hit = F.size(F.filter("words", lambda w: F.contains(low, F.lower(w))))
    accuracy = F.when(F.size("words") <= 0, -1.0).otherwise(F.round(hit / F.size("words"), 9))
    gap = is_gap(F.col("refs"))
    covers = ~gap & (F.size(F.array_except("refs", "found")) == 0)
    refusal = text.is_refusal(F.col("answer"))
    return cases.select("question_id", accuracy.alias("accuracy"), refusal.alias("refusal"), covers.alias("covers_all"), F.when(gap, refusal).alias("no_answer_ok"), (~gap & refusal).alias("false_refusal"))


def corpus_hash(corpus: DataFrame) -> DataFrame:
    """Sixteen hex digits over all sources, whatever their order.

    The digest of a sorted list would need every line in one place; a sum of
    per-source digests modulo 2^127 is as order-free and combines map-side.
    """
    line = F.sha2(F.concat_ws(":", "source_type", F.col("source_id").cast("string"), F.sha2(F.coalesce("content", F.lit("")), 256)), 256)
    part = lambda i: F.sum(F.conv(F.substring(line, i, 8), 16, 10).cast("decimal(38,0)"))
    whole = F.concat_ws(":", *[part(i).cast("string") for i in (1, 9, 17, 25)], F.count("*").cast("string"))
    return corpus.agg(F.substring(F.sha2(whole, 256), 1, 16).alias("corpus_hash"))


def evidence(chunks: DataFrame, gold: DataFrame, budget: int = 2400) -> DataFrame:
    """Evidence coverage by ranked chunks with source offsets.

    ``chunks``: question_id, rank, doc_id, start, end; ``gold``: question_id,
    doc_id, gold_id, start, end. A chunk is useful for a gold span if it holds
    at least min(24, length) characters and a fifth of it.
    """
    from loreweave.operators import rank

    taken = rank.budget_stop(chunks.withColumn("_n", F.col("end") - F.col("start")), ["question_id"], "_n", budget).select("question_id", "rank", "doc_id", F.col("start").alias("cs"), F.col("end").alias("ce"))
    j = gold.join(taken, ["question_id", "doc_id"], "left")
    n, over = F.col("end") - F.col("start"), F.greatest(F.least("end", "ce") - F.greatest("start", "cs"), F.lit(0))
    useful = (over >= F.least(F.lit(24), n)) & (over >= 0.2 * n)
    per = j.groupBy("question_id", "gold_id").agg(F.min(F.when(useful, F.col("rank"))).alias("first"), F.max(F.coalesce(over / n, F.lit(0.0))).alias("share"))
    return per.groupBy("question_id").agg(F.min("first").alias("first"), F.round(F.avg("share"), 9).alias("coverage"), F.bool_and(F.col("share") >= 1).alias("complete"))


def retrieval_arms(cases: DataFrame, arms: dict, k: int = 5) -> DataFrame:
    """``arm, question_id, gap, first`` of every arm: a name and a retriever (questions -> question_id, ref, rank).

    ``cases``: question_id, question, refs.
    """
    from functools import reduce

    asked = cases.select("question_id", "question")
    parts = [first_ranks(cases, retrieve(asked), k).withColumn("arm", F.lit(name)) for name, retrieve in arms.items()]
    return reduce(DataFrame.unionByName, parts).select("arm", "question_id", "gap", "first")


def paired_arms(ranks: DataFrame, one: str, two: str, subset: list[str] | None = None) -> DataFrame:
    """Q03: two arms over the same cases, in each subset: hit rates, reciprocal ranks, gains and losses of the second.

    ``ranks``: arm, question_id, gap, first (and the subset's columns); gap cases do not count.
    """
    by = subset or []
    side = lambda arm, name: ranks.filter((F.col("arm") == arm) & ~F.col("gap")).select("question_id", *by, F.col("first").alias(name))
    j = side(one, "a").join(side(two, "b").drop(*by), "question_id")
    a, b = (F.coalesce(1.0 / F.col(c), F.lit(0.0)) for c in ("a", "b"))
    mean = lambda x: F.round(F.avg(x), 9)
    hit = lambda c: F.col(c).isNotNull().cast("double")
    return j.groupBy(*by).agg(
        F.count("*").alias("cases"), mean(hit("a")).alias("hit_a"), mean(hit("b")).alias("hit_b"), mean((F.coalesce("a", F.lit(0)) == 1).cast("double")).alias("first_a"), mean((F.coalesce("b", F.lit(0)) == 1).cast("double")).alias("first_b"), mean(a).alias("mrr_a"), mean(b).alias("mrr_b"),
        F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("hit_gains"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("hit_losses"), F.count_if(b > a).alias("rank_gains"), F.count_if(b < a).alias("rank_losses"),
    )


def broken_blocks(protected: DataFrame, chunks: DataFrame) -> DataFrame:
    """Q05: ``type, blocks, broken``: protected blocks (doc_id, type, text) that stand whole in no chunk (doc_id, chunk_text) of their document, white space apart."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    b = protected.select("doc_id", "type", squeeze(F.col("text")).alias("_t")).distinct()
    whole = b.join(chunks.select("doc_id", squeeze(F.col("chunk_text")).alias("_c")), "doc_id").filter(F.contains("_c", F.col("_t"))).select("doc_id", "type", "_t").distinct().withColumn("_ok", F.lit(True))
    return b.join(whole, ["doc_id", "type", "_t"], "left").groupBy("type").agg(F.count("*").alias("blocks"), F.count_if(F.col("_ok").isNull()).alias("broken"))


def known_and_unknown(answers: DataFrame) -> DataFrame:
    """Q11: one row over answers (group, correct, abstained): accuracy, and errors and refusals of known and unknown cases; null accuracy of none."""
    known, wrong = F.col("group") != "unknown", ~F.col("correct") & ~F.col("abstained")
    return answers.agg(
        F.count("*").alias("total"), F.count_if("correct").alias("correct"), F.round(F.try_divide(F.count_if("correct"), F.count("*")), 9).alias("accuracy"),
        F.count_if(known & F.col("abstained")).alias("known_false_refusals"), F.count_if(known & wrong).alias("known_wrong"), F.count_if(~known & wrong).alias("unknown_wrong"),
    )


def answer_report(answers: DataFrame, price_in: float = 0.0, price_out: float = 0.0) -> DataFrame:
    """One row over scored answers: mean accuracy and support of those labelled, coverage, refusals, latency, tokens and cost.

    ``answers``: accuracy (-1: none stated), supported, gap, covers_all, refusal,
    latency_ms, tokens_in, tokens_out; prices for a million tokens.
    """
    mean = lambda x, when: F.round(F.avg(F.when(when, x)), 9)
    gap, cost = F.col("gap"), (F.sum("tokens_in") * price_in + F.sum("tokens_out") * price_out) / 1e6
    return answers.agg(
        F.count("*").alias("cases"), mean(F.col("accuracy"), F.col("accuracy") >= 0).alias("accuracy"), mean(F.col("supported").cast("double"), ~gap & F.col("supported").isNotNull()).alias("support"), mean(F.col("covers_all").cast("double"), ~gap).alias("coverage"),
        mean(F.col("refusal").cast("double"), gap).alias("no_answer_accuracy"), F.count_if(~gap & F.col("refusal")).alias("false_refusals"), F.round(F.avg("latency_ms"), 3).alias("latency_ms"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.round(cost, 9).alias("cost"),
    )


def facet_coverage(ranked: DataFrame, required: DataFrame, k: int = 8) -> DataFrame:
    """``question_id, facet_coverage``: the share of a question's required facets that its first k items have; one where none is required.

    ``ranked``: question_id, rank, facets (array); ``required``: question_id, facet.
    """
    have = ranked.filter(F.col("rank") <= k).select("question_id", F.explode("facets").alias("facet")).distinct().withColumn("_has", F.lit(1))
    per = required.distinct().join(have, ["question_id", "facet"], "left").groupBy("question_id").agg(F.avg(F.coalesce("_has", F.lit(0))).alias("_c"))
    return ranked.select("question_id").distinct().join(per, "question_id", "left").select("question_id", F.round(F.coalesce("_c", F.lit(1.0)), 9).alias("facet_coverage"))
