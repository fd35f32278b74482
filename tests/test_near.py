import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.functions import vector
from loreweave.operators import near, nodes, search, vectors


def rows_of(rng, n, dims=(6, 6, 9)):
    """Vectors of two lengths with copies, scaled copies, and the odd ones: null, zero, empty, not finite, huge, tiny."""
    out = [rng.normal(size=dims[i % len(dims)]).tolist() for i in range(n)]
    for i in range(0, n - 7, 7):
        out[i + 3] = [x * 4 for x in out[i]] if i % 2 else list(out[i])
    return [*out, None, [], [0.0] * 6, [float("nan")] * 6, [1e200] * 6, [1e-170] * 6, [None, *[1.0] * 5]]


@pytest.fixture
def tables(spark):
    rng = np.random.default_rng(5)
    v = [(f"s{i % 2}", "file", i // 3, i % 3, ["a", "b", None][i % 3], x) for i, x in enumerate(rows_of(rng, 120))]
    q = [(i, ["a", "b", None][i % 3], x) for i, x in enumerate([*(r[5] for r in v[::20]), *rows_of(rng, 8)])]
    items = spark.createDataFrame(v, "space string, source_type string, source_id long, seq int, embedding_space string, vec array<double>").repartition(5)
    return items, spark.createDataFrame(q, "question_id long, embedding_space string, vec array<double>")


def shown(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("block", [None, 40])
def test_as_by_expression(spark, tables, monkeypatch, block):
    """Scores, ties and odd vectors as of every pair scored by the expression, in small and large blocks."""
    if block:
        monkeypatch.setattr(near, "BLOCK", block)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        items, asked = tables
        key = ["source_type", "source_id", "seq"]
        pairs = items.crossJoin(asked.select("question_id", F.col("embedding_space").alias("_s"), F.col("vec").alias("_q"))).withColumn("score", vector.cosine(F.col("vec"), F.col("_q")))
        first = lambda df, n, order: df.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), *order))).filter(F.col("rank") <= n)

        met = near.scored(items.select(*key, "vec"), asked, 7, lengths=False, per_round=9)
        assert shown(first(met, 7, key)) == shown(first(pairs.select("question_id", *key, "score"), 7, key))

        id_ = F.col("source_id") * 3 + F.col("seq")
        got = nodes.recognised_by_vector(items.select(id_.alias("id"), "vec"), asked, 0.3, 8, 9)
        assert shown(got) == shown(first(pairs.filter("score >= 0.3").select("question_id", id_.alias("id"), "score"), 8, ["id"]).drop("rank"))

        good = pairs.filter(vector.is_valid(F.col("vec")) & vector.is_valid(F.col("_q")) & (F.size("vec") == F.size("_q")))
        want = first(good.filter("space = 's1'").select("question_id", *key, "score"), 5, key)
        for store in (vectors.ExactStore(items.drop("embedding_space")), vectors.ClusteredStore(items.drop("embedding_space"), clusters=7, probes=2)):
            assert shown(store.search("s1", asked, 5)) == shown(want)

        cfg = Config(vector_min_score=0.2, vector_score_gap=0.6, candidates=6, fused_window=6, wiki_window=2, max_passages=4)
        in_space = good.filter("embedding_space = _s and score >= 0.2")
        in_band = in_space.withColumn("_b", F.max("score").over(Window.partitionBy("question_id"))).filter(F.col("score") >= F.col("_b") - 0.6)
        ranked = first(in_band.select("question_id", *key, "score"), 10**6, [search.passage_key()])
        want = search.rank.diversify(ranked, ["question_id"], search.SOURCE, cfg.vector_source_priority, cfg.candidates)
        assert shown(search.vector_channel(items, asked, cfg)) == shown(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_few_pairs_are_handed_on(spark):
    """What is left to rank follows the number of questions, not of pairs."""
    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(3_000, 8)))], "id long, vec array<double>").repartition(2)
    q = v.filter("id < 30").select(F.col("id").alias("question_id"), "vec")
    assert near.scored(v, q, 5).count() <= 2 * 5 * 30
    by_source = near.scored(v.withColumn("source", F.floor(F.col("id") / 3)), q, 5, source=["source"])
    assert by_source.count() <= 2 * 5 * 3 * 30
