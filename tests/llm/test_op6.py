import random

import duckdb
import pytest
from pyspark.sql import types as T

from loreweave.llm import topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType()), T.StructField("v", T.StringType())])


def brute(rows, k, asked):
    import math

    use = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    queries = {}
    for i, e in use:
        if asked(i):
            queries[i] = min(queries.get(i, e), e)
    out = []
    for q, e in queries.items():
        best = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), j) for j, f in use if j != q and len(f) == len(e))[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def ours(spark, rows, k, **sizes):
    df = spark.createDataFrame([(i, e, "x", "y") for i, e in rows], SCHEMA).repartition(3)
    v = topk.quantized(df)
    return sorted(map(tuple, topk.exact_top_k(v, v.filter("vec_id % 2 = 0"), k, **sizes).collect()))


@pytest.mark.parametrize("sizes", [{}, {"size": 16, "per_round": 7}])
def test_against_brute_force(spark, sizes):
    rng = random.Random(4)
    f = lambda: rng.choice([-0.5, -0.25, 0.0, 0.1, 0.3, rng.random()])
    rows = [(i, [float(f()) for _ in range(40)]) for i in range(150)]
    rows += [(200 + i, [0.125] * 40) for i in range(70)]  # one very common vector
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, [0.1] * 40), (300, None), (301, [0.1, None] * 20), (302, [float("nan")] * 40), (303, [float("inf")] * 40), (304, [0.5] * 8), (306, [0.25] * 8), (308, []), (310, []), (312, [3e8] * 40), (314, [-3e8] * 40)]
    import numpy as np

    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    assert ours(spark, rows, 5, **sizes) == brute(rows, 5, lambda i: i % 2 == 0)


def test_empty(spark):
    assert ours(spark, [], 5) == []


def test_oracle(spark, sf_dir):
    duckdb.sql(f"create or replace view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    want = sorted(duckdb.sql(topk.ORACLE).fetchall())
    assert sorted(map(tuple, topk.op6(spark, sf_dir).collect())) == want
    assert want
