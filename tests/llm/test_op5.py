import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loreweave.llm import simhash
from loreweave.llm.graph import components


def plain(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, radius=3):
    fps = [plain(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def ours(docs, **k):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_components(docs, **k).collect()), key=str)


@given(st.sets(st.integers(0, 63), max_size=3))
@settings(max_examples=300, deadline=None)
def test_masks_cover(places):
    assert any(not any(m >> i & 1 for i in places) for m in simhash.covering_masks())
    for mask in simhash.covering_masks()[:3]:
        inside = [i for i in places if not mask >> i & 1]
        assert any(not any(m >> i & 1 for i in inside) for m in simhash.split_masks(mask))


@given(st.text(alphabet="aB é\t\n", max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_forest_is_exact():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(2)) for b in base for _ in range(30)}
    got = list(simhash.forest(np.asarray(list(fps), np.uint64)))
    assert len(got) == len({int(x) for x, _ in got})
    comp = {f: f for f in fps}
    for x, root in got:
        comp[int(x)] = int(root)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                assert comp[a] == comp[b]


@pytest.mark.parametrize("hot", [8192, 4])
def test_odd_and_near_rows(make_docs, odd_rows, hot):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    rows = list(odd_rows)
    for g in range(12):
        text = [rng.choice(words) for _ in range(120)]
        for k in range(9):
            t = list(text)
            for _ in range(k % 4):
                t[rng.randrange(len(t))] = "changed"
            rows.append((100 * g + 17 * k % 50 + 20, " ".join(t)))
    assert ours(make_docs(rows, ["fp", "component_id", "t", "key"]), hot=hot) == brute(rows)


def test_hot_bucket_of_near_fingerprints(spark):
    rng = random.Random(5)
    fps = list({(1 << 60) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) for _ in range(400)})
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = simhash.links(simhash.buckets(df, hot=30)).collect()
    comp = {simhash.signed(f): simhash.signed(f) for f in fps}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for r in found:
        assert ((r.u ^ r.v) & (1 << 64) - 1).bit_count() <= 64
        comp[find(r.u)] = find(r.v)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                assert find(simhash.signed(a)) == find(simhash.signed(b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 104), 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty(make_docs):
    assert simhash.near_components(make_docs([])).count() == 0


def test_op5_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.op5(spark, sf_dir).collect()), key=str)
    assert got == brute(rows)
