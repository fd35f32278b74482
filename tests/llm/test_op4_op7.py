import random
import zlib

import numpy as np
import pytest

from loreweave.llm import quality, toxicity
from loreweave.llm.tokens import Memory


def corpus(n=400, seed=1):
    """Toxic only where an insult stem meets a group word; either alone is clean."""
    rng = random.Random(seed)
    words = [f"wort{i}" for i in range(80)]
    rows, toxic = [], {}
    for i in range(n):
        text = [rng.choice(words) for _ in range(30)]
        kind = i % 4
        if kind in (1, 3):
            text.insert(5, "grunzel" + rng.choice(["a", "en", "ista"]))
        if kind in (2, 3):
            text.insert(9, "foreigners")
        rows.append((i, " ".join(text)))
        toxic[i] = int(kind == 3)
    return rows, toxic


@pytest.fixture(scope="module")
def learned(make_docs, spark):
    rows, toxic = corpus()
    labels = spark.createDataFrame([(i, 1, t) for i, t in toxic.items()] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return rows, toxic, labels, toxicity.learn(make_docs(rows, ["score"]), labels)


def test_pairs_are_learned(learned, make_docs):
    rows, toxic, _, machine = learned
    got = {r.doc_id: r.score for r in toxicity.score(make_docs(rows), machine).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40
    assert np.mean([(got[i] >= 0.5) == toxic[i] for i in held]) > 0.95


def test_held_out_labels_are_not_used(learned, make_docs, spark):
    rows, toxic, _, machine = learned
    flipped = [(i, 1, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in toxic.items()]
    again = toxicity.learn(make_docs(rows), spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert (again.kept == machine.kept).all()
    assert np.allclose(again.weights, machine.weights)


def test_scores_are_the_machines_formula(learned):
    *_, machine = learned
    rng = np.random.default_rng(1)
    for n in (0, 1, 7):
        r = rng.choice(len(machine.kept), n, replace=False)
        raw = machine.bias + machine.weights[r].sum() + sum(machine.vectors[a] @ machine.vectors[b] for i, a in enumerate(r) for b in r[:i])
        assert machine.scores([r])[0] == pytest.approx(1 / (1 + np.exp(-raw)))


def test_pairs_of_neutral_terms(make_docs, spark):
    """Toxic only where exactly one of two words stands: each word alone is as common in both classes."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        a, b = i & 1, i >> 1 & 1
        rows.append((i, " ".join([*rng.choices([f"w{j}" for j in range(60)], k=12), *["alpha"] * a, *["omega"] * b])))
        labels.append((i, 1, a ^ b))
    machine = toxicity.learn(make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.score for r in toxicity.score(make_docs(rows), machine).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i & 1 ^ i >> 1 & 1) for i in held]) > 0.95


def test_repeated_identifiers_count_once(learned, make_docs):
    rows, _, labels, machine = learned
    again = toxicity.learn(make_docs(rows + rows[:50] * 5), labels)
    assert (again.kept == machine.kept).all()
    assert np.allclose(again.weights, machine.weights)


def test_screen_is_brute_force(learned, make_docs):
    """Terms kept alone are those whose z-score, counted plainly, is large enough."""
    rows, toxic, _, machine = learned
    use = [(set(toxicity.terms(t, Memory(toxicity.terms_of))), toxic[i]) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    n1 = sum(y for _, y in use)
    z = {}
    for term in set().union(*(x for x, _ in use)):
        c1, df = sum(y for x, y in use if term in x), sum(term in x for x, _ in use)
        if df >= 3:
            z[term] = abs(toxicity.log_odds_z(c1, df - c1, n1, len(use) - n1))
    alone = {t for t, x in z.items() if x >= toxicity.SINGLE_Z}
    assert alone <= set(machine.kept.tolist()) <= set(z)


def test_toxic_odd_rows(learned, make_docs, odd_rows, spark):
    rows, _, labels, machine = learned
    got = toxicity.score(make_docs(odd_rows, ["toxic"]), machine).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)
    assert all(0 <= r.score < 0.5 for r in got)
    assert toxicity.score(make_docs([]), machine).count() == 0
    docs = make_docs([*odd_rows, *rows], ["toxic_score", "doc"])
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 3
    assert len(ids) < len(rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn(docs, none).scores([np.empty(0, int)])[0] == pytest.approx(0)
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.clean(docs, one).count() == docs.count()


def test_op4_query(spark, sf_dir):
    got = toxicity.op4(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert np.mean([r.predicted == labels[r.doc_id] for r in got if r.doc_id in labels]) > 0.9


def junk(rng, i):
    words = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{j % 7}x".replace("0", "o") for j in range(60)]
    if i % 4 == 0:
        return " ".join(w + rng.choice(["%%%", "$$$", "***"]) for w in words)
    if i % 4 == 1:
        return " ".join(w.upper() + "!!" for w in words)
    if i % 4 == 2:
        return " | ".join(words)
    return " ".join([words[0]] * 40 + [words[1]] * 40)


def prose(rng):
    return " ".join((rng.choice(["The", "a", "some", "other", "house", "river"]) + str(rng.choice(["", "s", "ing"])) + ("." if j % 9 == 8 else "")) for j in range(90))


def test_quality_without_labels(make_docs, odd_rows):
    rng = random.Random(2)
    rows = [(i, junk(rng, i // 5) if i % 5 == 0 else prose(rng)) for i in range(1000, 1400)]
    docs = make_docs([*rows, *odd_rows[1:3]], ["score", "keep", "quality_score"])
    scorer = quality.learn(docs)
    assert scorer.linear
    got = quality.score(docs, scorer).collect()
    assert np.mean([r.keep == (r.doc_id % 5 != 0) for r in got if r.doc_id >= 1000]) > 0.98
    assert all(r.keep for r in got if r.doc_id in (3, 4))
    kept = quality.good_only(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.keep}


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    n, labellers = 20_000, len(quality.LABELLERS)
    truth = rng.random(n) < 0.8
    counts = {}
    for good in truth:
        votes = [quality.GOOD if rng.random() < (0.97 if good else 0.3) else quality.BAD for _ in range(labellers)]
        code = 0
        for v in votes:
            code = 4 * code + v
        counts[code] = counts.get(code, 0) + 1
    posterior, accuracies, share = quality.estimate(counts)
    assert share == pytest.approx(truth.mean(), abs=0.01)
    assert np.allclose(accuracies[quality.GOOD, :, quality.GOOD], 0.97, atol=0.02)
    assert np.allclose(accuracies[quality.BAD, :, quality.GOOD], 0.3, atol=0.04)
    assert quality.votes_of(min(posterior)) == [quality.BAD] * labellers
    assert quality.estimate({quality.pattern(quality.stats("", [])): 3})[2] > 0.5


def test_em_and_scorer_by_plain_loops(make_docs):
    """Votes, posteriors and scores against the model's formulas, one text at a time."""
    rng = random.Random(5)
    rows = [(i, junk(rng, i // 5) if i % 5 == 0 else prose(rng)) for i in range(200)]
    codes = [quality.pattern(quality.stats(t, t.split())) for _, t in rows]
    posterior, accuracies, share = quality.estimate({c: codes.count(c) for c in codes})
    for c in set(codes):
        odds = share / (1 - share)
        for labeller, vote in enumerate(quality.votes_of(c)):
            if vote != quality.ABSTAIN:
                odds *= accuracies[quality.GOOD, labeller, vote] / accuracies[quality.BAD, labeller, vote]
        assert posterior[c] == pytest.approx(odds / (1 + odds), abs=1e-4)
    docs = make_docs([*rows, *rows[:40], *rows[:40]])
    scorer = quality.learn(docs)
    weights = dict(zip(scorer.places.tolist(), scorer.values.tolist(), strict=True))
    for r in quality.score(docs, scorer).collect():
        words = rows[r.doc_id][1].split()
        counts = {}
        for w in words:
            counts[quality.shape(w)] = counts.get(quality.shape(w), 0) + 1
        n = len(words) + quality.LEAST_WORDS
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
        raw = weights.get(quality.BIAS, 0) + weights.get(quality.REPEAT, 0) * (repeats / n) ** 0.5 + sum(weights.get(p, 0) * (c / n) ** 0.5 for p, c in counts.items())
        assert r.score == pytest.approx(1 / (1 + np.exp(-raw)))


def test_quality_odd_rows(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = quality.score(docs, quality.learn(docs)).collect()
    assert len(got) == len(odd_rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.good_only(make_docs([])).count() == 0
    assert quality.score(make_docs([]), quality.learn(make_docs([]))).count() == 0


def test_shapes():
    memory = Memory(quality.shape)
    assert memory["Hello"] == memory["World"] != memory["HELLO"]
    assert memory["ab%%%"] == memory["xyz%%%%%"] != memory["ab"]


def test_op7_query(spark, sf_dir):
    got = {r.doc_id: r for r in quality.op7(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.85
    assert np.mean([got[r.doc_id].predicted for r in labels if r.quality == 1]) > 0.9
