import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from loreweave.operators import assembly, code, communities, context, evidence, graph, paths, vectors

EDGES = "head string, relation string, tail string, place long"


def walked(edges, source, target, most):
    """Edge places and nodes of the path that a breadth-first walk over edges in order meets."""
    queue, via = deque([source]), {source: None}
    while queue:
        at = queue.popleft()
        for head, relation, tail, place in sorted(edges, key=lambda e: e[3]):
            for a, b in ((head, tail), (tail, head)) if relation in graph.SYMMETRIC else ((head, tail),):
                if a == at and b not in via:
                    via[b] = at, place
                    queue.append(b)
    if target not in via:
        return None
    ids, places = [target], []
    while via[ids[0]]:
        at, place = via[ids[0]]
        ids, places = [at, *ids], [place, *places]
    return (len(places), ids, places) if len(places) <= most else None


class TestPaths:
    @pytest.mark.parametrize("most", [1, 3, 6])
    def test_against_a_walk(self, spark, most):
        rng = random.Random(9)
        names = [f"n{i}" for i in range(24)]
        edges = [(*(rng.sample(names, 2) + [rng.choice(["is_a", "related_to"])])[:1], "related_to" if i % 2 else "is_a", rng.choice(names), i) for i in range(45)]
        edges += [("a", "is_a", "b", 100), ("b", "is_a", "c", 101), ("x", "is_a", "x", 102)]
        pairs = [(a, b) for a in names[:8] for b in names] + [("a", "c"), ("c", "a"), ("a", "nowhere"), ("x", "x")]
        got = paths.shortest_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "source string, target string"), most)
        found = {(r.source, r.target): (r.length, r.ids, r.places) for r in got.collect()}
        want = {(a, b): w for a, b in pairs if (w := walked(edges, a, b, most)) is not None}
        want = {k: v for k, v in want.items()}
        assert {k: v for k, v in found.items() if k[0] != k[1]} == {k: v for k, v in want.items() if k[0] != k[1]}
        assert all(found[k][0] == 0 for k in found if k[0] == k[1])

    @pytest.mark.parametrize("most", [1, 4])
    def test_pairs_of_a_group(self, spark, most):
        """As of a walk for each pair, also where places are equal in two groups; the pairs are never listed."""
        rng = random.Random(4)
        names = [f"n{i}" for i in range(18)]
        edges = [(rng.choice(names), "related_to" if i % 3 else "is_a", rng.choice(names), i) for i in range(40)]
        ends = [(g, n, k) for g in (1, 2) for k, n in enumerate(rng.sample(names, 9))]
        got = paths.paths_among(spark.createDataFrame(edges, EDGES), spark.createDataFrame(ends, "group long, id string, place long"), most)
        pairs = [(a[1], b[1]) for a in ends for b in ends if a[0] == b[0] and a[2] < b[2]]
        want = [(x, y, *w) for x, y in pairs if (w := walked(edges, x, y, most)) is not None]
        assert sorted((r.source, r.target, r.length, r.ids, r.places) for r in got.collect()) == sorted(want)

    def test_ends_without_ways_cost_no_pairs(self, spark, monkeypatch):
        sizes, real = [], paths.staged
        monkeypatch.setattr(paths, "staged", lambda df, name: (sizes.append((out := real(df, name)).count()), out)[1])
        ends = spark.range(600).select(F.lit(1).alias("group"), F.concat(F.lit("n"), "id").alias("id"), F.col("id").alias("place"))
        got = paths.paths_among(spark.createDataFrame([("n1", "related_to", "p", 5), ("p", "related_to", "n7", 6)], EDGES), ends, 4).collect()
        assert [(r.source, r.target, r.ids) for r in got] == [("n1", "n7", ["n1", "p", "n7"])] and max(sizes) <= 600

    def block(self, spark, rel, concepts, question, budget=10_000):
        rel = spark.createDataFrame(rel, EDGES + ", origin string, evidence string, sources array<string>")
        ids = sorted({x for c in concepts for x in [c[1]]} | {r.head for r in rel.collect()} | {r.tail for r in rel.collect()})
        names = spark.createDataFrame([(i, i.upper()) for i in ids], "id string, name string")
        c = spark.createDataFrame(concepts, "question_id long, id string, place int")
        q = spark.createDataFrame([(1, question)], "question_id long, question string")
        return paths.relation_block(rel, c, names, q, budget).collect()

    def test_block(self, spark):
        rel = [
            ("a", "related_to", "b", 1, "derived", "", None), ("b", "related_to", "a", 2, "manual", " seen   it ", ["note-1", "file-2"]), ("a", "is_a", "c", 3, "llm", " ", None),
            ("c", "is_a", "a", 4, "manual", "q", None), ("a", "used_for", "d", 5, "derived", "", None), ("a", "prerequisite", "e", 6, "manual", "", []), ("e", "part_of", "f", 7, "manual", "", None),
        ]
        [row] = self.block(spark, rel, [(1, "a", 1), (1, "b", 2), (1, "f", 3)], "A 和 B")
        lines = row.block.split("\n")
        assert lines[0].startswith(paths.OPENING + "A、B、F。")
        # the pair a, b keeps the line with a quote; what has no quote and came from a model is out, as is an edge into a concept
        assert lines[1:5] == ["1. B -相关→ A", "   证据：seen it　来源：note-1、file-2", "2. A -前置知识→ E", "3. A -用于→ D（推导）"]
        # the third edge has no quote, but a path may use it
        assert lines[5:7] == ["路径：A → E → F（2 跳）", "路径：B → A → E → F（3 跳）"]
        assert lines[7] + "\n" == paths.CLOSING and (row.triples, row.paths) == (3, 2)

    def test_budget_and_silence(self, spark):
        rel = [("a", "is_a", x, i, "manual", "", None) for i, x in enumerate("bcdefghij")]
        [row] = self.block(spark, rel, [(1, "a", 1)], "a 属于什么")
        assert (row.triples, row.paths) == (6, 0)
        head = len(row.block.split("\n")[0]) + 1
        [short] = self.block(spark, rel, [(1, "a", 1)], "a 属于什么", head + 30)
        assert short.triples == 2 and short.block.endswith(paths.CLOSING)
        assert self.block(spark, rel, [(1, "a", 1)], "what is a") == []  # one concept, no relation word
        assert self.block(spark, rel, [(1, "zz", 1)], "zz 属于什么") == []
        assert self.block(spark, rel, [(1, "a", 1)], "a 属于什么", 0) == []


def quality(edges, of, gamma=1.0):
    m = sum(w for *_, w in edges)
    inside, total = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        total[of[a]] += w
        total[of[b]] += w
        if of[a] == of[b]:
            inside[of[a]] += w
    return sum(inside[c] / m - gamma * (t / (2 * m)) ** 2 for c, t in total.items())


class TestCommunities:
    def found(self, spark, edges, **options):
        rows = communities.communities(spark.createDataFrame(edges, "a string, b string, w double"), **options).collect()
        of = {r.id: r.community for r in rows}
        assert len(of) == len(rows)
        members = defaultdict(set)
        for v, c in of.items():
            members[c].add(v)
        assert all(c == min(m) for c, m in members.items())
        near = defaultdict(set)
        for a, b, _ in edges:
            near[a].add(b)
            near[b].add(a)
        for m in members.values():  # connected
            seen, todo = set(), [min(m)]
            while todo:
                v = todo.pop()
                if v not in seen:
                    seen.add(v)
                    todo += near[v] & m
            assert seen == m
        return of

    def test_rounds_on_planted_groups(self, spark):
        rng = random.Random(4)
        edges = [(f"v{a}", f"v{b}", 1.0) for a in range(24) for b in range(a) if rng.random() < (0.7 if a % 3 == b % 3 else 0.04)]
        edges += [("v1", "v1", 2.0), (edges[0][1], edges[0][0], 1.0)]
        of = self.found(spark, edges, few_edges=0)
        plain = self.found(spark, edges)
        assert quality(edges, of) >= quality(edges, plain) - 0.01

    def test_rounds_near_the_best_partition(self, spark):
        def partitions(n):
            def grow(prefix, most):
                if len(prefix) == n:
                    yield prefix
                    return
                for c in range(most + 1):
                    yield from grow([*prefix, c], max(most, c + 1))

            yield from grow([], 0)

        rng = random.Random(8)
        edges = [(f"{a}", f"{b}", rng.choice([1.0, 2.0])) for a in range(7) for b in range(a) if rng.random() < (0.9 if (a < 4) == (b < 4) else 0.15)]
        ids = sorted({x for e in edges for x in e[:2]})
        best = max(quality(edges, dict(zip(ids, p, strict=True))) for p in partitions(len(ids)))
        of = self.found(spark, edges, few_edges=0)
        assert quality(edges, of) >= best - 0.03
        assert self.found(spark, [(b, a, w) for a, b, w in reversed(edges)], few_edges=0) == of

    def test_edge_cases(self, spark):
        assert communities.communities(spark.createDataFrame([], "a string, b string, w double")).count() == 0
        odd = [("a", "b", 1.0), ("c", None, 1.0), ("d", "e", 0.0), ("f", "f", 1.0)]
        for few in (0, 100):
            df = spark.createDataFrame(odd, "a string, b string, w double")
            assert {r.id: r.community for r in communities.communities(df, few_edges=few).collect()} == {"a": "a", "b": "a", "f": "f"}


class TestMended:
    def test_excerpt_values(self):
        filler = "一般说明。" * 300
        body = filler + "\nAlphaClient 配合 registerHandler 完成订阅；"
        assert "registerHandler" in context.excerpt("AlphaClient 如何调用 registerHandler？", body, 60)
        assert "9lives" not in context.weighted_terms("9lives which does please abc") and list(context.weighted_terms("9lives which does please abc")) == ["lives", "abc"]
        assert len(context.weighted_terms(" ".join(f"word{i:03}" for i in range(200)))) == 128
        assert "根据" not in context.weighted_terms("根据资料") and "据资" in context.weighted_terms("根据资料")

    def test_fallback_of_a_backend_that_fails_while_it_runs(self, spark):
        from pyspark.sql import functions as F

        class Broken:
            name = "broken"

            def order(self, hits):
                @F.udf("int")
                def fail(x):
                    raise OSError("gone")

                return hits.withColumn("position", fail("rank"))

        rows = [(1, "alpha", i, "note", i, 0, f"body {'alpha' if i == 3 else ''}") for i in range(1, 5)]
        hits = spark.createDataFrame(rows, "question_id long, question string, rank int, source_type string, source_id long, seq int, body string")
        got, name = assembly.rerank(hits, [Broken(), assembly.LexicalReranker()])
        assert name == "lexical" and got.orderBy("rank").first().source_id == 3
        assert assembly.rerank(hits, [Broken()])[1] == "none"

    def test_every_vector_length_is_searched(self, spark):
        rows = [("s", "note", n, 0, [1.0] * n) for n in range(1, 21)]
        items = spark.createDataFrame(rows, "space string, source_type string, source_id long, seq int, vec array<double>")
        asked = spark.createDataFrame([(n, [0.5] * n) for n in range(1, 21)], "question_id long, vec array<double>")
        got = vectors.ClusteredStore(items).search("s", asked, 3).collect()
        assert sorted((r.question_id, r.source_id) for r in got) == [(n, n) for n in range(1, 21)]

    def test_methods_without_a_modifier(self):
        java = "class A {\n  void pkg() {\n    if (x) { call(); }\n    else if (y) { }\n  }\n  Map<String, int[]> of(T t) throws X { }\n  A() { }\n}"
        assert [(k, n) for k, n, _ in code.symbols_of(java, "java")] == [("class", "A"), ("method", "pkg"), ("method", "of")]

    def test_names_of_merged_nodes(self, spark):
        nodes = spark.createDataFrame([("a", "A", ["a1"], 2), ("b", "B", ["a1", "b1", "A"], 3), ("c", "C", None, 1), ("d", "D", [], 4)], "id string, name string, aliases array<string>, source_count long")
        same = spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "d"), ("d", "gone")], "old string, new string")
        got = {r.id: (r.name, r.aliases, r.source_count) for r in evidence.merge_names(nodes, same).collect()}
        assert got == {"a": ("A", ["a1", "B", "b1", "C"], 6), "d": ("D", [], 4)}
