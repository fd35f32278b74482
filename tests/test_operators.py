import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.config import Config
from loreweave.operators import chunk, code, context, evaluate, graph, html, lineage, maintain, rank, search, workflow

CFG = Config(chunk_target=100, chunk_max=160, chunk_overlap=30)


class TestChunk:
    def test_headings_and_protected_blocks(self):
        text = "# A\nintro\n\n## B\n```py\n# not a heading\n\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n$$\nx\n$$\n# C\nend"
        units = chunk.blocks(text)
        assert [(u.heading, u.protected) for u in units] == [("A", False), ("A > B", True), ("A > B", True), ("A > B", True), ("C", False)]
        assert units[1].text == "```py\n# not a heading\n\ncode\n```"
        assert [h for h, _ in chunk.structural(text)] == ["A", "A > B", "C"]

    def test_unfinished_fence_and_nested_table(self):
        assert [u.protected for u in chunk.blocks("```\na\n\n# b")] == [True]
        t = "<table><tr><td><table>\nx\n</table></td></tr>\n</table>\nafter"
        assert [u.protected for u in chunk.blocks(t)] == [True, False]
        assert [u.protected for u in chunk.blocks("\\begin{align}\na\n\\end{align}\nb")] == [True, False]
        assert [u.protected for u in chunk.blocks("price \\$$5 here")] == [False]

    def test_limits(self):
        rng = random.Random(1)
        for _ in range(60):
            text = "\n\n".join(" ".join("w" * rng.randrange(1, 12) + rng.choice(["", "", ".", "!"]) for _ in range(rng.randrange(1, 80))) for _ in range(5))
            found = chunk.structural(text, CFG)
            assert all(len(t) <= CFG.chunk_max for _, t in found)
            joined = "".join("".join(t.split()) for _, t in found)
            assert all(w in joined for w in text.split())

    def test_oversized_protected_block_is_alone(self):
        big = "```\n" + "x" * 300 + "\n```"
        assert ("", big) in chunk.structural(f"before\n\n{big}\n\nafter", CFG)

    def test_numbers_do_not_end_sentences(self):
        assert not any(t.endswith("3.") for _, t in chunk.structural("Value 3.14 is pi. " * 30, CFG))
        units = chunk.structure_units("  12. Explain this. " * 20, CFG)
        assert all(u.text for u in units)

    def test_semantic(self):
        units = [chunk.Unit("h", c * 60) for c in "aaabbb"]
        vectors = [[1, 0]] * 3 + [[0, 1]] * 3
        found = chunk.semantic(units, vectors, Config(chunk_target=150, chunk_max=300, chunk_overlap=70))
        assert not any("a" in t and "b" in t for _, t in found)
        for bad in ([[1, 0]] * 5, [[0, 0]] * 6, [[float("nan"), 1]] * 6, [[1, 0]] * 5 + [[1]]):
            with pytest.raises(ValueError):
                chunk.semantic(units, bad, CFG)

    def test_distributed(self, spark):
        df = spark.createDataFrame([("file", 1, "# A\ntext"), ("file", 2, None), ("file", 3, "")], "source_type string, source_id long, content string")
        assert [(r.source_id, r.heading, r.chunk_text) for r in chunk.chunk(df).collect()] == [(1, "A", "text")]


class TestRank:
    def routes(self, spark):
        rows = [(1, "a", k, i + 1) for i, k in enumerate([10, 11, 10, 12])] + [(1, "b", k, i + 1) for i, k in enumerate([12, 10])]
        return spark.createDataFrame(rows, "q int, route string, key int, rank int")

    def test_rrf_one_vote_per_route(self, spark):
        got = {r.key: (r.score, r.channels) for r in rank.rrf(self.routes(spark), ["q"], ["key"]).collect()}
        assert got[10] == (pytest.approx(1 / 61 + 1 / 62), ["a", "b"])
        assert got[12] == (pytest.approx(1 / 63 + 1 / 61), ["a", "b"])

    def test_interleave(self, spark):
        got = rank.interleave(self.routes(spark), ["q"], ["key"], 9).orderBy("rank").collect()
        assert [r.key for r in got] == [10, 12, 11]

    def test_rerank_merge_loses_nothing(self, spark):
        ranked = spark.createDataFrame([(1, k, i + 1) for i, k in enumerate("abcd")], "q int, key string, rank int")
        order = spark.createDataFrame([(1, k, i) for i, k in enumerate("cxca")], "q int, key string, position int")
        got = rank.rerank_merge(ranked, order, ["q"], ["key"]).orderBy("rank").collect()
        assert [r.key for r in got] == list("cabd")

    def test_budgets(self, spark):
        df = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate([50, 60, 30, 20])], "q int, rank int, cost int")
        assert sorted(r["rank"] for r in rank.budget_stop(df, ["q"], "cost", 100).collect()) == [1]
        assert sorted(r["rank"] for r in rank.budget_skip(df, ["q"], "cost", 100).collect()) == [1, 3, 4]
        assert sorted(r["rank"] for r in rank.budget_skip(df, ["q"], "cost", 100, most=2).collect()) == [1, 3]

    def test_budget_skip_is_the_plain_loop(self, spark):
        rng = random.Random(3)
        items = [(q, i + 1, rng.choice([None, *range(5, 60)])) for q in (None, 1, 2) for i in range(40)]
        want = set()
        for q in (None, 1, 2):
            used = 0
            for _, i, c in (x for x in items if x[0] == q):
                if c is not None and used + c <= 100:
                    used += c
                    want.add((q, i))
        df = spark.createDataFrame(items, "q int, rank int, cost int").repartition(5)
        assert {(r.q, r["rank"]) for r in rank.budget_skip(df, ["q"], "cost", 100).collect()} == want

    def test_mmr(self, spark):
        df = spark.createDataFrame([(1, "a", 1, [1.0, 0.0]), (1, "b", 2, [1.0, 0.0]), (1, "c", 3, [0.0, 1.0])], "q int, key string, rank int, vec array<double>")
        orders = [[r.key for r in rank.mmr(df, ["q"], w).orderBy("position").collect()] for w in (0.7, 0.4)]
        assert orders == [["a", "b", "c"], ["a", "c", "b"]]

    def test_nearest_rank(self, spark):
        df = spark.createDataFrame([(1, float(v)) for v in range(1, 11)], "q int, v double")
        assert rank.nearest_rank(df, ["q"], "v", 85).first().percentile == 9


class TestSearch:
    def test_modes(self, spark):
        p = spark.createDataFrame([("note", 1, 0, "Git rebase", "how to rebase"), ("note", 2, 0, "Other", "git merge"), ("note", 3, 0, "None", "nothing")], "source_type string, source_id long, seq int, title string, body string")
        q = spark.createDataFrame([(1, "git rebase")], "question_id long, question string")
        got = search.search(p, q, mode="keyword").orderBy("rank").collect()
        assert [(r.source_id, r.score) for r in got] == [(1, 8), (2, 3)]
        fused = search.search(p, q).orderBy("rank").collect()
        assert [r.source_id for r in fused] == [1, 2]
        order = spark.createDataFrame([(1, "note", 2, 0, 0)], "question_id long, source_type string, source_id long, seq int, position int")
        assert [r.source_id for r in search.search(p, q, mode="keyword", order=order).orderBy("rank").collect()] == [2, 1]
        for mode in ("x", "vector"):
            with pytest.raises(ValueError):
                search.search(p, q, mode=mode)

    def test_few_of_many_questions(self, spark):
        """Scores of questions that share few terms with a passage are those of the plain loop."""
        rng = random.Random(4)
        word = lambda i: "w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] + "q"
        texts = {i: " ".join(rng.choice([word(rng.randrange(100)), "common"]) for _ in range(6)) for i in range(30)}
        titles = {i: rng.choice([word(rng.randrange(100)), "x"]) for i in texts}
        asked = {q: [word(q % 100), *(["common"] if q % 50 == 0 else [])] for q in range(160)}
        want = {(q, i): s for q, terms in asked.items() for i in texts if (s := sum(5 if t in texts[i] and t in titles[i] else 3 if t in texts[i] or t in titles[i] else 0 for t in terms))}
        p = spark.createDataFrame([("n", i, 0, titles[i], texts[i]) for i in texts], "source_type string, source_id long, seq int, title string, body string")
        q = spark.createDataFrame([(q, " ".join(t)) for q, t in asked.items()], "question_id long, question string")
        assert {(r.question_id, r.source_id): r.score for r in search.keyword_scores(p, q).collect()} == want

    def test_stale_vectors_leave_before_the_band(self, spark):
        v = spark.createDataFrame([("n", 1, 0, "old", [1.0, 0.0]), ("n", 2, 0, "now", [0.8, 0.6])], "source_type string, source_id long, seq int, chunk_text string, vec array<double>")
        fresh = spark.createDataFrame([("n", 1, 0, "new"), ("n", 2, 0, "now")], "source_type string, source_id long, seq int, chunk_text string")
        q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, vec array<double>")
        assert [r.source_id for r in search.vector_channel(v, q).collect()] == [1]
        assert [r.source_id for r in search.vector_channel(v, q, fresh=fresh).collect()] == [2]


class TestGraph:
    def rel(self, spark, rows):
        return spark.createDataFrame(rows, "head string, relation string, tail string, weight double")

    def test_closures(self, spark):
        r = self.rel(spark, [("a", "is_a", "b", 1.0), ("b", "is_a", "c", 1.0), ("c", "is_a", "d", 1.0), ("d", "is_a", "e", 1.0), ("x", "related_to", "y", 1.0), ("b", "used_for", "z", 1.0), ("p", "is_a", "q", 1.0), ("q", "is_a", "p", 1.0)])
        got = {(x.head, x.tail): round(x.weight, 4) for x in graph.transitive_closure(r).collect()}
        assert got == {("a", "c"): 0.7, ("b", "d"): 0.7, ("c", "e"): 0.7, ("a", "d"): 0.49, ("b", "e"): 0.49, ("a", "e"): 0.49}
        assert [(x.head, x.tail) for x in graph.symmetric_closure(r).collect()] == [("y", "x")]

    def test_hops_and_paths(self, spark):
        r = self.rel(spark, [("a", "is_a", "b", 1.0), ("c", "related_to", "b", 1.0), ("c", "is_a", "d", 1.0)])
        seeds = spark.createDataFrame([("a",)], "id string")
        got = sorted((x.hop, x.head, x.tail) for x in graph.k_hop(r, seeds, 3).collect())
        assert got == [(1, "a", "b"), (2, "c", "b"), (3, "c", "b"), (3, "c", "d")]
        pairs = spark.createDataFrame([("a", "d"), ("a", "zz")], "source string, target string")
        assert [(x.target, x.length) for x in graph.shortest_paths(r, pairs).collect()] == [("d", 3)]

    def test_path_lengths_of_random_graphs(self, spark):
        rng = np.random.default_rng(3)
        for n, m in ((12, 14), (20, 40)):
            edges = [(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))]
            far = {(i, i): 0 for i in range(n)}
            for step in range(1, 5):
                for (s, t), d in list(far.items()):
                    for x, y in [*edges, *((y, x) for x, y in edges)]:
                        if d == step - 1 and x == t:
                            far.setdefault((s, y), step)
            pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (30, 2))})
            r = self.rel(spark, [(f"v{a}", "is_a", f"v{b}", 1.0) for a, b in edges])
            got = graph.shortest_paths(r, spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in pairs], "source string, target string"), 4)
            assert sorted(map(tuple, got.collect())) == sorted((f"v{a}", f"v{b}", far[a, b]) for a, b in pairs if (a, b) in far)

    def test_paths_behind_a_hub_grow_from_the_few(self, spark, monkeypatch):
        sizes, real = [], graph.staged

        def counted(df, name):
            sizes.append((out := real(df, name)).count())
            return out

        monkeypatch.setattr(graph, "staged", counted)
        leaves = spark.range(500).select(F.concat(F.lit("s"), "id").alias("head"), F.lit("part_of").alias("relation"), F.lit("hub").alias("tail"))
        r = leaves.unionByName(spark.createDataFrame([("hub", "part_of", "top")], "head string, relation string, tail string"))
        pairs = leaves.select(F.col("head").alias("source")).crossJoin(spark.createDataFrame([("top",), ("other",)], "target string"))
        got = graph.shortest_paths(r, pairs, 4).collect()
        assert len(got) == 500 and {(x.target, x.length) for x in got} == {("top", 2)}
        assert sizes and max(sizes) <= 2 * 501

    def test_leiden(self):
        two = [(a, b, 1.0) for c in (0, 5) for a in range(c, c + 5) for b in range(a) if b >= c] + [(0, 5, 0.1)]
        got = graph.leiden(10, two)
        assert got == [0] * 5 + [1] * 5
        assert graph.leiden(10, two) == got
        assert graph.leiden(3, []) == [0, 1, 2]
        rng = np.random.default_rng(1)
        edges = [(int(a), int(b), 1.0) for a, b in rng.integers(0, 60, (150, 2)) if a != b]
        comm = graph.leiden(60, edges)
        near = {v: set() for v in range(60)}
        for a, b, _ in edges:
            near[a].add(b)
            near[b].add(a)
        for c in set(comm):
            members = {v for v in range(60) if comm[v] == c}
            seen, todo = set(), [min(members)]
            while todo:
                v = todo.pop()
                if v not in seen:
                    seen.add(v)
                    todo += near[v] & members
            assert seen == members

    def test_merge_and_cap(self, spark):
        t = spark.createDataFrame([(2, "a", "is_a", "b", " ", ["n1"], 0.2), (3, "a", "is_a", "b", "q3", ["n2", "n1"], 5.0), (5, "a", "is_a", "b", "q5", ["n3"], 0.0)], "id int, head string, relation string, tail string, evidence string, sources array<string>, weight double")
        r = graph.merge_triples(t).first()
        assert (r.evidence, r.sources, r.weight) == ("q3", ["n1", "n2", "n3"], 5.0)  # a merge does not cap

        def weight(*rows):
            df = spark.createDataFrame([(i, "a", "is_a", "b", "q", ["n"], w) for i, w in enumerate(rows)], t.schema)
            return graph.merge_triples(df).first().weight

        assert [weight(0.5, 0.0), weight(0.5, 2.0), weight(5.0), weight(5.0, 0.3), weight(-1.0, -2.0), weight(0.2, 0.1, 0.3)] == [0.5, 2.0, 1.0, 1.0, 1.0, 0.3]
        empty = spark.createDataFrame([(1, "a", "is_a", "b", "x" * 600, None, 0.5)], t.schema)
        assert (len(graph.merge_triples(empty).first().evidence), graph.merge_triples(empty).first().sources) == (480, [])
        e = spark.createDataFrame([("a", x, i) for i, x in enumerate("bcdef")] + [("g", "g", 9)], "a string, b string, ordinal int")
        assert [r.b for r in graph.degree_cap(e).collect()] == ["b", "c", "d"]

    @pytest.mark.parametrize(("per_node", "most"), [(3, 30), (1, 1000), (3, 1000), (2, 1)])
    def test_degree_cap_against_a_plain_loop(self, spark, per_node, most):
        rng = random.Random(6)
        rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(40)}", rng.randrange(300)) for _ in range(600)]
        rows += [("hub", f"n{i % 40}", i) for i in range(300)]
        count, seen, want = {}, set(), []
        for a, b, o in sorted(set(rows), key=lambda r: (r[2], r[0], r[1])):
            if a == b or frozenset((a, b)) in seen:
                continue
            seen.add(frozenset((a, b)))
            if len(want) < most and max(count.get(a, 0), count.get(b, 0)) < per_node:
                want.append((a, b, o))
                count[a], count[b] = count.get(a, 0) + 1, count.get(b, 0) + 1
        df = spark.createDataFrame(rows, "a string, b string, ordinal int")
        assert [tuple(r) for r in graph.degree_cap(df, per_node, most).collect()] == want

    def test_degree_cap_keeps_kinds_apart(self, spark):
        rows = [("a", "b", "is_a", 1), ("b", "a", "is_a", 2), ("b", "a", "part_of", 3), ("a", "c", "is_a", 4), ("a", "d", "is_a", 5)]
        df = spark.createDataFrame(rows, "a string, b string, relation string, ordinal int")
        assert [r.ordinal for r in graph.degree_cap(df).collect()] == [1, 3, 4]
        assert graph.degree_cap(df.limit(0)).count() == 0

    def test_leiden_finds_the_best_partition_of_small_graphs(self):
        def partitions(n):
            def grow(prefix, most):
                if len(prefix) == n:
                    yield prefix
                    return
                for c in range(most + 1):
                    yield from grow([*prefix, c], max(most, c + 1))

            yield from grow([], 0)

        def quality(edges, of):
            m = sum(w for *_, w in edges)
            inside, total = {}, {}
            for a, b, w in edges:
                for v in (a, b):
                    total[of[v]] = total.get(of[v], 0) + w
                if of[a] == of[b]:
                    inside[of[a]] = inside.get(of[a], 0) + w
            return sum(inside.get(c, 0) / m - (t / (2 * m)) ** 2 for c, t in total.items())

        rng = random.Random(8)
        for _ in range(12):
            n = 7
            edges = [(a, b, rng.choice([1.0, 2.0])) for a in range(n) for b in range(a) if rng.random() < (0.9 if (a < 4) == (b < 4) else 0.15)]
            best = max(quality(edges, p) for p in partitions(n))
            assert quality(edges, graph.leiden(n, edges)) >= best - 0.03

    def test_terms_over_several_passes(self, spark, monkeypatch):
        p = spark.createDataFrame([("n", 1, 0, "alpha", "beta gamma")], "source_type string, source_id long, seq int, title string, body string")
        words = spark.createDataFrame([("alpha",), ("beta",), ("gamma",), ("delta",)], "term string")
        monkeypatch.setattr(search, "TERMS_PER_PASS", 1)
        assert sorted(r.term for r in search.term_hits(p, words).collect()) == ["alpha", "beta", "gamma"]
        assert search.term_hits(p, words.limit(0)).count() == 0


class TestContent:
    def test_html(self):
        page = '<html><body><nav>x</nav><article><h2>T &amp; U</h2><p>a <b>b</b> <a href="/q?x=1&amp;y=2">l <i>i</i></a></p><pre class="language-Java"><code>if (a &lt; b)\n  **x**  \n</code></pre><ul><li>one</li><li>two</li></ul><script>bad()</script></article></body></html>'
        got = html.to_markdown(page, "https://h.example/p/")
        assert "## T & U" in got
        assert "a **b** [l i](https://h.example/q?x=1&y=2)" in got
        assert "```java\nif (a < b)\n  **x**\n```" in got
        assert "- one\n- two" in got
        assert "bad" not in got
        assert html.to_markdown(None) == html.to_markdown("") == ""
        dom = html.dom_markdown(page, "https://h.example/p/")
        assert "## T & U" in dom
        assert "https://h.example/q?x=1&y=2" in dom
        long = "<main>" + "m" * 500 + "</main>"
        assert html.to_markdown("<body>b" + long + "</body>") == "m" * 500
        assert html.to_markdown("<body>b<main>s</main></body>") == "b\n\ns"
        assert html.to_markdown("<head><title>t</title></head><nav>n</nav><p>x<template>y</template></p><footer>f</footer>") == "n\n\nx\n\nf"
        assert html.dom_markdown("<nav>n</nav><p>x</p><footer>f</footer>") == "x"
        assert html.to_markdown("<p>a <em>b <strong>c</em> d<ul><li>one<li>two</ul>&lt;x&gt; <br>y<hr>z").endswith("- one\n- two\n\n<x>\ny\n\n---\n\nz")
        assert html.to_markdown('<pre class="brush: c++">x\r\n  *y*  </pre>') == "```c++\nx\n  *y*\n```"
        assert html.to_markdown("<blockquote>a<br>b</blockquote><img src='i.png'>", "https://h.example/") == "> a\n> b\n\n![](https://h.example/i.png)"
        assert html.to_markdown('e <math><mi>x</mi><annotation encoding="application/x-tex">x^2</annotation></math> f') == "e $x^2$ f"
        assert html.to_markdown("<div>" * 3000 + "deep") == "deep"

    def test_code(self, spark):
        java = "package x;\npublic class Foo {\n  private static final int MAX_N = 3;\n  public\n  String bar(int a) {\n  }\n}\n"
        assert set(code.symbols_of(java, "java")) == {("class", "Foo", 2), ("const", "MAX_N", 3), ("method", "bar", 5)}
        assert code.symbols_of("class A:\n    def f(self):\n        pass\nLIMIT = 1", "python") == [("class", "A", 1), ("function", "f", 2), ("const", "LIMIT", 4)]
        assert ("function", "go", 1) in code.symbols_of("const go = async (x) => 1", "js")
        js = "export class A extends B {\n  async load(x, y = (1)) {\n    if (x) { return call(x) }\n  }\n}\nfunction f(a) {}\nlet g = function () {}\nvar h = x => x\nconst LIMIT_A = 3;\nconst t = f(1)\nexport default function main() {}"
        assert set(code.symbols_of(js, "ts")) == {("class", "A", 1), ("method", "load", 2), ("function", "f", 6), ("function", "g", 7), ("function", "h", 8), ("const", "LIMIT_A", 9), ("function", "main", 11)}
        assert set(code.symbols_of("type T struct {}\nfunc (t *T) Run(a int) error {\n}\nfunc Top() {}\nstruct P { int x; };\nenum E { A }", "go")) == {("function", "Run", 2), ("function", "Top", 4), ("class", "P", 5), ("enum", "E", 6)}
        assert set(code.symbols_of("interface I { }\nrecord R(int a) { }\npublic final class K<T> {\n  protected Map<String, T> of(T t) throws X { x = g(1); }\n}", "java")) == {("interface", "I", 1), ("record", "R", 2), ("class", "K", 3), ("method", "of", 4)}
        assert code.symbols_of("deploy() {\n}\nfunction build() {\n}\n", "sh") == [("function", "deploy", 1), ("function", "build", 3)]
        assert code.symbols_of("create or replace view a.v as select 1;\nCREATE TABLE t (x int);", "sql") == [("function", "a.v", 1), ("function", "t", 2)]
        assert code.symbols_of("async def a(x): pass\n# class No\nX_Y = 1", "py") == [("function", "a", 1), ("const", "X_Y", 3)]
        assert code.symbols_of(None, None) == code.symbols_of("", "java") == []
        rows = [("a/node_modules/x.js", "x", "ignored directory"), ("yarn.lock", "x", "lock or system file"), ("a.min.js", "x", "minified"), ("a.png", "x", "binary"), ("a.py", None, "unreadable"), ("a.py", " \n", "empty"), ("a.py", "x\0y", "binary content"), ("a.py", "x", None)]
        df = spark.createDataFrame(rows, "path string, text string, want string")
        from pyspark.sql import functions as F

        assert all(r.got == r.want for r in df.select("want", code.reject_reason(F.col("path"), F.col("text")).alias("got")).collect())
        langs = spark.createDataFrame([("a.py", "x", "python"), ("b", "def f():\n    return (1);", "guessed"), ("c", "hello", "text")], "path string, text string, want string")
        assert all(r.got == r.want for r in langs.select("want", code.language(F.col("path"), F.col("text")).alias("got")).collect())

    def test_lineage(self, spark):
        assert lineage.sections("intro\n# A\nx\n```\n# no\n```\n## B\ny\n# C\n") == [("", "intro"), ("A", "x\n```\n# no\n```"), ("A > B", "y")]
        assert lineage.repair("[速查 # 8] [note#3]", {"ref-8"}) == "[速查卡#8] 笔记#3"
        good = "## S\n" + "x" * 300 + " [笔记#1] [note#2]"
        df = spark.createDataFrame([(1, good, ["note-1", "note-2"]), (2, "short [笔记#9]", ["note-1"]), (3, None, ["note-1"])], "page_id int, markdown string, valid array<string>")
        got = {r.page_id: r for r in lineage.quality(df).collect()}
        assert got[1].ok
        assert got[1].soft == ""
        assert "unknown citations" in got[2].hard
        assert not got[3].ok

    def test_excerpts(self):
        text = "start. " + "filler word " * 60 + "The merge queue keeps order. " + "more text " * 60
        got = context.excerpt("how does the merge queue work", text, 120)
        assert len(got) == 120
        assert "merge queue" in got
        assert context.excerpt("zzz", text, 50) == text[:50]
        assert context.excerpt("x", "short", 50) == "short"
        fenced = "intro text here\n\n```\nmerge queue code\n```\n\n" + "tail words " * 40
        out = context.structure_excerpt("merge queue", fenced, 60)
        assert "```\nmerge queue code\n```" in out
        assert len(out) <= 60
        assert context.relevance("merge queue", "merge queue", "merge")[1] < context.relevance("merge queue", "merge queue")[0]
        assert context.longest_names("GitHub and Git use GitHub Actions", ["Git", "GitHub", "GitHub Actions"]) == ["GitHub", "Git", "GitHub Actions"]

    def test_evaluation(self, spark):
        cases = spark.createDataFrame([(1, ["a"]), (2, ["b"]), (3, []), (4, ["none"])], "question_id long, refs array<string>")
        ranked = spark.createDataFrame([(1, "x", 1), (1, "x", 2), (1, "a", 3), (2, "y", 1), (3, "a", 1)], "question_id long, ref string, rank int")
        r = evaluate.recall_mrr(cases, ranked).first()
        assert (r.cases, r.gap_cases, r.hits, r.recall, r.mrr) == (4, 2, 1, 0.5, 0.25)
        h = evaluate.corpus_hash(spark.createDataFrame([("n", 1, "a"), ("n", 2, None)], "source_type string, source_id long, content string")).first()[0]
        assert h == evaluate.corpus_hash(spark.createDataFrame([("n", 2, None), ("n", 1, "a")], "source_type string, source_id long, content string")).first()[0]


class TestMaintenance:
    def test_steps(self):
        now, marks, done = [0.0], {"a": 1, "b": 1}, []
        fail = [True]

        def b():
            if fail[0]:
                raise RuntimeError("x")
            done.append("b")

        m = maintain.Maintenance([maintain.Step("a", lambda: done.append("a"), lambda: marks["a"]), maintain.Step("b", b, lambda: marks["b"], ["a"]), maintain.Step("c", lambda: done.append("c"), lambda: 1, ["b"])], clock=lambda: now[0])
        assert m.tick() == [("a", "done"), ("b", "failed"), ("c", "blocked")]
        assert m.tick() == [("b", "waiting"), ("c", "blocked")]
        fail[0], now[0] = False, 31
        again = maintain.Maintenance(m.steps, clock=m.clock).load(m.dump())
        assert again.tick() == [("b", "done"), ("c", "done")]
        assert again.tick() == []
        assert done == ["a", "b", "c"]

    def test_changed_meanwhile(self):
        mark = [1]
        m = maintain.Maintenance([maintain.Step("a", lambda: mark.__setitem__(0, 2), lambda: mark[0])])
        assert m.tick() == [("a", "changed")]

    def test_incremental(self, spark, tmp_path):
        schema = "source_type string, source_id long, content string"
        root = f"file://{tmp_path}/kb"
        one = spark.createDataFrame([("n", 1, "first text"), ("n", 2, "second")], schema)
        assert maintain.maintain(spark, root, one) == {"added": 2}
        assert maintain.maintain(spark, root, one) == {"unchanged": 2}
        two = spark.createDataFrame([("n", 1, "first changed"), ("n", 3, "third")], schema)
        assert maintain.maintain(spark, root, two) == {"changed": 1, "removed": 1, "added": 1}
        got = {(r.source_id, r.chunk_text) for r in maintain.Snapshots(spark, root).read("chunks").collect()}
        assert got == {(1, "first changed"), (3, "third")}


class TestWorkflow:
    def test_validation(self):
        ok = {"id": "a", "op": "limit", "input": "t", "count": 1}
        for bad in ({}, {"steps": []}, {"steps": [{**ok, "op": "x"}]}, {"steps": [{**ok, "input": "later"}]}, {"steps": [ok, ok]}, {"steps": [{**ok, "id": str(i)} for i in range(9)]}, {"steps": [ok], "output": "z"}, {"steps": [{"id": "a", "op": "filter", "input": "t", "field": "x", "test": "like", "value": 1}]}):
            with pytest.raises(ValueError):
                workflow.validate(bad, {"t"})

    def test_operations(self, spark):
        t = spark.createDataFrame([(1, "b.b", 2), (2, "a.x", 2), (3, "b.b", 1)], "ordinal long, s string, n int")
        run = lambda *steps: [tuple(r) for r in workflow.compile_workflow({"steps": [{"id": str(i), "input": "t" if i == 0 else str(i - 1), **s} for i, s in enumerate(steps)]}, {"t": t}).orderBy("ordinal").collect()]
        assert [r[1] for r in run({"op": "sort", "field": "n", "descending": True})] == ["b.b", "a.x", "b.b"]
        assert [r[0] for r in run({"op": "unique", "field": "s"})] == [1, 2]
        assert [r[1] for r in run({"op": "replace", "field": "s", "find": "b", "by": "c", "first": True})] == ["c.b", "a.x", "c.b"]
        assert [r[1] for r in run({"op": "replace", "field": "s", "find": "b", "by": "c"})] == ["c.c", "a.x", "c.c"]
        assert [r[1] for r in run({"op": "split", "field": "s", "by": "."})][0] == ["b", "b"]
        assert [r[3] for r in run({"op": "template", "name": "l", "text": "{s}-{n}"})] == ["b.b-2", "a.x-2", "b.b-1"]
        assert [r[3] for r in run({"op": "length", "field": "s"})] == [3, 3, 3]
        assert [r[0] for r in run({"op": "pluck", "field": "n"}, {"op": "limit", "count": 2})] == [2, 2]
        assert [r[0] for r in run({"op": "filter", "field": "s", "test": "contains", "value": "a"})] == [2]
        with pytest.raises(ValueError):
            run({"op": "sort", "field": "nope"})
