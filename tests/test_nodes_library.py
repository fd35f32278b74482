import random

import pytest
from pyspark.sql import functions as F

from loreweave.operators import code, evaluate, graph, html, library, maintain, nodes, workflow

NODE = "name string, norm string, type string, aliases array<string>, source_count long, brief string"
REL = "head string, relation string, tail string, weight double, evidence string, sources array<string>, origin string, derived_from string"


def similarity(a, b):
    if not a or not b:
        return 0
    if a == b:
        return 1
    if a in b or b in a:
        return 0.6
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    s = 1 - row[-1] / max(len(a), len(b))
    return s if s >= 0.75 else 0


def test_duplicates_are_all_pairs(spark):
    rng = random.Random(2)
    names = ["", "a", "b", "ab", "队列", "消息队列", "éa"] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    rows = list(enumerate(names))
    want = {(i, j): round(similarity(a, b), 9) for i, a in rows for j, b in rows if i < j and similarity(a, b) > 0}
    got = {(r.a, r.b): round(r.score, 9) for r in nodes.duplicates(spark.createDataFrame(rows, "id int, name string")).collect()}
    assert got == want
    assert nodes.duplicates(spark.createDataFrame([], "id int, name string")).count() == 0


def test_upsert(spark):
    known = spark.createDataFrame([("Git", "git", "tool", ["scm"], 3, None)], NODE)
    rows = [("GIT", "git", None, None, 1, " ", 2), ("git", "git", "x", ["vcs"], 2, "brief", 1), (None, "", "x", [], 1, "", 3), ("New", "new", None, None, None, None, 4)]
    got = {r.norm: r for r in nodes.upsert(known, spark.createDataFrame(rows, NODE + ", place long")).collect()}
    g = got["git"]
    assert (g.name, g.type, sorted(g.aliases), g.source_count, g.brief) == ("Git", "tool", ["GIT", "git", "scm", "vcs"], 6, "brief")
    assert set(got) == {"git", "new"} and got["new"].aliases == [] and got["new"].source_count is None


def test_resolve_by_priority(spark):
    n = spark.createDataFrame([("e-1", "git", ["scm"]), ("e-2", "scm", []), ("e-3", "x", None)], "id string, norm string, alias_norms array<string>")
    q = spark.createDataFrame([("e-3", "git"), ("Scm", "scm"), ("?", "none"), ("e-1", "")], "name string, norm string")
    assert {r.name: r.id for r in nodes.resolve(q, n).collect()} == {"e-3": "e-3", "Scm": "e-2", "?": None, "e-1": "e-1"}


def test_correction_and_vocabulary(spark):
    df = spark.createDataFrame([("is_a", "A depends on B"), ("part_of", "需要先学"), ("is_a", None), ("used_for", "requires")], "r string, q string")
    assert [r[0] for r in df.select(nodes.corrected(F.col("r"), F.col("q"))).collect()] == ["prerequisite", "prerequisite", "is_a", "used_for"]
    raw = [("is-a", "is_a"), ("Depends On", "prerequisite"), ("A vs B", "contrast_with"), ("belongs_to_type", "part_of"), ("", None), (None, None), ("zzz", None), ("用于测试", "used_for")]
    df = spark.createDataFrame(raw, "raw string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", graph.canonical_relation(F.col("raw"))).collect())


def test_edges_of_a_question(spark):
    rel = spark.createDataFrame([("a", "is_a", "b", 0.5, "q", ["n"], "llm", None), ("c", "related_to", "a", 0.9, "q", None, "llm", None), ("a", "related_to", "c", 0.2, "q", ["n"], "llm", None), ("a", "used_for", "x", 1.0, " ", ["n"], "llm", None), ("a", "is_a", "y", 0.4, None, [], "derived", "r"), ("a", "is_a", "a", 1.0, "q", ["n"], "llm", None)], REL)
    got = nodes.ranked_edges(rel, spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "question_id long, id string")).orderBy("rank").collect()
    assert [(r.head, r.relation, r.tail, r.bridging) for r in got] == [("a", "is_a", "b", True), ("a", "related_to", "c", False), ("a", "is_a", "y", False)]


def test_reason_uses_evidenced_edges_only(spark):
    rel = spark.createDataFrame([("a", "is_a", "b", 1.0, "q", [], "llm", None), ("b", "is_a", "c", 1.0, "q", [], "llm", None), ("c", "is_a", "d", 1.0, "", [], "llm", None), ("x", "is_a", "y", 1.0, "q", [], "derived", "old")], REL)
    got = {(r.head, r.tail, r.origin) for r in nodes.reason(rel).collect()}
    assert got == {("a", "b", "llm"), ("b", "c", "llm"), ("c", "d", "llm"), ("a", "c", "derived")}


def test_views(spark):
    rel = spark.createDataFrame([("a", "is_a", "b", 1.0, "q", [], "llm", None), ("b", "related_to", "c", 1.0, "q", [], "derived", "r")], REL)
    n = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 2)], "id string, community int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(nodes.filtered(n, rel)[0]) == ["a", "b", "c"] and ids(nodes.filtered(n, rel, isolated=True)[0]) == ["a", "b", "c", "d"]
    assert ids(nodes.filtered(n, rel, origin="llm")[0]) == ["a", "b"] and nodes.filtered(n, rel, focus="d")[1].count() == 0 and ids(nodes.filtered(n, rel, community=2)[0]) == []
    assert {(r.x, r.y, r.direct, r.derived, r.forward, r.internal) for r in nodes.overview(rel, n).collect()} == {(1, 1, 1, 0, 0, True), (1, 2, 0, 1, 1, False)}
    assert {(r.id, r.hop) for r in nodes.undirected_hops(rel, spark.createDataFrame([("c",)], "id string"), 2).collect()} == {("c", 0), ("b", 1), ("a", 2)}
    states = {r.community: r.state for r in nodes.summary_states(n, nodes.member_hashes(n).filter("community = 1").select("community", "hash").unionByName(spark.createDataFrame([(9, "x")], "community int, hash string"))).collect()}
    assert states == {1: "fresh", 2: "missing", 9: "orphan"}


def test_folders_and_terms(spark):
    d = spark.createDataFrame([(1, None, "x"), (2, 5, "y"), (3, 6, "x")], "id int, folder_id int, category string")
    count = lambda *a, **k: library.in_folder(d, *a, **k).count()
    assert [count(), count(0), count(5), count(7), count(category="x"), count(0, "y")] == [3, 1, 1, 0, 2, 0]
    assert library.any_term(d.withColumn("t", F.lit("Alpha")), ["t"], []).count() == 0
    many = [f"longerterm{i}" for i in range(10)] + ["alpha"]
    assert library.any_term(d.withColumn("t", F.lit("Alpha")), ["t"], many).count() == 0 and library.any_term(d.withColumn("t", F.lit("Alpha")), ["t"], many[1:]).count() == 3


def test_occurrences(spark):
    rows = ["abcABCabc" + "x" * 300 + " abc\n\t y", None, "none", "abc" * 250]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select(library.occurrences(F.col("t"), "Abc").alias("o")).select("o.*").collect()
    assert [r.hits for r in df] == [4, 0, 0, 200] and [len(r.windows or []) for r in df] == [4, 0, 0, 5]
    assert df[0].windows[3].endswith("abc y")


def test_reading(spark):
    df = spark.createDataFrame([("abcdef",), (None,), ("",)], "t string")
    got = df.select(library.read_at(F.col("t"), 2, 3).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("cde", 5), (None, None), ("", None)]


def test_questions(spark):
    q = spark.createDataFrame([(1, ""), (2, None), (3, "Overview of Git"), (4, "整个知识库怎么做")], "question_id int, question string")
    assert [r[0] for r in q.select(library.is_corpus_question(F.col("question"))).collect()] == [False, False, True, False]
    hits = spark.createDataFrame([(3, 1, "git overview of it")], "question_id int, rank int, text string")
    assert {r.question_id: r.check_needed for r in library.needs_evidence(q.filter("question is not null"), hits).collect()} == {1: True, 3: False, 4: True}


def test_code_scope_and_modes(spark):
    s = spark.createDataFrame([(1, 1, "py", "a/x.py", "Loader", "", "", "body", 5), (2, None, "js", "b/y.js", None, None, None, "loader()", 9)], "id int, repo int, lang string, path string, title string, explain string, symbols string, text string, updated int")
    f = spark.createDataFrame([(1, "function", "loadAll", 3), (1, "function", "reload", 1)], "id int, kind string, name string, line int")
    run = lambda **k: [(r.id, r.match_by, r.hit_symbol) for r in code.search_code(s, f, "load", **k).orderBy("rank").collect()]
    assert run() == [(1, "symbol", "loadAll"), (2, "keyword", None)]
    assert run(mode="keyword") == [(2, "keyword", None), (1, "keyword", None)] and run(unassigned=True) == [(2, "keyword", None)]
    assert run(repo=1, lang="PY", path="a/") == [(1, "symbol", "loadAll")] and run(mode="symbol", repo=7) == []
    with pytest.raises(ValueError, match="mode"):
        run(mode="x")


def test_arms_and_reports(spark):
    cases = spark.createDataFrame([(1, "q", ["a"]), (2, "q", ["b"]), (3, "q", [])], "question_id long, question string, refs array<string>")
    one = spark.createDataFrame([(1, "a", 1), (2, "x", 1)], "question_id long, ref string, rank int")
    two = spark.createDataFrame([(1, "z", 1), (1, "a", 2), (2, "b", 1)], "question_id long, ref string, rank int")
    ranks = evaluate.retrieval_arms(cases, {"one": lambda q: one, "two": lambda q: two})
    r = evaluate.paired_arms(ranks, "one", "two").first()
    assert (r.cases, r.hit_a, r.hit_b, r.first_a, r.first_b, r.mrr_a, r.mrr_b, r.hit_gains, r.hit_losses, r.rank_gains, r.rank_losses) == (2, 0.5, 1.0, 0.5, 0.5, 0.5, 0.75, 1, 0, 1, 1)
    empty = spark.createDataFrame([], "`group` string, correct boolean, abstained boolean")
    assert evaluate.known_and_unknown(empty).first().accuracy is None


def test_steps_and_layout(spark):
    t = spark.createDataFrame([(1, 2)], "ordinal long, n int")
    step = {"steps": [{"id": "a", "op": "python", "input": "t", "function": "f"}]}
    with pytest.raises(ValueError, match="registered"):
        workflow.compile_workflow(step, {"t": t})
    with pytest.raises(ValueError, match="lost"):
        workflow.compile_workflow(step, {"t": t}, functions={"f": lambda df: df.select("n")})
    assert workflow.compile_workflow(step, {"t": t}, functions={"f": lambda df: df.withColumn("n", F.col("n") + 1)}).first().n == 3
    lines = spark.createDataFrame([(1, 10, 5, None), (1, 12, 5, 3.0), (1, 9, 2, 1.0), (2, 8, 1, None)], "doc_id int, size int, chars int, gap double")
    assert {r.doc_id: (r.body_size, r.line_gap) for r in html.layout_sizes(lines).collect()} == {1: (10, 1.0), 2: (8, None)}
    s = spark.createDataFrame([(k,) for k in "cab"], "source_key string")
    order = lambda last: [r.source_key for r in maintain.rotated(s, last, 2).collect()]
    assert [order(None), order("a"), order("b"), order("c")] == [["a", "b"], ["b", "c"], ["c", "a"], ["a", "b"]]


def test_document_edges(spark):
    d = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    e = lambda *rows: spark.createDataFrame(rows, "a int, b int")
    got = {tuple(r) for r in graph.document_edges(d, e((2, 1), (1, 2), (1, 9), (3, 3)), e((1, 2))).collect()}
    assert got == {(1, 2, "structural"), (1, 2, "semantic")}
