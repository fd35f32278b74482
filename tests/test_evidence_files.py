from pyspark.sql import functions as F

from loreweave.operators import evidence
from loreweave.sources import files

REL = "id int, head string, relation string, tail string, evidence string, sources array<string>, weight double, origin string, derived_from string"


def test_read_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("﻿# T  \r\n\r\n\r\n\r\ntext", encoding="utf-8")
    (tmp_path / "sub/b.txt").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.txt").write_text("  \n")
    (tmp_path / "e.txt").write_text("cafÃ© é", encoding="utf-8")
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert {k: r.status for k, r in got.items()} == {"a.md": "ok", "b.txt": "failed", "c.pdf": "unsupported", "d.txt": "empty", "e.txt": "ok"}
    assert got["a.md"].text == "# T\n\ntext"
    assert got["e.txt"].text == "café é"
    assert files.listing(spark, f"file://{tmp_path}").count() == 5


def test_offsets_and_location(spark):
    d = spark.createDataFrame([(1, "alpha beta\n\ngamma\n\n\n delta ")], "k int, body string")
    b = files.offsets(files.paragraphs(d, "k", "body"), "k")
    assert [(r.text, r.start, r.end) for r in b.orderBy("block").collect()] == [("alpha beta", 0, 10), ("gamma", 12, 17), ("delta", 19, 24)]
    s = spark.createDataFrame([(1, 1, "beta\n\ngam", "alpha beta\n\ngamma\n\ndelta"), (1, 2, "zzz", "alpha")], "k int, snippet_id int, snippet string, body string")
    assert sorted((r.snippet_id, r.block) for r in files.locate(b, s, "k").collect()) == [(1, 0), (1, 1)]


def test_regions(spark):
    lines = spark.createDataFrame([(1, 1, "in", 0.0, 0.0, 10.0, 1.0), (1, 1, "out", 50.0, 0.0, 60.0, 1.0), (1, 1, "both", 4.0, 0.0, 14.0, 1.0)], "doc_id int, page int, line string, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, 1, "a", 0.0, 0.0, 12.0, 9.0), (1, 1, "b", 12.0, 0.0, 30.0, 9.0)], "doc_id int, page int, region string, x0 double, y0 double, x1 double, y1 double")
    assert {r.line: r.region for r in files.assign_regions(lines, regions).collect()} == {"in": "a", "out": None, "both": "a"}


def test_support(spark):
    rel = spark.createDataFrame([(1, "a", "is_a", "b", "The  Quote here", ["file-1"], 1.0, "llm", None), (2, "a", "is_a", "c", "stale quote", ["file-1"], 1.0, "llm", None), (3, "x", "is_a", "x", "q", ["file-1"], 1.0, "llm", None), (4, "a", "is_a", "d", None, ["file-1"], 1.0, "llm", None), (5, "a", "nope", "d", "q", ["file-1"], 1.0, "llm", None)], REL)
    src = spark.createDataFrame([("file", 1, "before the **quote** here after")], "source_type string, source_id long, content string")
    ok = evidence.admissible(rel, ["is_a"])
    assert sorted(r.id for r in ok.collect()) == [1, 2]
    assert [r.id for r in evidence.supported(ok, src).collect()] == [1]
    concepts = spark.createDataFrame([(7, "a"), (7, "b")], "question_id int, id string")
    got = evidence.graph_evidence(ok, concepts, src).first()
    assert (got.question_id, got.source_ref, got.score, got["rank"]) == (7, "file-1", 2.1, 1)


def test_replace_support(spark):
    row = lambda i, t, s, w, o="llm": (i, "a", "is_a", t, "q", s, w, o, None)
    rel = spark.createDataFrame([row(1, "gone", ["file-1"], 1.0), row(2, "kept", ["file-1", "file-2"], 1.0), row(3, "again", ["file-1"], 0.8), row(4, "manual", ["file-1"], 0.7, "manual"), row(5, "other", ["file-2"], 0.6)], REL)
    fresh = spark.createDataFrame([row(9, "again", ["file-1"], 0.5), row(10, "new", ["file-1"], 0.3)], REL)
    got = {r.tail: (r.sources, r.weight) for r in evidence.replace_support(rel, "file-1", fresh).collect()}
    assert got == {"kept": (["file-2"], 0.4), "again": (["file-1"], 0.8), "manual": (["file-1"], 0.7), "other": (["file-2"], 0.6), "new": (["file-1"], 0.9)}


def test_expand_and_pool(spark):
    rel = spark.createDataFrame([("a", "b", 1.0), ("c", "a", 0.5)], "head string, tail string, weight double")
    names = spark.createDataFrame([("b", "Beta"), ("c", "In question")], "id string, name string")
    q = spark.createDataFrame([(1, "what is in question")], "question_id int, question string")
    got = evidence.expand_terms(rel, spark.createDataFrame([(1, "a")], "question_id int, id string"), names, q).collect()
    assert [(r.question_id, r.name) for r in got] == [(1, "Beta")]
    first = spark.createDataFrame([(1, k, i + 1) for i, k in enumerate("abcdef")], "question_id int, k string, rank int")
    extra = spark.createDataFrame([(1, "b", 1), (1, "x", 2)], "question_id int, k string, rank int")
    pool = evidence.rerank_pool(first, extra, ["k"], 4).orderBy("rank").collect()
    assert [r.k for r in pool] == ["a", "b", "c", "x"]


def test_browser_trigger(spark):
    df = spark.createDataFrame([(403, "x", True), (200, "", True), (200, "Please enable JavaScript", True), (200, "text", False)], "s int, h string, want boolean")
    assert all(r.got == r.want for r in df.select("want", files.html_needs_browser(F.col("s"), F.col("h")).alias("got")).collect())
