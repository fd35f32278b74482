import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.operators import commands, edits, facts, material, vectors
from loreweave.sources import table


def test_facts(spark):
    text = "容量 = 16 GB\n极光站的编号是 A7。\n为什么?: no\nkey: value.\nkey: value!\nx:  --\n缺项: 不知道\n" + "a" * 200
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, body string")
    got = {(r.subject, r.answer): r for r in facts.extract(d, "doc_id", "body").collect()}
    assert set(got) == {("容量", "16 GB"), ("极光站的编号", "A7"), ("key", "value")}
    assert got["极光站的编号", "A7"].entity == "极光站" and got["key", "value"].entity is None
    assert got["key", "value"].statement == "key: value."
    assert got["key", "value"].fact_id == hashlib.sha256(b"key=value").hexdigest()[:16]


def test_contrast_cases(spark):
    d = spark.createDataFrame([(1, "极光站的编号是 A7\nplain: thing")], "doc_id int, body string")
    f = facts.questions(facts.extract(d, "doc_id", "body"))
    got = {r.status: r for r in facts.contrast_cases(f, d, "doc_id", "body").collect()}
    assert set(got) == {"ok", "missing_or_ambiguous_entity"}
    ok = got["ok"]
    assert ok.replaced_entity == "极光站" and ok.question == f"{ok.entity}的编号是什么？" and ok.answer == "不知道"
    again = d.unionByName(spark.createDataFrame([(2, "text about " + ok.entity.upper())], d.schema))
    statuses = {r.status for r in facts.contrast_cases(f, again, "doc_id", "body").collect()}
    assert statuses == {"replacement_entity_in_corpus", "missing_or_ambiguous_entity"}


def test_numbered_headings():
    body = "1 Start\n\n1.1 Method:\n\n```\n2 Code\n```\n\n3 this is prose\n4 A, b\n5 Half. Sentence\n6 Ends here.\n7 题目\n0 Zero\n8 X"
    assert material.numbered_headings(body) == [("1", "Start"), ("1.1", "Method:"), ("6", "Ends here."), ("7", "题目")]
    assert material.numbered_headings(None) == []


def test_openings():
    h = lambda *x: [tuple(i.split(" ", 1)) for i in x]
    tree = [(0, h("1 Root", "1.1 Part")), (1, h("1.1.1 One")), (2, h("1.1.2 Two")), (3, []), (4, h("1.2 Next")), (5, h("1.2.1 Only"))]
    assert material.openings(tree) == {1: (0, "1.1 Part"), 2: (0, "1.1 Part"), 3: (0, "1.1 Part")}
    assert material.openings([(0, h("1 R", "1.1 P")), (1, h("1.1.2 B")), (2, h("1.1.1 A"))]) == {}  # children out of order
    assert material.openings([(0, h("1 R", "1.1 P")), (1, h("1.1.1 A")), (2, h("3.1.1 Lost")), (3, h("1.1.2 B"))]) == {}  # a barrier
    shown_twice = [(0, h("1 R", "1.1 P")), (1, h("1.1 P", "1.1.1 A")), (2, h("1.1.2 B"))]
    assert material.openings(shown_twice) == {1: (0, "1.1 P"), 2: (0, "1.1 P")}


def test_outline_needs_no_own_headings(spark):
    rows = [(k, i, "Own" if k == 2 and i == 0 else "", t) for k in (1, 2) for i, t in enumerate(["1 Root\n\n1.1 Part", "1.1.1 One", "1.1.2 Two", None])]
    got = material.outline(spark.createDataFrame(rows, "k int, seq int, heading string, chunk_text string"), ["k"]).collect()
    assert sorted((r.k, r.seq, r.parent_seq, r.parent_heading) for r in got) == [(1, s, 0, "1.1 Part") for s in (1, 2, 3)]


def test_section_outline_takes_whole_texts(spark, tmp_path):
    from loreweave.plans.q_material import section_outline

    rows = [(1, "one two three four. " * 6_100), (2, "a b.\nc d! e f? g"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id, r.seq, r.parent_seq, r.parent_heading) for r in section_outline(spark, str(tmp_path)).collect())
    long = [(1, s, s // 6 * 6 + 1, f"{s // 6 % 999 + 1}.1 Section of words") for s in range(6_100) if s % 6 in (2, 3)]
    assert got == [*long, (2, 2, 1, "1.1 Section of words"), (2, 3, 1, "1.1 Section of words")]


def test_section_outline_keeps_sentences_that_look_like_headings(spark, tmp_path):
    from loreweave.plans import registry

    odd = ["56.187.231.175 Keit auf. Ung. Enö. Ch. Sch.", "A. B. C. 1.2.3 Part. D", "A. B.\x01C. D.", "A. B.\x0b C. D. E", "A b\r7 Other one. B. C\r\n1.1 Part. D", "```. 2 Two. C. D. E", "- - -. B. ===. D", "A. B. C. | 1 | D", ". . . . "]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, registry.queries()["section_outline"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.sql(registry.oracle_sql()["section_outline"]).fetchall())


def test_chunks_keep_columns_of_their_source(spark):
    from loreweave.operators import chunk

    c = spark.createDataFrame([("file", 1, "# A\nx\n\n# B\ny", "one"), ("file", 2, "z", None)], "source_type string, source_id long, content string, title string")
    got = chunk.chunk(c, keep=["title"])
    assert "Join" not in got._jdf.queryExecution().toString()
    assert sorted(map(str, ((r.source_id, r.seq, r.title) for r in got.collect()))) == ["(1, 0, 'one')", "(1, 1, 'one')", "(2, 0, None)"]


SAMPLE = "concept_id int, names array<string>, place int, source_type string, source_id long, title string, seq int, heading string, chunk_text string"


def test_sample(spark):
    long = "words that carry some meaning for the reader of this page and go on for a while until the line is long enough"
    rows = [(1, ["agent"], 0, "file", 7, "Title", i, f"H{i // 3}", long + (" Agent agents" if i in (4, 9) else "")) for i in range(12)]
    rows += [(1, ["agent"], 1, "note", 8, "About Agent", i, "", long) for i in range(20)]
    rows += [(1, ["agent"], 2, "note", 9, "T", 0, "References", "agent " + long), (1, ["agent"], 2, "note", 9, "T", 1, "", "Authors: agent")]
    got = material.sample(spark.createDataFrame(rows, SAMPLE)).orderBy("rank").collect()
    of = lambda s: [r.seq for r in got if r.source_id == s]
    assert of(7) == [3, 4, 5, 9, 10]  # matches with neighbours of their section
    assert of(8) == [0, 4, 8, 11, 15, 19] and of(9) == []
    assert [r.source_id for r in got][:4] == [7, 8, 7, 8]
    assert {r.seq: r.score for r in got if r.source_id == 7} == {3: 0, 4: 8, 5: 0, 9: 8, 10: 0}
    first = got[0].prompt
    assert first.startswith("【资料#7】《Title》\n[原文块#3 · H1]\n") and first.endswith("\n\n")
    two = len(got[0].prompt) + len(got[1].prompt)
    assert material.sample(spark.createDataFrame(rows, SAMPLE), two).count() == 2


def test_edits():
    edit = edits.edited
    assert edit("a b a", [{"action": "replace", "text": "a", "value": "x", "occurrence": 2}]) == "a b x"
    assert edit("a b a", [{"action": "delete", "text": "a", "all": True}]) == " b "
    assert edit("a b a", [{"action": "insert_after", "text": "a", "value": "!", "prefix": "b "}]) == "a b a!"
    assert edit("one two", [{"action": "format", "text": "two", "style": "bold"}, {"action": "insert_before", "text": "one", "value": ">"}]) == ">one <strong>two</strong>"
    assert edit("a`b", [{"action": "format", "text": "a`b", "style": "code"}]) == "``a`b``"
    for text, op in [
        ("a a", {"action": "delete", "text": "a"}), ("a", {"action": "delete", "text": "z"}), ("a", {"action": "delete", "text": ""}), ("a", {"action": "jump", "text": "a"}),
        ("a", {"action": "replace", "text": "a"}), ("a", {"action": "delete", "text": "a", "occurrence": 2}), ("a", {"action": "delete", "text": "a", "occurrence": 1, "all": True}),
        ("`ab`", {"action": "format", "text": "ab", "style": "bold"}), ("ab", {"action": "format", "text": "ab", "style": "font_size", "value": "99"}),
    ]:
        with pytest.raises(edits.EditError):
            edit(text, [op])


def test_apply_edits(spark):
    notes = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, None)], "id int, content string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ops = f"id int, expected_hash string, operations array<{edits.OP}>"
    one = lambda t: [("replace", t, "X", None, None, None, None, None)]
    todo = spark.createDataFrame([(1, sha("abc"), one("b")), (2, sha("old"), one("b")), (3, sha(""), one("b"))], ops)
    got = {r.id: (r.content, r.status) for r in edits.apply_edits(notes, todo, "id", "content").collect()}
    assert got == {1: ("aXc", "edited"), 2: ("abc", "stale"), 3: ("", "rejected")}


def _commands(spark):
    rows = spark.range(7).select(F.col("id"), (F.col("id") * 10).alias("v"))
    return {
        "rows.page": commands.Command(lambda calls: rows, page_size=3),
        "row.get": commands.Command(lambda calls: calls.join(rows, "id")),
        "row.count": commands.Command(lambda calls: calls.select("call", F.size("ids").alias("n"))),
        "row.put": commands.Command(lambda calls: calls, writes=True),
    }


def test_command_pipeline(spark):
    steps = [
        {"id": "p", "command": "rows.page", "paginate": True, "input": {"page": 2, "size": 3}},
        {"id": "g", "command": "row.get", "forEach": {"$ref": "p#"}, "input": {"id": {"$item": "/id"}}},
        {"id": "c", "command": "row.count", "input": {"ids": {"$ref": "g#", "$pluck": "/v"}}},
        {"id": "w", "command": "row.put", "input": {"n": {"$ref": "c#/n"}, "tag": "x", "many": [1, 2]}},
    ]
    out, trace = commands.execute(spark, {"steps": steps}, _commands(spark))
    assert [(r.n, r.tag, r.many) for r in out.collect()] == [(4, "x", [1, 2])]
    assert [(r.id, r.calls) for r in trace.collect()] == [("p", 2), ("g", 4), ("c", 1), ("w", 0)]


@pytest.mark.parametrize("steps", [
    [], [{"id": "1", "command": "row.get"}], [{"id": "a", "command": "nope"}], [{"id": "a", "command": "row.get", "paginate": True}],
    [{"id": "a", "command": "row.put"}, {"id": "b", "command": "row.get"}], [{"id": "a", "command": "row.get", "input": {"id": {"$item": "/id"}}}],
    [{"id": "a", "command": "row.get", "input": {"id": {"$ref": "b#/id"}}}], [{"id": "a", "command": "row.get", "extra": 1}],
])
def test_pipeline_plan_errors(spark, steps):
    with pytest.raises(commands.PipelineError):
        commands.plan({"steps": steps}, _commands(spark))


def test_pipeline_missing_field(spark):
    steps = [{"id": "p", "command": "rows.page", "paginate": True}, {"id": "g", "command": "row.get", "forEach": {"$ref": "p#"}, "input": {"id": {"$item": "/none"}}}]
    with pytest.raises(commands.PipelineError, match="missing_reference"):
        commands.execute(spark, {"steps": steps}, _commands(spark))


def test_clustered_store_is_exact(spark, sf_dir):
    """Planted neighbours, weak ones, odd vectors and the tables' own: the ten nearest are those of the exact store."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    vecs = np.concatenate([base, (base[:, None] + 0.3 * rng.standard_normal((30, 6, 16))).reshape(-1, 16), rng.standard_normal((200, 16))])
    rows = [("s", "file", i, 0, v.tolist()) for i, v in enumerate(vecs)] + [("s", "file", 900, 0, [0.0] * 16), ("s", "file", 901, 0, None), ("s", "file", 902, 0, [1.0] * 4), ("s", "file", 903, 0, [2.0] * 4)]
    items = spark.createDataFrame(rows, "space string, source_type string, source_id long, seq int, vec array<float>")
    asked = items.filter("source_id < 30 or source_id >= 900").select(F.col("source_id").alias("question_id"), "vec")
    found = lambda store: sorted((r.question_id, r.source_id, r["rank"]) for r in store.search("s", asked, 10).collect())
    assert found(vectors.ClusteredStore(items, clusters=12, probes=2)) == found(vectors.ExactStore(items))
    assert vectors.ClusteredStore(items).search("s", asked.limit(0), 6).count() == 0
    e = table(spark, sf_dir, "embeddings").select(F.lit("s").alias("space"), F.lit("file").alias("source_type"), F.col("vec_id").alias("source_id"), F.lit(0).alias("seq"), F.col("embedding").alias("vec"))
    asked = e.filter("source_id % 50 = 0").select(F.col("source_id").alias("question_id"), "vec")
    assert found(vectors.ClusteredStore(e)) == found(vectors.ExactStore(e))


def test_store_changes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").limit(20)
    store = vectors.ExactStore(e.select(F.lit("s").alias("space"), F.lit("file").alias("source_type"), (F.col("vec_id") % 2).alias("source_id"), F.col("vec_id").cast("int").alias("seq"), F.col("embedding").alias("vec")))
    half = store.delete_source("s", "file", 0)
    assert half.items.count() < 20 and half.has_vectors("s") and not store.clear("s").has_vectors("s")
    assert store.replace_source("s", "file", 0, e.limit(1).select(F.lit(0).alias("seq"), F.col("embedding").alias("vec"))).items.count() == half.items.count() + 1
